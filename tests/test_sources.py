"""Bronze readers, sinks and streams, on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from evalmill.operators.compaction import first_wins, last_wins
from evalmill.sources import bronze, sinks
from evalmill.streaming.ingest import answers_per_window, compacted, deduplicated


def line(q, content, error=None, **more):
    return json.dumps({"run_id": "r", "question_id": q, "content": content, "error": error, "called_at": "2026-09-10T12:00:00Z", "attempt": 1} | more)


def test_log_positions_and_last_wins(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join([line("1", "A"), "", line("2", "x", "boom"), line("2", "B")]) + "\n")
    log = bronze.response_log(spark, f"{tmp_path}/*.jsonl")
    assert [r.position for r in log.orderBy("position").collect()] == [0, 2, 3]
    best = {r.question_id: (r.content, r.error) for r in last_wins(log, ["run_id", "question_id"], "position").collect()}
    assert best == {"1": ("A", None), "2": ("B", None)}
    assert first_wins(log, ["run_id", "question_id"], "position").where("question_id = '2'").first().content == "x"
    assert {r.question_id for r in bronze.finished_ids(spark, f"{tmp_path}/*.jsonl").collect()} == {"1", "2"}
    assert [r.run_id for r in bronze.discovered_runs(spark, str(tmp_path)).collect()] == ["r"]


def test_malformed_line(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text(line("1", "A") + "\n{broken\n")
    with pytest.raises(Exception):
        bronze.response_log(spark, f"{tmp_path}/*.jsonl").collect()
    assert bronze.finished_ids(spark, f"{tmp_path}/*.jsonl").count() == 1


def test_csv_and_manifests(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bronze.questions_csv(spark, f"{tmp_path}/none.csv")
    assert bronze.collected_ids(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "q.csv").write_text('scraped_at,category_id,category,type,difficulty,question,correct_answer,incorrect_answers,batch_index,result_index\n2026,9,C,multiple,easy,"a ""q"",\nx",R,"[""1"", ""2""]",1,0\n')
    q = bronze.questions_csv(spark, f"{tmp_path}/q.csv").first()
    assert q.question == 'a "q",\nx' and json.loads(q.incorrect_answers) == ["1", "2"]
    assert bronze.collected_ids(spark, f"{tmp_path}/q.csv").count() == 1
    (tmp_path / "a.manifest.json").write_text(json.dumps({"run_id": "r", "n_errors": 1, "machine": {"cpu": "x"}, "surprise": 1, "started_at": "2026-01-01T00:00:00Z"}, indent=1))
    m = bronze.manifests(spark, f"{tmp_path}/*.manifest.json").first()
    assert m.n_errors == 1 and json.loads(m.machine) == {"cpu": "x"} and m.variant_label is None and m.started_at is not None


def test_partitions_and_publish(spark, tmp_path):
    out = f"{tmp_path}/answers"
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int"), out)
    sinks.replace_partitions(spark.createDataFrame([("b", 3)], "run_id string, x int"), out)
    assert sorted((r.run_id, r.x) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]
    root = f"file://{tmp_path}/gold"
    first = spark.range(3)
    v = sinks.publish({"t": first}, root)
    with pytest.raises(ValueError):
        sinks.publish({"t": first}, root, checks=[first])
    with pytest.raises(ValueError):
        sinks.publish({"t": first.where("id < 0")}, root)
    assert sinks.published(spark, root, "t").count() == 3
    assert sinks.publish({"t": spark.range(5)}, root) != v and sinks.published(spark, root, "t").count() == 5


def test_streams(spark, small, tmp_path):
    fact = spark.read.parquet(f"{small}/fct_answer.parquet").select("answer_id", "run_id", "question_id", "ai_correct", "response_time", "called_at")
    for k in range(2):
        fact.where(F.col("answer_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    deduplicated(source(), ["run_id", "question_id"], "answer_id", f"file://{tmp_path}/seen", f"{tmp_path}/once", f"{tmp_path}/c1").awaitTermination()
    once = spark.read.parquet(f"{tmp_path}/once")
    assert once.count() == fact.select("run_id", "question_id").distinct().count() == once.select("run_id", "question_id").distinct().count()
    compacted(spark, source(), "answer_id", f"{tmp_path}/last", f"{tmp_path}/c2").awaitTermination()
    last = {(r.run_id, r.question_id): r.answer_id for r in spark.read.parquet(f"{tmp_path}/last").collect()}
    want = {(r[0], r[1]): r[2] for r in fact.groupBy("run_id", "question_id").agg(F.max("answer_id")).collect()}
    assert last == want
    q = answers_per_window(source(), late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == fact.where("called_at is not null").count()
