"""Checks that are violated, the build, and the fact that marts share."""

import pytest
from pyspark.sql import functions as F

from evalmill import session
from evalmill.operators.ordering import ecdf
from evalmill.plans import build, explore, gold, quality
from evalmill.sources import bronze, sinks




def test_violations_are_counted(spark, small):
    t = quality.gold_tables(spark, small)
    clean = {r.check_name: r.n_violations for r in quality.checked(t).collect()}
    one = t["answers"].limit(1)
    bad = one.withColumns({"grade": F.lit("guessed"), "reasoning_mode": F.lit("off"), "reasoning_tokens": F.lit(5), "response_time": F.lit(-1.0), "error": F.lit(None).cast("string"), "question_id": F.lit("nowhere"), "run_id": F.lit("none")})
    empty = one.withColumns({c: F.lit(None).cast(one.schema[c].dataType) for c in ("grade", "ai_correct", "run_id", "question_id", "response_time")}).withColumn("error", F.lit("x"))
    t["answers"] = t["answers"].unionByName(bad).unionByName(empty)
    t["runs"] = t["runs"].unionByName(t["runs"].limit(1).withColumns({"transport": F.lit(None).cast("string"), "status": F.lit("lost")}))
    t["questions"] = t["questions"].unionByName(t["questions"].limit(1).withColumns({"correct_letter": F.lit("E"), "difficulty": F.lit("odd")}))
    got = {r.check_name: r.n_violations for r in quality.checked(t).collect()}
    more = {n: got[n] - clean[n] for n in got}
    for n in ("answers.grade not accepted", "answers.reasoning_when_off", "answers.response_time_positive", "answers.question_id unknown", "answers.run_id unknown", "answers.grade is null", "answers.ai_correct is null", "runs.transport is null",
              "runs.status not accepted", "runs.run_id repeated", "questions.correct_letter not accepted", "questions.difficulty not accepted", "questions.question_id repeated", "questions.invalid"):
        assert more[n] == 1, n
    assert len(got) >= 29


def test_singular_checks(spark):
    r = spark.createDataFrame([("r1", 0.9, 0.2, 0.5), ("r2", 0.3, 0.2, 0.5), ("r3", None, 0.1, 0.2)], "run_id string, accuracy double, wilson_lo double, wilson_hi double")
    assert [x.run_id for x in quality.outside_interval(r).collect()] == ["r1"]
    a = spark.createDataFrame([("a", "exact", True), ("b", "exact", False), ("c", "odd", False), ("d", None, None), ("e", "wrong", False)], "run_id string, grade string, ai_correct boolean")
    assert {x.run_id: (x.unknown_grades, x.right_beyond_recognised) for x in quality.unbalanced_grades(a).collect()} == {"b": (0, -1), "c": (1, 0), "d": (1, 0)}
    runs = lambda *engines: spark.createDataFrame([(e, f) for e, f in engines], "runtime_engine string, model_format string")
    assert quality.mixed_runtimes(runs(("e@1", "gguf"), ("e@1", None))).count() == 0
    assert quality.mixed_runtimes(runs(("e@1", "gguf"), ("e@2", "gguf"))).count() == 2
    assert quality.mixed_runtimes(runs((None, "gguf"), ("e@1", "gguf"))).count() == 1 and quality.mixed_runtimes(runs(("e", "gguf"))).count() == 1 and quality.mixed_runtimes(runs(("e@1", "mlx"))).count() == 1
    q = spark.createDataFrame([("a", "x")], "k string, v string")
    assert quality.relationships(q, "k", q.where("false"), "k").count() == 1 and quality.accepted_values(q, "v", ["y"]).count() == 1 and quality.not_null(q, "v").count() == 0


def test_build_publishes_only_what_holds(spark, small, tmp_path):
    root = f"file://{tmp_path}/gold"
    some = {n: build.GOLD[n] for n in ("dim_run", "mart_run_summary")}
    broken = frozenset(r.check_name for r in build.violations(spark, small).collect())
    if broken:
        with pytest.raises(ValueError):
            build.build(spark, small, root, tables=some)
        assert not (tmp_path / "gold" / "CURRENT").exists()
    v = build.build(spark, small, root, tolerated=broken, tables=some)
    assert v and build.read(spark, root, "mart_run_summary").count() == gold.mart_run_summary(spark, small).count()
    names = build.stage(spark, small)
    assert "staging_stg_runs" in names and spark.table("staging_stg_runs").count() == 48


def test_one_fact_without_sorted_aggregates(spark, small):
    gold.forget_facts()
    first = gold.fact(spark, small, ["run_id"])
    assert len(gold._facts) == 1 and gold.fact(spark, small, ["grade"]) is not None and len(gold._facts) == 1
    assert first.count() == spark.read.parquet(f"{small}/fct_answer.parquet").select("run_id", "question_id").distinct().count()
    for name, query in gold.catalog.queries.items():
        if name.startswith("mart_"):
            plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and plan.count("fct_answer.parquet") == 0, name


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None), (4, None, None), (5, "a", "q")], "answer_id bigint, run_id string, question_id string")
    assert sorted(r.answer_id for r in gold.deduplicated(df).collect()) == [1, 3, 5]


def test_ecdf_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), (None, 3.0)] + [("hot", float(i % 7)) for i in range(100)], "v string, t double")
    got = ecdf(df, "v", "t").collect()
    assert sorted((r.t, round(r.share, 6)) for r in got if r.v == "a") == [(1.0, 0.333333), (1.0, 0.666667), (2.0, 1.0)] and [(r.t, r.share) for r in got if r.v is None] == [(3.0, 1.0)]
    assert sorted(round(r.share * 100) for r in got if r.v == "hot") == list(range(1, 101))


def test_ordered_pairs(spark):
    df = spark.createDataFrame([("v1", "v3", "ra", "rb", 5, 7, 2, 0.4, 0.1, 0.3)], "variant_a string, variant_b string, run_a string, run_b string, n int, a_only int, b_only int, accuracy_a double, accuracy_b double, accuracy_diff double")
    r = explore.with_order(df, "v3").first()
    assert (r.variant_a, r.variant_b, r.run_a, r.run_b, r.a_only, r.b_only, r.accuracy_a, r.accuracy_b, r.accuracy_diff) == ("v3", "v1", "rb", "ra", 2, 7, 0.1, 0.4, -0.3)
    assert explore.with_order(df, "v1").first().a_only == 7


def test_small_helpers(spark, tmp_path):
    listing = spark.createDataFrame([("ENGINE  SELECTED  FORMAT",), ("llama-x@1.2   ✓   gguf",), ("mlx@3  mlx",), ("✓",)], "value string")
    assert [tuple(r) for r in bronze.selected_engines(listing).collect()] == [("llama-x@1.2", "GGUF")]
    sinks.append_json(spark.sql("select timestamp'2026-01-01' as called_at, '/a' as endpoint, 200 as status, 5 as n_results, 0.5D as duration_s"), f"{tmp_path}/audit")
    assert bronze.audit_log(spark, f"{tmp_path}/audit").first().n_results == 5
    d = bronze.decoded(spark.createDataFrame([("Y2Fmw6k=", ["eA==", None]), (None, None)], "a string, b array<string>"), ["a"], ["b"]).collect()
    assert [tuple(r) for r in d] == [("café", ["x", None]), (None, None)]
    assert explore.relabelled(spark.range(1).selectExpr("'x' as g"), "g", {}, "l").first().l == "?"
    q = spark.createDataFrame([("a1", 9), ("a2", 8)], "question_id string, category_id int")
    assert explore.of_categories(q, [8]).count() == 1 and explore.of_categories(q, None).count() == 2 and explore.by_prefix(q, "a").first().question_id == "a1" and explore.not_collected(q, q.limit(1)).count() == 1


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "other", "spark://host:7077"

    class Fake:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()

    with pytest.raises(ValueError):
        session.scratch_root(Fake())
