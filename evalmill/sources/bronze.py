"""Readers of the bronze files: raw questions, response logs, run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import question_id
from ..session import hadoop_path
from .schemas import AUDIT, MANIFEST, QUESTIONS_CSV, RESPONSES


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.globStatus(p) is not None and len(fs.globStatus(p)) > 0


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw questions with the header's ten columns; a path without files raises FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(QUESTIONS_CSV).csv(path, header=True, multiLine=True, escape='"')


def collected_ids(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of the questions a raw file holds already; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "question_id string")
    q = questions_csv(spark, path)
    return q.select(question_id(*(F.col(c) for c in ("category", "type", "difficulty", "question", "correct_answer"))).alias("question_id")).distinct()


def response_log(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Logged calls with ``file`` and ``position``, a number that grows along each file.

    Files are read in splits: the position is made of the begin of a line's split and its place in it,
    so that it orders the lines as their numbers would, at any size of a file.
    Blank lines are skipped. A malformed line fails the read, or is skipped if ``tolerant``.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select(meta["file_name"].alias("file"), meta["file_block_start"].alias("_begin"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    # Rows of a split are numbered one after another; a partition may hold several.
    position = (F.col("_begin") + F.pmod("_row", F.lit(1 << 33))).cast("bigint")
    lines = read.select("file", position.alias("position"), "line").where(F.col("line").rlike(r"\S"))
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    parsed = lines.select("file", "position", "line", F.from_json("line", RESPONSES + (", _bad string" if tolerant else ""), {"mode": mode, **({"columnNameOfCorruptRecord": "_bad"} if tolerant else {})}).alias("r"))
    rows = parsed.where("r._bad is null and r is not null") if tolerant else parsed
    names = [c.split()[0] for c in RESPONSES.replace("\n", " ").split(",")]
    return rows.select("file", "position", *(F.col(f"r.{c}").alias(c) for c in names))


def finished_ids(spark: SparkSession, path: str) -> DataFrame:
    """Runs and questions that were answered without an error; malformed lines don't matter."""
    return response_log(spark, path, tolerant=True).where("error is null").select("run_id", "question_id").distinct()


def discovered_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that have a log, by file name."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.jsonl").select("path")  # names only: no content is read
    return files.select(F.regexp_extract("path", r"([^/]*)\.jsonl$", 1).alias("run_id")).distinct().orderBy("run_id")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each manifest; unknown fields are ignored, missing ones null, nested ones JSON text."""
    text = spark.read.text(path, wholetext=True).select("value")
    fields = [c.strip().split() for c in MANIFEST.replace("\n", " ").split(",")]
    values = [F.get_json_object("value", f"$.{name}").cast(kind).alias(name) for name, kind in fields]
    return text.select(*values).where("run_id is not null")


def answers(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Answers partitioned by run; older partitions may lack columns, which are null then."""
    return spark.read.schema(schema).parquet(folder)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def decoded(df: DataFrame, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Base64 of UTF-8 texts, and of arrays of them, as texts; nulls stay."""
    text = lambda c: F.decode(F.unbase64(c), "UTF-8")
    return df.withColumns({c: text(F.col(c)) for c in columns} | {c: F.transform(c, text) for c in arrays})


def selected_engines(listing: DataFrame, text: str = "value") -> DataFrame:
    """(engine, format) of the lines of a listed table that bear a check mark: their first word and their last in capitals."""
    fields = listing.select(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ").alias("f"))
    marked = fields.where((F.size("f") >= 2) & F.array_contains("f", "✓"))
    return marked.select(F.get("f", 0).alias("engine"), F.upper(F.element_at("f", -1)).alias("format"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Requests as they were logged by ``append_json``; malformed lines are left out."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)
