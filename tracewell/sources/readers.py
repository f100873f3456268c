"""Readers. Each line parser takes a DataFrame of lines, so files and streams share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import schemas
from tracewell.functions import constants as K
from tracewell.functions.scalars import parse_iso
from tracewell.session import broadcast_if_small, materialize


def parse_json_lines(lines: DataFrame, column: str, schema: T.StructType, name: str = "event"
                     ) -> DataFrame:
    """Skip blank lines; add the parsed struct and ``_bad`` for lines that do not parse."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    event = F.from_json(F.col(column), with_bad,
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # A filter on the parsed struct is not pushed below a generator, so each line is parsed once.
    parsed = lines.where(F.trim(column) != "").withColumn(name, F.explode(F.array(event)))
    return parsed.withColumn("_bad", F.col(f"{name}._corrupt").isNotNull())


def read_audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lines(spark.read.text(path), "value", schemas.AUDIT_EVENT)


def line_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("_bad")).alias("events"),
                      F.count_if("_bad").alias("bad_lines"))


def log_rows(df: DataFrame, start: Column, end: Column,
             categories: tuple[str, ...] = K.LOG_CATEGORIES) -> DataFrame:
    """Rows of a log table by category and time range; both filters reach the scan."""
    return df.where(F.col("category").isin(*categories)
                    & F.col("time_generated").between(start, end))


def log_lookback(df: DataFrame, minutes: int, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.where(F.col("time_generated") > now - F.make_dt_interval(mins=F.lit(minutes)))


def log_padded_range(df: DataFrame, start: Column, end: Column, before: int = 2, after: int = 6
                     ) -> DataFrame:
    """A time range widened to absorb ingestion lag."""
    return df.where(F.col("time_generated").between(
        start - F.make_dt_interval(mins=F.lit(before)), end + F.make_dt_interval(mins=F.lit(after))))


def log_payload_filter(df: DataFrame, equals: list[str] = (), contains: list[str] = (),
                       column: str = "log_s") -> DataFrame:
    """Keep rows whose JSON payload names one of the users."""
    user = F.get_json_object(column, "$.user.username")
    cond = F.lit(False)
    for name in equals:
        cond = cond | (user == name)
    for part in contains:
        cond = cond | user.contains(part)
    return df.where(cond)


def parse_sessions(lines: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    """Closed spans from ``SESSION i START|END ts`` lines.

    The latest START of an id wins and an END without START is ignored. A further END after a
    closed span repeats that span. The window runs per session id over marker lines only.
    """
    part = F.split(F.trim(column), r"\s+")
    marks = (lines.where((F.size(part) >= 4) & (F.get(part, 0) == "SESSION"))
             .select(F.col(pos), F.get(part, 1).try_cast("int").alias("session"),
                     F.get(part, 2).alias("kind"), F.get(part, 3).alias("stamp"))
             .where(F.col("session").isNotNull()))
    so_far = Window.partitionBy("session").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    starts = F.count_if(F.col("kind") == "START").over(so_far)
    marks = marks.withColumns({
        "start": F.last(F.when(F.col("kind") == "START", F.col("stamp")), True).over(so_far),
        "_run": starts,
    })
    run = Window.partitionBy("session", "_run").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0)
    marks = marks.withColumn(
        "end", F.first(F.when(F.col("kind") == "END", F.col("stamp")), True).over(run))
    return (marks.where((F.col("kind") == "END") & F.col("start").isNotNull())
            .select("session", parse_iso(F.col("start")).alias("start"),
                    parse_iso(F.col("end")).alias("end"), F.col(pos).alias("pos")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``pos``, which rises by file path, then by place in the file.

    Spark may read a larger file first, so its row numbers alone don't follow the files. Files and
    their blocks are ranked (one row each), and the row number within a task counts inside a block.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.select("_file", "_start").distinct().withColumn(
        "_rank", F.row_number().over(Window.orderBy("_file", "_start")))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.join(broadcast_if_small(blocks), ["_file", "_start"]).select(
        "value", (F.shiftleft(F.col("_rank").cast("bigint"), 33) + within).alias("pos"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return parse_sessions(numbered_lines(spark, path))


def parse_markers(lines: DataFrame, column: str = "value") -> DataFrame:
    """``KEY=timestamp`` lines."""
    pattern = r"^\s*([^=\s]+)\s*=\s*(\S+)\s*$"
    return (lines.where(F.col(column).rlike(pattern))
            .select(F.regexp_extract(column, pattern, 1).alias("key"),
                    parse_iso(F.regexp_extract(column, pattern, 2)).alias("ts")))


def parse_attack_windows(lines: DataFrame, column: str = "value") -> DataFrame:
    parsed = parse_json_lines(lines, column, schemas.ATTACK_WINDOW, "w").where(~F.col("_bad"))
    keep = [c for c in lines.columns if c != column]
    return parsed.select(
        *keep, F.coalesce("w.attack_type", F.lit("attack")).alias("attack_type"),
        parse_iso(F.col("w.start")).alias("start"), parse_iso(F.col("w.end")).alias("end"))


def read_attack_windows(spark: SparkSession, path: str) -> DataFrame:
    return parse_attack_windows(numbered_lines(spark, path))


def read_csv_clean(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; header lines repeated inside the files are dropped.

    Spark splits large files itself, so there is no chunk size to choose.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    first = df.columns[0]
    return df.where(F.coalesce(F.col(f"`{first}`") != first, F.lit(True)))


def header_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path`` and ``header``, the first line, of every file.

    The line is looked up by its number, the least of its file: numbers are combined in memory, where lines beside
    them would be sorted.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_block_start").alias("at")).where(F.col("at") == 0)
    least = materialize(lines.groupBy("path").agg(F.min("n").alias("n")))
    return lines.select("n", F.col("value").alias("header")).join(broadcast_if_small(least), "n").select("path", "header")


def read_csv_union(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stack CSV files whose columns differ; absent columns are null. Adds ``source_file``.

    Files with equal headers are one scan.
    """
    same: dict[str, list[str]] = {}
    for r in header_lines(spark, paths).orderBy("path").toLocalIterator():
        same.setdefault(r["header"], []).append(r["path"])
    out = None
    for files in same.values():
        one = spark.read.option("header", True).csv(files)
        one = one.withColumn("source_file", F.col("_metadata.file_name"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<model>/predictions`` folders or files; the model name comes from the path."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("recursiveFileLookup", True).csv(root))
    path = F.col("_metadata.file_path")
    return df.withColumn("model", F.regexp_extract(path, r"/([^/]+)/predictions[^/]*(?:/|$)", 1))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOKEN_ROW).json(path)


def parse_syscall_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep JSON object lines that parse and carry a rule."""
    objects = lines.where(F.col(column).startswith("{"))
    parsed = parse_json_lines(objects, column, schemas.SYSCALL_ALERT, "a")
    keep = [c for c in lines.columns if c != column]
    return parsed.where(~F.col("_bad") & F.col("a.rule").isNotNull()).select(
        *keep, "a.time", "a.rule", "a.priority", "a.output", "a.output_fields")


def stream_json(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None
                ) -> DataFrame:
    """Follow a landing folder of JSON files."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.json(path)


