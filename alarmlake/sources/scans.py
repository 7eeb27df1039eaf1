"""Readers for raw monthly CSV files, companion dimensions, Parquet tables and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.functions.jsontext import has_duplicate_keys, has_nonfinite, one_value
from alarmlake.functions.text import file_month, file_year, strip, table_prefix
from alarmlake.operators.filters import half_open
from alarmlake.operators.validate import iso_or_null, raise_unless, require_columns, same_signals, strict_integer, strict_timestamp
from alarmlake.schemas import ALARM_COLUMNS, CONDITION_DDL, EXAMPLE_DDL

# windows-1252 is latin-1 with printable characters in place of the C1 controls.
_CP1252 = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
LATIN_CONTROLS = "".join(chr(b) for b, glyph in _CP1252.items() if glyph)
CP1252_GLYPHS = "".join(_CP1252.values())


def with_row_numbers(rows: DataFrame, path: str = "_path", start: str = "_start") -> DataFrame:
    """Add ``row_no``: 1-based row of each file.

    Rows keep their order inside an input split, so the number is the rows of earlier splits of
    the file plus the position in the split; no file passes through one task.
    """
    placed = rows.withColumn("_id", F.monotonically_increasing_id())
    earlier = W.partitionBy(path).orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(path, start)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(path, start, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(path, start).orderBy("_id")
    return (
        placed.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [path, start])
        .withColumn("row_no", F.col("_offset") + F.col("_pos"))
        .drop("_id", "_pos", "_offset")
    )


def months_of(year: int, months: Sequence[int]) -> list[tuple[int, int]]:
    return [(year, m) for m in months]


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line; one short read per file on the driver, as for a listing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for path in paths:
        source = jvm.org.apache.hadoop.fs.Path(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source.getFileSystem(conf).open(source), "UTF-8"))
        found.setdefault(reader.readLine() or "", []).append(path)
        reader.close()
    return found


def monthly_csv(spark: SparkSession, folder: str, prefix: str, periods: Sequence[tuple[int, int]], columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Raw text columns of ``{prefix}_{year}_{month}.csv`` for the selected (year, month) pairs.

    Exactly one file per month must exist (the folder may be nested). Columns stay text, so
    nothing is inferred; the reader skips a byte-order mark. With ``exact`` off all columns of
    the files are kept, and they must be the same in every month. Files with equal headers are one
    read, so the plan does not widen with the months; column order may change between them.
    """
    chosen = list(periods)
    if not chosen or len(set(chosen)) != len(chosen) or any(not 1 <= m <= 12 for _, m in chosen):
        raise ValueError("months must be distinct numbers from 1 through 12")
    names = {f"{prefix}_{y}_{m:02d}.csv" for y, m in chosen}
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}_*.csv").load(folder).select("path")
    hits: dict[str, list[str]] = {name: [] for name in names}
    for row in listing.where(F.element_at(F.split("path", "/"), -1).isin(*names)).collect():  # one short path per month
        hits[row.path.rsplit("/", 1)[-1]].append(row.path)
    for name in sorted(names):
        if len(hits[name]) != 1:
            raise ValueError(f"expected exactly one {name}, found {len(hits[name])}")
    meta = F.col("_metadata")
    parts, fields = [], {}
    for paths in _first_lines(spark, sorted(p for found in hits.values() for p in found)).values():
        rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(paths)
        member = paths[0].rsplit("/", 1)[-1]
        require_columns(rows, columns, member)
        fields[member] = rows.columns
        parts.append(
            rows.select(
                *(columns if exact else rows.columns),
                meta.file_path.alias("_path"),
                meta.file_block_start.alias("_start"),
                table_prefix(meta.file_name).alias("table"),
                file_year(meta.file_name).alias("year"),
                file_month(meta.file_name).alias("month"),
            )
        )
    if not exact:
        same_signals(fields)
    return reduce(DataFrame.unionByName, parts)


def companion_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Small dimension file as text columns; UTF-8, or windows-1252 when the bytes are not UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    bad = raw.where(F.try_validate_utf8(F.col("content").cast("string")).isNull()).limit(1).count()
    encoding = "iso-8859-1" if bad else "UTF-8"
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    text = lambda c: F.translate(c, LATIN_CONTROLS, CP1252_GLYPHS) if bad else F.col(c)
    return require_columns(df, columns, path).select(*[text(c).alias(c) for c in columns])


def code_lookup(raw: DataFrame, code: str = "Alarm Code", description: str = "Description", stopping: str = "Stopping") -> DataFrame:
    """Checked code lookup: integral unique codes, trimmed nonempty text, stopping 0 or 1."""
    out = raw.select(
        strict_integer(F.col(f"`{code}`"), code).alias("alarm_code"),
        strip(F.col(f"`{description}`")).alias("description"),
        strict_integer(F.col(f"`{stopping}`"), stopping).cast("int").alias("stopping"),
    )
    copies = out.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("_copies"))
    ok = (F.col("_copies") == 1) & (F.coalesce(F.col("description"), F.lit("")) != "") & F.col("stopping").isin(0, 1)
    return out.join(copies, "alarm_code").where(raise_unless(ok, "invalid code lookup row")).drop("_copies")


def alarm_log(raw: DataFrame, time: str = "TimeOn", station: str = "StationNr", code: str = "Alarmcode") -> DataFrame:
    """Raw alarm rows as typed columns; the end time is not projected."""
    return raw.select(
        strict_timestamp(F.col(time), time).alias("ts"),
        strict_integer(F.col(station), station).cast("string").alias("turbine_id"),
        strict_integer(F.col(code), code).alias("alarm_code"),
    )


def parquet_slice(spark: SparkSession, path: str, columns: Sequence[str] = ALARM_COLUMNS, start: str | None = None, end: str | None = None) -> DataFrame:
    """Selected columns of rows with start <= ts < end; both reach the Parquet scan, and its partitions if it has dates."""
    return half_open(spark.read.parquet(path), start, end).select(*columns)


def source_bounds(rows: DataFrame, strict: bool = True) -> DataFrame:
    """One row: first and last ts and row count; null timestamps raise.

    A table partitioned by date reads ``ts`` in its first and last partition only; the counts come from footers.
    """
    if "date" in rows.columns:
        edge = lambda pick: rows.where(F.col("date") == rows.agg(pick("date")).scalar()).agg(pick("ts")).scalar()
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("date").isNull()).alias("null_ts"))
        out = counts.select(edge(F.min).alias("first_ts"), edge(F.max).alias("last_ts"), "n", "null_ts")
    else:
        out = rows.agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("null_ts")
        )
    if strict:
        out = out.where(raise_unless(F.col("null_ts") == 0, "source contains missing timestamps"))
    return out


def combined_bounds(alarms: DataFrame, scada: DataFrame | None = None) -> DataFrame:
    """Bounds over all selected sources; an empty alarm source raises."""
    first = source_bounds(alarms).where(raise_unless(F.col("n") > 0, "alarm source is empty"))
    parts = first.withColumn("source", F.lit("alarms"))
    if scada is not None:
        parts = parts.unionByName(source_bounds(scada).withColumn("source", F.lit("scada")))
    count = lambda name: F.coalesce(F.sum(F.when(F.col("source") == name, F.col("n"))), F.lit(0))
    return parts.agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), count("alarms").alias("alarm_rows"), count("scada").alias("scada_rows")
    )


def json_lines(spark: SparkSession, path: str, one_log: bool = False) -> DataFrame:
    """Text lines with their file and 1-based line number; ``one_log`` numbers on through the files in name order."""
    meta = F.col("_metadata")
    file, start = meta.file_path, meta.file_block_start
    raw = spark.read.text(path).select("value", (F.lit(path) if one_log else file).alias("_path"), F.struct(file, start).alias("_start"))
    return with_row_numbers(raw).select("value", F.col("_path").alias("path"), F.col("row_no").alias("file_line"))


JOURNAL_LINE = (
    "line BIGINT, schema_version INT, op STRING, rule_id STRING, model_version BIGINT, learning_rate DOUBLE, "
    "nuisance_threshold DOUBLE, collapse_window_s BIGINT, feature_encoding_version INT, "
    f"examples ARRAY<{EXAMPLE_DDL}>, "
    "rule STRUCT<rule_id:STRING,utterance:STRING,scope:STRUCT<turbine_id:STRING,alarm_code:BIGINT,signal:STRING>,"
    f"pattern:STRUCT<kind:STRING,window_s:BIGINT,conditions:ARRAY<{CONDITION_DDL}>>,"
    "action:STRING,confidence:DOUBLE,taught_by:STRING,taught_at:STRING,reversible:BOOLEAN>"
)


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines; a malformed line, another schema version or an unknown op fails the read."""
    rows = spark.read.schema(JOURNAL_LINE).option("mode", "FAILFAST").json(path)
    ok = (F.col("schema_version") == 1) & F.col("op").isin("learn", "commit", "undo")
    return rows.where(raise_unless(ok, "unsupported policy journal line"))


RECEIPT_DDL = "receipt_id STRING, checked_at STRING, operation STRING"


def receipts(lines: DataFrame) -> DataFrame:
    """Every nonblank receipt line with its fields or the reason it is unusable.

    ``lines`` has value and file_line. Nothing is dropped; callers split on ``reason``.
    """
    text = F.col("value")
    kept = lines.where(strip("value") != "")
    keys = F.json_object_keys(text)
    # Kind checks on the raw member: get_json_object drops quotes, so compare with typed parsing.
    parsed = F.from_json(text, RECEIPT_DDL)
    rows = kept.withColumn("r", parsed).withColumn("keys", keys)
    filled = lambda name: F.coalesce(strip(F.col(f"r.{name}")) != "", F.lit(False)) & _is_text(name)

    def _is_text(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")) == "STRING", F.lit(False))

    stamp = F.col("r.checked_at")
    aware = stamp.rlike(r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$")
    reason = (
        F.when(has_nonfinite(text), "nonfinite_number")
        .when(has_duplicate_keys(text), "duplicate_key")
        .when(F.col("keys").isNull() | one_value(text).isNull(), "not_an_object")
        .when(~(filled("receipt_id") & filled("checked_at") & filled("operation")), "missing_identity")
        .when(iso_or_null(stamp).isNull(), "bad_timestamp")
        .when(~aware, "naive_timestamp")
    )
    return rows.select("file_line", "value", reason.alias("reason"), "r.receipt_id", "r.checked_at", "r.operation")


def recent_receipts(rows: DataFrame, n: int = 30) -> DataFrame:
    return rows.where("reason IS NULL").orderBy(F.desc("file_line")).limit(n)


def receipt_issues(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.where("reason IS NOT NULL").orderBy("file_line").limit(n).select("file_line", "reason")


def receipt_integrity(rows: DataFrame) -> DataFrame:
    """One row: valid, invalid and recent counts, status, completeness, truncated issues."""
    return rows.agg(
        F.count_if(F.col("reason").isNull()).alias("valid_receipts"), F.count_if(F.col("reason").isNotNull()).alias("invalid_lines")
    ).select(
        "valid_receipts",
        "invalid_lines",
        F.least("valid_receipts", F.lit(30)).alias("recent_receipts"),
        F.when(F.col("invalid_lines") > 0, "degraded").otherwise("complete").alias("status"),
        (F.col("invalid_lines") == 0).alias("history_complete"),
        (F.col("invalid_lines") > 20).alias("issues_truncated"),
    )
