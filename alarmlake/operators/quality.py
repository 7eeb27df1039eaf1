"""Quality counts and column profiles over raw and canonical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from alarmlake.operators.validate import iso_or_null
from alarmlake.settings import UNDOCUMENTED


def to_long(wide: DataFrame, ids: Sequence[str], signals: Sequence[str]) -> DataFrame:
    """Wide sensor columns to (signal, value) rows; nulls are kept."""
    return wide.unpivot(list(ids), list(signals), "signal", "value")


def alarm_quality(raw: DataFrame, time: str = "TimeOn", end: str = "TimeOff", station: str = "StationNr", code: str = "Alarmcode") -> DataFrame:
    """One row: rows, exact repeats, repeated keys, keys with conflicting ends, missing ends.

    Everything follows from one count per distinct raw row. A null end is a value of its own.
    """
    exact = raw.groupBy(time, station, code, end).agg(F.count(F.lit(1)).alias("n"))
    per_key = exact.groupBy(time, station, code).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeats"), F.count(F.lit(1)).alias("ends"), F.sum(F.when(F.col(end).isNull(), F.col("n")).otherwise(0)).alias("missing")
    )
    return per_key.agg(
        F.sum("n").alias("source_rows"),
        F.sum("repeats").alias("exact_duplicate_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_key_rows"),
        F.count_if(F.col("ends") > 1).alias("conflicting_end_keys"),
        F.sum("missing").alias("missing_ends"),
    )


def sensor_profile(wide: DataFrame, signals: Sequence[str], keys: Sequence[str] = ("ts", "turbine_id"), by: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by`` (else one): rows, null cells, columns over 95 % null, all-null rows, repeated keys, bounds.

    Cells are counted where they are read; only the keys are shuffled, to find repeats.
    """
    all_null = F.lit(True)
    for s in signals:
        all_null = all_null & F.col(s).isNull()
    cells = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("included_rows"),
        F.count_if(all_null).alias("all_null_rows"),
        F.min(keys[0]).alias("first_ts"),
        F.max(keys[0]).alias("last_ts"),
        F.array(*[F.count_if(F.col(s).isNull()) for s in signals]).alias("_nulls"),
    )
    named = F.arrays_zip(F.array(*map(F.lit, signals)).alias("name"), F.col("_nulls").alias("nulls"))
    sparse = F.filter(named, lambda c: c["nulls"] / F.nullif("included_rows", F.lit(0)) > 0.95)
    repeats = wide.groupBy(*by, *keys).agg((F.count(F.lit(1)) - 1).alias("_again")).groupBy(*by).agg(F.sum("_again").alias("duplicate_key_rows"))
    met = cells.join(repeats, list(by)) if by else cells.withColumn("duplicate_key_rows", repeats.scalar())
    return met.select(
        *by,
        "included_rows",
        F.lit(len(signals)).alias("numeric_signals"),
        F.aggregate("_nulls", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("null_measurements"),
        F.array_join(F.transform(sparse, lambda c: c["name"]), ",").alias("sparse_columns"),
        "all_null_rows",
        "duplicate_key_rows",
        "first_ts",
        "last_ts",
    )


def missing_grid_keys(rows: DataFrame, stations: DataFrame, start: str, end: str, step: str = "10 minutes") -> DataFrame:
    """Expected (ts, station) keys of [start, end) that no row has.

    Expected keys are generated inside the executors, day by day; the grid follows from the time
    range and the station dimension, not from the data.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    day = F.expr("INTERVAL 1 DAY")
    days = stations.select("turbine_id", F.explode(F.sequence(lo, hi - F.expr("INTERVAL 1 MICROSECOND"), day)).alias("_day"))
    spread = days.repartition("turbine_id", "_day")
    last = F.least(F.col("_day") + day, hi) - F.expr("INTERVAL 1 MICROSECOND")
    grid = spread.select("turbine_id", F.explode(F.sequence("_day", last, F.expr(f"INTERVAL {step}"))).alias("ts"))
    observed = rows.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("turbine_id", "ts").distinct()
    return grid.join(observed, ["turbine_id", "ts"], "left_anti")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column in source order: name, type, null count. One scan of the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f.name).alias("null_count"))
            for i, f in enumerate(df.schema)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """Per text column its most frequent trimmed values and its number of distinct ones.

    Values are counted before ranking. Ranking is done per (column, hash bucket) first, so a
    column with very many values is never sorted in one task.
    """
    values = df.select(*[F.trim(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = values.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    bucketed = counts.withColumn("_bucket", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.desc("n"), F.asc("value")]
    local = bucketed.withColumn("_r", F.row_number().over(W.partitionBy("column", "_bucket").orderBy(*order))).where(F.col("_r") <= n)
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("rank") <= n)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    return ranked.join(distinct, "column").select("column", "rank", "value", "n", "distinct_values")


def duration_checks(raw: DataFrame, time: str = "TimeOn", end: str = "TimeOff") -> DataFrame:
    """One row: unparsable starts and ends, negative durations, start range."""
    start, stop = iso_or_null(F.col(time)), iso_or_null(F.col(end))
    return raw.select(F.col(time).alias("a"), F.col(end).alias("b"), start.alias("s"), stop.alias("e")).agg(
        F.count_if(F.col("a").isNotNull() & F.col("s").isNull()).alias("invalid_starts"),
        F.count_if(F.col("b").isNotNull() & F.col("e").isNull()).alias("invalid_ends"),
        F.count_if(F.col("e") < F.col("s")).alias("negative_durations"),
        F.min("s").alias("first_start"),
        F.max("s").alias("last_start"),
    )


def manifest_codes(alarms: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent codes with the share of documented rows."""
    counts = alarms.groupBy("alarm_code", "description").agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg(
        F.sum(F.when(F.col("description") != UNDOCUMENTED, F.col("n")).otherwise(0)) / F.sum("n") * F.lit(100.0)
    ).scalar()
    return counts.orderBy(F.desc("n"), F.asc("alarm_code")).limit(n).withColumn("documented_pct", share)


def difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column on the left that the right lacks."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def json_cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))
