"""Time and identity filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts(value: str | datetime):
    text = value.isoformat() if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp").cast("timestamp_ntz")


def in_dates(rows: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Drop the dates outside [start, end] from a table partitioned by date; other tables are returned as they are."""
    if "date" in rows.columns:
        if start is not None:
            rows = rows.where(F.col("date") >= F.to_date(start))
        if end is not None:
            rows = rows.where(F.col("date") <= F.to_date(end))
    return rows


def month_slice(rows: DataFrame, year: int, month: int) -> DataFrame:
    """Rows in [month start, next month); pushed down to the scan."""
    return half_open(rows, *month_bounds(year, month))


def month_bounds(year: int, month: int) -> tuple[datetime, datetime]:
    if not 1 <= month <= 12:
        raise ValueError("month must be 1 through 12")
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def _month_counts(start: Column, end: Column) -> list[Column]:
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    return [
        F.count_if(inside).alias("included"),
        F.count_if(F.col("ts") == end).alias("endpoint_excluded"),
        F.count_if(~inside & (F.col("ts") != end)).alias("illegal"),
    ]


def month_profile(rows: DataFrame, year: int, month: int) -> DataFrame:
    """One row: kept rows, rows on the next month's first instant, other outside rows."""
    return rows.agg(*_month_counts(*map(_ts, month_bounds(year, month))))


def own_month() -> tuple[Column, Column]:
    """Bounds of the month that the row's ``year`` and ``month`` name."""
    start = F.make_timestamp_ntz("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return start, start + F.make_ym_interval(F.lit(0), F.lit(1))


def month_profiles(rows: DataFrame) -> DataFrame:
    """``month_profile`` of every (year, month) in one pass."""
    return rows.groupBy("year", "month").agg(*_month_counts(*own_month()))


def own_month_rows(rows: DataFrame) -> DataFrame:
    """Rows inside the month that their file names."""
    start, end = own_month()
    return rows.where((F.col("ts") >= start) & (F.col("ts") < end))


def trailing_window(rows: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """Rows in (start, end]."""
    return in_dates(rows, _ts(start), _ts(end)).where((F.col("ts") > _ts(start)) & (F.col("ts") <= _ts(end)))


def half_open(rows: DataFrame, start: str | datetime | None, end: str | datetime | None) -> DataFrame:
    """Rows in [start, end); None leaves a side open."""
    lo, hi = (None if x is None else _ts(x) for x in (start, end))
    rows = in_dates(rows, lo, hi)
    if lo is not None:
        rows = rows.where(F.col("ts") >= lo)
    return rows if hi is None else rows.where(F.col("ts") < hi)


def seek(rows: DataFrame, at: str | datetime, bounds: DataFrame) -> DataFrame:
    """Rows at or after ``at``; outside the inclusive bounds the query raises."""
    lo, hi = bounds.select("first_ts").scalar(), bounds.select("last_ts").scalar()
    target = _ts(at)
    ok = F.when((target < lo) | (target > hi), F.raise_error(F.lit("seek target is outside the recording")).cast("boolean")).otherwise(
        F.lit(True)
    )
    return in_dates(rows, target, None).where((F.col("ts") >= target) & ok)


def point_lookup(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Every target with its number of matching rows; a valid target matches exactly once.

    Targets must be unique on ``keys``; matches are counted before the join back.
    """
    hits = rows.join(targets.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    return targets.join(hits, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def trace_raw(raw: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """First raw row (by file, row number) and number of raw rows for each wanted key."""
    return (
        raw.join(wanted.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min(F.struct(*order, *fields)).alias("first"), F.count(F.lit(1)).alias("occurrences"))
        .select(*keys, *[F.col(f"first.{c}").alias(c) for c in (*order, *fields)], "occurrences")
    )
