"""Checks that report or raise; none of them repairs data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.functions.text import strip
from alarmlake.settings import MAX_CODE_SHARE_PCT, MAX_SITE_RATE


def require_columns(df: DataFrame, columns: Sequence[str], source: str = "input") -> DataFrame:
    """Analysis-time check: every column is present exactly once."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError(f"{source}: column names must be unique")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{source}: missing required columns {missing}")
    return df


def same_signals(by_member: dict[str, Sequence[str]]) -> None:
    """Analysis-time check: one table carries the same signals in every month."""
    sets = {name: frozenset(cols) for name, cols in by_member.items()}
    if len(set(sets.values())) > 1:
        raise ValueError(f"signal schema changed between {sorted(sets)}")


def disjoint_signals(by_table: dict[str, Sequence[str]]) -> None:
    """Analysis-time check: no signal name is used by two tables."""
    seen: dict[str, str] = {}
    for name, cols in by_table.items():
        for col in cols:
            if seen.setdefault(col, name) != name:
                raise ValueError(f"signal {col} appears in both {seen[col]} and {name}")


# Accepted numbers, and those with a fraction that is not zero.
NUMERIC = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
FRACTION = r"\.0*[1-9]"
# Fixed value: numbers that are integers as they stand.
PLAIN_INTEGER = r"\A[+-]?\d{1,15}\z"


def _seldom(text: Column, parse: Callable[[Column], Column]) -> Column:
    """``parse`` of a value that no quick test settles.

    As a lambda its long expression stays out of the generated row loop; the JVM leaves a loop of over 8,000 bytes uncompiled.
    """
    return F.get(F.transform(F.array(text), parse), 0)


def integer_or_null(text: Column) -> Column:
    """BIGINT when the value is integral, else null. Nothing is rounded."""
    plain = text.cast("string")
    return F.when(plain.rlike(PLAIN_INTEGER), plain.try_cast("bigint")).otherwise(_seldom(text, _any_integer))


def _any_integer(text: Column) -> Column:
    number = F.when(strip(text.cast("string")).rlike(NUMERIC), text.try_cast("double"))
    exact = F.coalesce(text.try_cast("bigint"), F.when(F.abs(number) < 2.0**53, number.try_cast("bigint")))
    return F.when(number % 1 == 0, F.when(strip(text.cast("string")).rlike(FRACTION), F.when(F.abs(number) < 2.0**53, exact)).otherwise(exact))


def strict_integer(text: Column, label: str) -> Column:
    return F.coalesce(integer_or_null(text), F.raise_error(F.lit(f"{label} must contain non-null integers")).cast("bigint"))


# Fixed value: accepted ISO-8601 shape; a date, optionally a time, optionally an offset.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?\z"
BASIC_PATTERN = r"^\d{8}(T\d{6})?\z"
# Fixed value: date and time to the second, nothing around them.
PLAIN_TIMESTAMP = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\z"


def iso_or_null(text: Column) -> Column:
    """Naive UTC timestamp of ISO-8601 text, else null. Offsets convert to UTC, then drop."""
    plain = text.cast("string")
    return F.when(plain.rlike(PLAIN_TIMESTAMP), F.try_to_timestamp(plain)).otherwise(_seldom(text, _any_timestamp)).cast("timestamp_ntz")


def _any_timestamp(text: Column) -> Column:
    clean = strip(text)
    basic = F.concat(F.substring(clean, 1, 8), F.coalesce(F.nullif(F.substring(clean, 10, 6), F.lit("")), F.lit("000000")))
    parsed = F.when(clean.rlike(ISO_PATTERN), F.try_to_timestamp(F.regexp_replace(clean, ",", ".")))
    return F.coalesce(parsed, F.when(clean.rlike(BASIC_PATTERN), F.try_to_timestamp(basic, F.lit("yyyyMMddHHmmss"))))


def strict_timestamp(text: Column, label: str) -> Column:
    return F.coalesce(iso_or_null(text), F.raise_error(F.lit(f"{label} must contain non-null timestamps")).cast("timestamp_ntz"))


def strict_double(text: Column, label: str) -> Column:
    """DOUBLE; null stays null and other text raises."""
    value = text.try_cast("double")
    suffixed = strip(text.cast("string")).rlike(r"[0-9.][dDfF]\z")  # Java number suffixes are not numbers here
    bad = text.isNotNull() & (value.isNull() | suffixed)
    return F.when(bad, F.raise_error(F.lit(f"{label} must be numeric")).cast("double")).otherwise(value)


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (strip(name) == "")


def alarm_violations(alarms: DataFrame) -> DataFrame:
    """One row with the number of canonical-domain violations per rule."""
    return alarms.agg(
        F.count_if(F.col("ts").isNull()).alias("null_ts"),
        F.count_if(_blank("turbine_id")).alias("blank_turbine_id"),
        F.count_if(F.col("alarm_code").isNull()).alias("null_alarm_code"),
        F.count_if(_blank("description")).alias("blank_description"),
        F.count_if(~F.coalesce(F.col("stopping").isin(-1, 0, 1), F.lit(False))).alias("bad_stopping"),
    )


def sensor_violations(scada: DataFrame) -> DataFrame:
    """One row with the number of sensor-domain violations per rule."""
    value = F.col("value")
    return scada.agg(
        F.count_if(F.col("ts").isNull()).alias("null_ts"),
        F.count_if(F.col("turbine_id").isNull()).alias("null_turbine_id"),
        F.count_if(_blank("signal")).alias("blank_signal"),
        F.count_if(value.isNotNull() & ~F.isnan(value) & (F.abs(value) == F.lit(float("inf")))).alias("nonfinite_value"),
    )


def dimension_violations(rows: DataFrame, key: str, label: str) -> DataFrame:
    """One row: repeated keys, non-integer keys and blank labels of a dimension."""
    per_key = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(_blank(label)).alias("blank"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
        F.count_if(integer_or_null(F.col(key).cast("string")).isNull()).alias("non_integer_keys"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_labels"),
    )


def raise_on_violations(report: DataFrame, label: str) -> DataFrame:
    """Pass a one-row violation report through, raising when any count is positive."""
    total = sum((F.col(c) for c in report.columns), F.lit(0))
    message = F.concat(F.lit(f"{label}: "), F.to_json(F.struct(*report.columns)))
    first = report.columns[0]
    return report.withColumn(first, F.when(total > 0, F.raise_error(message).cast("bigint")).otherwise(F.col(first)))


def plausibility(site_rate: Column, largest_share: Column) -> Column:
    return (site_rate <= MAX_SITE_RATE) & (largest_share <= MAX_CODE_SHARE_PCT)


def raise_unless(condition: Column, message: str) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
