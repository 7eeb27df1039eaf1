"""Controlled vocabulary of stations, codes and spoken aliases, with conflict reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.functions.text import casefolded, collapse_spaces, label_aliases, strip
from alarmlake.settings import UNDOCUMENTED


def observed_stations(alarms: DataFrame) -> DataFrame:
    return alarms.select("turbine_id").distinct()


def code_descriptions(alarms: DataFrame, lookup: DataFrame) -> DataFrame:
    """Observed codes with their documented description or the placeholder."""
    observed = alarms.select("alarm_code").distinct()
    text = lookup.groupBy("alarm_code").agg(F.min(strip("description")).alias("description"))
    return observed.join(text, "alarm_code", "left").select(
        "alarm_code", F.coalesce("description", F.lit(UNDOCUMENTED)).alias("description")
    )


def station_labels(alarms: DataFrame, metadata: DataFrame) -> DataFrame:
    """Labels of observed stations only."""
    seen = observed_stations(alarms)
    return metadata.select(F.col("station_id").alias("turbine_id"), strip("turbine_name").alias("label")).join(
        seen, "turbine_id", "left_semi"
    )


def aliases(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode(label_aliases(F.col("label"))).alias("alias"), "turbine_id")


def conflicts(alarms: DataFrame, lookup: DataFrame, metadata: DataFrame) -> DataFrame:
    """(kind, subject) of everything that makes the vocabulary ambiguous."""
    text = lambda c: F.col(c).cast("string").alias("subject")
    kind = lambda name: F.lit(name).alias("kind")
    stations = metadata.groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(kind("repeated_station"), text("station_id"))
    looked = (
        lookup.groupBy("alarm_code").agg(F.count_distinct(strip("description")).alias("n")).where("n > 1").select(kind("lookup_description"), text("alarm_code"))
    )
    pairs = alarms.select("alarm_code", strip("description").alias("description")).distinct()
    observed = pairs.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(kind("observed_description"), text("alarm_code"))
    codes = code_descriptions(alarms, lookup)
    differs = (
        pairs.join(codes.withColumnRenamed("description", "expected"), "alarm_code")
        .where(F.col("description") != F.col("expected"))
        .select(kind("description_mismatch"), text("alarm_code"))
        .distinct()
    )
    ambiguous = (
        codes.where(F.col("description") != UNDOCUMENTED)
        .groupBy(collapse_spaces(casefolded(F.col("description"))).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(kind("ambiguous_description"), text("d"))
    )
    names = aliases(station_labels(alarms, metadata))
    shared = names.groupBy("alias").agg(F.count_distinct("turbine_id").alias("n")).where("n > 1").select(kind("shared_alias"), text("alias"))
    raw = observed_stations(alarms).select(F.col("turbine_id").alias("raw_id"))
    taken = (
        names.join(raw, F.col("alias") == F.col("raw_id")).where(F.col("turbine_id") != F.col("raw_id")).select(kind("alias_is_raw_id"), text("alias")).distinct()
    )
    out = stations
    for part in (looked, observed, differs, ambiguous, shared, taken):
        out = out.unionByName(part)
    return out


def documented_codes(alarms: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed codes with and without documentation."""
    seen = alarms.select("alarm_code").distinct()
    return seen.join(lookup, "alarm_code", "left_semi"), seen.join(lookup, "alarm_code", "left_anti")


def summary(alarms: DataFrame, lookup: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row with the size of each vocabulary part."""
    codes = code_descriptions(alarms, lookup)
    labels = station_labels(alarms, metadata)
    seen = observed_stations(alarms)
    unmapped = seen.join(metadata, seen.turbine_id == metadata.station_id, "left_anti")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return codes.agg(
        F.count(F.lit(1)).alias("codes"), F.count_if(F.col("description") != UNDOCUMENTED).alias("documented_codes")
    ).select(
        "codes",
        "documented_codes",
        (F.col("codes") - F.col("documented_codes")).alias("undocumented_codes"),
        count(seen).alias("turbines"),
        count(labels).alias("labels"),
        count(aliases(labels)).alias("aliases"),
        count(unmapped).alias("unmapped_stations"),
    )
