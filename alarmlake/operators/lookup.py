"""Dimension joins: code labels and station labels.

No broadcast is forced: Spark broadcasts a dimension whose measured size is under its
threshold and otherwise shuffles, with AQE splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.settings import UNDOCUMENTED


def with_code_labels(alarms: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join to the code lookup; a missing code becomes the undocumented sentinel."""
    labels = lookup.select("alarm_code", "description", "stopping")
    return alarms.join(labels, "alarm_code", "left").select(
        *[c for c in alarms.columns],
        F.coalesce("description", F.lit(UNDOCUMENTED)).alias("description"),
        F.coalesce("stopping", F.lit(-1)).cast("int").alias("stopping"),
    )


def with_station_labels(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    names = metadata.select(F.col("station_id").alias("turbine_id"), F.col("turbine_name").alias("turbine_label"))
    return rows.join(names, "turbine_id", "left")


def known_station_counts(alarms: DataFrame, metadata: DataFrame) -> DataFrame:
    """Row count per metadata station, keeping stations without alarms."""
    counts = alarms.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"))
    return metadata.join(counts, metadata.station_id == counts.turbine_id, "left").select(
        "station_id", "turbine_name", F.coalesce("n", F.lit(0)).alias("n")
    )


def unmapped_stations(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Observed station ids that the metadata does not list."""
    ids = rows.select("turbine_id").distinct()
    return ids.join(metadata, ids.turbine_id == metadata.station_id, "left_anti")


def split_known(rows: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = rows.turbine_id == metadata.station_id
    return rows.join(metadata, known, "left_semi"), rows.join(metadata, known, "left_anti")


def label_mismatches(alarms: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows whose stored label differs from the lookup (or from the sentinel)."""
    labels = lookup.select(
        "alarm_code", F.col("description").alias("_d"), F.col("stopping").cast("int").alias("_s")
    )
    same = F.col("description").eqNullSafe(F.coalesce("_d", F.lit(UNDOCUMENTED))) & F.col("stopping").eqNullSafe(
        F.coalesce("_s", F.lit(-1))
    )
    return alarms.join(labels, "alarm_code", "left").where(~same).drop("_d", "_s")
