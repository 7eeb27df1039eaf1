"""Sensor snapshots, the chronological merged event stream, and the last-B ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.plans.segments import dense_sequence, row_numbers


def with_occurrence(scada: DataFrame) -> DataFrame:
    """Number repeated readings of one (ts, station, signal) from 0 in arrival order."""
    return row_numbers(scada, ["ts", "turbine_id", "signal"]).withColumn("layer", F.col("_rn") - 1).drop("_rn")


def snapshots(scada: DataFrame) -> DataFrame:
    """One signals map per (ts, station, layer); null readings stay as null map values."""
    return (
        with_occurrence(scada)
        .groupBy("ts", "turbine_id", "layer")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "value")))).alias("signals"))
    )


def alarm_events(alarms: DataFrame) -> DataFrame:
    """Alarm rows as events with an empty signals map."""
    return alarms.select(
        "ts",
        "turbine_id",
        "alarm_code",
        "description",
        "stopping",
        F.create_map().cast("map<string,double>").alias("signals"),
        F.lit(True).alias("is_alarm"),
        F.col("alarm_code").alias("rank"),
        F.col("seq").alias("source_seq"),
    )


def sensor_events(scada: DataFrame) -> DataFrame:
    """Snapshots as events with null alarm fields."""
    return snapshots(scada).select(
        "ts",
        "turbine_id",
        F.lit(None).cast("bigint").alias("alarm_code"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("int").alias("stopping"),
        "signals",
        F.lit(False).alias("is_alarm"),
        F.col("layer").cast("bigint").alias("rank"),
        F.lit(0).cast("bigint").alias("source_seq"),
    )


def event_order() -> list[Column]:
    """Chronological, sensors before alarms at one instant, then source order."""
    return [F.col(c) for c in ("ts", "is_alarm", "turbine_id", "rank", "source_seq")]


def merged_events(alarms: DataFrame, scada: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Every alarm and every snapshot in one total order with a dense ``seq``."""
    events = alarm_events(alarms)
    if scada is not None:
        events = events.unionByName(sensor_events(scada))
    return dense_sequence(events, event_order(), partitions=partitions).drop("rank", "source_seq")


def ring(events: DataFrame, size: int, at: int | None = None) -> DataFrame:
    """The last ``size`` observations, optionally as of ``at`` observations seen.

    With the dense arrival number the ring is a range filter; without ``at`` it is a
    top-k by arrival number.
    """
    if at is None:
        return events.orderBy(F.desc("seq")).limit(size)
    return events.where((F.col("seq") >= at - size) & (F.col("seq") < at))


def console_view(events: DataFrame, ring_size: int, rows: int = 200) -> DataFrame:
    """Most recent alarm events of the ring."""
    return ring(events, ring_size).where(F.col("alarm_code").isNotNull()).orderBy(F.desc("seq")).limit(rows)


def event_id(generation: Column, seq: Column) -> Column:
    return F.concat_ws(":", generation.cast("string"), seq.cast("string"))


def edge_rows(rows: DataFrame, keys: list[str], order: str, first: int, last: int) -> DataFrame:
    """First and last rows of each key by ``order``; keys must be of bounded size."""
    up = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc(order)))
    down = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_u", up).withColumn("_d", down).where((F.col("_u") <= first) | (F.col("_d") <= last)).drop("_u", "_d")
