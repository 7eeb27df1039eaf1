"""File streams, watermarked windows and bounded runs; stateful operators are in ``folds``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlake.settings import FLOOD_THRESHOLD, FLOOD_WINDOW


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def flood_windows(events: DataFrame, window: str = FLOOD_WINDOW, threshold: int = FLOOD_THRESHOLD, delay: str = FLOOD_WINDOW) -> DataFrame:
    """Flagged clock-aligned bins, emitted once the watermark passes their end."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return (
        timed.groupBy(F.window("event_time", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("alarm_code")).alias("codes"))
        .where(F.col("n") > threshold)
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "codes"
        )
    )


def closing_row(rows: DataFrame, window: str = FLOOD_WINDOW, delay: str = FLOOD_WINDOW) -> DataFrame:
    """One more row after the end of a bounded stream: its time moves the watermark past every open window."""
    last = rows.agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    late = F.col("ts") + F.expr(f"INTERVAL {window}") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
    made = last.where("ts IS NOT NULL").select((F.col("seq") + 1).alias("seq"), late.cast(rows.schema["ts"].dataType).alias("ts"))
    return made.select(*[F.col(f.name) if f.name in ("seq", "ts") else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available into Parquet and return it as a table."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
