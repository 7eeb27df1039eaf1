"""Order-dependent work split into bounded pieces.

``seq`` is a unique arrival number, so a run of 2**bits consecutive numbers holds
at most 2**bits rows whatever the key skew. Operators that need order within a key
work per (key, run) and stitch runs through a per-run summary, so a key holding a
third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.session import materialize

RUN_BITS = 20


def micros(ts: Column | str) -> Column:
    """Exact microseconds since the epoch of a naive UTC timestamp."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def run_of(seq: Column | str, bits: int = RUN_BITS) -> Column:
    return F.shiftright(F.col(seq) if isinstance(seq, str) else seq, bits)


def row_numbers(df: DataFrame, keys: Sequence[str], seq: str = "seq", bits: int = RUN_BITS) -> DataFrame:
    """Add ``_rn``: 1-based position of each row within its key, in ``seq`` order.

    The sort happens per (key, run); offsets come from a pre-aggregated count per run.
    """
    runs = df.withColumn("_run", run_of(seq, bits))
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        runs.groupBy(*keys, "_run")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy(*keys, "_run").orderBy(seq)
    return (
        runs.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, [*keys, "_run"])
        .select(*df.columns, (F.col("_offset") + F.col("_pos")).alias("_rn"))
    )


def blocks_with_halo(df: DataFrame, rn: str, block_rows: int, halo: int) -> DataFrame:
    """Cut each key into blocks of ``block_rows`` rows and copy the last ``halo`` rows of a
    block into the next one, so any frame of up to ``halo`` preceding rows stays whole.

    ``_halo`` marks copies; drop them after evaluating the frame.
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    position = (F.col(rn) - 1) % block_rows
    block = F.floor((F.col(rn) - 1) / block_rows).cast("bigint")
    homes = F.when(
        position >= block_rows - halo,
        F.array(F.struct(block.alias("b"), F.lit(False).alias("h")), F.struct((block + 1).alias("b"), F.lit(True).alias("h"))),
    ).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("h"))))
    return (
        df.withColumn("_home", F.explode(homes))
        .withColumn("_block", F.col("_home.b"))
        .withColumn("_halo", F.col("_home.h"))
        .drop("_home")
    )


def dense_sequence(df: DataFrame, order: Sequence[Column], name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Number all rows 0..n-1 in a total order without a single-task sort.

    Rows are range-partitioned and sorted, written once, and numbered as
    partition offset + position; only one count per partition is combined.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialize(placed, "ordered")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), "_part")  # one row per partition; the rows themselves are not shuffled for it
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_part", "_at", "_offset")
    )


def running_total(df: DataFrame, value: str, index: str, name: str, chunk_bits: int = 12) -> DataFrame:
    """Inclusive running sum over a unique integer ``index``: a sum inside each chunk of
    2**chunk_bits indices plus the total of the chunks before it."""
    chunked = df.withColumn("_chunk", run_of(index, chunk_bits))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
    totals = (
        chunked.groupBy("_chunk")
        .agg(F.sum(value).alias("_total"))
        .select("_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_chunk").orderBy(index).rowsBetween(W.unboundedPreceding, 0)
    return (
        chunked.withColumn("_local", F.sum(value).over(inside))
        .join(totals, "_chunk")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_chunk", "_local", "_offset")
    )
