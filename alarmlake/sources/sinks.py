"""Writers: partitioned Parquet, staged publish, append-only JSON lines, JSON results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmlake.functions.jsontext import finite_or_null


def write_table(df: DataFrame, path: str, sort: tuple[str, ...] = ("turbine_id", "ts"), rows_per_file: int = 5_000_000, in_time_order: bool = False) -> DataFrame:
    """Parquet partitioned by date, rows sorted inside files so row-group statistics prune.

    Rows are range-partitioned on date, sort columns and a row hash, so partitions are even
    whatever share of the rows one date or station holds. Rows whose partitions already are even
    ranges of time (``in_time_order``, as of a dense sequence) stay where they are.
    """
    spread = df.withColumn("date", F.to_date("ts"))
    if not in_time_order:
        # A number of partitions keeps them from being merged: many dates mean many files, whatever their size.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = spread.repartitionByRange(parts, "date", *sort, F.xxhash64(*df.columns))
    (
        spread.sortWithinPartitions("date", *sort)
        .write.partitionBy("date")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def reconcile(written: DataFrame, expected: DataFrame) -> DataFrame:
    """One row with both counts; unequal counts raise."""
    want = expected.agg(F.count(F.lit(1))).scalar()
    got = written.agg(F.count(F.lit(1)).alias("written_rows")).withColumn("expected_rows", want)
    same = F.col("written_rows") == F.col("expected_rows")
    message = F.lit("written rows do not reconcile with the source")
    return got.withColumn("written_rows", F.when(~same, F.raise_error(message).cast("bigint")).otherwise(F.col("written_rows")))


def _flip_pointer(spark: SparkSession, root: str, run: str) -> None:
    """Replace the pointer file in one rename that overwrites."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    staged, pointer = (jvm.org.apache.hadoop.fs.Path(f"{root}/{n}") for n in (f"CURRENT.{run}", "CURRENT"))
    out = pointer.getFileSystem(conf).create(staged, True)
    out.write(bytearray(run.encode()))
    out.close()
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri() if pointer.toUri().getScheme() else jvm.java.net.URI(f"file://{root}"), conf).rename(
        staged, pointer, options
    )


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, validate: Callable[[dict[str, DataFrame]], None] | None = None, dated: dict[str, tuple[str, ...]] | None = None,
    in_time_order: tuple[str, ...] = (),
) -> str:
    """Write all tables to a staging folder, validate what was written, then flip the pointer.

    Tables in ``dated`` are partitioned by date and sorted by the columns named there, without a
    shuffle those in ``in_time_order``.

    Readers follow the pointer table, so they see either the previous run or the new one; a
    failure leaves the pointer as it was.
    """
    run = uuid.uuid4().hex
    base = f"{root.rstrip('/')}/runs/{run}"
    written = {}
    for name, df in tables.items():
        if name in (dated or {}):
            written[name] = write_table(df, f"{base}/{name}", dated[name], in_time_order=name in in_time_order)
        else:
            df.write.parquet(f"{base}/{name}")
            written[name] = spark.read.parquet(f"{base}/{name}")
    if validate is not None:
        validate(written)
    _flip_pointer(spark, root.rstrip("/"), run)
    return run


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the run the pointer names."""
    run = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/runs/{run}/{name}")


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; nulls are left out, as in the journal format."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Result table as JSON lines with explicit nulls; non-finite numbers become null."""
    cols = [
        finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema
    ]
    df.select(*cols).write.option("ignoreNullFields", "false").json(path)
