"""Files in the raw layout: one CSV per table and month, text lines, staged stream input."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession


def write_monthly_csv(df: DataFrame, folder: str, prefix: str, month: Column) -> list[str]:
    """Rows as ``{prefix}_{month}.csv``, one file per month (text ``yyyy_MM``); returns the months in order.

    One job writes every month. The layout demands a single file per month, so a month's rows meet in one task.
    """
    spark = df.sparkSession
    staging = f"{folder}/_{prefix}"
    df.withColumn("_month", month).repartition("_month").write.partitionBy("_month").option("header", True).csv(staging)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = []
    for home in fs.listStatus(path(staging)):
        if home.isDirectory():
            months.append(home.getPath().getName().removeprefix("_month="))
            (part,) = [f.getPath() for f in fs.listStatus(home.getPath()) if f.getPath().getName().startswith("part-")]
            target = f"{folder}/{prefix}_{months[-1]}.csv"
            if not fs.rename(part, path(target)):
                raise OSError(f"could not place {target}")
    return sorted(months)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small companion file with exact bytes."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()
    return path


def stage_stream(df: DataFrame, path: str, files: int, seq: str = "seq") -> str:
    """Parquet files by ranges of ``seq``, written in one job; a file stream reads them in order.

    A file stream goes by modification time, so the files get times in the order of their ranges.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, seq).sortWithinPartitions(seq).write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    begin = int(time.time()) - len(parts)
    for i, part in enumerate(parts):
        fs.setTimes(part, (begin + i) * 1000, -1)
    return path
