"""Exact deduplication by a stream with disk-backed keyed state that never expires.

The state (RocksDB, checkpointed to the shared folder) holds one entry per digest: the stable identifier
and the content locator (file, row) of the row that stays, and the number of rows. A later run on the same
checkpoint takes up only new files. A hit is never trusted on its digest alone: its bytes are compared with
the bytes at the locator, and rows that differ are grouped again by their whole text.

Defined cases: null text is the empty text; a null identifier is smaller than any other; of rows that
repeat an identifier and a text, the one with the greatest locator stays; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmlake.session import materialize, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(source: DataFrame, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return source.select(
        F.col(key).cast("long").alias("id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
        digest(body).alias("digest"),
        body.alias("body"),
    )


def fold_stream(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> None:
    """Fold all files under ``path`` that the checkpoint has not seen into its state, then stop."""
    own = spark.newSession()  # the state store setting stays out of the caller's session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else every store sets megabytes of disk aside
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name in (key, text)])
    reader = own.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream's path must be a folder or a pattern; the last character as a class lets it be one file too.
    folded = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), key, text, digest).groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
    run = folded.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def keyed_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep (id, locator), n: the state as a table."""
    state = spark.read.format("statestore").load(checkpoint)
    keep, n = (F.col(f"value.{f.name}") for f in state.schema["value"].dataType.fields)
    return state.select("key.digest", keep.alias("keep"), n.alias("n"))


def copies_of(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose digest was seen more than once, with their bytes: the only ones whose text is needed again."""
    return rows.join(state.filter("n > 1"), "digest").select("digest", "id", "locator", "body", (F.col("locator") == F.col("keep.locator")).alias("stays"))


def unequal_hits(copies: DataFrame) -> DataFrame:
    """Hits whose bytes differ from those at the kept locator."""
    kept = copies.filter("stays").select("digest", F.col("body").alias("kept_body"))
    hits = copies.filter(~F.col("stays")).join(kept, "digest")
    return hits.filter(F.col("body").cast("binary") != F.col("kept_body").cast("binary")).drop("kept_body", "stays")


def verdicts(spark: SparkSession, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """id, keep_id, group_size, kept, locator of every row under ``path``, from the folded state."""
    rows, state = _rows(spark.read.parquet(path), key, text, digest), keyed_state(spark, checkpoint)
    copies = materialize(copies_of(rows, state), "dedup-copies")
    # Rows that only share a digest (none, for SHA-256 in practice) are grouped by their whole text.
    apart = materialize(unequal_hits(copies), "dedup-apart")
    again = apart.groupBy("digest", "body").agg(F.max(F.struct("id", "locator")).alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    moved = apart.join(again, ["digest", "body"]).select("locator", "own_keep", "own_n")
    taken = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("away"))
    state = state.join(taken, "digest", "left")
    plain = rows.select("id", "locator", "digest").join(state, "digest").join(moved, "locator", "left")
    keep = F.coalesce("own_keep", "keep")
    return plain.select(
        "id",
        keep["id"].alias("keep_id"),
        F.coalesce(F.col("own_n"), F.col("n") - F.coalesce("away", F.lit(0))).alias("group_size"),
        (F.col("locator") == keep["locator"]).alias("kept"),
        "digest",
        "locator",
    )


def exact_dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """Fold new files, then judge every row; without ``checkpoint`` the state lives in the scratch folder."""
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    fold_stream(spark, path, checkpoint, key, text, digest, files_per_trigger)
    return verdicts(spark, path, checkpoint, key, text, digest)
