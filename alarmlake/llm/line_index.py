"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; its identity is the 128-bit
XXH3 of the key. Keys held by at least two documents are dealt into shards. A shard is a minimal perfect
hash over its keys (levels of bit arrays with one bit a key) that leads to three arrays: fingerprint, document count and least
document. Documents do not join lines: a task packs the hashes of its documents into one array per shard, the
packs are probed against the shard's arrays, and only the hashes to drop come back.

The index is built from counts combined before the shuffle, so a line that every document holds is one row. A shard that
answers very many probes is copied, so its packs are dealt over several tasks; the copies follow from the counts.

Defined cases: null or empty text is one empty line; rows with a null identifier hold no line for others and keep all
their lines; rows that repeat an identifier are one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import SPACE, raw_text
from alarmlake.session import materialize

SHARD_KEYS = 1 << 16
TASK_PROBES = 1 << 20
GAMMA = 2
MIN_POINTS = 10


def line_key(line: bytes, least: int = MIN_POINTS) -> bytes | None:
    """Key of a line, None if it has fewer than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def line_hashes(text: bytes, least: int) -> set[bytes]:
    digest = xxhash.xxh3_128_digest
    return {digest(k) for k in map(line_key, text.split(b"\n"), [least] * (text.count(b"\n") + 1)) if k is not None}


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of both hashes, another choice per level."""
    x = h1 + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)) ^ h2 * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class LineIndex:
    """Minimal perfect hash with its arrays."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, mark: np.ndarray, count: np.ndarray, first: np.ndarray) -> None:
        self.sizes, self.bits, self.mark, self.count, self.first = sizes, bits, mark, count, first
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.ranks = np.concatenate(([0], np.cumsum(bits)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray) -> LineIndex:
        sizes, levels, rest = [], [], np.arange(len(h1))
        while len(rest):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            size = GAMMA * len(rest) + 1
            at = (_mix(h1[rest], h2[rest], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            sizes.append(size)
            levels.append(bits)
            rest = rest[~alone]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        index = cls(np.array(sizes, np.int64), bits, np.zeros(0, np.uint64), count, first)
        slot = index.slots(h1, h2)
        index.mark, index.count, index.first = (np.empty_like(x) for x in (h2, count, first))
        index.mark[slot], index.count[slot], index.first[slot] = h2, count, first
        return index

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key in the arrays; of other keys any place, or -1."""
        slot, rest = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            at = (_mix(h1[rest], h2[rest], level) % np.uint64(size)).astype(np.int64) + self.offsets[level]
            hit = self.bits[at]
            slot[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit]
        return slot

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0: not held) and least document of each key."""
        slot = self.slots(h1, h2)
        safe = np.maximum(slot, 0)
        held = (slot >= 0) & (self.mark[safe] == h2) if len(self.mark) else np.zeros(len(h1), bool)
        return (np.where(held, self.count[safe], 0), np.where(held, self.first[safe], 0)) if len(self.mark) else (np.zeros(len(h1), np.int64),) * 2

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), len(self.bits), len(self.mark)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.sizes.astype("<i8"), np.packbits(self.bits), self.mark.astype("<u8"), self.count.astype("<i8"), self.first.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        levels, bits, n = np.frombuffer(data, "<i8", 3)
        at, parts = 24, []
        for kind, size in (("<i8", levels), ("u1", (bits + 7) // 8), ("<u8", n), ("<i8", n), ("<i8", n)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(parts[0], np.unpackbits(parts[1], count=bits).astype(bool), *parts[2:])


def _hashes_of(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) hashes and their documents, each once per row."""
    sets = [line_hashes(x.as_buffer().to_pybytes(), least) for x in batch.column("text")]
    hashes = np.frombuffer(b"".join(b"".join(s) for s in sets), "<u8").reshape(-1, 2)
    return hashes, np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = _hashes_of(batch, least)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].view(np.int64)), pa.array(hashes[:, 1].view(np.int64)), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return run


def repeated_lines(texts: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """h1, h2, first, n of keys that at least two documents of ``texts`` (id, text) hold."""
    held = texts.filter("id IS NOT NULL").mapInArrow(_occurrences(least), "h1 long, h2 long, id long")
    return held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last").drop("last")


def _build(table: pa.Table) -> pa.Table:
    h1, h2, n, first = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "first"))
    blob = LineIndex.build(h1.view(np.uint64), h2.view(np.uint64), n, first).to_bytes()
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "pack": pa.array([blob], pa.binary())})


def _packs(shards: int, ways: list[int], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = _hashes_of(batch, least)
            shard = (hashes[:, 0] >> np.uint64(40)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            hashes, ids, shard = hashes[order], ids[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            out = {"shard": [], "copy": [], "kind": [], "pack": []}
            for h, d, s in zip(np.split(hashes, cuts), np.split(ids, cuts), np.split(shard, cuts)):
                if len(s):
                    out["shard"].append(int(s[0]))
                    out["copy"].append(int(d[0]) % ways[int(s[0])])
                    out["kind"].append(1)
                    out["pack"].append(h[:, 0].tobytes() + h[:, 1].tobytes() + d.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("copy", pa.int64()), ("kind", pa.int32()), ("pack", pa.binary())]))

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard copy, its arrays first. Answers: document and the packed hashes that it loses."""
    index, at = None, None
    for batch in batches:
        for shard, copy, kind, pack in zip(*(batch.column(c) for c in ("shard", "copy", "kind", "pack"))):
            data = pack.as_buffer().to_pybytes()
            if kind.as_py() == 0:
                index, at = LineIndex.from_bytes(data), (shard.as_py(), copy.as_py())
                continue
            if at != (shard.as_py(), copy.as_py()):  # a shard without repeated lines has no arrays
                continue
            h1, h2, ids = np.frombuffer(data, "<u8").reshape(3, -1)
            ids = ids.view(np.int64)
            count, first = index.probe(h1, h2)
            lost = np.flatnonzero((count >= 2) & (first != ids))
            lost = lost[np.argsort(ids[lost], kind="stable")]
            cuts = np.flatnonzero(np.diff(ids[lost])) + 1
            parts = [x for x in np.split(lost, cuts) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[x[0]]) for x in parts], pa.int64()), pa.array([h1[x].tobytes() for x in parts], pa.binary())], ["id", "lost"])


def lost_lines(texts: DataFrame, least: int = MIN_POINTS, shard_keys: int = SHARD_KEYS, task_probes: int = TASK_PROBES) -> DataFrame:
    """id, lost (packed first hashes of the lines that the document loses)."""
    spark = texts.sparkSession
    lines = materialize(repeated_lines(texts, least), "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    lines = lines.withColumn("shard", F.shiftrightunsigned("h1", 40) % shards)
    ways = [1] * shards  # one number per shard: at most the repeated lines over shard_keys
    for row in lines.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        ways[row["shard"]] = -(-row["n"] // task_probes)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(F.lit(ways), F.col("shard").cast("int") + 1).cast("long") - 1))
    arrays = lines.groupBy("shard").applyInArrow(_build, "shard long, pack binary").select("shard", copies.alias("copy"), F.lit(0).alias("kind"), "pack")
    packs = texts.filter("id IS NOT NULL").mapInArrow(_packs(shards, ways, least), "shard long, copy long, kind int, pack binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrays.union(packs).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    answers = dealt.mapInArrow(_answers, "id long, lost binary")
    return materialize(answers.groupBy("id").agg(F.array_join(F.transform(F.collect_list("lost"), F.hex), "").alias("lost")), "lost-lines")


def _strip(least: int, schema: pa.Schema | None = None):
    digest = xxhash.xxh3_128_digest

    def strip(text: bytes, lost: bytes) -> tuple[bytes, int]:
        gone = {lost[i : i + 8] for i in range(0, len(lost), 8)}
        lines = text.split(b"\n")
        kept = [x for x in lines if (k := line_key(x, least)) is None or digest(k)[:8] not in gone]
        return b"\n".join(kept), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, lost in zip(batch.column("text"), batch.column("lost")):
                body = text.as_buffer().to_pybytes()
                kept, n = strip(body, bytes.fromhex(lost.as_py())) if lost.is_valid else (body, 0)
                texts.append(kept)
                total.append(body.count(b"\n") + 1)
                dropped.append(n)
            out = [batch.column("rest"), pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["rest", "kept", "n_lines", "n_dropped"])

    return run


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_POINTS, **sizes: int) -> DataFrame:
    """rest (the other columns of a document), kept (its text), n_lines and n_dropped."""
    texts = docs.select(F.col(key).cast("long").alias("id"), raw_text(text).alias("text"))
    lost = lost_lines(texts, least, **sizes)
    rest = F.struct(*(F.col(c) for c in docs.columns if c != text)).alias("rest")
    rows = docs.select(rest, F.col(key).cast("long").alias("id"), raw_text(text).alias("text"))
    met = rows.join(lost, "id", "left").select("rest", "text", "lost")
    kind = met.schema["rest"].dataType.simpleString()
    return met.mapInArrow(_strip(least), f"rest {kind}, kept binary, n_lines long, n_dropped long").withColumn("kept", F.col("kept").cast("string"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", **options: int) -> DataFrame:
    """``docs`` with the kept text, and its length where there is a column for it."""
    done = drop_lines(docs, key, text, **options)
    own = {text: F.col("kept"), length: F.length("kept").cast("long")}
    return done.select(*((own[c] if c in own else F.col(f"rest.{c}")).alias(c) for c in docs.columns))
