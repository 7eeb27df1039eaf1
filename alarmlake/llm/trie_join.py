"""SimHash near-duplicates by a self-join of binary tries.

Two fingerprints within 3 bits agree on at least one of four 16-bit blocks. So each distinct fingerprint
goes into four tries, rotated to start with one of the blocks, and only subtrees under an equal first block are
joined. Inside, pairs of nodes are walked down together: each step adds the bit in which the two branches differ,
and a pair past the error budget is dropped with everything below it. A first block with very many fingerprints
is dealt out as pairs of nodes 8 levels further down, so no task holds it whole. A task returns a star of links
for each group that it finds, never all pairs.

Defined cases: null or blank text has fingerprint zero; a null identifier is never the least one of a
component; rows that repeat an identifier are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text
from alarmlake.llm.components import components
from alarmlake.session import materialize

BUDGET = 3
BLOCKS = 4
BLOCK = 64 // BLOCKS
FINE = 8
SEED = 42
AREA = 64  # node pairs with at most so many leaf pairs are compared leaf by leaf
FRONT = 1 << 14  # node pairs walked at a time
BATCH = 1 << 17  # fingerprints joined at a time


def simhash(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 of every shingle, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    value = int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def _simhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([simhash(x.as_buffer().to_pybytes()) for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), prints], ["id", "mark", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (a hash of the text, so that rows can be found again), fp."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), raw_text(text).alias("text"))
    return rows.mapInArrow(_simhashes, "id long, mark long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _walk(v: np.ndarray, node: tuple[np.ndarray, ...], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget below the given node pairs (a from, a to, b from, b to, bits so far)."""
    zeros: dict[int, np.ndarray] = {}
    stack = [(depth, node)]
    while stack:
        depth, node = stack.pop()
        if len(node[0]) > FRONT:
            stack += [(depth, tuple(x[i : i + FRONT] for x in node)) for i in range(0, len(node[0]), FRONT)]
            continue
        alo, ahi, blo, bhi, bits = node
        area = (ahi - alo) * (bhi - blo)
        small = (area <= AREA) | (depth == 64)
        if small.any():
            size = area[small]
            total = int(size.sum())
            k = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat((bhi - blo)[small], size)
            i, j = np.repeat(alo[small], size) + k // wide, np.repeat(blo[small], size) + k % wide
            near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= BUDGET)
            yield i[near], j[near]
        alo, ahi, blo, bhi, bits = (x[~small] for x in node)
        if not len(alo):
            continue
        if depth not in zeros:
            clear = (v >> np.uint64(63 - depth)) & np.uint64(1) == 0
            zeros[depth] = np.concatenate(([0], np.cumsum(clear)))
        z = zeros[depth]
        amid, bmid, same = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo], alo == blo
        parts = [
            (alo, amid, blo, bmid, bits),
            (amid, ahi, bmid, bhi, bits),
            (alo, amid, bmid, bhi, bits + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, bits + 1)),  # of equal nodes, the mirror of the one before
        ]
        joined = tuple(np.concatenate(x) for x in zip(*parts))
        alive = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= BUDGET) & ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
        stack.append((depth + 1, tuple(x[alive] for x in joined)))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's group."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


def _join_groups(group: np.ndarray, side: np.ndarray, v: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) as stars. Rows are sorted by group and value; side: -1 whole group, else 0 / 1 of a pair of nodes or 2 of one node."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.append(first[1:], len(group))
    split = first + np.add.reduceat(side == 0, first)
    cross = side[first] == 0
    whole = ~cross & (last - first > 1)
    full = cross & (split < last)
    # Values are made unique over groups by walking positions only; a node is a range of one group.
    pairs_i, pairs_j = [], []
    begin = (first[whole], last[whole], first[whole], last[whole], np.zeros(int(whole.sum()), np.int64))
    apart = np.bitwise_count(v[first[full]] >> np.uint64(64 - BLOCK - FINE) ^ v[split[full]] >> np.uint64(64 - BLOCK - FINE)).astype(np.int64)
    for node, depth in ((begin, BLOCK), ((first[full], split[full], split[full], last[full], apart), BLOCK + FINE)):
        for i, j in _walk(v, node, depth):
            pairs_i.append(i)
            pairs_j.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs_i, pairs_j))
    root = _roots(len(v), i, j)
    # The centre of a star is its least fingerprint, as the components want it: links then all lead down.
    least = fp.copy()
    np.minimum.at(least, root, fp)
    centre = least[root]
    moved = np.flatnonzero(centre != fp)
    return fp[moved], centre[moved]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join whole groups, about BATCH rows at a time; rows come sorted by group and rotated value."""

    def joined(table: pa.Table) -> pa.RecordBatch:
        r, prefix, lo, hi, v, fp = (table.column(c).to_numpy() for c in ("r", "prefix", "lo", "hi", "v", "fp"))
        group = np.cumsum(np.concatenate(([0], (r[1:] != r[:-1]) | (prefix[1:] != prefix[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        v = v.view(np.uint64)
        order = np.lexsort((v, group))
        v, fp, lo, hi = v[order], fp[order], lo[order], hi[order]
        branch = (v >> np.uint64(64 - BLOCK - FINE) & np.uint64((1 << FINE) - 1)).astype(np.int64)
        side = np.where(lo < 0, -1, np.where(lo == hi, 2, np.where(branch == lo, 0, 1)))
        a, b = _join_groups(group, side, v, fp)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < BATCH:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(c).to_numpy() for c in ("r", "prefix", "lo", "hi")])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if len(cut):
            at = int(cut[-1]) + 1
            yield joined(table.slice(0, at))
            held = table.slice(at).to_batches()
            n = table.num_rows - at
    if n:
        yield joined(pa.Table.from_batches(held))


def near_links(distinct: DataFrame, split_at: int = BATCH) -> DataFrame:
    """Links (a, b) that connect every group of distinct fingerprints ``fp`` within the budget."""
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("r"), _rotated(F.col("fp"), k * BLOCK).alias("v")) for k in range(BLOCKS))))
    rows = distinct.select("fp", turned.alias("t")).select("fp", "t.r", "t.v", F.shiftrightunsigned("t.v", 64 - BLOCK).alias("prefix"))
    crowded = rows.groupBy("r", "prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_at)
    branch = F.shiftrightunsigned("v", 64 - BLOCK - FINE).bitwiseAND(F.lit((1 << FINE) - 1).cast("long")).cast("int")
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << FINE) - 1)), lambda b: F.bit_count(b.bitwiseXOR(F.col("branch"))) <= BUDGET)
    met = rows.join(crowded, ["r", "prefix"], "left").withColumn("branch", branch)
    met = met.withColumn("other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(near)))
    lo = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.least("branch", "other"))
    hi = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.greatest("branch", "other"))
    dealt = met.select("r", "prefix", lo.alias("lo"), hi.alias("hi"), "v", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "r", "prefix", "lo", "hi").sortWithinPartitions("r", "prefix", "lo", "hi").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", split_at: int = BATCH) -> DataFrame:
    """id, mark, fp, component_id (the least identifier reachable), class_fp of every row."""
    prints = materialize(fingerprints(docs, key, text), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(near_links(distinct.select("fp"), split_at))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("class_fp"))
    placed = materialize(placed, "simhash-classes")
    least = placed.groupBy("class_fp").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(least, "class_fp").select("fp", "class_fp", "component_id"), "fp")


def row_key(key: Column, mark: Column) -> Column:
    """Identifier and text hash as one value to join on, in which nulls are equal; the cast lets rows of any origin have the same type."""
    return F.struct(key.cast("long").alias("id"), mark.alias("mark")).cast("struct<id:bigint,mark:bigint>")


def one_each(docs: DataFrame, placed: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Documents with one of each ``group`` of ``placed`` (id, mark): that with the least identifier (nulls last)."""
    stay = placed.groupBy(group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("k")).select(row_key(F.col("k.id"), F.col("k.mark")).alias("_k"))
    rows = docs.select(F.struct("*").alias("_row"), row_key(F.col(key), F.xxhash64(text)).alias("_k"))
    # One key, so that the rows of the join are where the duplicates are dropped: texts are shuffled once.
    return rows.join(stay, "_k").dropDuplicates(["_k"]).select("_row.*")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with one of each near-duplicate group: that with the least identifier (nulls last)."""
    return one_each(docs, near_duplicates(docs, key, text), "class_fp", key, text)
