"""Ranked lexical search by branch and bound over FP-trees of documents.

A block of items is a bounded set of queries. Every document is restricted to the terms of the block and written down
once as a vector of term numbers and frequencies, terms ordered from the most to the least frequent one in the corpus. A task
takes some thousand vectors at a time and sorts them, which lays them out as a prefix tree: documents with the same
first terms are neighbours and share one path, and a subtree is a range. Each node keeps the greatest tf of every term
in its subtree and the least m, so that the score of no document below it can exceed the sum of its terms' weights at
that tf and m. The tree is walked depth first with a best-first order of the children; at each node every item of the block that is still open
compares its bound with the score of its own k-th best document so far and leaves the subtree if it cannot gain, and
a leaf is scored exactly for the items that have reached it. The k best of each task meet in two rounds.

All sums are 64-bit integers. The text of the items is the only thing that is broadcast: blocks are cut so that one has
``BLOCK_BYTES`` of item text on average, and every block reads the documents again. An item's own text must fit a task.

Defined cases: null text has no term and is not counted; an item without terms, or whose terms no document holds,
has no rows; rows that repeat an item identifier are one item with the terms of all; null is an identifier like another;
rows that repeat a document are ranked on their own, equal scores by identifier, a null one first; a long text is held
whole by its task, which keeps its terms of the block only; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text
from alarmlake.session import materialize

#: Of bytes, all but 0-9, A-Z, a-z and those from 80 hex on separate terms; A-Z are lower-cased.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TOP = 50
LEAF = 32  # documents of a range that are scored together
TREE = 4096  # documents of one tree
TREE_ENTRIES = 1 << 20  # vector entries of one tree
BLOCK_BYTES = 1 << 20
SALTS = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _restricted(shared):
    """Vectors of the documents over the block's terms, and the number of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_buffer().to_pybytes())
                found = Counter([number[w] for w in words if w in number])
                sizes.append(len(words))
                ids.append(list(found.keys()))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    return run


def _worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Tree:
    """Documents sorted by their term vectors; a node is a range of them that shares a path of terms."""

    def __init__(self, ids: list, m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        order = sorted(range(len(ids)), key=lambda i: vectors[i][0].tolist())
        self.ids, self.m = [ids[i] for i in order], m[order]
        self.paths = [vectors[i][0] for i in order]
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in self.paths])))
        self.terms = np.concatenate(self.paths) if order else np.zeros(0, np.int64)
        self.tfs = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0, np.int64)

    def summary(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms of a subtree, the greatest tf of each, and the least m."""
        a, b = self.starts[low], self.starts[high]
        order = np.argsort(self.terms[a:b], kind="stable")
        terms, tfs = self.terms[a:b][order], self.tfs[a:b][order]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
        return terms[first], np.maximum.reduceat(tfs, first) if len(first) else tfs, int(self.m[low:high].min())

    def children(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """The ranges below the first branching at or after ``depth``; documents that end on one path are dealt out as leaves."""
        first, last = self.paths[low], self.paths[high - 1]
        while depth < len(first) and depth < len(last) and first[depth] == last[depth]:
            depth += 1
        cuts, at = [low], low
        while at < high:
            # The documents that end here come first; of the others, equal terms are neighbours.
            term = self.paths[at][depth] if depth < len(self.paths[at]) else -1
            left, right = at, high
            while left < right:
                middle = (left + right) // 2
                here = self.paths[middle][depth] if depth < len(self.paths[middle]) else -1
                left, right = (middle + 1, right) if here <= term else (left, middle)
            if term == -1:
                cuts += range(at + LEAF, left, LEAF)
            cuts.append(left)
            at = left
        return [(a, b, depth + 1) for a, b in zip(cuts, cuts[1:])]


class Best:
    """The k best documents of every item seen by a task."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least, self.held = k, np.ones(items, np.int64), [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        held = self.held[item]
        held += zip((-scores).tolist(), ids)
        if len(held) > 4 * self.k:
            self.cut(item)

    def cut(self, item: int) -> None:
        held = self.held[item]
        held.sort(key=lambda x: (x[0], x[1] is not None, x[1]))
        del held[self.k :]
        if len(held) == self.k:
            self.least[item] = max(1, -held[-1][0])

    def settle(self, items: np.ndarray) -> None:
        for item in items.tolist():
            if len(self.held[item]) >= self.k:
                self.cut(item)


class Search:
    """Branch and bound for all items of a block; ``flat`` lists the terms of one item after the other."""

    def __init__(self, weights: np.ndarray, flat: np.ndarray, starts: np.ndarray, k: int) -> None:
        self.weights, self.flat, self.starts = weights, flat, starts
        self.best = Best(len(starts), k)
        self.room = np.zeros((LEAF, len(weights)), np.int64)
        self.visited = 0

    def sums(self, rows: int, items: np.ndarray) -> np.ndarray:
        """Sum over each item's terms of the first ``rows`` rows of the room."""
        if len(items) == len(self.starts):
            flat, starts = self.flat, self.starts
        else:
            ends = np.append(self.starts[1:], len(self.flat))[items]
            sizes = ends - self.starts[items]
            starts = np.cumsum(sizes) - sizes
            flat = self.flat[np.arange(sizes.sum()) + np.repeat(self.starts[items] - starts, sizes)]
        return np.add.reduceat(self.room[:rows, flat], starts, axis=1)

    def bounds(self, tree: Tree, low: int, high: int, items: np.ndarray) -> np.ndarray:
        terms, tfs, m = tree.summary(low, high)
        self.room[0, terms] = self.weights[terms] * _worth(tfs, np.int64(m))
        found = self.sums(1, items)[0]
        self.room[0, terms] = 0
        return found

    def score(self, tree: Tree, low: int, high: int, items: np.ndarray) -> None:
        """Exact scores of a leaf's documents for the items that have reached it."""
        self.visited += high - low
        a, b = tree.starts[low], tree.starts[high]
        rows = np.repeat(np.arange(high - low), np.diff(tree.starts[low : high + 1]))
        terms = tree.terms[a:b]
        self.room[rows, terms] = self.weights[terms] * _worth(tree.tfs[a:b], tree.m[low:high][rows])
        found = self.sums(high - low, items)
        self.room[rows, terms] = 0
        good = found >= self.best.least[items]
        gained = np.flatnonzero(good.any(axis=0))
        for j in gained.tolist():
            at = np.flatnonzero(good[:, j])
            self.best.add(int(items[j]), found[at, j], [tree.ids[low + i] for i in at.tolist()])
        self.best.settle(items[gained])

    def walk(self, tree: Tree) -> None:
        """Depth first; an item leaves a subtree whose bound is below its k-th best score (equal ones may win by identifier)."""
        stack = [(0, len(tree.ids), 0, np.arange(len(self.starts)), None)]
        while stack:
            low, high, depth, items, bound = stack.pop()
            if bound is not None:
                items = items[bound >= self.best.least[items]]
            if high == low or not len(items):
                continue
            if high - low <= LEAF:
                self.score(tree, low, high, items)
                continue
            below = []
            for a, b, d in tree.children(low, high, depth):
                limit = self.bounds(tree, a, b, items)
                open_ = limit >= self.best.least[items]
                if open_.any():
                    below.append((int(limit.max()), (a, b, d, items[open_], limit[open_])))
            stack += [node for _, node in sorted(below, key=lambda x: x[0])]


def trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, length: int) -> Iterator[Tree]:
    """Trees of bounded size over the vectors of a task, terms as their places in the order of frequency."""
    ids, sizes, vectors, entries = [], [], [], 0

    def close() -> Tree:
        m = np.array([50 + 50 * n * n_docs // length for n in sizes], np.int64)
        return Tree(ids, m, vectors)

    for batch in batches:
        for id_, n, terms, tfs in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("terms"), batch.column("tfs")):
            places = rank[terms.values.to_numpy()]
            order = np.argsort(places)
            ids.append(id_)
            sizes.append(n)
            vectors.append((places[order], tfs.values.to_numpy()[order]))
            entries += len(order)
            if len(ids) >= TREE or entries >= TREE_ENTRIES:
                yield close()
                ids, sizes, vectors, entries = [], [], [], 0
    if ids:
        yield close()


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weights, flat, starts, n_docs, length = shared.value
        search = Search(weights, flat, starts, k)
        for tree in trees(batches, rank, n_docs, length):
            search.walk(tree)
        for item, held in enumerate(search.best.held):
            search.best.cut(item)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(held), pa.int32()), pa.array([x[1] for x in held], pa.int64()), pa.array([-x[0] for x in held], pa.int64())], ["item", "doc_id", "score"])

    return run


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item: of each salt first, so that no task reads what all tasks have found for an item."""
    best = "row_number() OVER (PARTITION BY {} ORDER BY score DESC, doc_id)"
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("r", F.expr(best.format("item, salt"))).filter(F.col("r") <= k).drop("r", "salt")
    return few.withColumn("rank", F.expr(best.format("item"))).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """item (its place in ``items``), rank, doc_id, score; ``items`` holds a set of terms each."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    shared = spark.sparkContext.broadcast(number)
    vectors = materialize(docs.mapInArrow(_restricted(shared), "id long, n long, terms array<int>, tfs array<long>").filter("n > 0"), "fp-vectors")
    n_docs, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(number), np.int64)
    for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().itertuples(index=False):
        df[term] = n
    order = np.lexsort((np.arange(len(df)), -df))  # the most frequent term first
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[order].tolist()], np.int64)
    flat = np.concatenate([np.sort(rank[[number[t] for t in terms]]) for terms in items])
    starts = np.cumsum([0, *map(len, items[:-1])])
    model = spark.sparkContext.broadcast((rank, weights, flat, starts, n_docs, length or 1))
    found = vectors.filter(F.size("terms") > 0).select("id", "n", "terms", "tfs").mapInArrow(_searched(model, k), "item int, doc_id long, score long")
    return _best_of(found, k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), raw_text(text).alias("text"))
    queries = items.select(F.col(item_key).alias("item_id"), raw_text(item_text).alias("body"))
    size = queries.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    placed = queries.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks)))
    kind = queries.schema["item_id"].dataType
    found = None
    for block in range(blocks):
        terms: defaultdict = defaultdict(set)
        for r in placed.filter(F.col("block") == block).collect():
            terms[r["item_id"]].update(terms_of(bytes(r["body"])))
        names = [i for i, t in terms.items() if t]
        if not names:
            continue
        part = _search_block(rows, [terms[i] for i in names], k)
        keys = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
        part = materialize(part.join(keys, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "fp-found")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if found is None else found
