"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order ``order`` down to 0, over all 256 byte values; only contexts and
successors that were seen are stored. A byte that a context has seen costs its share of the context's counts; else the context escapes
(method C: as often as it has distinct successors) to the next shorter one, where bytes already ruled out are excluded; below order 0
all bytes are alike. A context that was never seen costs nothing and passes to the next shorter one. Statistics are frozen
after training, so the cost of every stored successor, and of every escape with its exclusion, is one number, and a text's
exact code length is a sum of them. The language with the shortest code is predicted; its posterior under equal priors is the score.

Counts are added up in each task before they are shuffled. Languages are broadcast in groups whose tables stay within
``max_bytes`` (a language larger than that is a group of its own; its size follows the distinct (order + 1)-grams of its
bytes and not the number of texts), one group after another; code lengths travel with the rows from group to group.

``keep_known`` also rejects a text whose best language codes it much worse than it codes its own training texts: with m and d
the mean and the standard deviation of the bits of a training byte, itself left out of the statistics (what was seen once escapes), a text of n bytes may take n m (1 + slack) + spread d sqrt(n) bits.

Defined cases: null text, or text without a letter, is ``und`` with score 0, as is every text if nothing was learned;
equal code lengths go to the first language by name; rows with a null language, and null texts, teach nothing; rows
that repeat an identifier are predicted on their own; texts of any length are coded whole, a million bytes at a time;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlake.session import materialize

UNKNOWN = "und"
ORDER = 3
MAX_BYTES = 256 << 20
CHUNK = 1 << 20
FLUSH = 1 << 21
SLACK = 0.75
SPREAD = 6.0
UNIFORM = 8.0  # bits of a byte below order 0
CONTEXT = 1 << 55  # marks the row of a context's escape; the order stands above bit 56


@dataclass
class Tree:
    """One language. By order: sorted cells (context and successor as a number, the successor in the lowest byte) with their bits; sorted contexts with the bits of their escape."""

    cells: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    mean: float
    deviation: float


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, place = np.unique(keys, return_inverse=True)
    return held, np.bincount(place, n, len(held)).astype(np.int64)


def grow(cells: np.ndarray, n: np.ndarray, order: int) -> Tree:
    """Tree from the counts of cells of the highest order."""
    tree, total = Tree([], [], [], [], 0.0, 0.0), n.sum()
    lower = lower_cells = left_out = None
    for k in range(order + 1):
        own, seen = _summed(cells & ((1 << 8 * (k + 1)) - 1), n)
        below = np.full(len(own), 1 / 256) if k == 0 else lower[np.searchsorted(lower_cells, own & ((1 << 8 * k) - 1))]
        context, first = np.unique(own >> 8, return_index=True)
        kinds, times = np.diff(np.append(first, len(own))), np.add.reduceat(seen, first)
        free = np.maximum(1 - np.add.reduceat(below, first), 1e-15)
        away = np.where(kinds == 256, 0.0, kinds / (times + kinds))
        chance = seen / np.repeat(times, kinds) * (1 - np.repeat(away, kinds))
        tree.cells.append(own)
        tree.bits.append(-np.log2(chance))
        tree.contexts.append(context)
        tree.escapes.append(np.where(kinds == 256, 0.0, np.log2(free) - np.log2(np.maximum(away, 1e-300))))
        # what the byte costs if it had not been there itself: what was seen once escapes
        shorter = np.full(len(own), UNIFORM) if k == 0 else left_out[np.searchsorted(lower_cells, own & ((1 << 8 * k) - 1))]
        left_out = np.where(seen > 1, tree.bits[k], np.repeat(tree.escapes[k], kinds) + shorter)
        lower, lower_cells = chance, own
    tree.mean = float((left_out * seen).sum() / total)
    tree.deviation = float(np.sqrt(max(0.0, (left_out**2 * seen).sum() / total - tree.mean**2)))
    return tree


class Model:
    """Trees of some languages in one hash table: a row of bits, one per language, for every cell and context that any of them has seen."""

    def __init__(self, languages: list[str], trees: list[Tree], order: int) -> None:
        self.languages, self.order = languages, order
        self.means, self.deviations = np.array([t.mean for t in trees]), np.array([t.deviation for t in trees])
        keys, rows, shorter, shorter_bits = [], [], None, None
        for k in range(order + 1):
            cells, contexts = np.unique(np.concatenate([t.cells[k] for t in trees])), np.unique(np.concatenate([t.contexts[k] for t in trees]))
            escapes, bits = np.zeros((len(contexts), len(trees))), np.empty((len(cells), len(trees)))
            for j, t in enumerate(trees):
                escapes[np.searchsorted(contexts, t.contexts[k]), j] = t.escapes[k]
            bits[:] = UNIFORM if k == 0 else shorter_bits[np.searchsorted(shorter, cells & ((1 << 8 * k) - 1))]
            bits += escapes[np.searchsorted(contexts, cells >> 8)]
            for j, t in enumerate(trees):
                bits[np.searchsorted(cells, t.cells[k]), j] = t.bits[k]
            keys += [cells | k << 56, contexts | k << 56 | CONTEXT]
            rows += [bits, escapes]
            shorter, shorter_bits = cells, bits
        keys = np.concatenate(keys).astype(np.uint64)
        self.bits = np.concatenate(rows).astype(np.float32)
        self.shift = 64 - max(4, (2 * len(keys)).bit_length())
        self.keys, self.rows = np.zeros(1 << 64 - self.shift, np.uint64), np.full(1 << 64 - self.shift, -1, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[slot[left]] < 0
            self.rows[slot[left[free]]] = left[free]  # one of those that ask for a slot gets it
            left = left[self.rows[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.rows) - 1)
        held = self.rows >= 0
        self.keys[held] = keys[self.rows[held]]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slots(keys)
        found = self.rows[slot]
        rest = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.rows) - 1)
            found[rest] = self.rows[slot[rest]]
            rest = rest[(self.keys[slot[rest]] != keys[rest]) & (found[rest] >= 0)]
        return found

    def costs(self, cells: np.ndarray) -> np.ndarray:
        """Bits of each successor after its context, given as cells of the highest order, under every language."""
        out = np.zeros((len(cells), len(self.languages)), np.float32)
        rest = np.arange(len(cells))
        for k in range(self.order, -1, -1):
            own = cells[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            row = self.find(own | np.uint64(k << 56))
            if k == self.order:
                out = self.bits[row]
                out[row < 0] = 0
            else:
                out[rest[row >= 0]] += self.bits[row[row >= 0]]
            rest, own = rest[row < 0], own[row < 0]
            if not len(rest):
                return out
            row = self.find(own >> np.uint64(8) | np.uint64(k << 56 | CONTEXT))
            out[rest[row >= 0]] += self.bits[row[row >= 0]]
        out[rest] += np.float32(UNIFORM)
        return out


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _cells(texts: list[bytes], order: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells of all bytes of ``texts``, about CHUNK at a time, with the place of the first; a text begins after ``order`` line ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = b"\n" * order
    joined = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    ends = np.cumsum(sizes)
    for a in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
        b = min(a + CHUNK, int(ends[-1]))
        own = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1)
        left, right = np.maximum(ends[own] - sizes[own], a), np.minimum(ends[own], b)
        at = np.arange(a, b) + np.repeat(order * (own + 1), right - left)
        cells = joined[at].astype(np.uint64)
        for k in range(1, order + 1):
            cells |= joined[at - k].astype(np.uint64) << np.uint64(8 * k)
        yield a, cells


def _count(order: int):
    """lang, cell, n of the texts of a task, added up as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def add(name: str, texts: list[bytes]) -> None:
            nonlocal size
            for _, cells in _cells(texts, order):
                part = np.unique(cells.astype(np.uint32) if order < 4 else cells, return_counts=True)
                held.setdefault(name, []).append((part[0].astype(np.int64), part[1]))
                size += len(part[0])

        def fold() -> None:
            nonlocal size
            for name, parts in held.items():
                held[name] = [_summed(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]
            size = sum(len(p[0][0]) for p in held.values())

        def rows() -> Iterator[pa.RecordBatch]:
            for name, [(cells, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells), pa.array(n, pa.int64())], ["lang", "cell", "n"])

        for batch in batches:
            own = np.array(batch.column("lang").to_pylist(), object)
            for name in dict.fromkeys(own):
                add(name, _bytes_of(batch.column("text").filter(pa.array(own == name))))
            if size > FLUSH:
                fold()
                if size > FLUSH // 2:
                    yield from rows()
                    held.clear()
                    size = 0
        fold()
        yield from rows()

    return run


def train(texts: DataFrame, order: int = ORDER, max_bytes: int = MAX_BYTES) -> Iterator[Model]:
    """Models of ``texts`` (lang, text as bytes; neither null), one bounded group of languages after another. Counts come from all rows."""
    counts = materialize(texts.mapInArrow(_count(order), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "cells")
    groups, size = [], 0
    for name, cells in sorted((r["lang"], r["cells"]) for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("cells")).collect()):
        # a cell has at most as many shorter ones and contexts; slots stand for up to four times the rows
        grown = 2 * (order + 1) * (size + cells)
        if groups and grown * (48 + 4 * (len(groups[-1]) + 1)) <= max_bytes:
            groups[-1].append(name)
            size += cells
        else:
            groups.append([name])
            size = cells
    for names in groups:
        trees = []
        for name in names:
            own = counts.filter(F.col("lang") == name).select("cell", "n").toArrow()
            trees.append(grow(own.column("cell").to_numpy(), own.column("n").to_numpy(), order))
        yield Model(names, trees, order)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    bits = np.zeros((len(texts), len(model.languages)))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(texts):  # texts of about CHUNK bytes are joined at a time
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + CHUNK, "right")))
        own_ends = ends[first:last] - ends[first] + sizes[first]
        for a, cells in _cells(texts[first:last], model.order):
            own = np.arange(np.searchsorted(own_ends, a, "right"), np.searchsorted(own_ends, a + len(cells), "left") + 1)
            own = own[sizes[first + own] > 0]
            starts = np.maximum(own_ends[own] - sizes[first + own], a) - a
            bits[first + own] += np.add.reduceat(model.costs(cells), starts, axis=0, dtype=np.float64)
        first = last
    return bits


def _add_lengths(shared, passed: list[str]):
    """Code lengths under the languages of one group, behind those of the groups before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = code_lengths(shared.value, _bytes_of(batch.column("text")))
            bits = [[*a, *b] for a, b in zip(batch.column("bits").to_pylist(), more.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(bits, pa.list_(pa.float64()))], [*passed, "bits"])

    return run


def _judged(docs: DataFrame, rows: DataFrame, learn: Column, text: str, lang: str, options: dict) -> tuple[DataFrame, list[str], list[float], list[float]]:
    """``rows`` (any columns, text as bytes) with the code length under every language; the languages with mean and deviation of the bits of a byte."""
    taught = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    rows = rows.withColumn("bits", F.array().cast("array<double>"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names, means, deviations = [], [], []
    for model in train(taught.filter(F.length("text") > 0), **options):
        if names:
            rows = materialize(rows, "lengths")  # the group before has done its work
        names, means, deviations = names + model.languages, means + model.means.tolist(), deviations + model.deviations.tolist()
        rows = rows.mapInArrow(_add_lengths(docs.sparkSession.sparkContext.broadcast(model), rows.columns[:-1]), kind)
    least = F.array_min("bits")
    best = F.array_position("bits", least).cast("int")
    mass = F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), F.greatest(least - b, F.lit(-1000.0))))
    known = F.col("clear") & (F.size("bits") > 0)
    return rows.select(
        *rows.columns,
        F.when(known, best).alias("place"),
        F.when(known, F.element_at(F.array(*map(F.lit, names)), best) if names else F.lit(None)).otherwise(UNKNOWN).cast("string").alias("lang_pred"),
        F.when(known, 1 / mass).otherwise(0.0).alias("score"),
    ), names, means, deviations


def _clear(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("clear")


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> DataFrame:
    """key, lang_pred, score of every row; learned from the rows where ``learn`` holds."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), _clear(text))
    return _judged(docs, rows, learn, text, lang, options)[0].select("key", "lang_pred", "score")


def keep_known(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", min_score: float = 0.3, slack: float = SLACK, spread: float = SPREAD, **options: int) -> DataFrame:
    """``docs`` without those of unknown language, with a posterior under ``min_score``, or in no language that was learned."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("text"), _clear(text))
    judged, names, means, deviations = _judged(docs, rows, learn, text, lang, options)
    if not names:
        return docs.filter(F.lit(False))
    mean, deviation = (F.element_at(F.array(*map(F.lit, x)), F.col("place")) for x in (means, deviations))
    n = F.octet_length("text")
    fits = F.array_min("bits") <= n * mean * (1 + slack) + spread * deviation * F.sqrt(n)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & fits).select("row.*")
