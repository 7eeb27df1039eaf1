"""Packing documents into sequences by vector best-fit.

A document becomes token ids and an end id. One longer than a sequence is cut into whole sequences behind a first
piece that may be shorter. Pieces are dealt evenly into groups of bounded size; in a group, by decreasing
length, each piece goes to the open sequence that suits it best under every residual capacity: tokens, documents
and attention cost (the sum of squared piece lengths). ``norm`` takes the sequence whose residual after the piece is least
(weighted norm), ``dot`` the one whose residual is most aligned with the piece (weighted dot-product).
Open sequences are kept by residual tokens; in each such bucket the last one used stands for the others.

Ids come from the byte-level BPE vocabulary file. Its rank form gives the same ids several times faster, so that is
used; the name of a special token inside a text has its own id in both.

Defined cases: null or empty text is one end id; rows that repeat an identifier are packed on their own; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.session import materialize

LENGTH = 1024
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}
GROUP = 1 << 15


@cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and the end id, as unsigned 32-bit numbers."""
    ids = encoder(path).encode_to_numpy(text, allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column("key"), ([], [], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = token_ids(text, path)
                for piece, (at, size) in enumerate(cut(len(ids), length)):
                    for held, value in zip(out, (i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes()))):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *(pa.array(x, pa.int64()) for x in out[1:])], ["key", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return rows.mapInArrow(_pieces(path, length), f"key {kind}, piece long, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, length: int = LENGTH, max_docs: int = LENGTH, max_cost: int = LENGTH**2, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    A piece that breaks a capacity by itself gets a bin of its own.
    """
    place, offset = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    whole = np.flatnonzero((sizes >= length) | (sizes**2 >= max_cost))
    place[whole] = np.arange(len(whole))
    used = len(whole)
    buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
    # Of each bucket's representative: residual documents and cost, -1 where the bucket is empty.
    docs, cost = np.full(length + 1, -1.0), np.full(length + 1, -1.0)
    residual = np.arange(length + 1) / length
    rest = np.flatnonzero((sizes < length) & (sizes**2 < max_cost))
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    w = weights

    def show(r: int) -> None:
        docs[r], cost[r] = buckets[r][-1][1:] if buckets[r] else (-1, -1)

    for i, t in zip(rest.tolist(), sizes[rest].tolist()):
        fits = (docs[t:] >= 1) & (cost[t:] >= t * t)
        if rule == "norm":
            score = w[0] * (residual[t:] - t / length) ** 2 + w[1] * ((docs[t:] - 1) / max_docs) ** 2 + w[2] * ((cost[t:] - t * t) / max_cost) ** 2
        else:
            score = -(w[0] * residual[t:] * (t / length) + w[1] * docs[t:] / max_docs / max_docs + w[2] * cost[t:] / max_cost * (t * t / max_cost))
        best = int(np.argmin(np.where(fits, score, np.inf)))
        if fits[best]:
            r = best + t
            number, d, c = buckets[r].pop()
            show(r)
        else:
            r, number, d, c = length, used, max_docs, max_cost
            used += 1
        place[i], offset[i] = number, length - r
        if d > 1:  # a bin without room for another document is closed
            buckets[r - t].append((number, d - 1, c - t * t))
            show(r - t)
    return place, offset


def _pack(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one group: GROUP pieces or so
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        place, offset = best_fit(table.column("length").to_numpy(), **options)
        number = (TaskContext.get().partitionId() << 32) + place
        yield from table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).to_batches()

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, group: int = GROUP, **options) -> DataFrame:
    """Pieces with sequence_id and offset."""
    cuts = materialize(pieces(docs, key, text, ranks, options.get("length", LENGTH)), "pieces")
    groups = max(1, round(cuts.count() / group))
    kind = cuts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cuts.repartition(groups).mapInArrow(_pack(options), schema)
