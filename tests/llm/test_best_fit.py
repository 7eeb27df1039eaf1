import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alarmlake.llm import best_fit

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(deadline=None, max_examples=200)
@given(st.text() | st.text("ab '<|>endoftx\n\t0é😀", max_size=60))
def test_ids_are_those_of_the_vocabulary_file(text):
    assert best_fit.token_ids(text, RANKS).tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, best_fit.END_ID]


def test_ids_of_long_and_special_texts():
    for text in ("x" * 50_000, "<|endoftext|> a<|endoftext|>", " " * 9000, "é" * 9000):
        assert best_fit.token_ids(text, RANKS).tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, best_fit.END_ID]


def test_cut():
    assert best_fit.cut(1) == [(0, 1)] and best_fit.cut(1024) == [(0, 1024)]
    assert best_fit.cut(1025) == [(0, 1), (1, 1024)] and best_fit.cut(3000) == [(0, 952), (952, 1024), (1976, 1024)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"max_cost": 300_000}, {"max_docs": 2, "max_cost": 500_000}])
def test_every_capacity_holds(rule, limits):
    sizes = np.random.default_rng(3).integers(1, 1025, 3000)
    place, offset = best_fit.best_fit(sizes, rule=rule, **limits)
    bins = defaultdict(list)
    for s, p, o in zip(sizes, place, offset):
        bins[p].append((o, s))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(s for _, s in held[:-1])]).tolist()
        if len(held) > 1:
            assert sum(s for _, s in held) <= 1024 and len(held) <= limits.get("max_docs", 1024) and sum(s * s for _, s in held) <= limits.get("max_cost", 1024**2)
    if not limits and rule == "norm":
        assert len(bins) <= 1.01 * -(-sizes.sum() // 1024)


def check(df, rows):
    """Every piece in its place, no gap, no token lost."""
    got, left = df.collect(), defaultdict(list)
    for d, text in rows:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (at, size) in enumerate(best_fit.cut(len(ids))):
            left[d, k].append((at, size, zlib.crc32(ids[at : at + size].tobytes())))
    for r in got:
        left[r.key, r.piece].remove((r.start, r.length, r.ids_crc32))
    assert not any(left.values())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held[:-1])]).tolist() and sum(n for _, n in held) <= 1024
    return len(sequences), sum(r.length for r in got)


def test_documents(spark, documents):
    rows = [(d, t) for d, t, *_ in documents]
    n, tokens = check(best_fit.pack(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert n <= 1.01 * -(-tokens // 1024) + 1


def test_edge_cases(edge, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    check(best_fit.pack(edge), rows)
    check(best_fit.pack(clashing, group=5), rows)
    assert best_fit.pack(nothing).collect() == []
