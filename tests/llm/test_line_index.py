from collections import Counter

import numpy as np

from alarmlake.llm import line_index
from tests.llm.brute import kept_lines


def test_index_is_minimal_and_perfect():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        h = draw.integers(0, 1 << 64, (n, 2), np.uint64)
        count, first = draw.integers(2, 9, n), draw.integers(0, 1 << 40, n)
        index = line_index.LineIndex.from_bytes(line_index.LineIndex.build(h[:, 0], h[:, 1], count, first).to_bytes())
        assert sorted(index.slots(h[:, 0], h[:, 1])) == list(range(n))
        got = index.probe(h[:, 0], h[:, 1])
        assert (got[0] == count).all() and (got[1] == first).all()
        strange = draw.integers(0, 1 << 64, (1000, 2), np.uint64)
        assert (index.probe(strange[:, 0], strange[:, 1])[0] == 0).all()
        assert (index.probe(np.concatenate((h[:, 0], strange[:, 0])), np.concatenate((h[:, 1] ^ np.uint64(1), strange[:, 1])))[0] == 0).all()


def check(df, rows, **options):
    done = line_index.drop_lines(df, **options).select("rest.doc_id", "n_lines", "n_dropped", "kept").collect()
    want = Counter((d, *k) for (d, _), k in zip(rows, kept_lines(rows)))
    assert Counter(tuple(r) for r in done) == want


def test_documents(spark, documents):
    rows = [(d, t) for d, t, *_ in documents]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    check(df, rows, shard_keys=16, task_probes=20)


def test_edge_cases(edge, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    check(edge, rows)
    check(clashing, rows, shard_keys=1, task_probes=1)
    done = line_index.dedup_lines(clashing)
    assert done.schema == clashing.schema and all(r.n_chars == len(r.text) for r in done.collect())
    assert line_index.dedup_lines(nothing).collect() == []


def test_keys():
    assert line_index.line_key(b" \tABC def ghi\r\x0b") == b"abc def ghi"
    assert line_index.line_key("é".encode() * 9) is None and line_index.line_key("É".encode() * 10) == "É".encode() * 10
