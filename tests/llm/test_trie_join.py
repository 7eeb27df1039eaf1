import numpy as np
import pytest

from alarmlake.llm import trie_join
from alarmlake.llm.components import components
from tests.llm.brute import groups, simhash


def signed(x):
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def planted(n, seed):
    """Random fingerprints, chains of near ones and one crowded neighbourhood."""
    draw = np.random.default_rng(seed)
    out = {int(x) for x in draw.integers(0, 1 << 64, n, np.uint64)}
    for start in list(out)[: n // 4]:
        x = start
        for _ in range(int(draw.integers(1, 5))):
            for b in draw.choice(64, int(draw.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    hub = int(draw.integers(0, 1 << 64, dtype=np.uint64))
    out |= {hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.choice(64, (n // 4, 2))}
    return sorted(out)


@pytest.mark.parametrize("split_at", [1, 4, trie_join.BATCH])
def test_links_connect_what_is_near(spark, split_at):
    fps = planted(400, 1)
    root = groups(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in components(trie_join.near_links(df, split_at)).collect()}
    mine = [got.get(signed(x), signed(x)) for x in fps]
    first = {}
    assert [first.setdefault(m, i) for i, m in enumerate(mine)] == root


def test_walk_finds_each_pair_once():
    v = np.array(planted(600, 2), np.uint64)
    whole = tuple(np.array([x]) for x in (0, len(v), 0, len(v), 0))
    found = [p for i, j in trie_join._walk(v, whole, 0) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{x: 200 for x in range(200, 240)}} or got == {**{i: 0 for i in range(1, 61)}, 101: 100, **{x: 200 for x in range(201, 240)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [simhash(t) for _, t in rows]
    root = groups(fps)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((d is None, d or 0, signed(f), str(least.get(r))) for (d, _), f, r in zip(rows, fps, root))
    got = sorted((r.id is None, r.id or 0, r.fp, str(r.component_id)) for r in trie_join.near_duplicates(df).collect())
    assert got == want
    return root


def test_documents(spark, documents):
    check(spark.createDataFrame([(d, t) for d, t, *_ in documents], "doc_id long, text string"))


def test_edge_cases(edge, clashing, nothing):
    root = check(edge)
    kept = trie_join.keep_one(clashing)
    assert kept.schema == clashing.schema and kept.count() == len(set(root))
    assert trie_join.near_duplicates(nothing).collect() == [] and trie_join.keep_one(nothing).collect() == []
