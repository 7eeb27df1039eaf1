import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from alarmlake.llm import fp_search
from tests.llm.brute import LOWER


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_search(docs, items, k):
    held = [(d, plain_terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out, asked = [], {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    for item, terms in asked.items():
        scored = []
        for d, t in held:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 20 * m)) for x in terms if tf[x])
            if score > 0:
                scored.append((-score, d is not None, d if d is not None else 0, d))
        out += [(str(item), r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_documents_against_plain_scores(spark, documents, sf_dir, block_bytes):
    rows = [(d, t) for d, t, *_ in documents]
    rows += [(d + 100_000, t) for d, t in rows[:40]] + [(7_000_000 + i, rows[3][1]) for i in range(90)]  # copies, more than a result holds
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = fp_search.search(docs.repartition(3), asked, k=20, block_bytes=block_bytes)
    assert result(got) == plain_search(rows, items, 20)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def random_tree(draw, size, width):
    weights = np.array([draw.randrange(0, 9000) for _ in range(width)], np.int64)
    weights.sort()
    vectors = []
    for _ in range(size):
        terms = sorted({min(width - 1, int(draw.expovariate(0.2))) for _ in range(draw.randrange(1, 14))})
        vectors.append((np.array(terms), np.array([draw.randrange(1, 5) for _ in terms], np.int64)))
    vectors += [vectors[0]] * 100  # one path that many documents share to its end
    m = np.array([draw.randrange(50, 400) for _ in vectors], np.int64)
    return weights, fp_search.Tree(list(range(len(vectors))), m, vectors)


def test_no_document_is_above_the_bound_of_its_node():
    draw = random.Random(3)
    weights, tree = random_tree(draw, 500, 40)
    items = [np.array(sorted(draw.sample(range(40), 6))) for _ in range(8)]
    search = fp_search.Search(weights, np.concatenate(items), np.cumsum([0, *map(len, items[:-1])]), 5)
    exact = np.array([[sum(int(weights[t]) * (10**9 * int(f) // (1000 * int(f) + 20 * int(tree.m[i]))) for t, f in zip(tree.paths[i], tree.tfs[tree.starts[i] : tree.starts[i + 1]]) if t in set(item.tolist())) for item in items] for i in range(len(tree.ids))])
    stack, leaves = [(0, len(tree.ids), 0)], []
    while stack:
        low, high, depth = stack.pop()
        assert (search.bounds(tree, low, high, np.arange(8)) >= exact[low:high].max(axis=0)).all()
        if high - low <= fp_search.LEAF:
            leaves.append((low, high))
        else:
            below = tree.children(low, high, depth)
            assert below[0][0] == low and below[-1][1] == high and all(a[1] == b[0] for a, b in zip(below, below[1:])) and len(below) > 1
            stack += below
    assert sum(b - a for a, b in leaves) == len(tree.ids)
    search.walk(tree)
    for j in range(8):
        search.best.cut(j)
        want = sorted((-int(s), tree.ids[i]) for i, s in enumerate(exact[:, j]) if s > 0)[:5]
        assert search.best.held[j] == want


def test_the_walk_leaves_subtrees_out():
    draw = random.Random(5)
    weights, tree = random_tree(draw, 4000, 60)
    items = [np.array([2, 9, 20])]
    search = fp_search.Search(weights, items[0], np.array([0]), 5)
    search.walk(tree)
    assert 0 < search.visited < len(tree.ids) // 2


def test_edge_cases(spark, edge, clashing, nothing):
    items = spark.createDataFrame([(1, "THE first line"), (1, "über straße"), (2, None), (3, ""), (None, "word 12345"), (4, "nowhere1"), (5, "the first line"), (5, "the first line")], "item_id long, text string")
    rows, asked = [(r.doc_id, r.text) for r in edge.collect()], [(r.item_id, r.text) for r in items.collect()]
    assert result(fp_search.search(edge, items)) == plain_search(rows, asked, 50) == result(fp_search.search(clashing, items.withColumn("score", fp_search.F.lit(1)).withColumn("rank", fp_search.F.lit(1))))
    assert fp_search.search(nothing, items).collect() == [] == fp_search.search(edge, items.limit(0)).collect()
