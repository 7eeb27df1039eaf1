import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from alarmlake.llm import pu_quality
from alarmlake.llm.common import held_out


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.key: r for r in pu_quality.score_quality(docs, labels, held_out("doc_id", 5, 0)).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    known = [(d, q) for d, q in duckdb.connect().execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 5 == 0]
    good, bad = ([got[d] for d, q in known if q == v] for v in (1, 0))
    assert np.mean([a.score > b.score for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.5


def test_the_fit_needs_no_negatives():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (4000, 2)), draw.normal(4, 1, (1000, 2))
    edges, w = pu_quality.fit(good[:2000], np.concatenate((good[2000:], bad[:500])), 0.8)

    def score(x):
        return 1 / (1 + np.exp(-w[pu_quality.binned(x, edges)].sum(1) - w[-1]))

    assert score(good).mean() > 0.9 and score(bad[500:]).mean() < 0.2


def test_edge_cases(spark, edge, clashing, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (None, 1), (50, 1), (51, 1), (4, 0), (999, 1)], "doc_id long, quality int")
    for docs in (edge, clashing):
        got = pu_quality.score_quality(docs, labels, F.lit(False)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert pu_quality.score_quality(nothing, labels, F.lit(False)).collect() == []
    none = pu_quality.score_quality(edge, labels.filter("quality = 7"), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    bad = pu_quality.score_quality(edge, labels.filter("quality = 0"), F.lit(False)).collect()
    assert {(r.score, r.predicted) for r in bad} == {(0.0, 0)}


def test_measures_of_odd_texts():
    for text in (b"", b" \n\t", b"x" * 100_000, b"\xf0\x9f\x98\x80" * 50, b"A|B|C " * 1000):
        found = pu_quality.measures(text)
        assert len(found) == len(pu_quality.MEASURES) and np.isfinite(found).all()
