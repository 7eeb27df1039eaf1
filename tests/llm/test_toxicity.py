import random
import zlib

import duckdb
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from alarmlake.llm import toxicity
from alarmlake.llm.common import held_out


def measured(text, strong=(), weak=()):
    return dict(zip(toxicity.FEATURES, toxicity.features(text, frozenset(strong), frozenset(weak)), strict=True))


def test_features_by_hand():
    got = measured(b"You are a BADWORD!! badword, y0u badw0rd. Calm b-a-d-w-o-r-d sooo calmness", strong=[b"badword", b"calmne-"], weak=[b"calm"])
    words = "you are a badword badword y u badw rd calm b a d w o r d sooo calmness".split()
    assert got["words"] == np.log1p(len(words)) and got["strong"] == 2 / len(words) and got["strong_kinds"] == 1
    assert got["weak"] == 1 / len(words) and got["stems"] == 1 / len(words) and got["second_person"] == 2 / len(words)
    assert got["proximity"] == 1.0 and got["worst_stretch"] == 2.0
    assert got["mixed"] == 2 / len(words) and got["spaced"] == 1 / len(words) and got["stretched"] == 1 / len(words)
    assert np.isclose(got["disguised"], np.log1p(2)) and got["shouted"] == 1 / len(words) and got["runs_of_marks"] == 1 / len(words)


def test_proximity_and_stretch_against_all_pairs():
    draw = random.Random(2)
    for _ in range(50):
        words = [draw.choice(["you", "idiot", *["word"] * 20]) for _ in range(300)]
        hits, second = ([i for i, w in enumerate(words) if w == x] for x in ("idiot", "you"))
        got = measured(" ".join(words).encode())
        near = [any(abs(h - s) <= toxicity.NEAR for s in second) for h in hits]
        assert np.isclose(got["proximity"], np.mean(near) if near else 0)
        assert got["worst_stretch"] == max((sum(h <= x < h + toxicity.STRETCH for x in hits) for h in hits), default=0)


def test_features_of_odd_texts():
    for text in (b"", b" \n", b"x" * 100_000, b"a " * 100_000, b"\xf0\x9f\x98\x80" * 50, b"!?" * 10_000, b"1d10t " * 1000):
        assert np.isfinite(toxicity.features(text, frozenset(), frozenset())).all()


def test_lexicon_against_counts(spark):
    rows = [(1, f"insult{'abc'[i % 3] * 2} foul word") for i in range(30)] + [(0, "a word of peace")] * 200 + [(0, "foul")]
    got = {bytes(r.word).decode(): r.strong for r in toxicity.learn_lexicon(spark.createDataFrame(rows, "value int, text string").selectExpr("value", "CAST(text AS BINARY) AS text"), 30, 201).collect()}
    # All toxic texts hold the beginning, 10 of 30 each whole word, and all the word that one other text holds too; "word" is everywhere.
    assert got == {"insult-": True, "insultaa": True, "insultbb": True, "insultcc": True, "foul": True}


def test_calibration_is_pool_adjacent_violators(spark):
    draw = random.Random(4)
    rows = [(x := draw.uniform(-3, 3), float(draw.random() < 1 / (1 + np.exp(-x)))) for _ in range(300)]
    model = toxicity.calibrated(spark.createDataFrame(rows, f"{toxicity.MARGIN} double, value double"))
    blocks = []
    for x, y in sorted(rows):
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], a[1] + b[1]])
    want = [s / n for s, n in blocks for _ in range(int(n))]
    got = [r.score for r in model.transform(spark.createDataFrame(sorted(rows), f"{toxicity.MARGIN} double, value double")).orderBy(toxicity.MARGIN).collect()]
    assert np.allclose(got, want)


def test_trees_find_an_interaction(spark):
    draw = random.Random(6)
    rows = [(Vectors.dense([a := draw.random(), b := draw.random()]), float((a > 0.5) != (b > 0.5))) for _ in range(600)]
    train = spark.createDataFrame(rows, ["x", "value"])
    got = toxicity.with_margin(toxicity.boosted(train), train).collect()
    assert np.mean([(r[toxicity.MARGIN] > 0) == (r.value == 1) for r in got]) > 0.95


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.key: r for r in toxicity.score_toxicity(docs, labels, held_out("doc_id", 5, 0)).collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    known = [(d, y) for d, y in duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").fetchall() if got[d].held_out]
    bad, good = ([got[d] for d, y in known if y == v] for v in (1, 0))
    assert np.mean([r.predicted for r in bad]) > 0.9 and np.mean([r.predicted for r in good]) < 0.01


def test_edge_cases(spark, edge, clashing, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1), (50, 1), (51, 0), (4, 0), (999, 1)], "doc_id long, toxic int")
    for docs in (edge, clashing):
        got = toxicity.score_toxicity(docs, labels, F.lit(False)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(nothing, labels, F.lit(False)).collect() == []
    for value, want in ((7, (0.0, 0)), (0, (0.0, 0)), (1, (1.0, 1))):
        assert {(r.score, r.predicted) for r in toxicity.score_toxicity(edge, labels.filter(f"toxic = {value}"), F.lit(False)).collect()} == {want}
    every = toxicity.score_toxicity(edge, labels, F.lit(True)).collect()
    assert {r.score for r in every} == {0.0}
