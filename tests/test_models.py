"""Classifiers of many revisions against a plain minimiser, one model at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlake.functions.features import encoded_features, numeric_features
from alarmlake.operators import journal, learn, models, rules
from alarmlake.schemas import RULE
from alarmlake.settings import PolicySettings
from alarmlake.sources import adapters, scans
from tests.test_policy import event, frame, num, rule

BATCH = "rule_id string, v_from bigint, v_to bigint, position int, features map<string,double>, label int, weight double"
END = journal.OPEN_END


def plain_fit(rows, reg=0.01):
    """Newton steps on dense arrays: feature -> weight."""
    names = sorted({f for r in rows for f in r[4]})
    x = np.array([[1.0] + [r[4].get(f, 0.0) for f in names] for r in rows])
    y, c = np.array([r[5] for r in rows], float), np.array([r[6] for r in rows], float)
    ridge = np.diag([0.0] + [reg] * len(names))
    w = np.zeros(len(names) + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (c * (p - y)) / c.sum() + ridge @ w
        curve = (x * (c * p * (1 - p))[:, None]).T @ x / c.sum() + ridge
        w -= 0.5 * np.linalg.solve(curve, gradient)
    return dict(zip([models.INTERCEPT, *names], w))


def random_batches(seed):
    rng = random.Random(seed)
    spans = {"r1": (2, 6), "r2": (3, END), "r3": (4, 5)}
    return [
        (name, lo, hi, i, {f: rng.choice([1.0, rng.uniform(-1, 1)]) for f in rng.sample("abcdefg", rng.randrange(0, 5))}, int(rng.random() < 0.4), rng.choice([0.2, 1.0, 5.0]))
        for name, (lo, hi) in spans.items()
        for i in range(25)
    ]


@pytest.mark.parametrize("seed,chunk_rows", [(1, 7), (2, 20_000)])
def test_every_revision_has_its_own_minimum(spark, seed, chunk_rows):
    rows = random_batches(seed)
    versions = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 4, 5, 6)], "version int")
    got = {}
    for r in models.fit_revisions(spark.createDataFrame(rows, BATCH), versions, chunk_rows=chunk_rows).collect():
        assert got.setdefault(r.version, {}).setdefault(r.feature, r.weight) == r.weight
    assert sorted(got) == [2, 3, 4, 5, 6]  # nothing is taught at the first revision
    for version, weights in got.items():
        want = plain_fit([r for r in rows if r[1] <= version < r[2]])
        assert weights == pytest.approx(want, abs=1e-6)
    assert got[5] == pytest.approx(got[3], abs=1e-7) and got[4] != pytest.approx(got[3], abs=1e-3)  # undo is a refit without the batch


def test_separable_examples_need_shorter_steps(spark):
    rows = [("r", 2, END, i, {"big": 1000.0 * (1 if i % 2 else -1), "x": 1.0}, i % 2, 1.0 + 99 * (i == 0)) for i in range(10)]
    got = {r.feature: r.weight for r in models.fit_revisions(spark.createDataFrame(rows, BATCH), spark.createDataFrame([(2,)], "version int"), reg=1e-6).collect()}
    x = np.array([[1.0, r[4]["big"], 1.0] for r in rows])
    w, c, y = np.array([got[""], got["big"], got["x"]]), np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
    gradient = x.T @ (c * (1 / (1 + np.exp(-x @ w)) - y)) / c.sum() + 1e-6 * np.array([0, w[1], w[2]])
    assert np.abs(gradient).max() < 1e-8


def test_edge_cases(spark):
    fit = lambda rows, versions: {(r.version, r.feature): r.weight for r in models.fit_revisions(spark.createDataFrame(rows, BATCH), spark.createDataFrame([(v,) for v in versions], "version int")).collect()}
    assert fit([], [2]) == {} and fit(random_batches(1), []) == {}
    ones = [("r", 2, 3, i, {"a": 1.0}, 1, 1.0) for i in range(3)]
    assert fit(ones, [2, 3]) == {(2, ""): models.CERTAIN}
    assert fit([r[:5] + (0, 1.0) for r in ones], [2]) == {(2, ""): -models.CERTAIN}
    bare = [("r", 2, END, i, None if i else {}, int(i == 0), 1.0) for i in range(4)]  # no features at all
    assert fit(bare, [2])[2, ""] == pytest.approx(math.log(1 / 3), abs=1e-7)


def test_agrees_with_the_single_fit(spark, sf_dir):
    e = adapters.scored_events(spark, sf_dir)
    new = adapters.sample_rules(spark, sf_dir).where("pattern.kind = 'learned'").orderBy("rule_order").limit(1)
    batch = learn.mint_examples(e, new.limit(0), new)
    model, slots = learn.fit(batch, max_iter=500)
    single = {r.feature: r.weight for r in learn.coefficients(model, slots).collect()}
    rows = batch.select("rule_id", F.lit(2).cast("bigint").alias("v_from"), F.lit(END).alias("v_to"), F.col("seq").alias("position"), "features", "label", "weight")
    got = {r.feature: r.weight for r in models.fit_revisions(rows, spark.createDataFrame([(2,)], "version int")).collect()}
    assert got.pop(models.INTERCEPT) == pytest.approx(model.intercept, abs=1e-2)
    assert got == pytest.approx(single, abs=1e-2)


def test_rescoring_uses_the_classifier_of_each_revision(spark):
    s = PolicySettings(ring_size=6)
    learned = [rule(k, "suppress", code=c, kind="learned", conditions=[num("alarm_code", "eq", c)]) for k, c in ((1, 5), (2, 6))]
    e, table = frame(spark, [event(i, code=5 + i % 2, station="ab"[i // 2 % 2]) for i in range(40)], learned)
    empty = spark.createDataFrame([], scans.JOURNAL_LINE)
    one, two = (spark.createDataFrame([r], RULE) for r in learned)
    lines = learn.learn_lines(empty, one, learn.mint_examples(e, table.limit(0), one))
    lines = lines.unionByName(learn.learn_lines(lines, two, learn.mint_examples(e, one, two)), allowMissingColumns=True)
    lines = lines.unionByName(learn.undo_lines(lines, "r1"), allowMissingColumns=True)
    steps = spark.createDataFrame([(2, 12), (3, 24), (4, 33)], "version bigint, applied_at bigint")
    fitted = models.fit_revisions(journal.batch_lifetimes(lines), steps, reg=0.001)
    weights = {(r.version, r.feature): r.weight for r in fitted.collect()}
    assert {v for v, _ in weights} == {2, 3, 4}
    placed = models.with_revision_probability(journal.with_revision(e, steps, s.ring_size), fitted)
    named = {r.seq: r.f for r in e.select("seq", encoded_features(numeric_features()).alias("f")).collect()}
    probability = {}
    for r in placed.collect():
        z = weights.get((r.revision, ""), 0.0) + sum(x * weights.get((r.revision, f), 0.0) for f, x in named[r.seq].items())
        assert r.probability == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        probability[r.seq] = r.revision, r.probability
    got = {r.seq: r for r in journal.rescored(e, lines, steps, s, models=fitted).collect()}
    assert len(got) == 40
    active = {1: {}, 2: {5: "r1"}, 3: {5: "r1", 6: "r2"}, 4: {6: "r2"}}
    for seq, r in got.items():
        revision, p = probability[seq]
        hides = active[revision].get(5 + seq % 2)
        assert r.revision == revision and r.show == (hides is None or p < s.nuisance_threshold)
    assert any(not r.show for r in got.values()) and any(r.show for r in got.values())
    # Both batches mark the same events with different labels, so r2 decides only once the model is fitted without r1's.
    for version, name in ((2, "classifier:r1"), (4, "classifier:r2")):
        assert {r.suppressed_by for r in journal.newly_suppressed(e, lines, steps, version, s, models=fitted).collect()} == {name}
    assert rules.counters(journal.rescored(e, lines, steps, s)).first().suppressed == 0  # without models: one half
