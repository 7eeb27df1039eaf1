"""Classifiers whose sums are too many for one task against a plain minimiser and against those of one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmlake.operators import models
from tests.test_models import BATCH, END, plain_fit, random_batches


def versions_of(spark, *numbers):
    return spark.createDataFrame([(v,) for v in numbers], "version int")


def by_version(fitted):
    got = {}
    for r in fitted.collect():
        assert r.feature not in got.setdefault(r.version, {})
        got[r.version][r.feature] = r.weight
    return got


def test_wide_models_have_their_own_minimum(spark):
    few = [("r0", 1, 2, i, {"a": 1.0}, i % 2, 1.0 + i) for i in range(4)]  # a model that one task solves among those that none does
    rows = random_batches(3) + few
    got = by_version(models.fit_revisions(spark.createDataFrame(rows, BATCH), versions_of(spark, 1, 3, 4), chunk_rows=9, most_sums=30))
    assert sorted(got) == [1, 3, 4]
    for version, weights in got.items():
        assert weights == pytest.approx(plain_fit([r for r in rows if r[1] <= version < r[2]]), abs=1e-6)


def lone_rows(n, seed=5):
    """Examples with a feature of their own and two that others share."""
    draw = random.Random(seed)
    return [(f"r{i}", 2, END, 0, {f"own{i}": 1.0, "load": draw.uniform(-1, 1), "k": 1.0}, i % 3 // 2, draw.choice([0.5, 1.0])) for i in range(n)]


def test_no_row_and_no_task_holds_a_wide_model(spark, monkeypatch):
    rows, sizes, plain = lone_rows(300), {}, models.materialize

    def watched(df, label):
        out = plain(df, label)
        for f in out.schema.fields:
            if isinstance(f.dataType, T.ArrayType):
                sizes[label] = max(sizes.get(label, 0), out.agg(F.coalesce(F.max(F.size(f.name)), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(models, "materialize", watched)
    got = by_version(models.fit_revisions(spark.createDataFrame(rows, BATCH), versions_of(spark, 2), chunk_rows=20, most_sums=400))
    assert sizes == {"model-examples": 4, "models": 0}  # an example's own features; no model as one row
    assert got[2] == pytest.approx(plain_fit(rows), abs=1e-6)
    assert got[2] == pytest.approx(by_version(models.fit_revisions(spark.createDataFrame(rows, BATCH), versions_of(spark, 2)))[2], abs=1e-6)


def test_wide_models_with_odd_examples(spark):
    bare = [("r", 2, END, i, None if i else {}, int(i == 0), 1.0) for i in range(4)]  # no features at all
    assert by_version(models.fit_revisions(spark.createDataFrame(bare, BATCH), versions_of(spark, 2), most_sums=0))[2][""] == pytest.approx(math.log(1 / 3), abs=1e-7)
    rows = [("r", 2, END, i, {"big": 1000.0 * (1 if i % 2 else -1), "x": 1.0}, i % 2, 1.0 + 99 * (i == 0)) for i in range(10)]
    got = by_version(models.fit_revisions(spark.createDataFrame(rows, BATCH), versions_of(spark, 2), reg=0.01, most_sums=0))[2]
    x = np.array([[1.0, r[4]["big"], 1.0] for r in rows])
    w, c, y = np.array([got[""], got["big"], got["x"]]), np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
    gradient = x.T @ (c * (1 / (1 + np.exp(-x @ w)) - y)) / c.sum() + 0.01 * np.array([0, w[1], w[2]])
    assert np.abs(gradient).max() < 1e-8
