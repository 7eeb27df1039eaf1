"""Rolling anomaly scores over past readings only."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from alarmlake.plans.segments import RUN_BITS, blocks_with_halo, row_numbers, run_of
from alarmlake.settings import DETECTOR_WINDOW, MAX_DOUBLE, STD_FLOOR

ASSET_SIGNAL = ["turbine_id", "signal"]
BLOCK_ROWS = 1 << 16


def _z(value: Column, n: Column, mean: Column, std: Column, previous: Column) -> Column:
    """|value - mean| / max(std, floor). Zero spread means every past value equals
    ``previous``, which replaces the rounded mean."""
    center = F.when(std == 0, previous).otherwise(mean)
    spread = F.greatest(std, F.lit(STD_FLOOR))
    gap = F.abs(value - center)
    raw = F.when(gap <= MAX_DOUBLE, gap / spread).otherwise(F.abs(value / spread - center / spread))
    finite = F.when(raw <= MAX_DOUBLE, raw).otherwise(F.lit(MAX_DOUBLE))
    return F.when(n < 2, F.lit(0.0)).otherwise(finite)


def zscores(readings: DataFrame, window: int = DETECTOR_WINDOW, block_rows: int = BLOCK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """Add ``score``: absolute population z-score of each reading against the previous
    ``window`` non-null readings of its key, (station, signal) by default; null readings score 0.

    Keys are cut into blocks of ``block_rows`` rows that repeat the ``window`` rows before them, so
    every frame stays whole and a long key is spread.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    seen = readings.withColumn("_seen", F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*(keys or ASSET_SIGNAL), "_seen"]
    seen = blocks_with_halo(row_numbers(seen, keys), "_rn", max(block_rows, window), window)
    part = W.partitionBy(*keys, "_block").orderBy("_rn")
    frame = part.rowsBetween(-window, -1)
    scored = seen.select(
        "*",
        F.count("value").over(frame).alias("_n"),
        F.avg("value").over(frame).alias("_mean"),
        F.stddev_pop("value").over(frame).alias("_std"),
        F.lag("value").over(part).alias("_prev"),
    ).where(~F.col("_halo"))
    z = _z(F.col("value"), F.col("_n"), F.col("_mean"), F.col("_std"), F.col("_prev"))
    return scored.withColumn("score", F.when(F.col("_seen"), z).otherwise(F.lit(0.0))).select(*readings.columns, "score")


def event_readings(events: DataFrame) -> DataFrame:
    """Readings of an event stream: one row per (seq, signal)."""
    return events.select("seq", "turbine_id", F.explode("signals").alias("signal", "value"))


def event_scores(events: DataFrame, window: int = DETECTOR_WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """seq and the highest signal score of every event that carries readings."""
    scored = zscores(event_readings(events), window, block_rows)
    return scored.groupBy("seq").agg(F.max("score").alias("anomaly_score"))


def with_anomaly(events: DataFrame, window: int = DETECTOR_WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Events with ``anomaly_score``; events without readings score 0."""
    scores = event_scores(events, window, block_rows)
    return events.join(scores, "seq", "left").withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(0.0)))


def running_scale(readings: DataFrame, bits: int = RUN_BITS) -> DataFrame:
    """Add ``scaled_before`` and ``scaled_after``: min/max scaling to [0, 1] with the range
    seen before the reading and with the range including it; constant ranges give 0.

    Running extremes are taken inside runs of 2**bits arrivals and combined with the
    extremes of all earlier runs of the key.
    """
    keys = ASSET_SIGNAL
    runs = readings.withColumn("_run", run_of("seq", bits))
    earlier = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    per_run = (
        runs.groupBy(*keys, "_run")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .select(*keys, "_run", F.min("lo").over(earlier).alias("_lo"), F.max("hi").over(earlier).alias("_hi"))
    )
    inside = W.partitionBy(*keys, "_run").orderBy("seq")
    past, upto = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    value = F.col("value")
    joined = runs.select(
        "*",
        F.min("value").over(past).alias("_plo"),
        F.max("value").over(past).alias("_phi"),
        F.min("value").over(upto).alias("_ulo"),
        F.max("value").over(upto).alias("_uhi"),
    ).join(per_run, [*keys, "_run"])

    def scaled(lo: Column, hi: Column) -> Column:
        inside_range = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / (hi - lo)))
        return F.when(value.isNull() | lo.isNull(), F.lit(None)).when(hi == lo, F.lit(0.0)).otherwise(inside_range)

    return joined.select(
        *readings.columns,
        scaled(F.least("_plo", "_lo"), F.greatest("_phi", "_hi")).alias("scaled_before"),
        scaled(F.least("_ulo", "_lo"), F.greatest("_uhi", "_hi")).alias("scaled_after"),
    )


# Half-space forest shape.
HST_TREES = 10
HST_DEPTH = 8
HST_SEED = 42
HST_MIN_SHARE = 0.1
HST_MARGIN = 0.15


@lru_cache(maxsize=8)
def _forest(features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded trees over the unit cube: split feature and split point of each inner node."""
    inner = 2**HST_DEPTH - 1
    rng = np.random.default_rng(seed)
    which = rng.integers(0, features, size=(HST_TREES, inner))
    where = rng.uniform(HST_MARGIN, 1 - HST_MARGIN, size=(HST_TREES, inner))
    split = np.empty((HST_TREES, inner))
    for t in range(HST_TREES):
        low = np.zeros((inner, features))
        high = np.ones((inner, features))
        for node in range(inner):
            f = which[t, node]
            split[t, node] = low[node, f] + where[t, node] * (high[node, f] - low[node, f])
            for child, side in ((2 * node + 1, high), (2 * node + 2, low)):
                if child < inner:
                    low[child], high[child] = low[node], high[node]
                    side[child, f] = split[t, node]
    return which, split


def forest_rows(features: int, seed: int = HST_SEED) -> list[tuple[int, int, int, float]]:
    """(tree, node, feature, split) of every inner node; the children of node i are 2i + 1 (below the split) and 2i + 2."""
    which, split = _forest(features, seed)
    return [(t, i, int(which[t, i]), float(split[t, i])) for t in range(HST_TREES) for i in range(which.shape[1])]


def _paths(points: np.ndarray, which: np.ndarray, split: np.ndarray) -> np.ndarray:
    """Node index per (row, tree, depth)."""
    rows = np.arange(len(points))
    out = np.zeros((len(points), HST_TREES, HST_DEPTH + 1), dtype=np.int64)
    for t in range(HST_TREES):
        node = np.zeros(len(points), dtype=np.int64)
        for depth in range(HST_DEPTH):
            right = points[rows, which[t, node]] >= split[t, node]
            node = 2 * node + 1 + right
            out[:, t, depth + 1] = node
    return out


def half_space_scores(events: DataFrame, signals: list[str], window: int = DETECTOR_WINDOW, seed: int = HST_SEED, windows_per_block: int = 64) -> DataFrame:
    """seq and half-space-forest score in [0, 1] of each event with readings.

    Readings are min/max scaled over the past of their (station, signal). Events are counted
    per station in windows of ``window``; a window is scored with the node masses of the window
    before it, so the first one scores 0. Blocks of whole windows, each with one halo window,
    are scored independently, so a station of any size is spread over tasks. The feature set
    is fixed to ``signals``; other names are an error.
    """
    known = F.array_contains(F.array(*[F.lit(s) for s in signals]), F.col("signal"))
    guarded = F.when(known, F.col("signal")).otherwise(
        F.raise_error(F.concat(F.lit("signal set is fixed; unexpected "), F.col("signal"))).cast("string")
    )
    readings = event_readings(events).where("value IS NOT NULL").withColumn("signal", guarded)
    scaled = running_scale(readings)
    vectors = scaled.groupBy("seq", "turbine_id").agg(
        *[F.coalesce(F.max(F.when(F.col("signal") == s, F.col("scaled_before"))), F.lit(0.0)).alias(f"b{i}") for i, s in enumerate(signals)],
        *[F.coalesce(F.max(F.when(F.col("signal") == s, F.col("scaled_after"))), F.lit(0.0)).alias(f"a{i}") for i, s in enumerate(signals)],
    )
    block_rows = window * windows_per_block
    blocks = blocks_with_halo(row_numbers(vectors, ["turbine_id"]), "_rn", block_rows, window)
    count = len(signals)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        which, split = _forest(count, seed)
        learn = _paths(pdf[[f"a{i}" for i in range(count)]].to_numpy(), which, split)
        ask = _paths(pdf[[f"b{i}" for i in range(count)]].to_numpy(), which, split)
        number = ((pdf["_rn"].to_numpy() - 1) // window).astype(np.int64)
        number -= number.min()
        windows, nodes = int(number.max()) + 1, 2 ** (HST_DEPTH + 1) - 1
        full = np.bincount(number, minlength=windows) == window
        ready = (number > 0) & full[number - 1]
        weight = 2.0 ** np.arange(HST_DEPTH + 1)
        total = np.zeros(len(pdf))
        for t in range(HST_TREES):
            cells = number[:, None] * nodes + learn[:, t]
            mass = np.bincount(cells.ravel(), minlength=windows * nodes)
            along = mass[np.maximum(number - 1, 0)[:, None] * nodes + ask[:, t]]
            # The walk ends below a node that holds too few readings.
            heavy = np.cumprod(along >= HST_MIN_SHARE * window, axis=1)
            alive = np.hstack([np.ones((len(pdf), 1)), heavy[:, :-1]])
            total += (along * alive * weight).sum(axis=1)
        top = HST_TREES * window * weight.sum()
        scores = np.where(ready, np.clip(1 - total / top, 0.0, 1.0), 0.0)
        keep = ~pdf["_halo"].to_numpy()
        return pd.DataFrame({"seq": pdf["seq"].to_numpy()[keep], "anomaly_score": scores[keep]})

    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("anomaly_score", T.DoubleType())])
    return blocks.groupBy("turbine_id", "_block").applyInPandas(score, schema)


DETECTORS = {"zscore": event_scores, "hst": half_space_scores}


def detector(method: str):
    """Batch scorer by configured name."""
    if method not in DETECTORS:
        raise ValueError(f"unknown detector {method!r}; expected one of {sorted(DETECTORS)}")
    return DETECTORS[method]
