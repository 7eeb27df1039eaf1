"""Collapse: show the first event of a key, hide repeats until the window after the last
shown event has passed."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alarmlake.plans.segments import RUN_BITS, run_of


def hide_repeats(us: np.ndarray, width: int, anchor: int | None) -> tuple[np.ndarray, int | None]:
    """Hidden flags for times in arrival order, and the anchor left behind.

    In-order input jumps from one shown event to the next by binary search.
    """
    n = len(us)
    hidden = np.ones(n, dtype=bool)
    in_order = n > 0 and bool(np.all(us[1:] >= us[:-1])) and (anchor is None or us[0] >= anchor)
    if in_order:
        at = 0 if anchor is None else int(np.searchsorted(us, anchor + width))
        while at < n:
            hidden[at] = False
            anchor = int(us[at])
            at = int(np.searchsorted(us, anchor + width))
        return hidden, anchor
    for i, t in enumerate(us.tolist()):
        if anchor is None or not 0 <= t - anchor < width:
            hidden[i] = False
            anchor = t
    return hidden, anchor


def _next_shown(us: list[int], width: int) -> list[int]:
    """For each event taken as anchor, the index of the next shown event (n when none)."""
    n = len(us)
    out = [n] * n
    lower: list[int] = []  # indices of later, ever smaller times
    high_neg: list[int] = []  # negated later record times, for bisection
    high_at: list[int] = []
    for i in range(n - 1, -1, -1):
        t = us[i]
        while lower and us[lower[-1]] >= t:
            lower.pop()
        k = bisect_right(high_neg, -(t + width)) - 1
        after = high_at[k] if k >= 0 else n
        out[i] = min(lower[-1] if lower else n, after)
        lower.append(i)
        while high_neg and -high_neg[-1] <= t:
            high_neg.pop()
            high_at.pop()
        high_neg.append(-t)
        high_at.append(i)
    return out


def run_transfer(us: list[int], width: int) -> dict[str, list[int]]:
    """How one run maps an incoming anchor to an outgoing one.

    An anchor A is replaced at the first time below A or at or above A + width, that is at a
    running minimum or a running maximum of the run. Only records within one window of the
    first time can decide, so those are kept with the anchor each finally leads to.
    """
    n = len(us)
    follow = _next_shown(us, width)
    leads_to = [0] * n
    for i in range(n - 1, -1, -1):
        leads_to[i] = us[i] if follow[i] == n else leads_to[follow[i]]
    out: dict[str, list[int]] = {"up_t": [], "up_i": [], "up_exit": [], "down_t": [], "down_i": [], "down_exit": []}
    first = us[0]
    for name, better, done in (
        ("up", lambda t, best: t > best, lambda t: t >= first + width),
        ("down", lambda t, best: t < best, lambda t: t <= first - width),
    ):
        best = None
        for i, t in enumerate(us):
            if best is None or better(t, best):
                best = t
                out[f"{name}_t"].append(t)
                out[f"{name}_i"].append(i)
                out[f"{name}_exit"].append(leads_to[i])
                if done(t):
                    break
    return out


def apply_transfer(step, width: int, anchor: int | None) -> int:
    """Outgoing anchor of a run entered with ``anchor``."""
    up_t, down_t = step.up_t, step.down_t
    if anchor is None:
        return int(step.up_exit[0])
    u = int(np.searchsorted(up_t, anchor + width))
    d = int(np.searchsorted(-np.asarray(down_t), -anchor, side="right"))
    hits = []
    if u < len(up_t):
        hits.append((step.up_i[u], step.up_exit[u]))
    if d < len(down_t):
        hits.append((step.down_i[d], step.down_exit[d]))
    return int(min(hits)[1]) if hits else anchor


def throttle(rows: DataFrame, keys: list[str], seq: str = "seq", us: str = "us", width: str = "width_us", bits: int = RUN_BITS) -> DataFrame:
    """Add ``hidden`` to rows (primitive columns only), folding each key in ``seq`` order.

    Keys are folded per run of 2**bits arrival numbers. Keys spanning several runs first get
    the anchor that enters each run: runs are summarised in parallel and only the summaries
    are walked in order. ``width`` is constant within a key.
    """
    run_keys = [*keys, "_run"]
    placed = rows.withColumn("_run", run_of(seq, bits))
    spans = placed.groupBy(*keys).agg(F.min("_run").alias("lo"), F.max("_run").alias("hi"))
    long_keys = spans.where(F.col("lo") < F.col("hi")).select(*keys)
    key_schema = T.StructType([placed.schema[k] for k in run_keys])
    lists = ["up_t", "up_i", "up_exit", "down_t", "down_i", "down_exit"]
    summary_schema = T.StructType(
        [*key_schema.fields, T.StructField("width", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in lists]]
    )
    anchor_schema = T.StructType([*key_schema.fields, T.StructField("_anchor", T.LongType())])

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        step = run_transfer(pdf[us].tolist(), int(pdf[width].iat[0]))
        head = {k: [pdf[k].iat[0]] for k in run_keys}
        return pd.DataFrame({**head, "width": [int(pdf[width].iat[0])], **{c: [step[c]] for c in lists}})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, None
        for pdf in batches:
            entering = []
            for step in pdf.itertuples(index=False):
                key = tuple(getattr(step, k) for k in keys)
                if key != current:
                    current, anchor = key, None
                entering.append(anchor)
                anchor = apply_transfer(step, int(step.width), anchor)
            yield pdf[keys].assign(_run=pdf.iloc[:, len(keys)], _anchor=pd.array(entering, dtype="Int64"))

    renamed = [*keys, "run"]
    anchors = (
        placed.join(long_keys, keys, "left_semi")
        .select(*run_keys, seq, us, width)
        .groupBy(*run_keys)
        .applyInPandas(summarise, summary_schema)
        .withColumnRenamed("_run", "run")
        .repartition(*keys)
        .sortWithinPartitions(*renamed)
        .mapInPandas(walk, anchor_schema)
    )
    out_schema = T.StructType([*rows.schema.fields, T.StructField("hidden", T.BooleanType())])
    names = [*rows.columns, "hidden"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for k in run_keys:
                values = pdf[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(pdf))
            times = pdf[us].to_numpy(dtype="int64")
            hidden = np.empty(len(pdf), dtype=bool)
            for s, e in zip(starts.tolist(), ends.tolist()):
                key = tuple(pdf[k].iat[s] for k in run_keys)
                if key != current:
                    entering = pdf["_anchor"].iat[s]
                    current, anchor = key, None if pd.isna(entering) else int(entering)
                hidden[s:e], anchor = hide_repeats(times[s:e], int(pdf[width].iat[s]), anchor)
            yield pdf.assign(hidden=hidden)[names]

    return (
        placed.join(anchors, run_keys, "left")
        .repartition(*run_keys)
        .sortWithinPartitions(*run_keys, seq)
        .mapInPandas(fold, out_schema)
    )
