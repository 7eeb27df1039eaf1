"""Order-dependent operators: split forms equal plain forms and brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alarmlake.operators import detect, events
from alarmlake.operators.throttle import throttle
from alarmlake.plans import segments
from alarmlake.sources import adapters


def readings(spark, values, key=("a", "s")):
    rows = [(i, *key, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq bigint, turbine_id string, signal string, value double")


def scores(df, window=288, block_rows=1 << 16):
    return [r.score for r in detect.zscores(df, window, block_rows).orderBy("seq").collect()]


def test_constant_history_scores_zero_then_large(spark):
    got = scores(readings(spark, [1234567.1] * 288 + [1234567.1, 1234568.1]))
    assert got[:289] == [0.0] * 289 and got[289] == pytest.approx(1e9, rel=1e-6)


def test_nulls_do_not_advance_history(spark):
    assert scores(readings(spark, [1, None, 3, None, 2]))[-1] == 0.0
    assert scores(readings(spark, [1, 3, None, 4]))[-1] == pytest.approx(2.0)


def test_extreme_values_are_capped(spark):
    got = scores(readings(spark, [0, 0, 1.7e308, -1.7e308, 5]))
    assert all(np.isfinite(got)) and got[2] == pytest.approx(1.7976931348623157e308)


@pytest.mark.parametrize("limit", [16, 64, 1 << 20])
def test_hot_key_blocks_match_statistics(spark, limit):
    rng = random.Random(5)
    values = [None if rng.random() < 0.1 else rng.gauss(100, 3) for _ in range(400)]
    want, past = [], []
    for v in values:
        want.append(0.0 if v is None or len(past) < 2 else abs(v - statistics.mean(past[-12:])) / max(statistics.pstdev(past[-12:]), 1e-9))
        if v is not None:
            past.append(v)
    assert scores(readings(spark, values), 12, limit) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_row_numbers_and_running_scale(spark, sf_dir, bits):
    r = adapters.scada_long(spark, sf_dir)
    split = segments.row_numbers(r, ["signal"], bits=bits)
    plain = r.withColumn("_rn", F.row_number().over(Window.partitionBy("signal").orderBy("seq")).cast("bigint"))
    assert split.select("seq", "_rn").exceptAll(plain.select("seq", "_rn")).count() == 0
    a, b = detect.running_scale(r, bits=bits), detect.running_scale(r)
    assert a.exceptAll(b).count() == 0 and a.count() == r.count()


def test_occurrence_index_split_equals_plain(spark, sf_dir):
    s = adapters.scada_grid(spark, sf_dir)
    plain = F.row_number().over(Window.partitionBy("ts", "turbine_id", "signal").orderBy("seq")) - 1
    assert events.with_occurrence(s).exceptAll(s.withColumn("layer", plain.cast("bigint"))).count() == 0


def brute(rows):
    anchors, out = {}, {}
    for seq, key, us, width in sorted(rows):
        anchor = anchors.get(key)
        out[seq] = anchor is not None and 0 <= us - anchor < width
        if not out[seq]:
            anchors[key] = us
    return out


@pytest.mark.parametrize("bits", [1, 3, 6, 20])
@pytest.mark.parametrize("shape", ["sorted", "regular", "dense", "random", "sawtooth"])
def test_collapse_equals_brute_force(spark, bits, shape):
    rng = random.Random(hash((bits, shape)) % 1000)
    width, rows, clock = 25, [], 0
    for seq in range(600):
        clock += {"sorted": rng.randrange(20), "regular": 10, "dense": rng.choice([0, 0, 1]), "random": 0, "sawtooth": 7}[shape]
        us = rng.randrange(300) if shape == "random" else clock % 200 if shape == "sawtooth" else clock
        rows.append((seq, "hot" if rng.random() < 0.8 else "cold", us, width))
    df = spark.createDataFrame(rows, "seq bigint, turbine_id string, us bigint, width_us bigint").repartition(3)
    got = {r.seq: r.hidden for r in throttle(df, ["turbine_id"], bits=bits).collect()}
    assert got == brute(rows)


def test_merged_stream_is_total_and_sensors_come_first(spark, sf_dir):
    a, s = adapters.alarms(spark, sf_dir), adapters.scada_grid(spark, sf_dir)
    a = a.withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    rows = events.merged_events(a, s, partitions=5).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    order = [(r.ts, r.is_alarm) for r in rows]
    assert order == sorted(order)
    assert sum(len(r.signals) for r in rows) == s.count() and sum(r.is_alarm for r in rows) == a.count()


def test_repeated_signal_makes_two_snapshots(spark):
    rows = [(1, "2024-01-01", "a", "x", 1.0), (2, "2024-01-01", "a", "x", None), (3, "2024-01-01", "a", "y", 3.0)]
    df = spark.createDataFrame(rows, "seq bigint, ts string, turbine_id string, signal string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.layer: r.signals for r in events.snapshots(df).collect()}
    assert got == {0: {"x": 1.0, "y": 3.0}, 1: {"x": None}}


def test_half_space_scores(spark, sf_dir):
    e = adapters.scada_long(spark, sf_dir).select("seq", "ts", "turbine_id", F.create_map("signal", "value").alias("signals"))
    names = ["click", "error", "purchase", "signup", "view"]
    one = detect.half_space_scores(e, names, window=8, windows_per_block=1)
    two = detect.half_space_scores(e, names, window=8, windows_per_block=16)
    rows = {r.seq: r.anomaly_score for r in one.collect()}
    assert rows == {r.seq: r.anomaly_score for r in two.collect()}
    assert all(0 <= v <= 1 for v in rows.values()) and any(v > 0 for v in rows.values())
    order = {}
    for r in e.where("element_at(map_values(signals), 1) IS NOT NULL").select("seq", "turbine_id").orderBy("seq").collect():
        order.setdefault(r.turbine_id, []).append(r.seq)
    assert all(rows[q] == 0 for seqs in order.values() for q in seqs[:8])
    with pytest.raises(Exception, match="signal set is fixed"):
        detect.half_space_scores(e, names[:2], window=8).collect()


def test_detector_registry():
    assert detect.detector("zscore") is detect.event_scores
    with pytest.raises(ValueError):
        detect.detector("other")
