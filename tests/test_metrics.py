"""Boundary cases of rates, floods, co-occurrence and cliques."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alarmlake.operators import cliques, cooccur, metrics, validate
from alarmlake.operators.lookup import with_code_labels

START = datetime(2025, 1, 1)


def alarms(spark, rows):
    """rows: (seconds, station, code)"""
    data = [(i, START + timedelta(seconds=s), t, c, f"code {c}", 0) for i, (s, t, c) in enumerate(rows)]
    return spark.createDataFrame(data, "seq bigint, ts timestamp_ntz, turbine_id string, alarm_code bigint, description string, stopping int")


def edges(spark, rows, window=60, support=0.8):
    return {(r.code_a, r.code_b): r for r in cooccur.cooccurrence_edges(alarms(spark, rows), window, support).collect()}


@pytest.mark.parametrize("gap,found", [(59, True), (60, True), (61, False)])
def test_window_is_inclusive(spark, gap, found):
    assert ((1, 2) in edges(spark, [(30, "a", 1), (30 + gap, "a", 2)])) is found


def test_same_instant_needs_zero_window(spark):
    assert (1, 2) in edges(spark, [(30, "a", 1), (30, "a", 2)], window=0)
    assert not edges(spark, [(30, "a", 1), (31, "a", 2)], window=0)


def test_stations_are_separate(spark):
    assert not edges(spark, [(30, "a", 1), (30, "b", 2)])


def test_one_way_association_is_no_edge(spark):
    rows = [(0, "a", 1), (0, "a", 2), (1000, "a", 2), (2000, "a", 2)]
    assert not edges(spark, rows)


def test_duplicates_keep_their_weight_and_partners_count_once(spark):
    rows = [(0, "a", 1), (0, "a", 1), (10, "a", 2), (20, "a", 2), (30, "a", 2)]
    row = edges(spark, rows)[1, 2]
    assert (row.matched_a, row.total_a, row.matched_b, row.total_b) == (2, 2, 3, 3)


def test_chain_gives_two_groups(spark):
    rows = [(0, "a", 1), (50, "a", 2), (100, "a", 3)]
    rows = [(s + k * 10_000, t, c) for k in range(3) for s, t, c in rows]
    e = cooccur.cooccurrence_edges(alarms(spark, rows), 60, 0.8)
    assert sorted(tuple(r.codes) for r in cliques.maximal_cliques(e).collect()) == [(1, 2), (2, 3)]


@pytest.mark.parametrize("window", [0, 7, 60, 300])
def test_matches_pairwise_count(spark, window):
    rng = random.Random(window)
    rows = [(rng.choice([rng.randrange(4000), 500 + rng.randrange(30)]), rng.choice("aab"), rng.randrange(6)) for _ in range(400)]
    want = {}
    for s, t, c in rows:
        for p in range(6):
            if p != c and any(t == t2 and c2 == p and abs(s - s2) <= window for s2, t2, c2 in rows):
                want[c, p] = want.get((c, p), 0) + 1
    got = {(r.anchor_code, r.partner_code): r.matched for r in cooccur.matched_anchors(alarms(spark, rows), window).collect()}
    assert got == want


@pytest.mark.parametrize("seed,density,slice_size", [(1, 0.3, 64), (2, 0.6, 2), (3, 0.9, 1), (4, 0.75, 3)])
def test_cliques_match_brute_force(spark, seed, density, slice_size):
    rng = random.Random(seed)
    n = 11
    pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < density]
    joined = set(pairs)
    full = [c for k in range(2, n + 1) for c in itertools.combinations(range(n), k) if all(p in joined for p in itertools.combinations(c, 2))]
    want = sorted(c for c in full if not any(set(c) < set(o) for o in full))
    rows = [p[::-1] if rng.random() < 0.5 else p for p in pairs]
    rows += rows[:3] + [(4, 4), (None, 2)]  # repeated pairs, a loop and a null are no further edges
    got = cliques.maximal_cliques(spark.createDataFrame(rows, "code_a bigint, code_b bigint"), slice_size).collect()
    assert sorted(tuple(r.codes) for r in got) == want


def test_no_search_holds_a_hub(spark):
    hubs, n = [10_001, 10_002], 2000
    pairs = [(h, c) for h in hubs for c in range(n)] + [tuple(hubs)] + [(c, c + 1) for c in range(0, n, 2)]
    e = spark.createDataFrame(pairs, "code_a bigint, code_b bigint")
    sizes = cliques.search_parts(e).select(F.greatest(F.size("names"), F.size("edges"), F.size("bars")).alias("n")).agg(F.max("n"), F.count("n")).first()
    assert sizes[0] <= 6 and sizes[1] == n + 1
    got = sorted(tuple(r.codes) for r in cliques.maximal_cliques(e).collect())
    assert got == [(c, c + 1, *hubs) for c in range(0, n, 2)]


def test_a_wide_search_is_dealt_out(spark):
    """Even codes meet odd codes only: every pair is a clique, and a code has up to 100 later neighbours."""
    pairs = [(a, b) for a, b in itertools.combinations(range(200), 2) if a % 2 != b % 2 or a // 2 == b // 2]
    e = spark.createDataFrame(pairs, "code_a bigint, code_b bigint")
    parts = cliques.search_parts(e, slice_size=16).agg(F.max("parts"), F.max(F.size("names"))).first()
    assert parts[0] > 1 and parts[0] == -(-parts[1] // 16)
    got = sorted(tuple(r.codes) for r in cliques.maximal_cliques(e, slice_size=16).collect())
    assert got == sorted(tuple(sorted(p)) for p in pairs)


def test_no_edges_no_cliques(spark):
    assert cliques.maximal_cliques(spark.createDataFrame([], "code_a bigint, code_b bigint")).collect() == []


def test_bins_are_half_open_and_strict(spark):
    rows = [(0, "a", 1)] * 2 + [(599, "a", 3), (600, "a", 2), (601, "a", 2)]
    got = metrics.find_bursts(alarms(spark, rows), "10 minutes", 2).collect()
    assert [(r.start, r.n, r.codes) for r in got] == [(START, 3, [1, 3])]


def test_runs_join_adjacent_bins_only(spark):
    rows = [(600 * b + k, "a", 1) for b in (0, 1, 3, 4, 5) for k in range(2)]
    runs = metrics.flood_runs(metrics.find_bursts(alarms(spark, rows), "10 minutes", 1)).orderBy("start").collect()
    assert [(r.bins, r.records, r.minutes) for r in runs] == [(2, 4, 20.0), (3, 6, 30.0)]
    s = metrics.flood_summary(alarms(spark, rows), "10 minutes", 1).first()
    assert (s.window_count, s.total_bins, s.run_count, s.longest_bins) == (5, 6, 2, 3)


def test_pareto_target_is_an_integer_ceiling(spark):
    rows = [(i, "a", 1) for i in range(4)] + [(9, "a", 2)]
    r = metrics.pareto(alarms(spark, rows)).first()
    assert (r.codes_to_reach_80pct, r.distinct_codes, r.top10_share_pct) == (1, 2, 100.0)
    empty = metrics.pareto(alarms(spark, rows).where("false")).first()
    assert (empty.codes_to_reach_80pct, empty.distinct_codes, empty.top10_share_pct) == (0, 0, 0.0)


def test_stopping_split_keeps_zero_rows(spark):
    got = {r.category: (r.n, r.share_pct) for r in metrics.stopping_split(alarms(spark, [(0, "a", 1)])).collect()}
    assert got == {"stopping": (0, 0.0), "non_stopping": (1, 100.0), "unknown": (0, 0.0)}
    assert metrics.stopping_split(alarms(spark, [(0, "a", 1)]).where("false")).count() == 3


def test_rate_needs_a_span_and_labels_must_agree(spark):
    one = alarms(spark, [(5, "a", 1)])
    with pytest.raises(Exception, match="positive time span"):
        metrics.alarm_rate(one).collect()
    mixed = alarms(spark, [(0, "a", 1), (1, "a", 1)]).withColumn("stopping", F.col("seq").cast("int"))
    with pytest.raises(Exception, match="conflicting labels"):
        metrics.code_summary(mixed).collect()


def test_unknown_codes_are_kept(spark):
    lookup = spark.createDataFrame([(1, "one", 1)], "alarm_code bigint, description string, stopping int")
    base = alarms(spark, [(0, "a", 1), (1, "a", 9)]).drop("description", "stopping")
    assert [(r.description, r.stopping) for r in with_code_labels(base, lookup).orderBy("seq").collect()] == [("one", 1), ("(undocumented)", -1)]


def test_strict_projections(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    for value in df.collect():
        one = spark.createDataFrame([value], "v string")
        with pytest.raises(Exception, match="non-null integers"):
            one.select(validate.strict_integer(F.col("v"), "v")).collect()
    with pytest.raises(ValueError, match="missing required columns"):
        validate.require_columns(df, ["v", "w"])
    with pytest.raises(ValueError, match="signal schema changed"):
        validate.same_signals({"m1": ["a"], "m2": ["a", "b"]})
    with pytest.raises(ValueError, match="appears in both"):
        validate.disjoint_signals({"t1": ["a"], "t2": ["a"]})


def test_row_order_does_not_matter(spark, sf_dir):
    from alarmlake.sources import adapters

    a = adapters.alarms(spark, sf_dir)
    shuffled = a.orderBy(F.xxhash64("seq"))
    for fn in (metrics.alarm_rate, metrics.pareto, lambda x: metrics.find_bursts(x, "1 hour", 3)):
        assert sorted(map(str, fn(a).collect())) == sorted(map(str, fn(shuffled).collect()))
