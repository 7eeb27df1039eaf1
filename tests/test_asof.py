"""The as-of merge of events and revisions against a plain search."""

import random
from bisect import bisect_right

import pytest

from alarmlake.operators import journal


@pytest.mark.parametrize("bits", [2, 4, 20])
@pytest.mark.parametrize("ring", [0, 3, 40])
def test_every_event_takes_the_newest_reaching_revision(spark, bits, ring):
    draw = random.Random(bits * 100 + ring)
    at = sorted(draw.randrange(0, 260) for _ in range(60))  # several at one place, some after the last event
    steps = [(v, a) for v, a in enumerate(at, 2)]
    seqs = sorted(draw.sample(range(200), 150))
    events = spark.createDataFrame([(s, f"e{s}") for s in seqs], "seq bigint, name string")
    got = journal.with_revision(events, spark.createDataFrame(steps, "version bigint, applied_at bigint"), ring, bits)
    reach = [max(a - ring, 0) for _, a in steps]
    assert sorted((r.seq, r.name, r.revision) for r in got.collect()) == [(s, f"e{s}", 1 + bisect_right(reach, s)) for s in seqs]


def test_no_revision_and_no_event(spark):
    events = spark.createDataFrame([(5, "a"), (1 << 21, "b")], "seq bigint, name string")
    none = spark.createDataFrame([], "version bigint, applied_at bigint")
    assert sorted((r.seq, r.revision) for r in journal.with_revision(events, none, 3).collect()) == [(5, 1), (1 << 21, 1)]
    assert journal.with_revision(events.limit(0), none, 3).collect() == []


def test_rows_of_the_plan_do_not_multiply(spark):
    """Events meet revision starts in a union: no join condition compares positions."""
    events = spark.range(1000).selectExpr("id AS seq")
    steps = spark.range(2, 500).selectExpr("id AS version", "id * 2 AS applied_at")
    plan = journal.with_revision(events, steps, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and not any("Join" in line and ("<" in line or ">" in line) for line in plan.splitlines())
