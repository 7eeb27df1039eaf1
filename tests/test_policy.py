"""Rules, verdict precedence, journal, rescoring and learning against small Python models."""

import pytest
from pyspark.sql import functions as F

from alarmlake.functions.conditions import condition_holds, is_critical
from alarmlake.operators import journal, learn, rules
from alarmlake.plans.segments import micros
from alarmlake.schemas import EVENT, RULE
from alarmlake.settings import PolicySettings
from alarmlake.sources import adapters

NOTHING = (None, None, None, None, None, None)


def rule(order, action, code=None, station=None, signal=None, kind="code_match", window=0, conditions=(), confidence=0.7, reversible=True):
    cond = [(f, op, num, text, flag, null) for f, op, num, text, flag, null in conditions]
    return (order, f"r{order}", f"say {order}", (station, code, signal), (kind, window, cond), action, confidence, "me", "2024-01-01T00:00:00Z", reversible)


def event(seq, code=None, station="a", signals=None, features=None, signal=None, value=None, critical=None, severity=None, second=None):
    from datetime import datetime, timedelta

    ts = datetime(2024, 1, 1) + timedelta(seconds=seq if second is None else second)
    return (seq, ts, station, code, None if code is None else f"d{code}", None if code is None else 0, signals or {}, features or {}, signal, value, critical, severity)


def frame(spark, events, table):
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(table, RULE)


def num(field, op, value):
    return (field, op, float(value), None, None, False)


CASES = [
    (num("x", "eq", 5), True), (num("x", "ne", 5), False), (num("x", "lt", 6), True), (num("x", "lte", 5), True),
    (num("x", "gt", 5), False), (num("x", "gte", 5), True), (num("signals.x", "eq", 5), True), (num("features.x", "eq", 7), True),
    (num("gone", "ne", 5), False), (num("gone", "eq", 5), False), (num("bad", "ne", 5), False), (num("alarm_code", "eq", 3), True),
    (num("critical", "ne", 1), True), (num("critical", "eq", 1), False), (num("ts", "ne", 1), False), (num("signals", "ne", 1), False),
    (("turbine_id", "eq", None, "a", None, False), True), (("turbine_id", "gt", 1.0, None, None, False), False),
    (("critical", "eq", None, None, True, False), True), (("empty", "eq", None, None, None, True), True), (num("empty", "ne", 5), True),
    (num("severity", "ne", 5), False), (num("x", "eq", 5.5), False), (num("only", "eq", 9), True),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_conditions(spark, case):
    condition, want = CASES[case]
    e = event(0, 3, signals={"x": 5.0, "empty": None, "bad": float("inf")}, features={"x": 7.0, "only": 9.0}, critical=True)
    df = spark.createDataFrame([(*e, condition)], EVENT + ", c STRUCT<field:STRING,op:STRING,value_num:DOUBLE,value_str:STRING,value_bool:BOOLEAN,value_null:BOOLEAN>")
    assert df.select(condition_holds(F.col("c")).alias("m")).first().m is want


def test_critical(spark):
    df = spark.createDataFrame([event(0, critical=True), event(1, severity="EMERGENCY"), event(2, severity="high"), event(3, critical=False)], EVENT)
    assert [r.c for r in df.orderBy("seq").select(is_critical().alias("c")).collect()] == [True, True, False, False]


def test_scope_matches_signals_and_wildcards(spark):
    table = [rule(1, "suppress", station="a"), rule(2, "suppress", code=5), rule(3, "suppress", signal="t"), rule(4, "escalate")]
    evs = [event(0, 5), event(1, 6, "b"), event(2, station="b", signals={"t": 1.0}), event(3, station="b", signal="t"), event(4, station="b", features={"t": None})]
    e, r = frame(spark, evs, table)
    got = {x.seq: [m.rule_id for m in x.matches] for x in rules.match_rules(e, r).collect()}
    assert got == {0: ["r1", "r2", "r4"], 1: ["r4"], 2: ["r3", "r4"], 3: ["r3", "r4"], 4: ["r3", "r4"]}


def test_every_shape_matches_and_no_job_runs_early(spark):
    shapes = [(c, st, sg) for c in (5, None) for st in ("a", None) for sg in ("t", None)]
    table = [rule(i, "suppress", code=c, station=st, signal=sg) for i, (c, st, sg) in enumerate(shapes)] + [rule(20 + i, "suppress", station="a") for i in range(7)]
    evs = [event(i, c, st, signals={"t": 1.0} if i % 2 else None, signal="t" if i % 3 == 0 else None) for i, (c, st) in enumerate([(5, "a"), (5, "b"), (6, "a"), (None, "a"), (6, "b")] * 3)]
    e, r = frame(spark, evs, table)
    spark.sparkContext.setJobGroup("plan-only", "matching")
    joined = rules.match_rules(e, r)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    ids = lambda df: {x.seq: [m.rule_id for m in x.matches] for x in df.collect()}
    got = ids(joined)
    assert rules.shapes_of(r) == {"code", "station", "signal", "any"}
    want = {x[0]: [] for x in evs}
    assert set(got) == set(want)
    for i, shape in enumerate(("code", "station", "signal", "any")):
        some = r.where(rules.rule_shape() == shape)
        part = ids(rules.match_rules(e, some, shapes=frozenset({shape})))
        assert part == ids(rules.match_rules(e, some)) and any(part.values())
        want = {k: v + part[k] for k, v in want.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert got[1] == ["r2", "r3", "r6", "r7"]  # code 5 on another station, with the signal


def test_precedence(spark):
    table = [
        rule(1, "collapse", code=5, window=60), rule(2, "suppress"), rule(3, "escalate", code=6, confidence=0.4), rule(4, "escalate", code=6, confidence=0.9),
        rule(5, "suppress", code=7, kind="learned", conditions=[num("x", "gt", 0)]),
    ]
    narrow = [t for t in table if t[0] != 2]
    evs = [event(0, 5), event(1, 6), event(2, 7, signals={"x": 1.0}), event(3, 5, critical=True), event(4, 5), event(5, 8)]
    e, r = frame(spark, evs, table)
    got = {x.seq: (x.show, x.suppressed_by, x.confidence) for x in rules.score(e, r).collect()}
    assert got == {0: (False, "r2", 0.7), 1: (True, None, 0.9), 2: (False, "r2", 0.7), 3: (True, None, 1.0), 4: (False, "r2", 0.7), 5: (False, "r2", 0.7)}
    e, r = frame(spark, evs, narrow)
    got = {x.seq: (x.show, x.suppressed_by, round(x.confidence, 3)) for x in rules.score(e, r, probability=F.lit(0.95)).collect()}
    assert got[0] == (True, None, 0.7) and got[4] == (False, "r1", 0.7)
    assert got[2] == (False, "classifier:r5", 0.95) and got[5] == (True, None, 0.05)
    calm = {x.seq: x.show for x in rules.score(e, r, probability=F.lit(0.89)).collect()}
    assert calm[2] is True


def test_rule_validation(spark):
    bad = [
        rule(1, "suppress"), rule(2, "delete"), rule(3, "suppress", kind="learned"), rule(4, "suppress", station=" "), rule(5, "suppress", window=-1),
        rule(6, "suppress", conditions=[num("a b", "eq", 1)]), rule(7, "suppress", conditions=[("a", "lt", None, "x", None, False)]), rule(8, "suppress", confidence=1.2), rule(8, "suppress"),
    ]
    r = spark.createDataFrame(bad, RULE)
    got = {(x.rule_id, tuple(x.problems)) for x in rules.rule_violations(r).collect()}
    assert got == {
        ("r1", ()), ("r2", ("action",)), ("r3", ("needs_condition",)), ("r4", ("blank_scope",)), ("r5", ("window",)), ("r6", ("condition_field",)),
        ("r7", ("ordered_number",)), ("r8", ("confidence", "repeated_id")), ("r8", ("repeated_id",)),
    }


def test_rescored_history_equals_ring_simulation(spark, sf_dir):
    """Replay every event and journal step with an explicit ring and compare final verdicts."""
    ring = 60
    e = adapters.scored_events(spark, sf_dir)
    j, revs = adapters.sample_journal(spark, sf_dir), adapters.sample_revisions(spark, sf_dir)
    lives = {r.rule_id: r for r in journal.rule_lifetimes(j).collect()}
    hits = {}
    for row in rules.match_rules(e, adapters.sample_rules(spark, sf_dir)).select("seq", "turbine_id", micros("ts").alias("us"), is_critical().alias("c"), "matches").collect():
        hits[row.seq] = row
    steps = {}
    for r in revs.collect():
        steps.setdefault(r.applied_at, []).append(r.version)

    def verdict(row, version, anchors):
        live = [m for m in row.matches if lives[m.rule_id].v_from <= version < lives[m.rule_id].v_to]
        if row.c or any(m.action == "escalate" for m in live):
            return True, None
        for m in live:
            if m.action == "suppress" and m.kind != "learned":
                return False, m.rule_id
        for m in live:
            if m.action == "collapse":
                key = (m.rule_id, row.turbine_id)
                if key in anchors and 0 <= row.us - anchors[key] < (m.window_s or 60) * 1_000_000:
                    return False, m.rule_id
                anchors[key] = row.us
                return True, None
        return True, None

    final, buffer, boundary, live, version = {}, [], {}, {}, 1
    for seq in range(len(hits) + 1):
        for v in sorted(steps.get(seq, [])):
            version = v
            gone = {i for i, x in lives.items() if not x.v_from <= v < x.v_to}
            anchors = {k: t for k, t in boundary.items() if k[0] not in gone}
            for item in buffer:
                final[item[0]] = verdict(hits[item[0]], v, anchors)
                item[1] = dict(anchors)
            live = anchors
        if seq == len(hits):
            break
        final[seq] = verdict(hits[seq], version, live)
        if len(buffer) == ring:
            boundary = buffer.pop(0)[1]
        buffer.append([seq, dict(live)])
    got = {r.seq: (r.show, r.suppressed_by) for r in journal.rescored(e, j, revs, PolicySettings(ring_size=ring), bits=6).collect()}
    assert got == final


def test_minting_labels_and_weights(spark):
    table = [rule(1, "escalate", code=9), rule(2, "suppress", code=4)]
    evs = [event(0, 5), event(1, 5, critical=True), event(2, 4), event(3, 9), event(4, 6), event(5, signals={"x": 1.0}), event(6, 5)]
    e, active = frame(spark, evs, table)
    new = spark.createDataFrame([rule(3, "suppress", code=5)], RULE)
    got = {r.seq: (r.label, r.weight) for r in learn.mint_examples(e, active, new).collect()}
    assert got == {0: (1, 1.25), 1: (0, 5 / 6), 3: (0, 5 / 6), 4: (0, 5 / 6), 6: (1, 1.25)}
    collapse = spark.createDataFrame([rule(3, "collapse", code=5, window=60)], RULE)
    got = {r.seq: r.label for r in learn.mint_examples(e, active, collapse).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 4: 0, 6: 1}
    escalate = spark.createDataFrame([rule(3, "escalate", code=5)], RULE)
    assert {r.label for r in learn.mint_examples(e, active, escalate).collect()} == {0}


def test_learn_then_undo_restores_rules(spark, sf_dir):
    j = adapters.sample_journal(spark, sf_dir)
    before = journal.active_rules(j)
    new = adapters.sample_rules(spark, sf_dir).limit(1).withColumn("rule_id", F.lit("fresh")).withColumn("reversible", F.lit(True))
    batch = learn.mint_examples(adapters.scored_events(spark, sf_dir), before.select(*new.columns), new)
    taught = j.unionByName(learn.learn_lines(j, new, batch), allowMissingColumns=True)
    assert journal.journal_violations(taught).count() == 0
    assert journal.active_rules(taught).join(before, "rule_id", "left_anti").collect()[0].rule_id == "fresh"
    undone = taught.unionByName(learn.undo_lines(taught, "fresh"), allowMissingColumns=True)
    assert journal.journal_violations(undone).count() == 0
    assert journal.active_rules(undone).select("rule_id", "rule_order").exceptAll(before.select("rule_id", "rule_order")).count() == 0
    assert journal.active_batches(undone).count() == journal.active_batches(j).count()
    with pytest.raises(Exception, match="already used"):
        learn.learn_lines(undone, new, batch).collect()
    assert learn.undo_lines(undone, "fresh").count() == 0


def test_learned_rule_stays_inside_its_scope(spark, sf_dir):
    e = adapters.scored_events(spark, sf_dir)
    new = adapters.sample_rules(spark, sf_dir).where("pattern.kind = 'learned'").orderBy("rule_order").limit(1)
    batch = learn.mint_examples(e, new.limit(0), new)
    model, slots = learn.fit(batch)
    weights = learn.coefficients(model, slots)
    scored = learn.with_probability(e, weights, model.intercept)
    again = learn.with_probability(e.repartition(7), weights.repartition(3), model.intercept)
    assert scored.select("seq", "probability").exceptAll(again.select("seq", "probability")).count() == 0
    code = new.first().rule_order
    v = rules.score(scored, new, keep=["seq", "ts", "turbine_id", "alarm_code"], probability=F.col("probability"))
    hidden = v.where("NOT show").collect()
    assert all(r.alarm_code == code and r.suppressed_by == f"classifier:r{code}" and r.confidence >= 0.9 for r in hidden)


BROKEN = {
    "nonsequential_version": ("model_version", "line = 6", "model_version + 1"),
    "unknown_op": ("op", "line = 5", "'forget'"),
    "commit_without_learn": ("op", "line = 9", "'commit'"),
    "changed_settings": ("collapse_window_s", "line = 8", "collapse_window_s + 1"),
    "invalid_settings": ("nuisance_threshold", "op = 'commit'", "0.4D"),
    "encoding_version": ("feature_encoding_version", "line = 4", "2"),
    "schema_version": ("schema_version", "line = 3", "7"),
    "invalid_example": ("examples", "line = 10", "transform(examples, e -> named_struct('features', e.features, 'label', 3, 'weight', e.weight))"),
}


@pytest.mark.parametrize("problem", BROKEN)
def test_broken_journals_are_refused(spark, sf_dir, problem):
    column, where, value = BROKEN[problem]
    whole = spark.createDataFrame(adapters.sample_journal(spark, sf_dir).where("line <= 12").collect(), adapters.sample_journal(spark, sf_dir).schema)
    kind = dict(whole.dtypes)[column]
    j = whole.withColumn(column, F.expr(f"CASE WHEN {where} THEN CAST({value} AS {kind}) ELSE {column} END"))
    assert journal.active_rules(whole).count() == 6
    with pytest.raises(Exception, match="broken journal, line [0-9]+: "):
        journal.active_rules(j).collect()
    if problem == "nonsequential_version":
        with pytest.raises(Exception, match="broken journal, line 6: nonsequential_version"):
            journal.rescored(adapters.scored_events(spark, sf_dir), j, adapters.sample_revisions(spark, sf_dir)).collect()


def test_many_rules_are_minted_as_one_by_one(spark, sf_dir):
    e, r = adapters.scored_events(spark, sf_dir).where("seq < 400"), adapters.sample_rules(spark, sf_dir).where("rule_order < 14")
    together = {(x.rule_id, x.seq): (x.label, round(x.weight, 9)) for x in learn.mint_batches(e, r, r).collect()}
    for name in ("r2", "r4", "r7", "r13"):
        new = r.where(F.col("rule_id") == name)
        alone = {(x.rule_id, x.seq): (x.label, round(x.weight, 9)) for x in learn.mint_batches(e, r.where(F.col("rule_id") != name), new).collect()}
        assert alone == {k: v for k, v in together.items() if k[0] == name}


def test_lines_of_many_rules_and_invalid_ones(spark, sf_dir):
    e, r = adapters.scored_events(spark, sf_dir), adapters.sample_rules(spark, sf_dir)
    j = adapters.sample_journal(spark, sf_dir)
    new = r.where("rule_order IN (3, 8, 5)").withColumn("rule_id", F.concat(F.lit("new-"), "rule_id"))
    lines = learn.learn_lines(j, new, learn.mint_examples(e, r, new))
    assert [(x.op, x.rule_id or x.rule.rule_id) for x in lines.orderBy("line").collect()] == [(op, f"new-r{k}") for k in (3, 5, 8) for op in ("learn", "commit")]
    assert journal.journal_violations(j.unionByName(lines, allowMissingColumns=True)).count() == 0
    with pytest.raises(Exception, match="invalid rule new-r.: confidence"):
        learn.learn_lines(j, new.withColumn("confidence", F.lit(2.0)), learn.mint_examples(e, r, new)).collect()


def test_settings_bounds():
    for bad in ({"learning_rate": 0}, {"nuisance_threshold": 0.5}, {"nuisance_threshold": 1.1}, {"collapse_window_s": 0}):
        with pytest.raises(ValueError):
            PolicySettings(**bad)
