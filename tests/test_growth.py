"""Work that must not grow with rules that repeat a predicate, nor with the number of micro-batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from alarmlake.catalog import job_queries
from alarmlake.operators import journal, learn, models, rules, validate
from alarmlake.plans.segments import dense_sequence
from alarmlake.session import materialize
from alarmlake.sources import adapters, raw_files, scans, sinks

KEPT = ["seq", "stage", "protected", "rule_id", "rule_confidence", "window_s"]


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """Events with a repeated and a missing arrival number."""
    e = adapters.scored_events(spark, sf_dir).where("seq < 400")
    odd = e.where("seq < 40").withColumn("seq", F.when(F.col("seq") % 2 == 0, F.col("seq") + 1))
    return e.unionByName(odd).localCheckpoint()


@pytest.fixture(scope="module")
def repeated(spark, sf_dir):
    """Every rule several times over, in mixed order, with other actions, confidences and windows."""
    base = adapters.sample_rules(spark, sf_dir).where("rule_order < 120 OR scope.signal IS NOT NULL")
    draw = F.pmod(F.xxhash64("rule_order", "i"), F.lit(1000))
    many = base.crossJoin(spark.range(6).withColumnRenamed("id", "i"))
    return many.select(
        (draw * 1000 + F.col("rule_order")).alias("rule_order"),
        F.concat("rule_id", F.lit("-"), F.col("i").cast("string")).alias("rule_id"),
        "scope",
        F.col("pattern").withField("window_s", draw % 7 * 60).withField("kind", F.when(draw % 4 == 0, "learned").otherwise(F.col("pattern.kind"))).alias("pattern"),
        F.element_at(F.array(F.lit("suppress"), F.lit("collapse"), F.lit("escalate")), (draw % 3 + 1).cast("int")).alias("action"),
        (draw % 11 / 10.0).alias("confidence"),
    ).localCheckpoint()


def listed(df):
    return sorted(map(str, df.collect()))


def test_leading_rules_decide_like_all_rules(events, repeated):
    leading = rules.leading_rules(repeated)
    kinds = repeated.select("scope", "pattern.conditions", "action", "pattern.kind").distinct().count()
    assert leading.count() <= 2 * kinds and leading.count() < repeated.count()
    assert listed(rules.decide(rules.match_leading(events, repeated)).select(*KEPT)) == listed(rules.decide(rules.match_rules(events, repeated)).select(*KEPT))


def test_rules_that_repeat_a_predicate_lead_once(spark, events):
    table = adapters.sample_rules(spark, "/root/testdata/sf0.001").where("action = 'suppress'").limit(1)
    copies = table.crossJoin(spark.range(300)).withColumns({"rule_order": F.col("id"), "rule_id": F.concat(F.lit("c"), F.col("id").cast("string"))}).drop("id")
    assert [r.rule_id for r in rules.leading_rules(copies).collect()] == ["c0"]


def test_pairs_of_predicates_are_the_pairs_of_rules(events, repeated):
    found, named = rules.matching_predicates(events, repeated)
    whole = rules.match_rules(events, repeated).select("seq", F.explode("matches.rule_id").alias("rule_id"))
    got = listed(found.join(named, "predicate").select("seq", "rule_id"))
    assert got == listed(whole) and got
    assert found.count() < len(got)


def test_leading_rules_of_revisions_decide_like_all(spark, events):
    draw = random.Random(5)
    rows = []
    for i in range(2, 150):
        end = draw.choice([journal.OPEN_END, i + draw.randrange(1, 60)])
        rows.append((i, draw.randrange(6), i, end, draw.choice(["suppress", "collapse", "escalate"]), draw.randrange(4) / 4, draw.choice([0, 60])))
    drawn = spark.createDataFrame(rows, "rule_order bigint, of int, v_from bigint, v_to bigint, action string, confidence double, window_s bigint")
    shapes = adapters.sample_rules(spark, "/root/testdata/sf0.001").where("rule_order < 6").select(F.col("rule_order").cast("int").alias("of"), F.concat(F.lit("r"), F.lit("")).alias("_"), "scope", "pattern").drop("_")
    table = drawn.join(shapes, "of").withColumn("rule_id", F.concat(F.lit("r"), F.col("rule_order").cast("string"))).withColumn("pattern", F.col("pattern").withField("window_s", F.col("window_s"))).drop("of", "window_s")
    placed = events.where("alarm_code < 6").withColumn("revision", F.pmod(F.xxhash64("seq"), F.lit(200)))
    decided = lambda t: listed(rules.decide(rules.match_rules(placed, t, F.col("revision"), ("v_from", "v_to"))).select(*KEPT))
    leading = rules.leading_rules(table, ("v_from", "v_to"))
    assert decided(leading) == decided(table) and leading.count() < table.count()


def test_batches_of_a_stream_do_not_stay_small(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(job_queries.live, "event_stream", lambda spark, path, *rest: paths.append(path))
    for n in (3_000, 60_000):
        job_queries._stream(spark, spark.range(n).withColumnRenamed("id", "seq"), "batches")
    staged = [spark.read.parquet(p) for p in paths]
    assert [p.count() for p in staged] == [3_000, 60_000]
    assert [len(p.inputFiles()) for p in staged] == [4, 12]


def test_equal_batches_are_made_once(spark, sf_dir):
    """Rules that match nothing in the ring share a batch; the rows of every rule are those of a rule taught alone."""
    e, r = adapters.scored_events(spark, sf_dir), adapters.sample_rules(spark, sf_dir)
    unknown = r.where("scope.alarm_code IS NOT NULL").limit(1).withColumn("scope", F.col("scope").withField("alarm_code", F.lit(10**9).cast("bigint")))
    idle = unknown.crossJoin(spark.range(50)).withColumns({"rule_order": 10**9 + F.col("id"), "rule_id": F.concat(F.lit("idle-"), F.col("id").cast("string"))}).drop("id")
    members, examples = learn.example_classes(e, r, idle)
    assert members.count() == 50 and members.select("batch").distinct().count() == 1
    assert examples.count() * 50 == learn.mint_examples(e, r, idle).count() > 0
    kinds = idle.withColumn("pattern", F.col("pattern").withField("kind", F.lit("code_match")))
    lines = learn.learn_lines(adapters.sample_journal(spark, sf_dir), kinds, examples, members=members)
    sizes = {x.n for x in lines.where("op = 'commit'").select(F.size("examples").alias("n")).collect()}
    assert sizes == {examples.count()}


def test_a_chunk_gets_the_weights_of_its_own_features():
    plain = models.pd.DataFrame
    data = plain({"label": [1.0, 0.0], "weight": [1.0, 1.0], "slots": [[-1, 7], [-1, 900_000]], "xs": [[1.0, 1.0], [1.0, 1.0]]})
    state = plain({"version": [3], "chunk": [0], "slots": [[-1, 7, 900_000]], "point": [[0.0, 0.5, -0.5]]})
    sums = models._partial(data, state)
    assert set(sums["i"]) == {-1, 7, 900_000} and (sums["j"] == models.LOSS).sum() == 1
    pairs = {(i, j): v for i, j, v in zip(sums["i"], sums["j"], sums["v"]) if j >= -1}
    assert set(pairs) == {(-1, -1), (-1, 7), (7, 7), (-1, 900_000), (900_000, 900_000)}


def plan_of(df, mode):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_row_loop_of_the_raw_log_is_compiled(spark, sf_dir):
    text = materialize(adapters.raw_alarm_log(spark, sf_dir), "text")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan_of(scans.alarm_log(text), "codegen"))]
    assert sizes and max(sizes) < 8000  # the JVM leaves larger methods uncompiled


NUMBERS = [None, "", " ", "5", "+5", "-0", "00012", "9" * 15, "9" * 16, "9223372036854775807", "9223372036854775808", " 7 ", "7\n", "7.0", "7.50", "1.5e1", "1d", "+", "NaN", "5\x00"]
TIMES = ["2024-01-01T00:00:01", "2024-01-01 00:00:01", "2024-13-01T00:00:00", "2024-02-30 01:01:01", "2024-01-01T24:00:00", "2024-01-01T00:00:01Z", "2024-01-01T00:00:01,5", " 2024-01-01T00:00:01\n", "20240101T000001", "2024-01-01"]


@pytest.mark.parametrize(("quick", "whole"), [(validate.integer_or_null, validate._any_integer), (validate.iso_or_null, lambda t: validate._any_timestamp(t).cast("timestamp_ntz"))])
def test_quick_test_of_a_text_changes_no_value(spark, quick, whole):
    rows = spark.createDataFrame([(v,) for v in NUMBERS + TIMES], "v string").select("v", quick(F.col("v")).alias("a"), whole(F.col("v")).alias("b")).collect()
    assert [(r.v, r.a) for r in rows] == [(r.v, r.b) for r in rows]
    assert sum(r.a is not None for r in rows) > 5


def test_rows_are_not_shuffled_for_the_offsets_of_their_numbers(spark, sf_dir):
    numbered = dense_sequence(adapters.alarms(spark, sf_dir).drop("seq"), [F.col("ts"), F.col("alarm_code")])
    assert "SortMergeJoin" not in plan_of(numbered, "simple")
    assert sorted(r.seq for r in numbered.select("seq").collect()) == list(range(numbered.count()))


def test_table_in_time_order_is_written_where_its_rows_are(spark, sf_dir, tmp_path):
    rows = dense_sequence(adapters.alarms(spark, sf_dir).drop("seq"), [F.col("ts"), F.col("turbine_id")])
    back = sinks.write_table(rows, f"{tmp_path}/table", in_time_order=True)
    assert back.drop("date").exceptAll(rows.select(*back.drop("date").columns)).isEmpty() and back.count() == rows.count()
    assert back.where(F.col("date") != F.to_date("ts")).isEmpty()
    order = [(r.f, r.turbine_id, r.ts) for r in back.select(F.col("_metadata.file_path").alias("f"), "turbine_id", "ts", F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
    files = {f: [x[1:] for x in order if x[0] == f] for f, *_ in order}
    assert all(x == sorted(x) for x in files.values())


def test_months_follow_from_the_files_written(spark, tmp_path):
    rows = spark.createDataFrame([("2024_02", "a"), ("2023_12", "b"), ("2024_02", "c")], "m string, v string")
    assert raw_files.write_monthly_csv(rows.select("v", "m"), f"{tmp_path}/raw", "t", F.col("m")) == ["2023_12", "2024_02"]
