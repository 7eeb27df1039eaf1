"""Files: monthly scans, encodings, receipts, journal, publish."""

import time

import pytest
from pyspark.sql import functions as F

from alarmlake import session
from alarmlake.functions import text
from alarmlake.functions.jsontext import has_duplicate_keys
from alarmlake.operators import filters, validate
from alarmlake.session import scratch_path
from alarmlake.sources import adapters, raw_files, scans, sinks


def test_month_must_have_exactly_one_file(spark):
    folder = scratch_path(spark, "months")
    df = spark.createDataFrame([("2024-01-01", "1")], "TimeOn string, Alarmcode string")
    raw_files.write_monthly_csv(df, folder, "tblAlarmLog", F.lit("2024_01"))
    assert scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1]), ["TimeOn"]).count() == 1
    with pytest.raises(ValueError, match="found 0"):
        scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1, 2]), ["TimeOn"])
    raw_files.write_monthly_csv(df, folder + "/again", "tblAlarmLog", F.lit("2024_01"))
    with pytest.raises(ValueError, match="found 2"):
        scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1]), ["TimeOn"])
    with pytest.raises(ValueError, match="distinct numbers"):
        scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1, 1]), ["TimeOn"])
    with pytest.raises(ValueError, match="missing required columns"):
        scans.monthly_csv(spark, folder + "/again", "tblAlarmLog", scans.months_of(2024, [1]), ["Nope"])


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "cp1252"])
def test_companion_encodings(spark, encoding):
    path = scratch_path(spark, "companion") + ".csv"
    raw_files.write_bytes(spark, path, "Name,Unit\r\nTemp é,°C “x” €\r\n".encode(encoding))
    assert [tuple(r) for r in scans.companion_csv(spark, path, ["Name", "Unit"]).collect()] == [("Temp é", "°C “x” €")]


def test_byte_order_mark_and_row_numbers(spark):
    folder = scratch_path(spark, "bom")
    body = "TimeOn,Alarmcode\n" + "".join(f"2024-01-01,{i}\n" for i in range(50))
    raw_files.write_bytes(spark, f"{folder}/tblAlarmLog_2024_01.csv", body.encode("utf-8-sig"))
    rows = scans.with_row_numbers(scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1]), ["TimeOn", "Alarmcode"]))
    assert all(r.row_no == int(r.Alarmcode) + 1 for r in rows.collect())


def test_row_numbers_over_many_splits(spark):
    path = scratch_path(spark, "lines")
    spark.range(0, 3000, 1, 1).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("value")).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = scans.json_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3000 and all(r.file_line == int(r.value) + 1 for r in rows)


GOOD = '{"receipt_id":"a","checked_at":"2024-01-01T00:00:00+00:00","operation":"learn"}'
LINES = [
    (GOOD, None), (GOOD[:-1], "not_an_object"), (GOOD[:-1] + ',"operation":"x"}', "duplicate_key"), (GOOD[:-1] + ',"v":[{"a":{"b":1,"\\u0062":2}}]}', "duplicate_key"), (GOOD[:-1] + ',"v":[{"a":"}{"},{"a":"x\\":"}]}', None), (GOOD[:-1] + ',"v":NaN}', "nonfinite_number"),
    (GOOD.replace('"a"', '" "'), "missing_identity"), (GOOD.replace('"a"', "7"), "missing_identity"), (GOOD.replace("+00:00", ""), "naive_timestamp"),
    (GOOD.replace("2024-01-01T", "someday "), "bad_timestamp"), ("[]", "not_an_object"), ("", None), (GOOD.replace("+00:00", "Z"), None), (GOOD[:-1] + ',"v":[{"a":1}]}', None),
]


def test_receipts(spark):
    df = spark.createDataFrame([(line, i + 1) for i, (line, _) in enumerate(LINES)], "value string, file_line bigint")
    rows = scans.receipts(df)
    got = {r.file_line: r.reason for r in rows.collect()}
    assert got == {i + 1: reason for i, (line, reason) in enumerate(LINES) if line}
    assert scans.receipt_integrity(rows).first().status == "degraded"
    assert scans.receipt_integrity(rows.where("reason IS NULL")).first().history_complete


def test_journal_read_fails_on_bad_lines(spark, sf_dir):
    for bad in ('{"schema_version":1,"op":"learn"', '{"schema_version":2,"op":"learn"}', '{"schema_version":1,"op":"forget"}'):
        path = scratch_path(spark, "journal")
        sinks.append_lines(adapters.sample_journal(spark, sf_dir), path)
        raw_files.write_bytes(spark, f"{path}/part-bad.json", bad.encode())
        with pytest.raises(Exception):
            scans.journal(spark, path).collect()


def test_failed_publish_keeps_previous_tables(spark):
    root = scratch_path(spark, "publish")
    sinks.publish(spark, {"t": spark.range(3)}, root)

    def refuse(written):
        sinks.reconcile(written["t"], spark.range(4)).collect()

    with pytest.raises(Exception, match="do not reconcile"):
        sinks.publish(spark, {"t": spark.range(5)}, root, refuse)
    assert sinks.published(spark, root, "t").count() == 3
    sinks.publish(spark, {"t": spark.range(7)}, root)
    assert sinks.published(spark, root, "t").count() == 7


def test_time_slice_reaches_the_scan(spark, sf_dir):
    df = scans.parquet_slice(spark, f"{sf_dir}/events.parquet", ["event_id", "ts"], "2024-01-10", "2024-01-17")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_written_table_prunes_dates(spark, sf_dir):
    path = scratch_path(spark, "dated")
    back = sinks.write_table(adapters.alarms(spark, sf_dir), path)
    plan = back.where("date = DATE'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filters_prune_dates(spark, sf_dir):
    path = scratch_path(spark, "dated")
    rows = sinks.write_table(adapters.alarms(spark, sf_dir), path)
    found = [
        scans.parquet_slice(spark, path, ["ts"], "2024-01-10", "2024-01-17"),
        filters.month_slice(rows, 2024, 1),
        filters.trailing_window(rows, "2024-01-05T10:00:00", "2024-01-06T10:00:00"),
        filters.seek(rows, "2024-01-20T12:00:00", scans.source_bounds(rows)),
    ]
    for df in found:
        assert "PartitionFilters: [isnotnull(date" in plan_of(df) and ">= " in plan_of(df)
    bounds = scans.source_bounds(rows)
    assert bounds.select("first_ts", "last_ts", "n").first() == rows.agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    assert "PartitionFilters: [isnotnull(date" in plan_of(bounds)


def test_months_in_another_column_order(spark):
    folder = scratch_path(spark, "order")
    raw_files.write_monthly_csv(spark.createDataFrame([("2024-01-01", "1")], "TimeOn string, Alarmcode string"), folder, "tblAlarmLog", F.lit("2024_01"))
    raw_files.write_monthly_csv(spark.createDataFrame([("2", "2024-02-01")], "Alarmcode string, TimeOn string"), folder + "/b", "tblAlarmLog", F.lit("2024_02"))
    raw_files.write_monthly_csv(spark.createDataFrame([("3", "2024-03-01")], "Other string, TimeOn string"), folder + "/c", "tblAlarmLog", F.lit("2024_03"))
    rows = scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1, 2]), ["TimeOn", "Alarmcode"], exact=False)
    assert sorted((r.month, r.TimeOn, r.Alarmcode) for r in rows.collect()) == [(1, "2024-01-01", "1"), (2, "2024-02-01", "2")]
    with pytest.raises(ValueError, match="signal schema changed"):
        scans.monthly_csv(spark, folder, "tblAlarmLog", scans.months_of(2024, [1, 2, 3]), ["TimeOn"], exact=False)


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_strict_values_are_not_repaired(spark):
    given = ["7", " 7 ", "7.0", "7e0", "7.00000000001", "9007199254740993", "1d", "x", "", None, "9223372036854775808"]
    assert column(spark, given, validate.integer_or_null) == [7, 7, 7, 7, None, 9007199254740993, None, None, None, None, None]
    assert column(spark, ["1.5", " 2e3 ", None], lambda c: validate.strict_double(c, "x")) == [1.5, 2000.0, None]
    for bad in ("1d", "1f", "2.5D", "x"):
        with pytest.raises(Exception, match="must be numeric"):
            column(spark, [bad], lambda c: validate.strict_double(c, "x"))


def test_basic_timestamps(spark):
    got = column(spark, ["20240101T000001", "20240102", "2024-01-01T00:00:01", "2024-01-01\n", "20241301"], validate.iso_or_null)
    assert [str(g) for g in got] == ["2024-01-01 00:00:01", "2024-01-02 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:00", "None"]


def test_strict_receipts(spark):
    good = '{"receipt_id":"r","checked_at":"2024-01-01T00:00:00Z","operation":"o"%s}'
    lines = [good % "", good % "" + " trailing text", good % "" + "," + good % "", good % ',"x":1e999', (good % "").replace('"r"', '"\\t"'), "\t", " ", good % ',"note":"1e999"']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "file_line bigint, value string")
    got = {r.file_line: r.reason for r in scans.receipts(df).collect()}
    assert got == {0: None, 1: "not_an_object", 2: "not_an_object", 3: "nonfinite_number", 4: "missing_identity", 7: None}


def test_unicode_space_is_space(spark):
    assert column(spark, [" a\t b ", "\n"], text.strip) == ["a\t b", ""]
    assert column(spark, ["a  b \tc "], text.collapse_spaces) == ["a b c"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="shared folder"):
        session.scratch_root(Cluster)


def test_duplicate_keys_of_plain_and_of_odd_texts(spark):
    """Plain texts are not walked key by key: a walk over 100,000 keys copies their list as often."""
    texts = {
        '{"a":1,"b":{"c":2}}': False, '{"a":1,"b":{"a":2}}': False, '{"a":1,"b":{"c":2,"c":3}}': True, '{"a":1,"a" :2}': True, '{"a":"a","b":"a\\":"}': False,
        '{"a":1,"\\u0061":2}': True, '{"":1,"":2}': True, '{"":"","b":""}': False, '{"x":":","y":"x\\"","x":1}': True, '{"a":":\\"a\\":","b":"{"}': False, '[{"a":1,"a":2}]': None, "": None, " {}": False,
        "{" + ",".join(f'"key {i}":"key 0"' for i in range(100_000)) + "}": False,
    }
    began = time.monotonic()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", has_duplicate_keys(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == texts and time.monotonic() - began < 20
