"""Sources and sinks on real files, streams run to completion, composite jobs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.catalog.base import ORACLES, query, sql
from alarmlake.catalog.event_queries import readings_text, stored_metrics
from alarmlake.catalog.metrics_queries import _GROUPS, PAIR_S, SUPPORT
from alarmlake.catalog.rule_queries import _STEP, _one_rule, _throttle_sql
from alarmlake.functions import features
from alarmlake.operators import filters, lookup, rules
from alarmlake.plans import jobs
from alarmlake.session import materialize, scratch_path
from alarmlake.sources import adapters as A
from alarmlake.sources import raw_files, scans, sinks
from alarmlake.streaming import folds, live

r6 = lambda c: F.round(c, 6)
LOG_COLUMNS = ["TimeOn", "TimeOff", "StationNr", "Alarmcode"]
_UNIQUE_WIDE = "SELECT ts, turbine_id, max(l_quantity) l_quantity, max(l_extendedprice) l_extendedprice, max(l_discount) l_discount, max(l_tax) l_tax FROM scada_wide WHERE turbine_id IN (SELECT station_id FROM station_metadata) GROUP BY 1, 2"


def raw_folder(spark, d):
    """The raw layout of the line items and its months; every month of the source."""
    folder = scratch_path(spark, "raw")
    log = A.raw_alarm_log(spark, d)
    wide = A.scada_wide(spark, d).join(A.station_metadata(spark, d), F.col("turbine_id") == F.col("station_id"), "left_semi")
    wide = wide.groupBy("ts", "turbine_id").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    wide = materialize(wide, "wide")  # grouped once, for both tables
    text = wide.withColumns({"TimeStamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "StationId": F.col("turbine_id"), "wtc_ActRegSt_endvalue": F.lit("NotActive")})
    month_of = lambda name: F.translate(F.substring(name, 1, 7), "-", "_")
    months = raw_files.write_monthly_csv(log.select(*LOG_COLUMNS), folder, "tblAlarmLog", month_of("TimeOn"))
    raw_files.write_monthly_csv(text.select("TimeStamp", "StationId", "l_quantity", "l_tax"), folder, "tblSCTurTemp", month_of("TimeStamp"))
    raw_files.write_monthly_csv(text.select("TimeStamp", "StationId", "l_extendedprice", "l_discount", "wtc_ActRegSt_endvalue"), folder, "tblSCTurGrid", month_of("TimeStamp"))
    return folder, [(int(m[:4]), int(m[5:])) for m in months]


def monthly_log(spark, d):
    folder, periods = raw_folder(spark, d)
    return scans.monthly_csv(spark, folder, "tblAlarmLog", periods, LOG_COLUMNS)


@query("SRC1_monthly_scan", sql("SELECT 'tblAlarmLog' AS \"table\", CAST(substr(time_on, 1, 4) AS INT) AS year, CAST(substr(time_on, 6, 2) AS INT) AS month, time_on, time_off, station, code FROM raw_log", "raw_log"))
def _(spark, d):
    return monthly_log(spark, d).select("table", "year", "month", F.col("TimeOn").alias("time_on"), F.col("TimeOff").alias("time_off"), F.col("StationNr").alias("station"), F.col("Alarmcode").alias("code"))


@query("SRC1_file_rows", sql("SELECT CAST(substr(time_on, 1, 4) AS INT) AS year, CAST(substr(time_on, 6, 2) AS INT) AS month, 1::BIGINT first_row, count(*) last_row, count(*) distinct_rows FROM raw_log GROUP BY 1, 2", "raw_log"))
def _(spark, d):
    rows = scans.with_row_numbers(monthly_log(spark, d))
    return rows.groupBy("year", "month").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.count_distinct("row_no").alias("distinct_rows"))


def dated_alarms(spark, d):
    """Folder of the alarm table partitioned by date."""
    path = scratch_path(spark, "dated")
    sinks.write_table(A.alarms(spark, d), path)
    return path


@query("SRC5_dated_slice", sql("SELECT ts, turbine_id, alarm_code FROM alarms WHERE ts >= '2024-01-10 06:00:00' AND ts < '2024-01-17 18:00:00'", "alarms"))
def _(spark, d):
    return scans.parquet_slice(spark, dated_alarms(spark, d), ["ts", "turbine_id", "alarm_code"], "2024-01-10T06:00:00", "2024-01-17T18:00:00")


@query("SRC6_dated_bounds", sql("SELECT min(ts) first_ts, max(ts) last_ts, count(*) n, count(*) FILTER (ts IS NULL) null_ts FROM alarms", "alarms"))
def _(spark, d):
    return scans.source_bounds(spark.read.parquet(dated_alarms(spark, d)))


@query("FLT5_dated_seek", sql("SELECT seq, ts FROM alarms WHERE ts >= '2024-01-20 12:00:00'", "alarms"))
def _(spark, d):
    rows = spark.read.parquet(dated_alarms(spark, d))
    return filters.seek(rows, "2024-01-20T12:00:00", scans.source_bounds(rows)).select("seq", "ts")


@query("SRC3_companion_scan", "SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7e\\xa0-\\xff]', '?', 'g') field FROM documents")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x20-\x7e\xa0-\xff]", "?").alias("field"))
    path = scratch_path(spark, "companion")
    docs.write.option("header", True).option("encoding", "iso-8859-1").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return scans.companion_csv(spark, path, ["doc_id", "field"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "field")


@query("SRC9_journal_scan", sql("SELECT 'learn' op, count(*) n FROM lifetimes UNION ALL SELECT 'commit', count(*) FROM lifetimes UNION ALL SELECT 'undo', count(*) FROM lifetimes WHERE v_to < 1000000", "lifetimes"))
def _(spark, d):
    path = scratch_path(spark, "journal")
    sinks.append_lines(A.sample_journal(spark, d), path)
    return scans.journal(spark, path).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("SNK4_append_lines", sql("SELECT rule_id, v_from model_version FROM lifetimes", "lifetimes"))
def _(spark, d):
    path = scratch_path(spark, "journal")
    j = A.sample_journal(spark, d)
    sinks.append_lines(j.where("op = 'learn'"), path)
    sinks.append_lines(j.where("op <> 'learn'"), path)
    back = scans.journal(spark, path).where("op = 'commit'")
    return back.select("rule_id", "model_version")


def receipt_lines(spark, d):
    """Receipt log with one line per event, some of them damaged in every known way."""
    e = A.table(spark, d, "events").orderBy("event_id")
    k = F.col("event_id") % 50
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(k == 5, "").when(k == 9, "Z").otherwise("+00:00")
    ident = F.when(k == 7, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"r-'), F.col("event_id").cast("string"), F.lit('"')))
    operation = F.when(k == 4, " ").otherwise(F.col("event_type"))
    extra = F.when(k == 2, ',"operation":"twice"').when(k == 3, ',"x":NaN').otherwise(',"note":"NaN is text here"')
    line = F.concat(F.lit('{"receipt_id":'), ident, F.lit(',"checked_at":"'), stamp, zone, F.lit('","operation":"'), operation, F.lit('"'), extra, F.lit("}"))
    damaged = F.when(k == 1, F.substring(line, 1, 30)).when(k == 6, "  ").when(k == 8, "[1, 2]").otherwise(line)
    path = scratch_path(spark, "receipts")
    e.select(damaged.alias("value")).write.text(path)  # sorted parts, one after another
    return scans.receipts(scans.json_lines(spark, path, one_log=True))


_REASON = "CASE event_id % 50 WHEN 1 THEN 'not_an_object' WHEN 2 THEN 'duplicate_key' WHEN 3 THEN 'nonfinite_number' WHEN 4 THEN 'missing_identity' WHEN 5 THEN 'naive_timestamp' WHEN 7 THEN 'missing_identity' WHEN 8 THEN 'not_an_object' END"


@query("SRC10_receipt_scan", f"SELECT event_id + 1 file_line, {_REASON} reason FROM events WHERE event_id % 50 <> 6")
def _(spark, d):
    return receipt_lines(spark, d).select("file_line", "reason")


@query("SRT4_receipt_views", f"SELECT * FROM (SELECT 'issue' kind, event_id + 1 file_line FROM events WHERE {_REASON} IS NOT NULL ORDER BY event_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'recent', event_id + 1 FROM events WHERE {_REASON} IS NULL AND event_id % 50 <> 6 ORDER BY event_id DESC LIMIT 30)")
def _(spark, d):
    rows = receipt_lines(spark, d)
    issues = scans.receipt_issues(rows).select(F.lit("issue").alias("kind"), "file_line")
    return issues.unionByName(scans.recent_receipts(rows).select(F.lit("recent").alias("kind"), "file_line"))


@query("AGG25_receipt_integrity", f"SELECT count(*) FILTER ({_REASON} IS NULL) valid_receipts, count(*) FILTER ({_REASON} IS NOT NULL) invalid_lines, 30::BIGINT recent_receipts, 'degraded' status, false history_complete, true issues_truncated FROM events WHERE event_id % 50 <> 6")
def _(spark, d):
    return scans.receipt_integrity(receipt_lines(spark, d)).withColumn("recent_receipts", F.col("recent_receipts").cast("bigint"))


@query("SNK1_partitioned_table", sql("SELECT CAST(ts AS DATE) AS date, count(*) n FROM alarms GROUP BY 1", "alarms"))
def _(spark, d):
    return sinks.write_table(A.alarms(spark, d), scratch_path(spark, "alarms")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("SNK2_row_reconciliation", sql("SELECT count(*) written_rows, count(*) expected_rows FROM scada_long", "scada_long"))
def _(spark, d):
    s = A.scada_long(spark, d)
    return sinks.reconcile(sinks.write_table(s, scratch_path(spark, "scada"), ("turbine_id", "signal", "ts")), s)


@query("SNK3_staged_publish", sql("SELECT alarm_code, count(*) n FROM alarms GROUP BY 1", "alarms"))
def _(spark, d):
    root = scratch_path(spark, "published")
    a = A.alarms(spark, d)
    sinks.publish(spark, {"alarms": a.limit(5)}, root)
    sinks.publish(spark, {"alarms": a}, root, lambda w: sinks.reconcile(w["alarms"], a).collect() and None)
    return sinks.published(spark, root, "alarms").groupBy("alarm_code").agg(F.count(F.lit(1)).alias("n"))


@query("SNK5_json_results", sql("SELECT turbine_id, signal, count(*) n, round(avg(value), 6) mean FROM scada_long WHERE signal <> 'click' GROUP BY 1, 2 UNION ALL SELECT turbine_id, signal, count(*), NULL FROM scada_long WHERE signal = 'click' GROUP BY 1, 2", "scada_long"))
def _(spark, d):
    s = A.scada_long(spark, d).groupBy("turbine_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    path = scratch_path(spark, "json")
    sinks.write_json(s.withColumn("mean", F.when(F.col("signal") == "click", F.lit(float("nan"))).otherwise(F.col("mean"))), path)
    return spark.read.schema("turbine_id STRING, signal STRING, n BIGINT, mean DOUBLE").json(path).withColumn("mean", r6("mean"))


# --- streams ----------------------------------------------------------------------------


ROWS_A_FILE, FILES_A_BATCH = 1000, 4
SMALL_FILES, ROWS_A_LARGE_FILE = 12, 250_000  # small tables come in three batches, large ones in batches of a million rows


def _stream(spark, df, label, by="seq"):
    """The table as a stream. What a batch costs apart from its rows is paid once for many rows."""
    rows = materialize(df, f"{label}-rows")
    count = rows.count()
    files = max(min(1 + count // ROWS_A_FILE, SMALL_FILES), 1 + count // ROWS_A_LARGE_FILE)
    path = raw_files.stage_stream(rows, scratch_path(spark, label), files, by)
    return live.event_stream(spark, path, df.schema, FILES_A_BATCH)


@query("STR3_flood_stream", sql("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", count(*) n,
  array_to_string(list_sort(list(DISTINCT alarm_code)), ',') codes FROM alarms GROUP BY 1, 2 HAVING count(*) > 16""", "alarms"))
def _(spark, d):
    a = A.alarms(spark, d)
    stream = _stream(spark, a.unionByName(live.closing_row(a, "1 hour")), "alarms-in")
    out = live.run_available(live.flood_windows(stream, "1 hour", 16), scratch_path(spark, "floods"), scratch_path(spark, "ckpt"))
    return out.withColumn("codes", F.array_join(out.codes.cast("array<string>"), ","))


@query("STR4_collapse_stream", sql("SELECT seq, hidden FROM fold", "alarms", **_throttle_sql(14400000000, _STEP, ["turbine_id"])))
def _(spark, d):
    stream = _stream(spark, _one_rule(spark, d).drop("generation"), "collapse-in")
    return folds.collapse(stream, scratch_path(spark, "collapsed")).select("seq", "hidden")


@query("STR9_reset_stream", sql("SELECT seq, hidden FROM fold", "alarms", **_throttle_sql(14400000000, _STEP, ["turbine_id", "generation"])))
def _(spark, d):
    stream = _stream(spark, _one_rule(spark, d), "reset-in")
    return folds.collapse(stream, scratch_path(spark, "reset"), "generation").select("seq", "hidden")


@query("STR5_detector_stream", sql("SELECT r.seq, round(coalesce(z.score, 0.0), 4) score FROM scada_long r LEFT JOIN zscores z ON z.seq = r.seq", "scada_long", "zscores"))
def _(spark, d):
    rows = A.scada_long(spark, d).select("seq", "turbine_id", "signal", "value")
    out = folds.rolling_scores(_stream(spark, rows, "readings-in"), scratch_path(spark, "scores"), 12)
    return out.select("seq", F.round("score", 4).alias("score"))


_LIVE = {
    "z": """SELECT seq, CASE WHEN n < 2 THEN 0.0 WHEN lo = hi THEN abs(val - lo) / 1e-9 ELSE abs(val - mean) / greatest(std, 1e-9) END score FROM
      (SELECT seq, val, count(val) OVER w n, avg(val) OVER w mean, stddev_pop(val) OVER w std, min(val) OVER w lo, max(val) OVER w hi FROM scored
       WINDOW w AS (PARTITION BY turbine_id, sig ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))""",
    "chance": "SELECT d.*, 1 / (1 + exp(-(val / 10 - 3))) p FROM decided d",
    "hid": """SELECT c.*, c.stage = 'classify' AND c.rule_code IS NOT NULL AND c.p >= 0.9 AS cls, c.stage = 'suppress' OR coalesce(f.hidden, false) OR (c.stage = 'classify' AND c.rule_code IS NOT NULL AND c.p >= 0.9) AS gone
      FROM chance c LEFT JOIN folded f ON f.seq = c.seq""",
}


@query("STR7_verdict_stream", sql("""SELECT h.seq, h.stage, NOT gone AS "show", CASE WHEN cls THEN 'classifier:' || r.rule_id WHEN gone THEN r.rule_id END suppressed_by,
  round(CASE WHEN h.stage = 'critical' THEN 1.0 WHEN h.stage = 'escalate' THEN CAST(h.esc AS DOUBLE) WHEN h.stage = 'classify' THEN CASE WHEN gone THEN p ELSE 1 - p END ELSE CAST(r.confidence AS DOUBLE) END, 6) confidence,
  round(z.score, 4) anomaly_score FROM hid h JOIN z ON z.seq = h.seq LEFT JOIN rules r ON r.code = h.rule_code""", "decided", "folded", "rules", **_LIVE))
def _(spark, d):
    stream = _stream(spark, A.scored_events(spark, d), "events-in")
    chance = features.sigmoid(F.element_at(F.map_values("signals"), 1) / 10 - 3)
    out = folds.verdict_stream(stream, A.sample_rules(spark, d), scratch_path(spark, "verdicts"), ["seq", "ts", "turbine_id"], chance, window=12)
    return out.select("seq", "stage", "show", "suppressed_by", r6("confidence").alias("confidence"), F.round("anomaly_score", 4).alias("anomaly_score"))


_COUNTED = {
    "v": "SELECT *, CASE WHEN ts < '2024-01-15' THEN 0 ELSE 1 END generation, epoch_us(ts) us, alarm_code IS NOT NULL AND \"show\" visible, alarm_code IS NOT NULL AND NOT \"show\" gone FROM verdict",
    "last": "SELECT *, max(us) OVER (PARTITION BY generation) newest FROM (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY seq DESC) r FROM v) WHERE r <= 2000",
    "rate": "SELECT generation, count(*) FILTER (visible AND us > newest - 3600000000) visible_per_hour FROM last GROUP BY 1",
}


@query("STR10_live_counters", sql("""SELECT v.generation, count(*) FILTER (visible) shown, count(*) FILTER (gone) suppressed, round(count(*) FILTER (gone) / nullif(count(*) FILTER (visible OR gone), 0), 6) suppression_rate,
  any_value(visible_per_hour) visible_per_hour, max(seq) last_seq FROM v JOIN rate ON rate.generation = v.generation GROUP BY 1""", "verdict", **_COUNTED))
def _(spark, d):
    generation = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1)
    v = rules.score(A.scored_events(spark, d), A.sample_rules(spark, d)).select("seq", "ts", "alarm_code", "show", generation.alias("generation"))
    rows = folds.live_counters(_stream(spark, v, "verdicts-in"), scratch_path(spark, "counters"), ring_size=2000)
    return folds.newest_counters(rows).withColumn("suppression_rate", r6("suppression_rate"))


@query("STR1_two_source_stream", sql("SELECT seq, ts, turbine_id, alarm_code, is_alarm, readings FROM stream", "stream"))
def _(spark, d):
    alarms, readings = _stream(spark, A.alarms(spark, d), "alarms-in", "ts"), _stream(spark, A.scada_grid(spark, d), "grid-in", "ts")
    out = folds.merged_stream(alarms, readings, scratch_path(spark, "merged"))
    return out.select("seq", "ts", "turbine_id", "alarm_code", "is_alarm", readings_text().alias("readings"))


# --- jobs -------------------------------------------------------------------------------


def _profile_sql(table, left, right):
    nulls = [f"count(*) - count({c})" for c in (left, right)]
    sparse = ", ".join(f"CASE WHEN ({n}) / count(*) > 0.95 THEN '{c}' END" for n, c in zip(nulls, (left, right)))
    return f"""SELECT 'profile', NULL, min(ts), NULL, concat('{table}_', strftime(ts, '%Y_%m'), '.csv'), concat_ws('|', count(*), 2, {nulls[0]} + {nulls[1]}, concat_ws(',', {sparse}),
      count(*) FILTER ({left} IS NULL AND {right} IS NULL), 0, strftime(max(ts), '%Y-%m-%d %H:%M:%S'), count(*), 0, 0), NULL FROM u GROUP BY strftime(ts, '%Y_%m')"""


_LABELLED_LOG = """SELECT CAST(time_on AS TIMESTAMP) ts, station turbine_id, CAST(code AS BIGINT) alarm_code, coalesce(description, '(undocumented)') description, coalesce(stopping, -1) stopping
  FROM raw_log LEFT JOIN code_lookup ON alarm_code = CAST(code AS BIGINT)"""


@query("JOB1_dataset_build", sql(f"""SELECT 'alarms' AS "table", row_number() OVER (ORDER BY ts, turbine_id, alarm_code, description, stopping) - 1 AS seq, ts, turbine_id, CAST(alarm_code AS VARCHAR) field, concat_ws('|', description, stopping) AS text, NULL::DOUBLE AS number FROM labelled
  UNION ALL SELECT 'scada', NULL, ts, turbine_id, signal, NULL, value FROM (SELECT ts, turbine_id, unnest(['l_quantity', 'l_tax', 'l_extendedprice', 'l_discount']) signal, unnest([l_quantity, l_tax, l_extendedprice, l_discount]) AS value FROM u)
  UNION ALL {_profile_sql('tblSCTurTemp', 'l_quantity', 'l_tax')} UNION ALL {_profile_sql('tblSCTurGrid', 'l_discount', 'l_extendedprice')}
  UNION ALL SELECT 'manifest', NULL, NULL, NULL, NULL, concat_ws('|', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT time_on, time_off, station, code FROM raw_log)), count(*) - count(DISTINCT (time_on, station, code)),
    (SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT time_on, time_off, station, code FROM raw_log) GROUP BY time_on, station, code HAVING count(*) > 1)), count(*) FILTER (time_off IS NULL)), NULL FROM raw_log""",
  "raw_log", "scada_wide", "station_metadata", "code_lookup", labelled=_LABELLED_LOG, u=_UNIQUE_WIDE))
def _(spark, d):
    folder, periods = raw_folder(spark, d)
    out = jobs.build_dataset(spark, folder, scratch_path(spark, "dataset"), periods, A.code_lookup(spark, d), A.station_metadata(spark, d), ["tblSCTurTemp", "tblSCTurGrid"])
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    line = lambda *names: F.concat_ws("|", *[F.col(c).cast("string") for c in names]).alias("text")
    parts = [
        out["alarms"].select(F.lit("alarms").alias("table"), "seq", "ts", "turbine_id", F.col("alarm_code").cast("string").alias("field"), line("description", "stopping"), none("double", "number")),
        out["scada"].select(F.lit("scada"), none("bigint", "seq"), "ts", "turbine_id", "signal", none("string", "text"), "value"),
        out["profile"].select(F.lit("profile"), none("bigint", "seq"), "first_ts", none("string", "turbine_id"), "member", line("included_rows", "numeric_signals", "null_measurements", "sparse_columns", "all_null_rows", "duplicate_key_rows", "last_ts", "included", "endpoint_excluded", "illegal"), none("double", "number")),
        out["manifest"].select(F.lit("manifest"), none("bigint", "seq"), none("timestamp_ntz", "ts"), none("string", "turbine_id"), none("string", "field"), line("source_rows", "exact_duplicate_rows", "duplicate_key_rows", "conflicting_end_keys", "missing_ends"), none("double", "number")),
    ]
    return reduce(DataFrame.union, parts)


_PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]
_PART_SQL = " UNION ALL ".join(f"""SELECT 'columns' AS "table", '{c}' AS "column", {i}::BIGINT AS place, '{t}' AS value, count(*) - count({c}) n, NULL::BIGINT distinct_values FROM part""" for i, (c, t) in enumerate(_PART))


@query("JOB2_schema_profile", f"""{_PART_SQL} UNION ALL SELECT 'values', "column", rank, value, n, distinct_values FROM ({ORACLES['AGG16_top_values']})""")
def _(spark, d):
    columns, values = jobs.schema_profile(A.table(spark, d, "part"))
    fields = columns.select(F.lit("columns").alias("table"), "column", F.col("position").cast("bigint").alias("place"), F.col("dtype").alias("value"), F.col("null_count").alias("n"), F.lit(None).cast("bigint").alias("distinct_values"))
    return fields.union(values.select(F.lit("values"), "column", F.col("rank").cast("bigint"), "value", "n", "distinct_values"))


def _labelled(spark, d):
    return lookup.with_code_labels(A.raw_alarms(spark, d), A.code_lookup(spark, d))


@query("JOB3_baseline", sql("""SELECT 'by_turbine' AS name, (SELECT count(*) FROM station_metadata) n UNION ALL SELECT 'flood_windows', (SELECT count(*) FROM bursts) UNION ALL SELECT 'flood_runs', (SELECT count(*) FROM runs)
  UNION ALL SELECT 'edges', (SELECT count(*) FROM edges) UNION ALL SELECT 'groups', (SELECT count(*) FROM groups) UNION ALL SELECT 'group_members', (SELECT count(*) FROM groups) UNION ALL SELECT 'top_codes', 20
  UNION ALL SELECT unnest(['sanity', 'rate', 'known_station_rate', 'coverage', 'pareto', 'flood_summary']), 1 UNION ALL SELECT 'stopping_split', 3 UNION ALL SELECT 'duplicate_sensitivity', 2""", "alarms", "runs", "station_metadata", **_GROUPS))
def _(spark, d):
    o = jobs.BaselineOptions(window="1 hour", threshold=16, pair_window_s=PAIR_S, min_support=SUPPORT)
    report = jobs.baseline(_labelled(spark, d), A.station_metadata(spark, d), o)
    out = None
    for name, df in report.items():
        if name.startswith("worst_") or name == "documented_without_group":
            continue
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("JOB5_vocabulary_build", sql(f"""SELECT 'codes' AS name, CAST(alarm_code AS VARCHAR) AS key, min(description) AS value FROM alarms GROUP BY alarm_code UNION ALL SELECT DISTINCT 'turbines', turbine_id, NULL FROM alarms
  UNION ALL SELECT DISTINCT 'unmapped', turbine_id, NULL FROM alarms WHERE turbine_id NOT IN (SELECT station_id FROM station_metadata)
  UNION ALL SELECT 'labels', station_id, turbine_name FROM station_metadata WHERE station_id IN (SELECT turbine_id FROM alarms) UNION ALL SELECT 'aliases', alias, turbine_id FROM ({ORACLES['FUN9_aliases']})""", "alarms", "station_metadata"))
def _(spark, d):
    tables = jobs.build_vocabulary(A.alarms(spark, d), A.code_lookup(spark, d), A.station_metadata(spark, d))
    root = scratch_path(spark, "vocabulary")
    jobs.publish_vocabulary(spark, tables, root)
    fields = {"conflicts": ("kind", "subject"), "codes": ("alarm_code", "description"), "turbines": ("turbine_id", None), "unmapped": ("turbine_id", None), "labels": ("turbine_id", "label"), "aliases": ("alias", "turbine_id")}
    text = lambda c, name: (F.lit(None) if c is None else F.col(c)).cast("string").alias(name)
    return reduce(DataFrame.union, [sinks.published(spark, root, n).select(F.lit(n).alias("name"), text(k, "key"), text(v, "value")) for n, (k, v) in fields.items()])


_AUDITS = ["as_it_is", "metric_off", "rows_lost", "label_changed"]


@query("JOB6_source_audit", sql("""SELECT variant, CASE WHEN variant IN ('metric_off', 'rows_lost') THEN 'mismatch' ELSE 'verified' END status, records, (SELECT count(*) FROM station_metadata) stations, site_rate, round(top / records * 100, 6) top10_share_pct,
  CASE WHEN variant = 'rows_lost' THEN (SELECT count(DISTINCT (ts, turbine_id, alarm_code)) FROM alarms WHERE seq % 50 = 7) ELSE 0 END key_differences,
  CASE WHEN variant = 'label_changed' THEN (SELECT count(*) FROM alarms WHERE seq % 90 = 4) ELSE 0 END label_differences, CAST(records - keys AS BIGINT) duplicates_retained, variant = 'as_it_is' verified FROM measured JOIN tops USING (variant)""",
  "alarms", "station_metadata", audited=f"SELECT variant, alarms.* FROM alarms, (SELECT unnest({_AUDITS}) variant) WHERE variant <> 'rows_lost' OR seq % 50 <> 7",
  measured="SELECT variant, count(*) records, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0), 6) site_rate, count(DISTINCT (ts, turbine_id, alarm_code)) keys FROM audited GROUP BY variant",
  tops="SELECT variant, sum(n) top FROM (SELECT variant, count(*) n, row_number() OVER (PARTITION BY variant ORDER BY count(*) DESC) r FROM audited GROUP BY variant, alarm_code) WHERE r <= 10 GROUP BY variant"))
def _(spark, d):
    whole, raw, codes, stations = A.alarms(spark, d), A.raw_alarms(spark, d), A.code_lookup(spark, d), A.station_metadata(spark, d)
    other = F.when(F.col("seq") % 90 == 4, F.lit("another label")).otherwise(F.col("description"))
    processed = {"rows_lost": whole.where("seq % 50 <> 7"), "label_changed": whole.withColumn("description", other)}
    parts = [
        jobs.source_audit(raw, processed.get(v, whole), codes, stations, stored_metrics(spark, d, "site_rate" if v == "metric_off" else "")).withColumn("variant", F.lit(v))
        for v in _AUDITS
    ]
    return reduce(DataFrame.unionByName, parts).withColumns({"site_rate": r6("site_rate"), "top10_share_pct": r6("top10_share_pct")})


@query("JOB7_backfill", sql("""SELECT s.seq, s.is_alarm, NOT coalesce(s.is_alarm AND EXISTS (SELECT 1 FROM rules r WHERE r.kind IN (0, 1) AND r.code = s.alarm_code AND (r.kind = 0 OR r.station = s.turbine_id)), false) AS show, round(coalesce(a.score, 0.0), 4) anomaly_score
  FROM stream s LEFT JOIN (SELECT seq, max(CASE WHEN n < 2 THEN 0.0 WHEN lo = hi THEN abs(value - lo) / 1e-9 ELSE abs(value - mean) / greatest(std, 1e-9) END) score FROM windowed GROUP BY seq) a ON a.seq = s.seq""", "stream", "rules",
  stream_keys="""SELECT row_number() OVER (ORDER BY ts, is_alarm, turbine_id, rnk, src) - 1 AS seq, ts, turbine_id, rnk, is_alarm FROM (SELECT ts, turbine_id, true is_alarm, alarm_code rnk, seq src FROM alarms UNION ALL SELECT DISTINCT ts, turbine_id, false, layer, 0 FROM layers)""",
  windowed="""SELECT *, count(value) OVER w n, avg(value) OVER w mean, stddev_pop(value) OVER w std, min(value) OVER w lo, max(value) OVER w hi FROM (SELECT k.seq, l.turbine_id, l.signal, l.value FROM layers l JOIN stream_keys k ON NOT k.is_alarm AND k.ts = l.ts AND k.turbine_id = l.turbine_id AND k.rnk = l.layer WHERE l.value IS NOT NULL)
    WINDOW w AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""))
def _(spark, d):
    v = jobs.backfill(A.alarms(spark, d), A.scada_grid(spark, d), A.sample_rules(spark, d).where("pattern.kind = 'code_match' AND action = 'suppress'"), 12)
    return v.select("seq", F.col("alarm_code").isNotNull().alias("is_alarm"), "show", F.round("anomaly_score", 4).alias("anomaly_score"))


_TEACH = {
    "teach": "SELECT min(code) code FROM rules WHERE kind = 0",
    "hit": "SELECT seq, turbine_id, is_critical FROM scored WHERE alarm_code = (SELECT code FROM teach)",
    "span": "SELECT first_seq, least((SELECT count(*) FROM scored), greatest(first_seq + 1, 2000)) end_seq FROM (SELECT min(seq) first_seq FROM hit)",
    "recent": "SELECT s.* FROM scored s, span WHERE s.seq >= end_seq - 2000 AND s.seq < end_seq AND s.alarm_code IS NOT NULL",
}


@query("JOB8_teach_and_measure", sql("""SELECT first_seq, end_seq, (SELECT count(*) FROM recent) examples, (SELECT count(*) FROM recent) before_shown, 0::BIGINT before_suppressed,
  (SELECT count(*) FILTER (alarm_code <> (SELECT code FROM teach) OR is_critical) FROM recent) after_shown, (SELECT count(*) FILTER (alarm_code = (SELECT code FROM teach) AND NOT is_critical) FROM recent) after_suppressed,
  (SELECT count(*) FILTER (alarm_code = (SELECT code FROM teach) AND NOT is_critical) FROM recent) newly_suppressed, (SELECT min(seq) FROM hit WHERE seq >= end_seq) later_seq, (SELECT first(is_critical ORDER BY seq) FROM hit WHERE seq >= end_seq) later_show, NULL::BIGINT other_seq, NULL::BOOLEAN other_show,
  (SELECT CASE WHEN (SELECT reversible FROM rules WHERE code = (SELECT code FROM teach)) THEN count(*) ELSE count(*) FILTER (alarm_code <> (SELECT code FROM teach) OR is_critical) END FROM recent) undo_shown,
  (SELECT CASE WHEN (SELECT reversible FROM rules WHERE code = (SELECT code FROM teach)) THEN 0 ELSE count(*) FILTER (alarm_code = (SELECT code FROM teach) AND NOT is_critical) END FROM recent) undo_suppressed FROM span""", "scored", "rules", **_TEACH))
def _(spark, d):
    r = A.sample_rules(spark, d)
    rule = r.where("pattern.kind = 'code_match' AND action = 'suppress' AND scope.turbine_id IS NULL").orderBy("rule_order").limit(1)
    return jobs.teach_and_measure(A.scored_events(spark, d), rule)


_DECLARED = """SELECT ts, turbine_id, alarm_code, CASE WHEN seq % 300 = 0 THEN 9 ELSE stopping END AS stopping FROM alarms WHERE seq % 100 = 0
  UNION ALL SELECT DISTINCT ts, turbine_id, -1, 0 FROM alarms WHERE seq % 97 = 0"""


@query("JOB9_scenario_checks", sql("""SELECT d.*, count(a.seq) matches, coalesce(count(a.seq) = 1 AND min(a.stopping) = d.stopping, false) ok, w.n window_rows, off, off = 0 window_ok
  FROM (SELECT unnest([0, 1]) off) CROSS JOIN declared d CROSS JOIN (SELECT count(*) n FROM alarms_dup WHERE ts > '2024-01-05 10:00:00' AND ts <= '2024-01-05 22:00:00') w
  LEFT JOIN alarms_dup a ON a.ts = d.ts AND a.turbine_id = d.turbine_id AND a.alarm_code = d.alarm_code GROUP BY d.ts, d.turbine_id, d.alarm_code, d.stopping, w.n, off""", "alarms_dup", declared=_DECLARED))
def _(spark, d):
    a = A.alarms(spark, d)
    declared = a.where("seq % 100 = 0").select("ts", "turbine_id", "alarm_code", F.when(F.col("seq") % 300 == 0, 9).otherwise(F.col("stopping")).alias("stopping"))
    absent = a.where("seq % 97 = 0").select("ts", "turbine_id", F.lit(-1).cast("bigint").alias("alarm_code"), F.lit(0).alias("stopping")).distinct()
    raw = A.table(spark, d, "events").where("ts > TIMESTAMP_NTZ'2024-01-05 10:00:00' AND ts <= TIMESTAMP_NTZ'2024-01-05 22:00:00'")
    want = raw.agg(F.count(F.lit(1)) + F.count_if(F.col("event_id") % 29 == 0)).scalar()
    start, end = "2024-01-05T10:00:00", "2024-01-05T22:00:00"
    parts = [jobs.scenario_checks(A.alarms_dup(spark, d), declared.union(absent), start, end, want - off).withColumn("off", F.lit(off)) for off in (0, 1)]
    return parts[0].unionByName(parts[1])
