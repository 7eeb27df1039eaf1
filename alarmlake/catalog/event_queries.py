"""Filters, joins, sets, event stream, detectors and windows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.catalog.base import query, sql
from alarmlake.operators import audit, detect, events, filters, lookup, quality, validate
from alarmlake.plans.segments import dense_sequence
from alarmlake.session import materialize
from alarmlake.sources import adapters as A
from alarmlake.sources import scans

r6 = lambda c: F.round(c, 6)
SIGNALS = ["click", "error", "purchase", "signup", "view"]


def count_by(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# --- scans and bounds -------------------------------------------------------------------


@query("SRC5_time_slice", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17'")
def _(spark, d):
    return scans.parquet_slice(spark, f"{d}/events.parquet", ["event_id", "ts"], "2024-01-10", "2024-01-17")


@query("SRC6_source_bounds", "SELECT min(ts) first_ts, max(ts) last_ts, count(*) n, count(*) FILTER (ts IS NULL) null_ts FROM events")
def _(spark, d):
    return scans.source_bounds(A.table(spark, d, "events"))


@query("SRC7_combined_bounds", sql("SELECT least((SELECT min(ts) FROM alarms), (SELECT min(ts) FROM scada_wide)) first_ts, greatest((SELECT max(ts) FROM alarms), (SELECT max(ts) FROM scada_wide)) last_ts, (SELECT count(*) FROM alarms) alarm_rows, (SELECT count(*) FROM scada_wide) scada_rows", "alarms", "scada_wide"))
def _(spark, d):
    return scans.combined_bounds(A.alarms(spark, d), A.scada_wide(spark, d))


# --- filters ----------------------------------------------------------------------------



@query("FLT1_month_filter", sql("SELECT count(*) FILTER (ts >= '1998-03-01' AND ts < '1998-04-01') included, count(*) FILTER (ts = '1998-04-01') endpoint_excluded, count(*) FILTER (ts < '1998-03-01' OR ts > '1998-04-01') illegal FROM scada_wide", "scada_wide"))
def _(spark, d):
    return filters.month_profile(A.scada_wide(spark, d), 1998, 3)


@query("FLT2_known_stations", sql("SELECT turbine_id IN (SELECT station_id FROM station_metadata) known, turbine_id, count(*) n FROM alarms GROUP BY 1, 2", "alarms", "station_metadata"))
def _(spark, d):
    known, unknown = lookup.split_known(A.alarms(spark, d), A.station_metadata(spark, d))
    both = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return count_by(both, "known", "turbine_id")


@query("FLT3_trailing_window", sql("SELECT * FROM alarms WHERE ts > '2024-01-05 10:00:00' AND ts <= '2024-01-06 10:00:00'", "alarms"))
def _(spark, d):
    return filters.trailing_window(A.alarms(spark, d), "2024-01-05T10:00:00", "2024-01-06T10:00:00")


_TARGETS = "SELECT DISTINCT turbine_id, alarm_code, CAST(ts AS DATE) AS day FROM alarms WHERE seq % 5 = 0 UNION SELECT turbine_id, -1, CAST(ts AS DATE) FROM alarms WHERE seq % 97 = 0"


@query("FLT4_point_lookup", sql("SELECT t.turbine_id, t.alarm_code, t.day, count(a.seq) matches FROM targets t LEFT JOIN alarms a ON a.turbine_id = t.turbine_id AND a.alarm_code = t.alarm_code AND CAST(a.ts AS DATE) = t.day GROUP BY 1, 2, 3", "alarms", targets=_TARGETS))
def _(spark, d):
    a = A.alarms(spark, d).withColumn("day", F.to_date("ts"))
    keys = ["turbine_id", "alarm_code", "day"]
    absent = a.where("seq % 97 = 0").select("turbine_id", F.lit(-1).cast("bigint").alias("alarm_code"), "day")
    return filters.point_lookup(a, a.where("seq % 5 = 0").select(*keys).union(absent).distinct(), keys)


@query("FLT5_seek", sql("SELECT seq, ts FROM alarms WHERE ts >= '2024-01-20 12:00:00'", "alarms"))
def _(spark, d):
    a = A.alarms(spark, d)
    return filters.seek(a.select("seq", "ts"), "2024-01-20T12:00:00", scans.source_bounds(a))


@query("FLT6_provenance", sql("""SELECT time_on, station, code, first(member ORDER BY member, seq) member, first(seq ORDER BY member, seq) row_no, count(*) occurrences FROM
  (SELECT *, concat('log_', substr(time_on, 1, 7)) member FROM raw_log) WHERE (time_on, station, code) IN (SELECT (time_on, station, code) FROM raw_log WHERE seq % 10 = 3) GROUP BY 1, 2, 3""", "raw_log"))
def _(spark, d):
    raw = A.raw_alarm_log(spark, d).select(F.col("TimeOn").alias("time_on"), F.col("StationNr").alias("station"), F.col("Alarmcode").alias("code"), F.concat(F.lit("log_"), F.substring("TimeOn", 1, 7)).alias("member"), F.col("seq").alias("row_no"))
    keys = ["time_on", "station", "code"]
    return filters.trace_raw(raw, raw.where("row_no % 10 = 3"), keys, ["member", "row_no"], [])


# --- projections ------------------------------------------------------------------------


@query("PRJ1_canonical_rows", sql("SELECT CAST(time_on AS TIMESTAMP) ts, station turbine_id, CAST(code AS BIGINT) alarm_code FROM raw_log", "raw_log"))
def _(spark, d):
    return scans.alarm_log(A.raw_alarm_log(spark, d))


@query("PRJ2_unpivot", sql("""SELECT seq, 'l_quantity' signal, l_quantity AS value FROM scada_wide UNION ALL SELECT seq, 'l_extendedprice', l_extendedprice FROM scada_wide
  UNION ALL SELECT seq, 'l_discount', l_discount FROM scada_wide UNION ALL SELECT seq, 'l_tax', l_tax FROM scada_wide""", "scada_wide"))
def _(spark, d):
    return quality.to_long(A.scada_wide(spark, d), ["seq"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("PRJ3_event_struct", sql("SELECT ts, turbine_id, alarm_code, description, stopping, 0 AS readings, true is_alarm FROM alarms", "alarms"))
def _(spark, d):
    return events.alarm_events(A.alarms(spark, d)).select("ts", "turbine_id", "alarm_code", "description", "stopping", F.size("signals").alias("readings"), "is_alarm")


# --- joins ------------------------------------------------------------------------------


@query("JON1_code_lookup", sql("SELECT * FROM alarms", "alarms"))
def _(spark, d):
    return A.alarms(spark, d)


@query("SRC4_code_lookup_scan", sql("SELECT * FROM code_lookup", "code_lookup"))
def _(spark, d):
    raw = A.code_lookup(spark, d).select(F.col("alarm_code").cast("string").alias("Alarm Code"), F.concat(F.lit(" "), "description", F.lit("  ")).alias("Description"), F.col("stopping").cast("string").alias("Stopping"))
    return scans.code_lookup(raw)


@query("JON2_station_labels", sql("SELECT a.seq, a.turbine_id, m.turbine_name turbine_label FROM alarms a LEFT JOIN station_metadata m ON m.station_id = a.turbine_id", "alarms", "station_metadata"))
def _(spark, d):
    return lookup.with_station_labels(A.raw_alarms(spark, d).select("seq", "turbine_id"), A.station_metadata(spark, d))


@query("JON3_known_station_counts", sql("SELECT m.station_id, m.turbine_name, count(a.seq) n FROM station_metadata m LEFT JOIN alarms a ON a.turbine_id = m.station_id GROUP BY 1, 2", "alarms", "station_metadata"))
def _(spark, d):
    return lookup.known_station_counts(A.raw_alarms(spark, d), A.station_metadata(spark, d))


@query("JON4_unmapped_stations", sql("SELECT DISTINCT turbine_id FROM scada_wide WHERE turbine_id NOT IN (SELECT station_id FROM station_metadata)", "scada_wide", "station_metadata"))
def _(spark, d):
    return lookup.unmapped_stations(A.scada_wide(spark, d), A.station_metadata(spark, d))


_RAW_CELLS = "SELECT ts, turbine_id, signal, layer, CASE WHEN seq % 53 = 0 THEN value + 1 WHEN seq % 59 = 0 THEN NULL ELSE value END AS value FROM layers WHERE seq % 61 <> 0"


@query("JON7_cell_compare", sql("""SELECT ts, turbine_id, signal, layer, l.value left_value, r.value right_value, l.signal IS NOT NULL in_left, r.signal IS NOT NULL in_right FROM (SELECT * FROM layers WHERE seq % 67 <> 0) l
  FULL JOIN raw_cells r USING (ts, turbine_id, signal, layer) WHERE l.signal IS NULL OR r.signal IS NULL OR l.value IS DISTINCT FROM r.value""", "layers", raw_cells=_RAW_CELLS))
def _(spark, d):
    cells = events.with_occurrence(A.scada_grid(spark, d)).withColumn("layer", F.col("layer").cast("bigint"))
    raw = cells.where("seq % 61 <> 0").withColumn("value", F.expr("CASE WHEN seq % 53 = 0 THEN value + 1 WHEN seq % 59 = 0 THEN NULL ELSE value END"))
    return audit.cell_differences(cells.where("seq % 67 <> 0"), raw, ["ts", "turbine_id", "signal", "layer"])


@query("JON8_label_conformity", sql("SELECT seq FROM alarms WHERE seq % 37 = 0 OR (seq % 41 = 0 AND stopping <> 1)", "alarms"))
def _(spark, d):
    stored = A.alarms(spark, d).withColumns({
        "description": F.when(F.col("seq") % 37 == 0, F.concat("description", F.lit("?"))).otherwise(F.col("description")),
        "stopping": F.when(F.col("seq") % 41 == 0, 1).otherwise(F.col("stopping")),
    })
    return lookup.label_mismatches(stored, A.code_lookup(spark, d)).select("seq")


@query("JON9_chronological_merge", sql("SELECT seq, ts, turbine_id, alarm_code, is_alarm FROM stream", "stream"))
def _(spark, d):
    return events.merged_events(A.alarms(spark, d), A.scada_grid(spark, d)).select("seq", "ts", "turbine_id", "alarm_code", "is_alarm")


# --- event stream -----------------------------------------------------------------------



def readings_text():
    return F.array_join(F.transform(F.map_entries("signals"), lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"].isNull(), "null").otherwise(F.format_string("%.2f", e["value"])))), ",")


@query("STR1_merged_stream", sql("SELECT seq, ts, turbine_id, alarm_code, is_alarm, readings FROM stream", "stream"))
def _(spark, d):
    return events.merged_events(A.alarms(spark, d), A.scada_grid(spark, d)).select("seq", "ts", "turbine_id", "alarm_code", "is_alarm", readings_text().alias("readings"))


@query("STR2_snapshot_pivot", sql("""SELECT ts, turbine_id, layer, string_agg(concat(signal, '=', CASE WHEN value IS NULL THEN 'null' ELSE printf('%.2f', value) END), ',' ORDER BY signal) readings, count(*) FILTER (value IS NULL) null_readings FROM layers GROUP BY 1, 2, 3""", "layers"))
def _(spark, d):
    s = events.snapshots(A.scada_grid(spark, d))
    nulls = F.size(F.filter(F.map_values("signals"), lambda v: v.isNull())).cast("bigint")
    return s.select("ts", "turbine_id", F.col("layer").cast("bigint").alias("layer"), readings_text().alias("readings"), nulls.alias("null_readings"))


@query("WIN5_occurrence_index", sql("SELECT seq, layer FROM layers", "layers"))
def _(spark, d):
    return events.with_occurrence(A.scada_grid(spark, d)).select("seq", F.col("layer").cast("bigint").alias("layer"))


@query("WIN7_ring", sql("SELECT seq, ts FROM alarms ORDER BY seq DESC LIMIT 2000", "alarms"))
def _(spark, d):
    return events.ring(A.alarms(spark, d), 2000).select("seq", "ts")


@query("STR11_event_id", sql("SELECT concat(generation, ':', seq) event_id, turbine_id FROM (SELECT *, CASE WHEN ts < '2024-01-15' THEN 0 ELSE 1 END generation FROM alarms)", "alarms"))
def _(spark, d):
    generation = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), 0).otherwise(1)
    return A.alarms(spark, d).select(events.event_id(generation, F.col("seq")).alias("event_id"), "turbine_id")


@query("SRT1_canonical_sort", sql("SELECT row_number() OVER (ORDER BY ts, turbine_id, alarm_code, seq) - 1 AS position, seq FROM (SELECT date_trunc('day', ts) ts, turbine_id, alarm_code, seq FROM alarms)", "alarms"))
def _(spark, d):
    a = A.raw_alarms(spark, d).withColumn("ts", F.date_trunc("day", "ts"))
    return dense_sequence(a, [F.col(c) for c in ("ts", "turbine_id", "alarm_code", "seq")], "position").select("position", "seq")


@query("SRT3_console_view", sql("SELECT seq, alarm_code FROM (SELECT * FROM scored ORDER BY seq DESC LIMIT 2000) WHERE alarm_code IS NOT NULL ORDER BY seq DESC LIMIT 200", "scored"))
def _(spark, d):
    return events.console_view(A.scored_events(spark, d), 2000).select("seq", "alarm_code")


@query("SRT5_edge_rows", sql("""SELECT ts, turbine_id, layer, signal, value FROM (SELECT *, row_number() OVER (PARTITION BY ts, turbine_id, layer ORDER BY signal) u, row_number() OVER (PARTITION BY ts, turbine_id, layer ORDER BY signal DESC) v,
  CASE WHEN value IS NULL THEN row_number() OVER (PARTITION BY ts, turbine_id, layer, value IS NULL ORDER BY signal) END k FROM layers) WHERE u <= 1 OR v <= 1 OR k <= 1""", "layers"))
def _(spark, d):
    s = events.snapshots(A.scada_grid(spark, d)).withColumn("layer", F.col("layer").cast("bigint"))
    return audit.preview_names(s, ["ts", "turbine_id", "layer"], 1, 1).drop("position")


# --- sets -------------------------------------------------------------------------------


@query("SET1_month_union", sql("SELECT seq, CAST(time_on AS TIMESTAMP) ts FROM raw_log WHERE time_on >= '1998' AND time_on < '1999'", "raw_log"))
def _(spark, d):
    # Every month is a scan of its own; the text is parsed once for all of them.
    rows = materialize(A.raw_alarm_log(spark, d).select("seq", validate.iso_or_null(F.col("TimeOn")).alias("ts")), "typed-log")
    return reduce(DataFrame.unionByName, [filters.month_slice(rows, 1998, m) for m in range(1, 13)])


@query("SET2_multiset_equality", sql("""SELECT turbine_id, alarm_code, CAST(sum(l) AS BIGINT) left_rows, CAST(sum(r) AS BIGINT) right_rows FROM (SELECT turbine_id, alarm_code, 1 l, 0 r FROM alarms UNION ALL SELECT turbine_id, alarm_code, 0, 1 FROM alarms_dup)
  GROUP BY 1, 2 HAVING sum(l) <> sum(r)""", "alarms_dup"))
def _(spark, d):
    return audit.multiset_difference(A.alarms(spark, d), A.alarms_dup(spark, d), ["turbine_id", "alarm_code"])


@query("SET3_distinct_keys", sql("SELECT ts, turbine_id, alarm_code, min(seq) seq FROM alarms_dup GROUP BY 1, 2, 3", "alarms_dup"))
def _(spark, d):
    return A.alarms_dup(spark, d).groupBy("ts", "turbine_id", "alarm_code").agg(F.min("seq").alias("seq"))


@query("SET4_code_difference", sql("SELECT DISTINCT alarm_code FROM alarms WHERE alarm_code NOT IN (SELECT alarm_code FROM code_lookup)", "alarms"))
def _(spark, d):
    return quality.difference(A.raw_alarms(spark, d), A.code_lookup(spark, d), "alarm_code")


# --- detectors --------------------------------------------------------------------------


@query("WIN1_zscore", sql("SELECT r.seq, r.turbine_id, r.signal, round(coalesce(z.score, 0.0), 4) score FROM scada_long r LEFT JOIN zscores z ON z.seq = r.seq", "scada_long", "zscores"))
def _(spark, d):
    return detect.zscores(A.scada_long(spark, d), 12).select("seq", "turbine_id", "signal", F.round("score", 4).alias("score"))


@query("WIN2_past_only_scores", sql("SELECT e.event_id seq, round(coalesce(z.score, 0.0), 4) anomaly_score FROM events e LEFT JOIN zscores z ON z.seq = e.event_id", "zscores"))
def _(spark, d):
    e = A.scada_long(spark, d).select("seq", "ts", "turbine_id", F.create_map("signal", "value").alias("signals"))
    return detect.with_anomaly(e, 12).select("seq", F.round("anomaly_score", 4).alias("anomaly_score"))


_SCALE = """SELECT seq, CASE WHEN value IS NULL OR plo IS NULL THEN NULL WHEN phi = plo THEN 0.0 ELSE round(least(1.0, greatest(0.0, (value - plo) / (phi - plo))), 6) END scaled_before,
  CASE WHEN value IS NULL THEN NULL WHEN uhi = ulo THEN 0.0 ELSE round((value - ulo) / (uhi - ulo), 6) END scaled_after FROM
  (SELECT *, min(value) OVER p plo, max(value) OVER p phi, min(value) OVER u ulo, max(value) OVER u uhi FROM scada_long
   WINDOW p AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query("WIN3_running_scale", sql(_SCALE, "scada_long"))
def _(spark, d):
    return detect.running_scale(A.scada_long(spark, d)).select("seq", r6("scaled_before").alias("scaled_before"), r6("scaled_after").alias("scaled_after"))


HST_WINDOW = 32
_HST = {
    "forest": "SELECT * FROM (VALUES {}) f (tree, node, signal, split)".format(
        ", ".join(f"({t}, {i}, '{SIGNALS[f]}', {split!r}e0)" for t, i, f, split in detect.forest_rows(len(SIGNALS)))
    ),
    "scaled": """SELECT seq, turbine_id, signal, (row_number() OVER (PARTITION BY turbine_id ORDER BY seq) - 1) // {} AS win,
        CASE WHEN plo IS NULL OR phi = plo THEN 0.0 ELSE least(1.0, greatest(0.0, (value - plo) / (phi - plo))) END AS before,
        CASE WHEN uhi = ulo THEN 0.0 ELSE (value - ulo) / (uhi - ulo) END AS after
      FROM (SELECT *, min(value) OVER p plo, max(value) OVER p phi, min(value) OVER u ulo, max(value) OVER u uhi FROM scada_long WHERE value IS NOT NULL
        WINDOW p AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY turbine_id, signal ORDER BY seq ROWS UNBOUNDED PRECEDING))""".format(HST_WINDOW),
    "walk": """SELECT s.seq, s.turbine_id, s.win, s.signal, side.learn, CASE WHEN side.learn THEN s.after ELSE s.before END x, tree, 0 AS node, 0 AS depth
        FROM scaled s, (VALUES (true), (false)) side (learn), (SELECT DISTINCT tree FROM forest)
      UNION ALL SELECT w.seq, w.turbine_id, w.win, w.signal, w.learn, w.x, w.tree,
        2 * w.node + 1 + CASE WHEN (CASE WHEN w.signal = f.signal THEN w.x ELSE 0.0 END) >= f.split THEN 1 ELSE 0 END, w.depth + 1
        FROM walk w JOIN forest f ON f.tree = w.tree AND f.node = w.node""",
    "mass": "SELECT turbine_id, win, tree, node, count(*) n FROM walk WHERE learn GROUP BY ALL",
    "visits": """SELECT w.seq, w.tree, w.depth, w.win, coalesce(m.n, 0) n FROM walk w
        LEFT JOIN mass m ON m.turbine_id = w.turbine_id AND m.win = w.win - 1 AND m.tree = w.tree AND m.node = w.node WHERE NOT w.learn""",
    "kept": """SELECT *, count(*) FILTER (n < {}) OVER (PARTITION BY seq, tree ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) light
        FROM visits""".format(detect.HST_MIN_SHARE * HST_WINDOW),
}
_HST_TOP = detect.HST_TREES * HST_WINDOW * (2 ** (detect.HST_DEPTH + 1) - 1)


@query("STR6_half_space_trees", sql(f"""SELECT seq, CASE WHEN max(win) = 0 THEN 0.0 ELSE
  round(1 - sum(CASE WHEN light = 0 THEN n * (1 << depth) ELSE 0 END) / {_HST_TOP}, 9) END anomaly_score FROM kept GROUP BY seq""", "scada_long", **_HST))
def _(spark, d):
    e = A.scada_long(spark, d).select("seq", "ts", "turbine_id", F.create_map("signal", "value").alias("signals"))
    return detect.half_space_scores(e, SIGNALS, window=HST_WINDOW).withColumn("anomaly_score", F.round("anomaly_score", 9))


# --- time functions ---------------------------------------------------------------------


@query("FUN1_floor_time", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) bin, CAST(ts AS DATE) AS day, count(*) n FROM events GROUP BY 1, 2")
def _(spark, d):
    return count_by(A.table(spark, d, "events").select(F.window("ts", "10 minutes")["start"].alias("bin"), F.to_date("ts").alias("day")), "bin", "day")


@query("FUN2_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') iso, ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE utc FROM events")
def _(spark, d):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return A.table(spark, d, "events").select("event_id", iso.alias("iso"), validate.iso_or_null(F.concat(iso, F.lit("+05:30"))).alias("utc"))


@query("AGG21_member_fingerprint", sql("SELECT substr(time_on, 1, 7) member, count(*) n FROM raw_log GROUP BY 1", "raw_log"))
def _(spark, d):
    raw = A.raw_alarm_log(spark, d).withColumn("member", F.substring("TimeOn", 1, 7))
    return audit.fingerprint(raw, "member", ["TimeOn", "TimeOff", "StationNr", "Alarmcode"]).select("member", "n")


@query("AGG21_member_digest")
def _(spark, d):
    raw = A.raw_alarm_log(spark, d).withColumn("member", F.substring("TimeOn", 1, 7))
    return audit.fingerprint(raw, "member", ["TimeOn", "TimeOff", "StationNr", "Alarmcode"])


@query("AGG22_snapshot_digest", sql("""SELECT ts, turbine_id, layer, CAST(count(*) AS INT) readings, CAST(count(*) FILTER (value IS NULL) AS INT) null_readings,
  sha256(concat('{', string_agg(concat('"', signal, '":', CASE WHEN value IS NULL THEN 'null' ELSE CAST(value AS VARCHAR) END), ',' ORDER BY signal), '}')) signals_sha256 FROM layers GROUP BY 1, 2, 3""", "layers"))
def _(spark, d):
    s = events.snapshots(A.scada_grid(spark, d)).withColumn("layer", F.col("layer").cast("bigint"))
    return audit.snapshot_digest(s)


def stored_metrics(spark, d, tampered: str = ""):
    """Metrics as somebody else worked them out from the raw rows; ``tampered`` names one that is off."""
    rows, codes = A.table(spark, d, "events"), A.raw_alarms(spark, d)
    top = codes.groupBy("alarm_code").count().orderBy(F.desc("count")).limit(10).agg(F.sum("count")).scalar()
    stored = rows.agg(F.count("event_id").alias("records"), F.expr("timestampdiff(MICROSECOND, min(ts), max(ts)) / 3.6e9D").alias("observed_hours")).select(
        "records", "observed_hours", (F.col("records") / F.col("observed_hours")).alias("site_rate"), (top / F.col("records") * 100).alias("top10_share_pct"), A.table(spark, d, "nation").agg(F.count("n_nationkey")).scalar().alias("stations")
    )
    return stored.withColumn(tampered, F.col(tampered) + 1) if tampered else stored


TAMPERED = ["", "records", "site_rate", "top10_share_pct", "stations"]
_METRICS_SQL = """count(*) records, (SELECT count(*) FROM station_metadata) stations, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0), 6) site_rate,
  round((SELECT sum(n) FROM (SELECT count(*) n FROM alarms GROUP BY alarm_code ORDER BY n DESC LIMIT 10)) / count(*) * 100, 6) top10_share_pct"""


@query("AGG23_published_reconciliation", sql(f"SELECT stored, CASE WHEN stored = '' THEN 'verified' ELSE 'mismatch' END status, {_METRICS_SQL} FROM alarms, (SELECT unnest({TAMPERED}) stored) GROUP BY stored", "alarms", "station_metadata"))
def _(spark, d):
    again = audit.published_metrics(A.alarms(spark, d), A.station_metadata(spark, d))
    parts = [audit.reconcile_published(stored_metrics(spark, d, t), again).withColumn("stored", F.lit(t)) for t in TAMPERED]
    return reduce(DataFrame.unionByName, parts).withColumns({"site_rate": r6("site_rate"), "top10_share_pct": r6("top10_share_pct")})


@query("FUN16_sha256", "SELECT doc_id, sha256(text) digest FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
