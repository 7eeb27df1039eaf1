"""Rates, Pareto, floods, co-occurrence, cliques, quality."""

from pyspark.sql import functions as F

from alarmlake.catalog.base import query, sql
from alarmlake.operators import cliques, cooccur, lookup, metrics, quality, validate
from alarmlake.plans import jobs
from alarmlake.plans.segments import dense_sequence
from alarmlake.session import materialize
from alarmlake.sources import adapters as A

HOUR, OVER = "1 hour", 16
PAIR_S, SUPPORT = 3 * 86400, 0.5
r6 = lambda c: F.round(c, 6)
_HOURS = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0)"


@query("AGG1_alarm_rate", sql(f"SELECT count(*) records, count(DISTINCT turbine_id) stations, round({_HOURS}, 6) AS hours, round(count(*) / {_HOURS} / count(DISTINCT turbine_id), 6) rate FROM alarms", "alarms"))
def _(spark, d):
    return metrics.alarm_rate(A.raw_alarms(spark, d), per_turbine=True).select("records", "stations", r6("hours").alias("hours"), r6("rate").alias("rate"))


_PARETO = """SELECT round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 10)) / (SELECT sum(n) FROM c) * 100, 6) top10_share_pct,
  (SELECT min(k) FROM (SELECT row_number() OVER (ORDER BY n DESC, alarm_code) k, sum(n) OVER (ORDER BY n DESC, alarm_code) s FROM c) WHERE s >= (4 * (SELECT sum(n) FROM c) + 4) // 5) codes_to_reach_80pct,
  (SELECT count(*) FROM c) distinct_codes"""


@query("AGG2_pareto", sql(_PARETO, "alarms", c="SELECT alarm_code, count(*) n FROM alarms GROUP BY 1"))
def _(spark, d):
    return metrics.pareto(A.raw_alarms(spark, d)).withColumn("top10_share_pct", r6("top10_share_pct"))


@query("WIN6_pareto_cut", sql(_PARETO, "alarms_dup", c="SELECT alarm_code, count(*) n FROM alarms_dup GROUP BY 1"))
def _(spark, d):
    return metrics.pareto(A.alarms_dup(spark, d)).withColumn("top10_share_pct", r6("top10_share_pct"))


_CODES = "SELECT alarm_code, count(*) n, round(count(*) / (SELECT count(*) FROM alarms) * 100, 6) share_pct, min(description) description, min(stopping) stopping FROM alarms GROUP BY 1"


@query("AGG3_code_summary", sql(_CODES, "alarms"))
def _(spark, d):
    return metrics.code_summary(A.alarms(spark, d)).withColumn("share_pct", r6("share_pct"))


@query("FUN17_share_percentages", sql("SELECT turbine_id, count(*) n, round(count(*) * 100.0 / (SELECT count(*) FROM alarms), 6) share_pct FROM alarms GROUP BY 1", "alarms"))
def _(spark, d):
    a = A.alarms(spark, d)
    total = a.agg(F.count(F.lit(1))).scalar()
    return a.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n")).withColumn("share_pct", r6(F.col("n") * 100.0 / total))


@query("SRT2_top_codes", sql(_CODES + " ORDER BY n DESC, alarm_code LIMIT 20", "alarms"))
def _(spark, d):
    return metrics.top_codes(A.alarms(spark, d), 20).withColumn("share_pct", r6("share_pct"))


@query("AGG4_flood_bins", sql("SELECT b.start, b.start + INTERVAL 1 HOUR AS stop, b.n, array_to_string(list_sort(list(DISTINCT a.alarm_code)), ',') codes FROM bursts b JOIN alarms a ON time_bucket(INTERVAL 1 HOUR, a.ts) = b.start GROUP BY 1, 2, 3", "bursts"))
def _(spark, d):
    b = metrics.find_bursts(A.raw_alarms(spark, d), HOUR, OVER)
    return b.select("start", F.col("end").alias("stop"), "n", F.array_join("codes", ",").alias("codes"))


@query("WIN4_flood_runs", sql("SELECT *, CAST(bins * 60 AS DOUBLE) AS minutes FROM runs", "runs"))
def _(spark, d):
    runs = metrics.flood_runs(metrics.find_bursts(A.raw_alarms(spark, d), HOUR, OVER))
    return runs.select("start", F.col("end").alias("stop"), "bins", "records", "peak", "minutes")


@query("AGG5_flood_summary", sql("""SELECT (SELECT count(*) FROM bursts) window_count, t.total_bins, round((SELECT count(*) FROM bursts) / t.total_bins * 100, 6) flood_share_pct,
  w.start worst_start, w.n worst_n, (SELECT count(*) FROM runs) run_count, l.start longest_start, l.bins longest_bins, l.records longest_records
  FROM (SELECT CAST((epoch_us(max(start)) - epoch_us(min(start))) // 3600000000 + 1 AS BIGINT) total_bins FROM bins) t
  LEFT JOIN (SELECT * FROM bursts ORDER BY n DESC, start LIMIT 1) w ON true LEFT JOIN (SELECT * FROM runs ORDER BY bins DESC, start LIMIT 1) l ON true""", "runs"))
def _(spark, d):
    s = metrics.flood_summary(A.raw_alarms(spark, d), HOUR, OVER)
    return s.select("window_count", "total_bins", r6("flood_share_pct").alias("flood_share_pct"), "worst_start", "worst_n", "run_count", "longest_start", "longest_bins", "longest_records")


@query("AGG6_worst_bin", sql("""SELECT count(DISTINCT turbine_id) stations, count(*) n, count(*) FILTER (stopping = 1) stopping, count(*) - count(DISTINCT (ts, turbine_id, alarm_code)) duplicates,
  (SELECT coalesce(string_agg(concat(alarm_code, ':', k), ',' ORDER BY k DESC, alarm_code), '') FROM (SELECT alarm_code, count(*) k FROM w GROUP BY 1 ORDER BY k DESC, alarm_code LIMIT 5)) top_codes FROM w""", "alarms_dup", "bursts",
  bins="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) n FROM alarms_dup GROUP BY 1",
  w="SELECT * FROM alarms_dup WHERE time_bucket(INTERVAL 1 HOUR, ts) = (SELECT start FROM bursts ORDER BY n DESC, start LIMIT 1)"))
def _(spark, d):
    w = metrics.worst_bin_rows(A.alarms_dup(spark, d), HOUR, OVER)
    top = metrics.top_codes(w, 5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "alarm_code"))).alias("t"))
    text = top.select(F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["alarm_code"].cast("string"), (-x["k"]).cast("string"))), ",")).scalar()
    split = metrics.stopping_split(w).where("category = 'stopping'").select("n").scalar()
    cover = metrics.coverage_counts(w, A.station_metadata(spark, d))
    return cover.select("stations", F.col("records").alias("n"), split.alias("stopping"), F.col("duplicate_records").alias("duplicates"), text.alias("top_codes"))


@query("AGG7_stopping_split", sql("""SELECT c.category, count(a.seq) n, round(count(a.seq) / (SELECT count(*) FROM alarms) * 100, 6) share_pct
  FROM (VALUES ('stopping', 1), ('non_stopping', 0), ('unknown', -1)) c(category, flag) LEFT JOIN alarms a ON a.stopping = c.flag GROUP BY 1""", "alarms"))
def _(spark, d):
    return metrics.stopping_split(A.alarms(spark, d)).withColumn("share_pct", r6("share_pct"))


_MATCHED = f"""SELECT a.alarm_code anchor_code, b.alarm_code partner_code, count(DISTINCT a.seq) matched FROM alarms a
  JOIN alarms b ON b.turbine_id = a.turbine_id AND b.alarm_code <> a.alarm_code AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= {PAIR_S * 1_000_000} GROUP BY 1, 2"""
_EDGES = f"""SELECT f.anchor_code code_a, f.partner_code code_b, f.matched matched_a, ta.n total_a, f.matched / ta.n support_a, g.matched matched_b, tb.n total_b, g.matched / tb.n support_b
  FROM pairs f JOIN pairs g ON g.anchor_code = f.partner_code AND g.partner_code = f.anchor_code
  JOIN totals ta ON ta.alarm_code = f.anchor_code JOIN totals tb ON tb.alarm_code = f.partner_code
  WHERE f.anchor_code < f.partner_code AND f.matched / ta.n >= {SUPPORT} AND g.matched / tb.n >= {SUPPORT}"""
_PAIR_TABLES = {"pairs": _MATCHED, "totals": "SELECT alarm_code, count(*) n FROM alarms GROUP BY 1", "edges": _EDGES}
_NEAR = "SELECT c, list(x) l FROM (SELECT code_a c, code_b x FROM edges UNION ALL SELECT code_b, code_a FROM edges) GROUP BY c"
_GROW = """SELECT [code_a, code_b] codes, list_intersect(a.l, b.l) common FROM edges JOIN near a ON a.c = code_a JOIN near b ON b.c = code_b UNION ALL
  SELECT list_append(g.codes, g.n), list_intersect(g.common, near.l) FROM (SELECT codes, common, unnest(common) n FROM grown) g JOIN near ON near.c = g.n WHERE g.n > g.codes[len(g.codes)]"""
_GROUPS = {**_PAIR_TABLES, "near": _NEAR, "grown": _GROW, "groups": "SELECT codes FROM grown WHERE len(common) = 0"}


def edges(spark, d):
    return materialize(cooccur.cooccurrence_edges(A.raw_alarms(spark, d), PAIR_S, SUPPORT), "edges")


@query("JON5_temporal_proximity", sql("SELECT * FROM pairs", "alarms", **_PAIR_TABLES))
def _(spark, d):
    return cooccur.matched_anchors(A.raw_alarms(spark, d), PAIR_S)


@query("AGG8_cooccurrence", sql("SELECT code_a, code_b, CAST(matched_a AS BIGINT) matched_a, total_a, round(support_a, 6) support_a, CAST(matched_b AS BIGINT) matched_b, total_b, round(support_b, 6) support_b FROM edges", "alarms", **_PAIR_TABLES))
def _(spark, d):
    return edges(spark, d).withColumns({"support_a": r6("support_a"), "support_b": r6("support_b")})


@query("GRF1_maximal_cliques", sql("SELECT array_to_string(codes, ',') codes, len(codes) size FROM groups", "alarms", **_GROUPS))
def _(spark, d):
    g = cliques.maximal_cliques(edges(spark, d))
    return g.select(F.array_join("codes", ",").alias("codes"), F.size("codes").cast("bigint").alias("size"))


@query("GRF2_clusters", sql("SELECT array_to_string(codes, ',') codes FROM groups", "alarms", **_GROUPS))
def _(spark, d):
    return cliques.maximal_cliques(edges(spark, d)).select(F.array_join("codes", ",").alias("codes"))


@query("SRT6_clique_order", sql("SELECT row_number() OVER (ORDER BY codes) position, array_to_string(codes, ',') codes FROM (SELECT codes FROM groups)", "alarms", **_GROUPS))
def _(spark, d):
    ordered = dense_sequence(cliques.maximal_cliques(edges(spark, d)), [F.col("codes")], "p")
    return ordered.select((F.col("p") + 1).alias("position"), F.array_join("codes", ",").alias("codes"))


@query("AGG9_group_coverage", sql("""SELECT array_to_string(g.codes, ',') codes, (SELECT min(t.n) FROM totals t WHERE list_contains(g.codes, t.alarm_code)) min_code_rows,
  count(*) AS "rows", count(DISTINCT a.turbine_id) station_count, count(DISTINCT CAST(a.ts AS DATE)) distinct_dates,
  (SELECT round(min(least(e.support_a, e.support_b)), 6) FROM edges e WHERE list_contains(g.codes, e.code_a) AND list_contains(g.codes, e.code_b)) min_pairwise_support,
  (SELECT min(t.n) FROM totals t WHERE list_contains(g.codes, t.alarm_code)) < 20 low_support
  FROM groups g JOIN alarms a ON list_contains(g.codes, a.alarm_code) GROUP BY g.codes""", "alarms", **_GROUPS))
def _(spark, d):
    a, e = A.raw_alarms(spark, d), edges(spark, d)
    c = cooccur.group_coverage(cliques.maximal_cliques(e), a, e)
    return c.select(F.array_join("codes", ",").alias("codes"), "min_code_rows", "rows", "station_count", "distinct_dates", r6("min_pairwise_support").alias("min_pairwise_support"), "low_support")


def _labels12(spark, d):
    codes = A.code_lookup(spark, d)
    return metrics.code_summary(lookup.with_code_labels(A.raw_alarms(spark, d).select("ts", "alarm_code"), codes))


_NAMED = """SELECT a.alarm_code, count(*) n, coalesce(min(d.description), '(undocumented)') description FROM alarms a
  LEFT JOIN code_lookup d ON d.alarm_code = a.alarm_code GROUP BY 1"""


@query("JON12_group_members", sql("SELECT array_to_string(g.codes, ',') codes, l.alarm_code, l.description, l.n FROM groups g JOIN named l ON list_contains(g.codes, l.alarm_code)", "alarms", **_GROUPS, named=_NAMED))
def _(spark, d):
    m = cooccur.group_members(cliques.maximal_cliques(edges(spark, d)), _labels12(spark, d))
    return m.select(F.array_join("codes", ",").alias("codes"), F.explode("members").alias("m")).select("codes", "m.alarm_code", "m.description", "m.n")


@query("FUN19_group_text", sql("""SELECT array_to_string(g.codes, ',') codes, CASE WHEN count(*) FILTER (l.description <> '(undocumented)') = 0 THEN 'Physical meaning unverified: every member code is undocumented.'
  ELSE concat('Co-occurrence associated with documented event(s): ', string_agg(DISTINCT l.description, '; ' ORDER BY l.description) FILTER (l.description <> '(undocumented)'), '. A shared physical cause and the meanings of undocumented members remain unverified.') END interpretation
  FROM groups g JOIN named l ON list_contains(g.codes, l.alarm_code) GROUP BY g.codes""", "alarms", **_GROUPS, named=_NAMED))
def _(spark, d):
    m = cooccur.group_members(cliques.maximal_cliques(edges(spark, d)), _labels12(spark, d))
    return m.select(F.array_join("codes", ",").alias("codes"), "interpretation")


@query("SET5_codes_without_group", sql("SELECT alarm_code, description FROM named WHERE description <> '(undocumented)' AND alarm_code NOT IN (SELECT unnest(codes) FROM groups)", "alarms", **{**_GROUPS, "edges": _EDGES.replace(str(SUPPORT), "0.6")}, named=_NAMED))
def _(spark, d):
    e = cooccur.cooccurrence_edges(A.raw_alarms(spark, d), PAIR_S, 0.6)
    return cooccur.documented_without_group(_labels12(spark, d), cliques.maximal_cliques(e)).select("alarm_code", "description")


@query("AGG10_known_station_rate", sql(f"SELECT count(*) FILTER (turbine_id IN (SELECT station_id FROM station_metadata)) known_records, round({_HOURS}, 6) AS hours, (SELECT count(*) FROM station_metadata) stations, round(count(*) FILTER (turbine_id IN (SELECT station_id FROM station_metadata)) / {_HOURS} / (SELECT count(*) FROM station_metadata), 6) rate_per_turbine FROM alarms", "alarms", "station_metadata"))
def _(spark, d):
    return metrics.known_station_rate(A.raw_alarms(spark, d), A.station_metadata(spark, d)).withColumns({"hours": r6("hours"), "rate_per_turbine": r6("rate_per_turbine")})


@query("AGG11_coverage", sql("""SELECT count(*) records, count(DISTINCT turbine_id) stations, count(DISTINCT turbine_id) FILTER (known) known_stations,
  count(*) FILTER (known) known_records, count(*) FILTER (NOT known) unknown_records, count(*) - count(DISTINCT (ts, turbine_id, alarm_code)) duplicate_records
  FROM (SELECT *, turbine_id IN (SELECT station_id FROM station_metadata) known FROM alarms_dup)""", "alarms_dup", "station_metadata"))
def _(spark, d):
    return metrics.coverage_counts(A.alarms_dup(spark, d), A.station_metadata(spark, d))


@query("AGG12_duplicate_sensitivity", sql(f"""SELECT 'all_rows' variant, count(*) records, round(count(*) / {_HOURS}, 6) alarms_per_hour, round((SELECT sum(n) FROM (SELECT count(*) n FROM alarms_dup GROUP BY alarm_code ORDER BY n DESC LIMIT 10)) / count(*) * 100, 6) top10_share_pct, (SELECT count(*) FROM (SELECT 1 FROM alarms_dup GROUP BY time_bucket(INTERVAL 1 HOUR, ts) HAVING count(*) > 16)) flood_windows FROM alarms_dup
  UNION ALL SELECT 'distinct_keys', count(*), round(count(*) / {_HOURS}, 6), round((SELECT sum(n) FROM (SELECT count(*) n FROM alarms GROUP BY alarm_code ORDER BY n DESC LIMIT 10)) / count(*) * 100, 6), (SELECT count(*) FROM bursts) FROM alarms""", "alarms_dup", "bursts"))
def _(spark, d):
    o = jobs.BaselineOptions(window=HOUR, threshold=OVER, pair_window_s=60, min_support=0.8)
    return jobs.duplicate_sensitivity(A.alarms_dup(spark, d), o).select("variant", "records", r6("alarms_per_hour").alias("alarms_per_hour"), r6("top10_share_pct").alias("top10_share_pct"), "flood_windows")


_RAW_DUP = "SELECT * FROM raw_log UNION ALL SELECT * FROM raw_log WHERE seq % 29 = 0 UNION ALL SELECT seq, time_on, NULL, station, code FROM raw_log WHERE seq % 31 = 0"


def raw_dup(spark, d):
    raw = A.raw_alarm_log(spark, d)
    open_end = raw.where("seq % 31 = 0").withColumn("TimeOff", F.lit(None).cast("string"))
    return raw.unionByName(raw.where("seq % 29 = 0")).unionByName(open_end)


@query("AGG13_alarm_quality", sql("""SELECT count(*) source_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT time_on, time_off, station, code FROM raw_dup)) exact_duplicate_rows,
  count(*) - count(DISTINCT (time_on, station, code)) duplicate_key_rows,
  (SELECT count(*) FROM (SELECT 1 FROM (SELECT DISTINCT time_on, time_off, station, code FROM raw_dup) GROUP BY time_on, station, code HAVING count(*) > 1)) conflicting_end_keys,
  count(*) FILTER (time_off IS NULL) missing_ends FROM raw_dup""", "raw_log", raw_dup=_RAW_DUP))
def _(spark, d):
    return quality.alarm_quality(raw_dup(spark, d))


_SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("AGG14_sensor_profile", sql("""SELECT count(*) included_rows, 4 numeric_signals, CAST(count(*) * 4 - count(l_quantity) - count(l_extendedprice) - count(l_discount) - count(l_tax) AS BIGINT) null_measurements,
  concat_ws(',', CASE WHEN 1 - count(l_quantity) / count(*) > 0.95 THEN 'l_quantity' END, CASE WHEN 1 - count(l_extendedprice) / count(*) > 0.95 THEN 'l_extendedprice' END, CASE WHEN 1 - count(l_discount) / count(*) > 0.95 THEN 'l_discount' END, CASE WHEN 1 - count(l_tax) / count(*) > 0.95 THEN 'l_tax' END) sparse_columns,
  count(*) FILTER (coalesce(l_quantity, l_extendedprice, l_discount, l_tax) IS NULL) all_null_rows, CAST(count(*) - count(DISTINCT (ts, turbine_id)) AS BIGINT) duplicate_key_rows, min(ts) first_ts, max(ts) last_ts
  FROM (SELECT ts, turbine_id, CASE WHEN seq % 7 <> 0 THEN l_quantity END l_quantity, CASE WHEN seq % 7 <> 0 THEN l_extendedprice END l_extendedprice, CASE WHEN seq % 7 <> 0 THEN l_discount END l_discount, CASE WHEN seq % 40 = 1 THEN l_tax END l_tax FROM scada_wide)""", "scada_wide"))
def _(spark, d):
    wide = A.scada_wide(spark, d)  # every seventh row is empty, and one signal is nearly so
    holes = {c: F.when(F.col("seq") % 7 != 0, F.col(c)) for c in _SIGNALS[:3]} | {"l_tax": F.when(F.col("seq") % 40 == 1, F.col("l_tax"))}
    return quality.sensor_profile(wide.withColumns(holes), _SIGNALS)


@query("AGG15_grid_completeness", sql("""SELECT s.station_id turbine_id, count(*) missing FROM station_metadata s, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:50:00', INTERVAL 10 MINUTE) g(ts)
  WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.turbine_id = s.station_id AND k.ts = g.ts) GROUP BY 1""", "scada_long", "station_metadata", keys="SELECT DISTINCT turbine_id, time_bucket(INTERVAL 10 MINUTE, ts) ts FROM scada_long"))
def _(spark, d):
    rows = A.scada_long(spark, d).withColumn("ts", F.window("ts", "10 minutes")["start"])
    stations = A.station_metadata(spark, d).select(F.col("station_id").alias("turbine_id"))
    return quality.missing_grid_keys(rows, stations, "2024-01-01", "2024-01-31").groupBy("turbine_id").agg(F.count(F.lit(1)).alias("missing"))


@query("AGG16_column_profile", sql(" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) null_count FROM scada_wide" for i, (c, t) in enumerate([("seq", "bigint"), ("ts", "timestamp_ntz"), ("turbine_id", "string"), *[(c, "double") for c in _SIGNALS]])), "scada_wide"))
def _(spark, d):
    return quality.column_profile(A.scada_wide(spark, d))


_TOPVALS = " UNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, trim({c})) rank, trim({c}) AS value, count(*) n, (SELECT count(DISTINCT trim({c})) FROM part) distinct_values FROM part GROUP BY trim({c}) ORDER BY rank LIMIT 10)"
    for c in ("p_name", "p_brand", "p_type")
)


@query("AGG16_top_values", _TOPVALS)
def _(spark, d):
    part = A.table(spark, d, "part")
    return quality.top_values(part, quality.text_columns(part)).withColumn("rank", F.col("rank").cast("bigint"))


@query("AGG17_duration_checks", sql("""SELECT count(*) FILTER (time_on IS NOT NULL AND try_cast(time_on AS TIMESTAMP) IS NULL) invalid_starts, count(*) FILTER (time_off IS NOT NULL AND try_cast(time_off AS TIMESTAMP) IS NULL) invalid_ends,
  count(*) FILTER (try_cast(time_off AS TIMESTAMP) < try_cast(time_on AS TIMESTAMP)) negative_durations, min(try_cast(time_on AS TIMESTAMP)) first_start, max(try_cast(time_on AS TIMESTAMP)) last_start
  FROM (SELECT CASE WHEN seq % 101 = 0 THEN 'unknown' ELSE time_on END time_on, CASE WHEN seq % 103 = 0 THEN 'n/a' WHEN seq % 107 = 0 THEN '1990-01-01T00:00:00' ELSE time_off END time_off FROM raw_log)""", "raw_log"))
def _(spark, d):
    raw = A.raw_alarm_log(spark, d).select(
        F.when(F.col("seq") % 101 == 0, "unknown").otherwise(F.col("TimeOn")).alias("TimeOn"),
        F.when(F.col("seq") % 103 == 0, "n/a").when(F.col("seq") % 107 == 0, "1990-01-01T00:00:00").otherwise(F.col("TimeOff")).alias("TimeOff"),
    )
    return quality.duration_checks(raw)


@query("AGG18_manifest_codes", sql("SELECT alarm_code, description, count(*) n, round((SELECT count(*) FROM alarms WHERE description <> '(undocumented)') / (SELECT count(*) FROM alarms) * 100, 6) documented_pct FROM alarms GROUP BY 1, 2 ORDER BY n DESC, alarm_code LIMIT 10", "alarms"))
def _(spark, d):
    return quality.manifest_codes(A.alarms(spark, d)).withColumn("documented_pct", r6("documented_pct"))


@query("VAL8_plausibility", sql(f"SELECT round(count(*) / {_HOURS}, 6) site_rate, (SELECT round(max(c) / sum(c) * 100, 6) FROM (SELECT count(*) c FROM alarms GROUP BY alarm_code)) largest_code_share_pct, true plausible FROM alarms", "alarms"))
def _(spark, d):
    return jobs.sanity(A.alarms(spark, d), A.station_metadata(spark, d)).select(r6("site_rate").alias("site_rate"), r6("largest_code_share_pct").alias("largest_code_share_pct"), "plausible")


@query("VAL9_reconciliation", sql("SELECT count(*) records, count(*) split_rows, count(*) code_rows, count(*) FILTER (turbine_id IN (SELECT station_id FROM station_metadata)) station_rows, true reconciled FROM alarms", "alarms", "station_metadata"))
def _(spark, d):
    return jobs.sanity(A.alarms(spark, d), A.station_metadata(spark, d)).select("records", "split_rows", "code_rows", "station_rows", "reconciled")


_CODE_TEXT = "CASE WHEN seq % 41 = 0 THEN concat(code, '.5') WHEN seq % 43 = 0 THEN 'x' WHEN seq % 47 = 0 THEN NULL WHEN seq % 2 = 0 THEN concat(code, '.0') ELSE code END"


@query("VAL2_strict_integer", sql(f"SELECT seq, CASE WHEN try_cast(t AS DOUBLE) % 1 = 0 THEN CAST(try_cast(t AS DOUBLE) AS BIGINT) END alarm_code FROM (SELECT seq, {_CODE_TEXT} t FROM raw_log)", "raw_log"))
def _(spark, d):
    text = F.expr("CASE WHEN seq % 41 = 0 THEN concat(Alarmcode, '.5') WHEN seq % 43 = 0 THEN 'x' WHEN seq % 47 = 0 THEN NULL WHEN seq % 2 = 0 THEN concat(Alarmcode, '.0') ELSE Alarmcode END")
    return A.raw_alarm_log(spark, d).select("seq", validate.integer_or_null(text).alias("alarm_code"))


@query("VAL3_strict_timestamp", sql("""SELECT seq, CASE WHEN seq % 41 = 0 THEN NULL WHEN seq % 43 = 0 THEN CAST(time_on AS TIMESTAMP) - INTERVAL 2 HOUR ELSE CAST(time_on AS TIMESTAMP) END ts FROM raw_log""", "raw_log"))
def _(spark, d):
    text = F.expr("CASE WHEN seq % 41 = 0 THEN 'yesterday' WHEN seq % 43 = 0 THEN concat(TimeOn, '+02:00') WHEN seq % 2 = 0 THEN concat(TimeOn, 'Z') ELSE TimeOn END")
    return A.raw_alarm_log(spark, d).select("seq", validate.iso_or_null(text).alias("ts"))


@query("VAL4_domain_check", sql("""SELECT 0::BIGINT null_ts, count(*) FILTER (seq % 59 = 0) blank_turbine_id, count(*) FILTER (seq % 61 = 0) null_alarm_code, 0::BIGINT blank_description, count(*) FILTER (seq % 67 = 0) bad_stopping FROM alarms""", "alarms"))
def _(spark, d):
    broken = A.alarms(spark, d).select(
        "ts", F.when(F.col("seq") % 59 == 0, " ").otherwise(F.col("turbine_id")).alias("turbine_id"),
        F.when(F.col("seq") % 61 != 0, F.col("alarm_code")).alias("alarm_code"), "description",
        F.when(F.col("seq") % 67 == 0, 7).otherwise(F.col("stopping")).alias("stopping"),
    )
    return validate.alarm_violations(broken)


@query("VAL5_numeric_coercion", sql("SELECT seq, CASE WHEN l_discount IS NULL THEN NULL ELSE l_discount END AS value FROM scada_wide", "scada_wide"))
def _(spark, d):
    text = A.scada_wide(spark, d).select("seq", F.col("l_discount").cast("string").alias("t"), F.lit("NotActive").alias("status"))
    return text.drop("status").select("seq", validate.strict_double(F.col("t"), "l_discount").alias("value"))


@query("VAL6_sensor_domain", sql("SELECT 0::BIGINT null_ts, count(*) FILTER (seq % 59 = 0) null_turbine_id, count(*) FILTER (seq % 61 = 0) blank_signal, count(*) FILTER (seq % 67 = 0) nonfinite_value FROM scada_long", "scada_long"))
def _(spark, d):
    broken = A.scada_long(spark, d).select(
        "ts", F.when(F.col("seq") % 59 != 0, F.col("turbine_id")).alias("turbine_id"),
        F.when(F.col("seq") % 61 == 0, "").otherwise(F.col("signal")).alias("signal"),
        F.when(F.col("seq") % 67 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
    )
    return validate.sensor_violations(broken)


@query("VAL10_dimension_check", sql("""SELECT count(*) FILTER (n > 1) repeated_keys, count(*) FILTER (try_cast(station_id AS BIGINT) IS NULL) non_integer_keys, CAST(sum(blank) AS BIGINT) blank_labels FROM
  (SELECT station_id, count(*) n, count(*) FILTER (trim(label) = '') blank FROM (SELECT CASE WHEN s_suppkey % 10 = 3 THEN concat('s', s_suppkey) ELSE CAST(s_suppkey % 60 AS VARCHAR) END station_id, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name END label FROM supplier) GROUP BY 1)"""))
def _(spark, d):
    dim = A.table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).otherwise((F.col("s_suppkey") % 60).cast("string")).alias("station_id"),
        F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("label"),
    )
    return validate.dimension_violations(dim, "station_id", "label")
