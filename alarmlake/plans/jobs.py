"""User entry points composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlake.operators import audit, cliques, cooccur, learn, lookup, metrics, quality, rules, validate, vocabulary
from alarmlake.operators.detect import with_anomaly
from alarmlake.operators.events import merged_events
from alarmlake.operators.filters import month_profiles, own_month_rows, point_lookup, trailing_window
from alarmlake.operators.journal import active_rules
from alarmlake.plans.segments import dense_sequence
from alarmlake.schemas import ALARM_KEY
from alarmlake.session import materialize
from alarmlake.settings import (
    COOCCUR_MIN_SUPPORT,
    COOCCUR_WINDOW_S,
    FLOOD_THRESHOLD,
    FLOOD_WINDOW,
    PolicySettings,
    RawLayout,
)
from alarmlake.sources import scans, sinks

@dataclass(frozen=True)
class BaselineOptions:
    window: str = FLOOD_WINDOW
    threshold: int = FLOOD_THRESHOLD
    pair_window_s: float = COOCCUR_WINDOW_S
    min_support: float = COOCCUR_MIN_SUPPORT
    top: int = 20


def build_dataset(spark: SparkSession, raw: str, out: str, periods: list[tuple[int, int]], codes: DataFrame, stations: DataFrame, tables: list[str], layout: RawLayout = RawLayout()) -> dict[str, DataFrame]:
    """Raw monthly CSV files to the two canonical tables (partitioned by date), their manifest and profiles.

    Nothing is published unless every check passes on what was written.
    """
    keys = [layout.alarm_time, layout.alarm_end, layout.alarm_station, layout.alarm_code]
    raw_alarms = scans.monthly_csv(spark, raw, layout.alarm_prefix, periods, keys)
    typed = lookup.with_code_labels(scans.alarm_log(raw_alarms, *[keys[i] for i in (0, 2, 3)]), codes)
    typed = materialize(typed, "parsed-alarms")  # else the range sampling of the sequence parses and joins all rows once more
    alarms = dense_sequence(typed, [F.col(c) for c in (*ALARM_KEY, "description", "stopping")])
    long, profiles, signals_by_table = [], [], {}
    for table in tables:
        wide = scans.monthly_csv(spark, raw, table, periods, [layout.scada_time, layout.scada_station], exact=False)
        skip = {layout.scada_time, layout.scada_station, *layout.scada_excluded, "_path", "_start", "table", "year", "month"}
        signals = signals_by_table[table] = sorted(c for c in wide.columns if c not in skip)
        parsed = wide.select(
            "year",
            "month",
            validate.strict_timestamp(F.col(layout.scada_time), layout.scada_time).alias("ts"),
            validate.strict_integer(F.col(layout.scada_station), layout.scada_station).cast("string").alias("turbine_id"),
            *[validate.strict_double(F.col(s), s).alias(s) for s in signals],
        )
        parsed = materialize(parsed, f"parsed-{table}")  # text is parsed once, for the table and its profile
        kept = own_month_rows(parsed)
        month = ["year", "month"]
        member = F.format_string(f"{table}_%d_%02d.csv", *month).alias("member")
        profiles.append(month_profiles(parsed).join(quality.sensor_profile(kept, signals, by=month), month, "left").select(member, "*").drop(*month))
        long.append(quality.to_long(kept, ["ts", "turbine_id"], signals))
    validate.disjoint_signals(signals_by_table)
    scada, profile = reduce(DataFrame.unionByName, long), reduce(DataFrame.unionByName, profiles)
    manifest = quality.alarm_quality(raw_alarms, *keys)

    def check(written: dict[str, DataFrame]) -> None:
        # The source's own counts are in the manifest and the profile, so no file is read again.
        rows = {name: df.count() for name, df in written.items() if name in ("alarms", "scada")}
        source = written["manifest"].first()["source_rows"], written["profile"].agg(F.sum(F.col("included") * F.col("numeric_signals"))).first()[0]
        if (rows["alarms"], rows["scada"]) != tuple(n or 0 for n in source):
            raise ValueError("written rows do not reconcile with the source")
        lost = lookup.unmapped_stations(written["scada"], stations).limit(1).count()
        illegal = written["profile"].where("illegal > 0 OR duplicate_key_rows > 0").limit(1).count()
        if lost or illegal:
            raise ValueError("sensor rows outside their month, repeated keys or unknown stations")

    dated = {"alarms": ("turbine_id", "ts"), "scada": ("turbine_id", "signal", "ts")}
    sinks.publish(spark, {"alarms": alarms, "scada": scada, "profile": profile, "manifest": manifest}, out, check, dated, ("alarms",))
    return {name: sinks.published(spark, out, name) for name in ("alarms", "scada", "profile", "manifest")}


def schema_profile(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column profile and most frequent values of text columns."""
    return quality.column_profile(df), quality.top_values(df, quality.text_columns(df))


def duplicate_sensitivity(alarms: DataFrame, o: BaselineOptions = BaselineOptions()) -> DataFrame:
    """Main metrics on all rows and on one row per event key."""
    first = alarms.groupBy(*ALARM_KEY).agg(F.min("description").alias("description"), F.min("stopping").alias("stopping"))
    out = None
    for name, rows in (("all_rows", alarms), ("distinct_keys", first)):
        groups = materialize(cliques.maximal_cliques(cooccur.cooccurrence_edges(rows, o.pair_window_s, o.min_support)), "groups")
        part = metrics.alarm_rate(rows).select(
            F.lit(name).alias("variant"),
            "records",
            F.col("rate").alias("alarms_per_hour"),
            metrics.pareto(rows).select("top10_share_pct").scalar().alias("top10_share_pct"),
            metrics.find_bursts(rows, o.window, o.threshold).agg(F.count(F.lit(1))).scalar().alias("flood_windows"),
            groups.agg(F.count(F.lit(1))).scalar().alias("groups"),
            groups.agg(F.sum(F.xxhash64("codes").cast("decimal(38,0)")).cast("string")).scalar().alias("membership"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def sanity(alarms: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row of plausibility and reconciliation checks; a failed one raises."""
    rate = metrics.alarm_rate(alarms)
    share = metrics.code_summary(alarms).agg(F.max("share_pct")).scalar()
    split = metrics.stopping_split(alarms).agg(F.sum("n")).scalar()
    by_code = metrics.code_counts(alarms).agg(F.sum("n")).scalar()
    by_station = lookup.known_station_counts(alarms, metadata).agg(F.sum("n")).scalar()
    known = metrics.coverage_counts(alarms, metadata).select("known_records").scalar()
    checked = rate.select("records", F.col("rate").alias("site_rate"), share.alias("largest_code_share_pct"), split.alias("split_rows"), by_code.alias("code_rows"), by_station.alias("station_rows"), known.alias("known_rows"))
    plausible = validate.raise_unless(validate.plausibility(F.col("site_rate"), F.col("largest_code_share_pct")), "suspicious baseline")
    same = (F.col("split_rows") == F.col("records")) & (F.col("code_rows") == F.col("records")) & (F.col("station_rows") == F.col("known_rows"))
    return checked.withColumn("plausible", plausible).withColumn("reconciled", validate.raise_unless(same, "counts do not reconcile"))


def baseline(alarms: DataFrame, metadata: DataFrame, o: BaselineOptions = BaselineOptions()) -> dict[str, DataFrame]:
    """Every table of the baseline report."""
    edges = materialize(cooccur.cooccurrence_edges(alarms, o.pair_window_s, o.min_support), "edges")
    groups = materialize(cliques.maximal_cliques(edges), "groups")
    labels = metrics.code_summary(alarms)
    worst = metrics.worst_bin_rows(alarms, o.window, o.threshold)
    return {
        "sanity": sanity(alarms, metadata),
        "rate": metrics.alarm_rate(alarms),
        "known_station_rate": metrics.known_station_rate(alarms, metadata),
        "by_turbine": lookup.known_station_counts(alarms, metadata),
        "coverage": metrics.coverage_counts(alarms, metadata),
        "pareto": metrics.pareto(alarms),
        "top_codes": metrics.top_codes(alarms, o.top),
        "flood_summary": metrics.flood_summary(alarms, o.window, o.threshold),
        "flood_windows": metrics.find_bursts(alarms, o.window, o.threshold),
        "flood_runs": metrics.flood_runs(metrics.find_bursts(alarms, o.window, o.threshold)),
        "worst_top_codes": metrics.top_codes(worst, 5),
        "worst_split": metrics.stopping_split(worst),
        "edges": edges,
        "groups": cooccur.group_coverage(groups, alarms, edges),
        "group_members": cooccur.group_members(groups, labels),
        "documented_without_group": cooccur.documented_without_group(labels, groups),
        "stopping_split": metrics.stopping_split(alarms),
        "duplicate_sensitivity": duplicate_sensitivity(alarms, o),
    }


def build_vocabulary(alarms: DataFrame, codes: DataFrame, metadata: DataFrame) -> dict[str, DataFrame]:
    """Vocabulary tables; any conflict raises when the tables are published."""
    labels = vocabulary.station_labels(alarms, metadata)
    return {
        "conflicts": vocabulary.conflicts(alarms, codes, metadata),
        "turbines": vocabulary.observed_stations(alarms),
        "codes": vocabulary.code_descriptions(alarms, codes),
        "labels": labels,
        "aliases": vocabulary.aliases(labels),
        "unmapped": lookup.unmapped_stations(alarms, metadata),
    }


def publish_vocabulary(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> str:
    def check(written: dict[str, DataFrame]) -> None:
        bad = written["conflicts"].limit(20).collect()
        if bad:
            raise ValueError(f"vocabulary conflicts: {[tuple(r) for r in bad]}")

    return sinks.publish(spark, tables, out, check)


def source_audit(raw: DataFrame, processed: DataFrame, codes: DataFrame, stations: DataFrame, published: DataFrame) -> DataFrame:
    """One row: do rows, labels and published metrics agree with the raw source?"""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    status = audit.reconcile_published(published, audit.published_metrics(processed, stations))
    return status.select(
        "*",
        count(audit.multiset_difference(raw, processed)).alias("key_differences"),
        count(lookup.label_mismatches(processed, codes)).alias("label_differences"),
        processed.groupBy(*ALARM_KEY).agg((F.count(F.lit(1)) - 1).alias("d")).agg(F.sum("d")).scalar().alias("duplicates_retained"),
    ).withColumn(
        "verified", (F.col("status") == "verified") & (F.col("key_differences") == 0) & (F.col("label_differences") == 0)
    )


def backfill(alarms: DataFrame, scada: DataFrame, rule_table: DataFrame, window: int, extras: bool = True) -> DataFrame:
    """Merged history scored in one batch: order, anomaly score, verdict."""
    events = merged_events(alarms, scada)
    if extras:
        events = with_event_extras(events)
    scored = with_anomaly(events, window)
    return rules.score(scored, rule_table, keep=[*rules.KEEP, "anomaly_score"])


def with_event_extras(events: DataFrame) -> DataFrame:
    """Add the optional event fields as absent."""
    return events.select(
        "*",
        F.create_map().cast("map<string,double>").alias("features"),
        F.lit(None).cast("string").alias("signal"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("boolean").alias("critical"),
        F.lit(None).cast("string").alias("severity"),
    )


def teach_and_measure(events: DataFrame, rule: DataFrame, settings: PolicySettings | None = None) -> DataFrame:
    """One row: effect of teaching one rule on the ring ending at its first match.

    Counters before, after and after undo; the verdict of the first later match, and of the
    same code on another station. ``seq`` is dense.
    """
    s = settings or PolicySettings()
    spark = events.sparkSession
    hit = F.size("matches") > 0
    code, station = (rule.select(f"scope.{c}").first()[0] for c in ("alarm_code", "turbine_id"))
    matched = rules.match_rules(events, rule).select("seq", "turbine_id", "alarm_code", hit.alias("hit"))
    total, first = matched.agg(F.count(F.lit(1)), F.min(F.when(F.col("hit"), F.col("seq")))).first()
    none, first = first is None, first or 0
    end = min(total, max(first + 1, s.ring_size))
    elsewhere = (F.col("alarm_code") == F.lit(code)) & (F.col("turbine_id") != F.lit(station))
    later, other = matched.where(F.col("seq") >= end).agg(
        F.min(F.when(F.col("hit"), F.col("seq"))), F.min(F.when(elsewhere, F.col("seq")))
    ).first()
    recent = events.where((F.col("seq") >= end - s.ring_size) & (F.col("seq") < end))
    nothing = rule.limit(0)
    before = rules.score(recent, nothing)
    after = rules.score(recent, rule)
    changed = before.where("show").select("seq").join(after.where("NOT show"), "seq", "left_semi")
    batch = learn.mint_examples(events, nothing, rule, at=end, settings=s)
    single = lambda at: rules.score(events.where(F.col("seq") == F.lit(at)), rule).agg(F.max("show")).scalar()
    empty = spark.createDataFrame([], scans.JOURNAL_LINE)
    learned = learn.learn_lines(empty, rule, batch, s)
    undo = learn.undo_lines(learned, rule.select("rule_id").first()[0])
    undone = rules.score(recent, active_rules(learned.unionByName(undo, allowMissingColumns=True)))
    b, a, u = (rules.counters(v) for v in (before, after, undone))
    return b.select(
        F.lit(first).cast("bigint").alias("first_seq"),
        F.lit(end).cast("bigint").alias("end_seq"),
        batch.agg(F.count(F.lit(1))).scalar().alias("examples"),
        F.col("shown").alias("before_shown"),
        F.col("suppressed").alias("before_suppressed"),
        a.select("shown").scalar().alias("after_shown"),
        a.select("suppressed").scalar().alias("after_suppressed"),
        changed.agg(F.count(F.lit(1))).scalar().alias("newly_suppressed"),
        F.lit(later).cast("bigint").alias("later_seq"),
        single(later).alias("later_show"),
        F.lit(other).cast("bigint").alias("other_seq"),
        single(other).alias("other_show"),
        u.select("shown").scalar().alias("undo_shown"),
        u.select("suppressed").scalar().alias("undo_suppressed"),
    ).where(F.lit(not none))


def scenario_checks(alarms: DataFrame, declared: DataFrame, start: str, end: str, expected_rows: int | Column) -> DataFrame:
    """Declared rows with their match count and flag agreement, plus the trailing-window count."""
    looked = point_lookup(alarms, declared, ALARM_KEY)
    flags = alarms.join(declared.select(*ALARM_KEY), ALARM_KEY, "left_semi").groupBy(*ALARM_KEY).agg(F.min("stopping").alias("actual_stopping"))
    window = trailing_window(alarms, start, end).agg(F.count(F.lit(1))).scalar()
    return looked.join(flags, ALARM_KEY, "left").select(
        *ALARM_KEY,
        "stopping",
        "matches",
        F.coalesce((F.col("matches") == 1) & (F.col("actual_stopping") == F.col("stopping")), F.lit(False)).alias("ok"),
        window.alias("window_rows"),
        (window == expected_rows).alias("window_ok"),
    )

