"""Alarm rate, Pareto, top codes, flood windows and runs, stopping split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.plans.segments import micros, running_total
from alarmlake.schemas import ALARM_KEY
from alarmlake.session import materialize
from alarmlake.settings import FLOOD_THRESHOLD, FLOOD_WINDOW, UNDOCUMENTED

US_PER_HOUR = 3_600_000_000


def observed_hours(us_min: Column, us_max: Column) -> Column:
    return (us_max - us_min) / F.lit(float(US_PER_HOUR))


def alarm_rate(alarms: DataFrame, per_turbine: bool = False, strict: bool = True) -> DataFrame:
    """One row: record count, observed hours and records per hour.

    Distinct stations are counted through a partial aggregate, so no task sees one
    station's rows together. A zero span raises unless ``strict`` is off.
    """
    by_station = alarms.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    total = by_station.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count("turbine_id").alias("stations"),
        F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"),
    )
    hours = observed_hours(micros("first_ts"), micros("last_ts"))
    if strict:
        bad = F.raise_error(F.lit("alarm_rate needs records over a positive time span")).cast("double")
        hours = F.when(F.coalesce(hours, F.lit(0.0)) <= 0, bad).otherwise(hours)
    total = total.withColumn("hours", hours)
    rate = F.col("records") / F.col("hours")
    return total.withColumn("rate", rate / F.col("stations") if per_turbine else rate)


def code_counts(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("n"))


def pareto(alarms: DataFrame) -> DataFrame:
    """One row: top-10 share, fewest codes reaching ceil(4n/5) rows, distinct codes.

    The running total walks distinct *count values*, of which n rows allow at most
    sqrt(2n), so the ordered step stays small even with very many codes.
    """
    counts = code_counts(alarms)
    levels = counts.groupBy(F.col("n").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    down = W.orderBy(F.desc("c"))
    walked = levels.select(
        "c",
        "m",
        F.coalesce(F.sum(F.col("c") * F.col("m")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("m").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("codes_before"),
        F.sum(F.col("c") * F.col("m")).over(W.partitionBy()).alias("total"),
    )
    target = F.floor((F.lit(4) * F.col("total") + F.lit(4)) / F.lit(5))
    needed = F.col("codes_before") + F.ceil((target - F.col("rows_before")) / F.col("c"))
    inside = (F.col("rows_before") < target) & (F.col("rows_before") + F.col("c") * F.col("m") >= target)
    top_rows = F.greatest(F.lit(0), F.least(F.col("m"), F.lit(10) - F.col("codes_before"))) * F.col("c")
    return walked.agg(
        F.coalesce(F.sum(top_rows) / F.max("total") * F.lit(100.0), F.lit(0.0)).alias("top10_share_pct"),
        F.coalesce(F.max(F.when(inside, needed)), F.lit(0)).cast("bigint").alias("codes_to_reach_80pct"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("distinct_codes"),
    )


def code_summary(alarms: DataFrame, strict: bool = True) -> DataFrame:
    """Count, share and label per code; conflicting labels raise."""
    per_label = alarms.groupBy("alarm_code", "description", "stopping").agg(F.count(F.lit(1)).alias("n"))
    per_code = per_label.groupBy("alarm_code").agg(
        F.sum("n").alias("n"),
        F.min("description").alias("description"),
        F.min("stopping").alias("stopping"),
        F.count(F.lit(1)).alias("_labels"),
    )
    if strict:
        message = F.concat(F.lit("conflicting labels for alarm code "), F.col("alarm_code").cast("string"))
        per_code = per_code.withColumn("n", F.when(F.col("_labels") > 1, F.raise_error(message).cast("bigint")).otherwise(F.col("n")))
    total = per_label.agg(F.sum("n").alias("total")).scalar()
    return per_code.drop("_labels").withColumn("share_pct", F.col("n") / total * F.lit(100.0))


def top_codes(alarms: DataFrame, n: int = 20) -> DataFrame:
    if n < 1:
        raise ValueError("n must be a positive integer")
    return code_summary(alarms).orderBy(F.desc("n"), F.asc("alarm_code")).limit(n)


def bin_counts(alarms: DataFrame, window: str = FLOOD_WINDOW) -> DataFrame:
    """Rows per (clock-aligned bin, code): the pre-aggregate behind every flood metric."""
    return (
        alarms.groupBy(F.window("ts", window).alias("w"), "alarm_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "alarm_code", "n")
    )


def find_bursts(alarms: DataFrame, window: str = FLOOD_WINDOW, threshold: int = FLOOD_THRESHOLD) -> DataFrame:
    """Bins holding strictly more than ``threshold`` rows, with their sorted distinct codes."""
    if threshold < 0:
        raise ValueError("threshold must be nonnegative")
    return (
        bin_counts(alarms, window)
        .groupBy("start", "end")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("alarm_code")).alias("codes"))
        .where(F.col("n") > threshold)
    )


def flood_runs(bursts: DataFrame) -> DataFrame:
    """Consecutive flagged bins joined into runs.

    A bin opens a run when the bin before it is not flagged: every bin marks itself and its
    successor, and one aggregate meets both marks. Run numbers come from a chunked running
    total of openings.
    """
    width = micros("end") - micros("start")
    bins = bursts.select("start", "end", "n", F.floor(micros("start") / width).cast("bigint").alias("_index"))
    marks = F.array(
        F.struct(F.col("_index").alias("i"), F.struct("start", "end", "n").alias("bin")),
        F.struct((F.col("_index") + 1).alias("i"), F.lit(None).cast("struct<start:timestamp_ntz,end:timestamp_ntz,n:bigint>").alias("bin")),
    )
    marked = bins.select(F.explode(marks).alias("m")).groupBy(F.col("m.i").alias("_index")).agg(
        F.max("m.bin").alias("bin"), F.count(F.lit(1)).alias("_marks")
    )
    flagged = materialize(
        marked.where("bin IS NOT NULL").select("_index", "bin.*", F.when(F.col("_marks") == 1, 1).otherwise(0).alias("_opens")), "bins"
    )
    return (
        running_total(flagged, "_opens", "_index", "run_no")
        .groupBy("run_no")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count(F.lit(1)).alias("bins"),
            F.sum("n").alias("records"),
            F.max("n").alias("peak"),
        )
        .withColumn("minutes", (micros("end") - micros("start")) / F.lit(60_000_000))
    )


def flood_summary(alarms: DataFrame, window: str = FLOOD_WINDOW, threshold: int = FLOOD_THRESHOLD) -> DataFrame:
    """One row: flagged bins, bins between first and last, share, worst bin, longest run."""
    cells = materialize(bin_counts(alarms, window), "bins")  # one row per bin and code
    bursts = cells.groupBy("start", "end").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)
    runs = flood_runs(bursts)
    span = cells.agg(
        F.min("start").alias("lo"),
        F.max("start").alias("hi"),
        F.max(micros("end") - micros("start")).alias("width"),
    )
    bins = bursts.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.max_by(F.struct("start", "n"), F.struct("n", (-micros("start")).alias("k"))).alias("worst"),
    )
    run = runs.agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max_by(F.struct("start", "end", "bins", "records", "peak", "minutes"), F.struct("bins", (-micros("start")).alias("k"))).alias("longest"),
    )
    total = ((micros("hi") - micros("lo")) / F.col("width")).cast("bigint") + 1
    worst, longest = bins.select(F.struct("*")).scalar(), run.select(F.struct("*")).scalar()
    return (
        span.select(total.alias("total_bins"), worst.alias("b"), longest.alias("r"))
        .select("total_bins", "b.*", "r.*")
        .select(
            "window_count",
            "total_bins",
            (F.col("window_count") / F.col("total_bins") * F.lit(100.0)).alias("flood_share_pct"),
            F.col("worst.start").alias("worst_start"),
            F.col("worst.n").alias("worst_n"),
            "run_count",
            F.col("longest.start").alias("longest_start"),
            F.col("longest.end").alias("longest_end"),
            F.col("longest.bins").alias("longest_bins"),
            F.col("longest.records").alias("longest_records"),
            F.col("longest.peak").alias("longest_peak"),
            F.col("longest.minutes").alias("longest_minutes"),
        )
    )


def worst_bin_rows(alarms: DataFrame, window: str = FLOOD_WINDOW, threshold: int = FLOOD_THRESHOLD) -> DataFrame:
    """All rows of the bin with most records (earliest on ties)."""
    worst = (
        find_bursts(alarms, window, threshold)
        .orderBy(F.desc("n"), F.asc("start"))
        .limit(1)
        .select(F.col("start").alias("_start"))
    )
    return alarms.withColumn("_start", F.window("ts", window)["start"]).join(worst, "_start", "left_semi").drop("_start")


def stopping_split(alarms: DataFrame) -> DataFrame:
    """Always three rows: stopping, non_stopping, unknown with count and share."""
    names = F.explode(
        F.array(
            F.struct(F.lit("stopping").alias("category"), F.lit(1).alias("flag")),
            F.struct(F.lit("non_stopping").alias("category"), F.lit(0).alias("flag")),
            F.struct(F.lit("unknown").alias("category"), F.lit(-1).alias("flag")),
        )
    )
    totals = alarms.agg(
        F.create_map(
            F.lit(1), F.count_if(F.col("stopping") == 1), F.lit(0), F.count_if(F.col("stopping") == 0), F.lit(-1), F.count_if(F.col("stopping") == -1)
        ).alias("by_flag"),
        F.count(F.lit(1)).alias("total"),
    )
    return (
        totals.withColumn("c", names)
        .select(F.col("c.category").alias("category"), F.element_at("by_flag", F.col("c.flag")).alias("n"), "total")
        .select(
            "category",
            "n",
            F.when(F.col("total") > 0, F.col("n") / F.nullif("total", F.lit(0)) * F.lit(100.0)).otherwise(F.lit(0.0)).alias("share_pct"),
        )
    )


def known_station_rate(alarms: DataFrame, metadata: DataFrame) -> DataFrame:
    """Mean rate over metadata stations: matching rows / site hours / metadata stations."""
    by_station = alarms.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    known = metadata.select(F.col("station_id").alias("turbine_id"), F.lit(True).alias("known"))
    return (
        by_station.join(known, "turbine_id", "left")
        .agg(
            F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("known_records"),
            observed_hours(micros(F.min("lo")), micros(F.max("hi"))).alias("hours"),
        )
        .withColumn("stations", metadata.agg(F.count(F.lit(1))).scalar())
        .withColumn("rate_per_turbine", F.col("known_records") / F.col("hours") / F.col("stations"))
    )


def coverage_counts(alarms: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows, stations, known / unknown rows and repeated event keys, in two pre-aggregated passes."""
    keys = alarms.groupBy(*ALARM_KEY).agg(F.count(F.lit(1)).alias("n"))
    stations = keys.groupBy("turbine_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dups"))
    known = metadata.select(F.col("station_id").alias("turbine_id"), F.lit(True).alias("known"))
    hit = F.coalesce("known", F.lit(False))
    return stations.join(known, "turbine_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.count(F.lit(1)).alias("stations"),
        F.count_if(hit).alias("known_stations"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("known_records"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("unknown_records"),
        F.coalesce(F.sum("dups"), F.lit(0)).alias("duplicate_records"),
    )


def documented_share(alarms: DataFrame) -> DataFrame:
    return alarms.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("description") != UNDOCUMENTED).alias("documented"),
    ).withColumn("documented_pct", F.col("documented") / F.col("records") * F.lit(100.0))
