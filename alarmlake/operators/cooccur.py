"""Same-station co-occurrence of alarm codes within an inclusive time window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.plans.segments import micros
from alarmlake.session import materialize
from alarmlake.settings import COOCCUR_MIN_SUPPORT, COOCCUR_WINDOW_S, LOW_SUPPORT_ROWS, UNDOCUMENTED

_STATION_BUCKET = ["turbine_id", "bucket"]


def _width_us(window_s: float) -> int:
    if not math.isfinite(window_s) or window_s < 0:
        raise ValueError("window_s must be finite and nonnegative")
    return int(round(window_s * 1_000_000))


def matched_anchors(alarms: DataFrame, window_s: float = COOCCUR_WINDOW_S) -> DataFrame:
    """(anchor_code, partner_code, matched): anchor rows having any partner row on the same
    station with |dt| <= window. Several partners count once; duplicate rows keep their weight.

    Time is cut into buckets one window wide. A partner in the anchor's own bucket always
    matches, and a partner in a neighbouring bucket is represented by its nearest time there,
    so whole (bucket, code) cells are compared instead of row pairs. Only cells that match in
    part fall back to their rows. A hot station spreads over its buckets, and a hot bucket
    shrinks to one row per code before it is shuffled.
    """
    width = _width_us(window_s)
    step = max(width, 1)
    instants = (
        alarms.groupBy("turbine_id", "alarm_code", micros("ts").alias("us"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col("us") / step).cast("bigint"))
    )
    cells = instants.groupBy("turbine_id", "bucket", "alarm_code").agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.sum("n").alias("n")
    )
    none = F.lit(None).cast("bigint")
    spots = [F.struct(F.lit(0).alias("d"), F.lit(True).alias("own"), none.alias("before"), none.alias("after"))]
    if width > 0:
        spots += [
            F.struct(F.lit(1).alias("d"), F.lit(False).alias("own"), F.col("hi").alias("before"), none.alias("after")),
            F.struct(F.lit(-1).alias("d"), F.lit(False).alias("own"), none.alias("before"), F.col("lo").alias("after")),
        ]
    partners = (
        cells.withColumn("s", F.explode(F.array(*spots)))
        .groupBy("turbine_id", (F.col("bucket") + F.col("s.d")).alias("bucket"), F.col("alarm_code").alias("partner_code"))
        .agg(
            F.max("s.own").alias("own"),
            F.max("s.before").alias("before"),
            F.min("s.after").alias("after"),
        )
    )
    from_before = lambda t: F.coalesce(t - F.col("before") <= width, F.lit(False))
    from_after = lambda t: F.coalesce(F.col("after") - t <= width, F.lit(False))
    pairs = cells.join(partners, _STATION_BUCKET).where(F.col("alarm_code") != F.col("partner_code"))
    whole = F.col("own") | from_before(F.col("hi")) | from_after(F.col("lo"))
    some = from_before(F.col("lo")) | from_after(F.col("hi"))
    by_cell = pairs.where(whole).groupBy(F.col("alarm_code").alias("anchor_code"), "partner_code").agg(F.sum("n").alias("matched"))
    partial = pairs.where(~whole & some).select("turbine_id", "bucket", "alarm_code", "partner_code", "before", "after")
    by_row = (
        instants.join(partial, ["turbine_id", "bucket", "alarm_code"])
        .where(from_before(F.col("us")) | from_after(F.col("us")))
        .groupBy(F.col("alarm_code").alias("anchor_code"), "partner_code")
        .agg(F.sum("n").alias("matched"))
    )
    return by_cell.unionByName(by_row).groupBy("anchor_code", "partner_code").agg(F.sum("matched").alias("matched"))


def cooccurrence_edges(alarms: DataFrame, window_s: float = COOCCUR_WINDOW_S, min_support: float = COOCCUR_MIN_SUPPORT) -> DataFrame:
    """Code pairs (code_a < code_b) whose support reaches ``min_support`` in both directions."""
    if not 0 < min_support <= 1:
        raise ValueError("min_support must lie in (0, 1]")
    forward = F.col("anchor_code") < F.col("partner_code")
    both = (
        matched_anchors(alarms, window_s)
        .groupBy(
            F.least("anchor_code", "partner_code").alias("code_a"),
            F.greatest("anchor_code", "partner_code").alias("code_b"),
        )
        .agg(
            F.coalesce(F.sum(F.when(forward, F.col("matched"))), F.lit(0)).alias("matched_a"),
            F.coalesce(F.sum(F.when(~forward, F.col("matched"))), F.lit(0)).alias("matched_b"),
        )
    )
    totals = alarms.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("total"))
    a = totals.select(F.col("alarm_code").alias("code_a"), F.col("total").alias("total_a"))
    b = totals.select(F.col("alarm_code").alias("code_b"), F.col("total").alias("total_b"))
    return (
        both.join(a, "code_a")
        .join(b, "code_b")
        .withColumn("support_a", F.col("matched_a") / F.col("total_a"))
        .withColumn("support_b", F.col("matched_b") / F.col("total_b"))
        .where((F.col("support_a") >= min_support) & (F.col("support_b") >= min_support))
        .select("code_a", "code_b", "matched_a", "total_a", "support_a", "matched_b", "total_b", "support_b")
    )


def group_coverage(groups: DataFrame, alarms: DataFrame, edges: DataFrame) -> DataFrame:
    """Per group: smallest code count, stations, dates, weakest pair, low-support flag.

    Stations and dates are counted from distinct (code, station) and (code, date) pairs.
    """
    members = materialize(groups.select("codes", F.explode("codes").alias("alarm_code")), "members")
    counts = alarms.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.join(counts, "alarm_code").groupBy("codes").agg(
        F.min("n").alias("min_code_rows"), F.sum("n").alias("rows")
    )
    stations = (
        members.join(alarms.select("alarm_code", "turbine_id").distinct(), "alarm_code")
        .select("codes", "turbine_id").distinct()
        .groupBy("codes").agg(F.count(F.lit(1)).alias("station_count"))
    )
    dates = (
        members.join(alarms.select("alarm_code", F.to_date("ts").alias("day")).distinct(), "alarm_code")
        .select("codes", "day").distinct()
        .groupBy("codes").agg(F.count(F.lit(1)).alias("distinct_dates"))
    )
    weakest = (
        members.join(edges, members.alarm_code == edges.code_a)
        .where(F.array_contains("codes", F.col("code_b")))
        .groupBy("codes")
        .agg(F.min(F.least("support_a", "support_b")).alias("min_pairwise_support"))
    )
    return (
        sizes.join(stations, "codes")
        .join(dates, "codes")
        .join(weakest, "codes")
        .withColumn("low_support", F.col("min_code_rows") < LOW_SUPPORT_ROWS)
    )


def group_members(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups with member labels and a text naming the documented members.

    ``labels`` holds one row per code: alarm_code, description, stopping, n.
    """
    member = F.struct("alarm_code", "description", "stopping", "n")
    named = F.when(F.col("description") != UNDOCUMENTED, F.col("description"))
    joined = groups.select("codes", F.explode("codes").alias("alarm_code")).join(labels, "alarm_code")
    grouped = joined.groupBy("codes").agg(
        F.array_sort(F.collect_list(member)).alias("members"),
        F.array_join(F.array_sort(F.collect_set(named)), "; ").alias("anchors"),
    )
    # Wording of the interpretation text.
    text = F.when(
        F.col("anchors") == "", F.lit("Physical meaning unverified: every member code is undocumented.")
    ).otherwise(
        F.concat(
            F.lit("Co-occurrence associated with documented event(s): "),
            F.col("anchors"),
            F.lit(". A shared physical cause and the meanings of undocumented members remain unverified."),
        )
    )
    return grouped.withColumn("interpretation", text)


def documented_without_group(labels: DataFrame, groups: DataFrame) -> DataFrame:
    grouped = groups.select(F.explode("codes").alias("alarm_code")).distinct()
    return labels.where(F.col("description") != UNDOCUMENTED).join(grouped, "alarm_code", "left_anti")
