"""Agreement between raw sources, processed tables and published metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlake.functions.jsontext import canonical_map_json
from alarmlake.operators.metrics import alarm_rate, pareto
from alarmlake.schemas import ALARM_KEY


def multiset_difference(left: DataFrame, right: DataFrame, keys: Sequence[str] = ALARM_KEY) -> DataFrame:
    """Keys whose number of rows differs between the sides.

    Each side is reduced to one count per key before they meet, so repeated rows never do.
    """
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("m"))
    b = right.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("m"))
    return (
        a.unionByName(b)
        .groupBy(*keys)
        .agg(F.sum("n").alias("left_rows"), F.sum("m").alias("right_rows"))
        .where(F.col("left_rows") != F.col("right_rows"))
    )


def cell_differences(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys on one side only, or with different values; null equals null. Keys are unique per side."""
    keys = list(keys)
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    both = F.col("in_left") & F.col("in_right")
    same = F.coalesce(both, F.lit(False)) & F.col("left_value").eqNullSafe(F.col("right_value"))
    return a.join(b, keys, "full_outer").where(~same).select(
        *keys, "left_value", "right_value", F.col("in_left").isNotNull().alias("in_left"), F.col("in_right").isNotNull().alias("in_right")
    )


def fingerprint(rows: DataFrame, member: str, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-independent digest per source member.

    The digest hashes the multiset through a sum of row hashes, so it is a plain partial
    aggregate: a member of any size never meets in one task.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.sum(h).cast("string") for h in halves]
    return rows.groupBy(member).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


def snapshot_digest(snapshots: DataFrame) -> DataFrame:
    """Digest of the canonical JSON of each signals map, with its null readings."""
    return snapshots.select(
        *[c for c in snapshots.columns if c != "signals"],
        F.size("signals").alias("readings"),
        F.size(F.filter(F.map_values("signals"), lambda v: v.isNull())).alias("null_readings"),
        F.sha2(canonical_map_json(F.col("signals")), 256).alias("signals_sha256"),
    )


def preview_names(snapshots: DataFrame, keys: Sequence[str], ends: int = 6, nulls: int = 2) -> DataFrame:
    """First and last signal names of each snapshot and its first null ones."""
    names = F.array_sort(F.map_keys("signals"))
    empty = F.filter(names, lambda n: F.try_element_at("signals", n).isNull())
    head = F.slice(names, 1, ends)
    tail = F.slice(names, F.greatest(F.size(names) - ends + 1, F.lit(1)), ends)
    chosen = F.array_sort(F.array_distinct(F.concat(head, tail, F.slice(empty, 1, nulls))))
    return snapshots.select(*keys, F.posexplode(chosen).alias("position", "signal"), "signals").select(
        *keys, "position", "signal", F.try_element_at("signals", F.col("signal")).alias("value")
    )


def published_metrics(alarms: DataFrame, stations: DataFrame) -> DataFrame:
    """The metrics a baseline publishes and an audit recomputes."""
    rate = alarm_rate(alarms).select("records", "hours", "rate")
    share = pareto(alarms).select("top10_share_pct").scalar()
    return rate.select(
        "records", F.col("hours").alias("observed_hours"), F.col("rate").alias("site_rate"), share.alias("top10_share_pct"),
        stations.agg(F.count(F.lit(1))).scalar().alias("stations"),
    )


def reconcile_published(published: DataFrame, recomputed: DataFrame, rel_tol: float = 1e-12) -> DataFrame:
    """One row: do stored metrics agree with recomputed ones?"""
    close = lambda c: F.abs(F.col(f"p.{c}") - F.col(f"r.{c}")) <= rel_tol * F.greatest(F.abs(F.col(f"p.{c}")), F.abs(F.col(f"r.{c}")))
    same = (F.col("p.records") == F.col("r.records")) & (F.col("p.stations") == F.col("r.stations")) & close("site_rate") & close("top10_share_pct")
    both = published.select(F.struct("*").alias("p"), recomputed.select(F.struct("*")).scalar().alias("r"))
    return both.select(
        F.when(same, "verified").otherwise("mismatch").alias("status"),
        F.col("r.records").alias("records"),
        F.col("r.stations").alias("stations"),
        F.col("r.site_rate").alias("site_rate"),
        F.col("r.top10_share_pct").alias("top10_share_pct"),
    )
