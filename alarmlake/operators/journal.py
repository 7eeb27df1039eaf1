"""Append-only rule journal: fold, consistency checks, revisions and rescoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.operators.models import with_revision_probability
from alarmlake.operators.rules import KEEP, decide, leading_rules, match_rules, shapes_of, verdicts
from alarmlake.plans.segments import RUN_BITS, run_of, running_total
from alarmlake.session import materialize
from alarmlake.settings import PolicySettings

FIRST_REVISION = 1
OPEN_END = (1 << 62)
OPERATIONS = ("learn", "commit", "undo")


def rule_lifetimes(journal: DataFrame) -> DataFrame:
    """Committed rules with the revision range [v_from, v_to) in which they are active.

    A learn line without a commit has no effect; learn order is commit order.
    """
    learned = journal.where("op = 'learn'").groupBy("rule.rule_id").agg(F.max_by("rule", "line").alias("rule"))
    commits = journal.where("op = 'commit'").groupBy("rule_id").agg(F.min("model_version").alias("v_from"))
    undone = journal.where("op = 'undo'").groupBy("rule_id").agg(F.min("model_version").alias("v_to"))
    return (
        commits.join(learned, "rule_id")
        .join(undone, "rule_id", "left")
        .select(
            F.col("v_from").alias("rule_order"),
            "rule_id",
            *[f"rule.{c}" for c in ("utterance", "scope", "pattern", "action", "confidence", "taught_by", "taught_at", "reversible")],
            "v_from",
            F.coalesce("v_to", F.lit(OPEN_END)).alias("v_to"),
        )
    )


def checked(journal: DataFrame) -> DataFrame:
    """The journal, refused as a whole: reading it raises with the line and the problem of its first broken constraint."""
    first = journal_violations(journal).agg(F.min(F.struct("line", "problem")).alias("f")).select(F.concat(F.lit("broken journal, line "), F.col("f.line").cast("string"), F.lit(": "), F.col("f.problem")))
    fault = first.scalar()
    return journal.withColumn("op", F.when(fault.isNull(), F.col("op")).otherwise(F.raise_error(fault).cast("string")))


def active_rules(journal: DataFrame, version: int | None = None) -> DataFrame:
    """Rules active at a revision (the latest by default); a broken journal is refused."""
    rules = rule_lifetimes(checked(journal))
    at = F.lit(version) if version is not None else F.lit(OPEN_END - 1)
    return rules.where((F.col("v_from") <= at) & (at < F.col("v_to")))


def active_batches(journal: DataFrame, excluded: str | None = None) -> DataFrame:
    """Training examples of the active rules: rule_id, position, features, label, weight."""
    undone = journal.where("op = 'undo'").select("rule_id").distinct()
    commits = journal.where("op = 'commit'").join(undone, "rule_id", "left_anti")
    if excluded is not None:
        commits = commits.where(F.col("rule_id") != excluded)
    return commits.select("rule_id", "model_version", F.posexplode("examples").alias("position", "e")).select(
        "rule_id", "model_version", "position", "e.features", "e.label", F.coalesce("e.weight", F.lit(1.0)).alias("weight")
    )


def batch_lifetimes(journal: DataFrame) -> DataFrame:
    """Every training example with the revision range [v_from, v_to) in which its batch is active; a broken journal is refused."""
    lines = checked(journal)
    undone = lines.where("op = 'undo'").groupBy("rule_id").agg(F.min("model_version").alias("v_to"))
    rows = lines.where("op = 'commit'").select("rule_id", F.col("model_version").alias("v_from"), F.posexplode("examples").alias("position", "e"))
    return rows.join(undone, "rule_id", "left").select(
        "rule_id", "v_from", F.coalesce("v_to", F.lit(OPEN_END)).alias("v_to"), "position", "e.features", "e.label", F.coalesce("e.weight", F.lit(1.0)).alias("weight")
    )


def journal_violations(journal: DataFrame) -> DataFrame:
    """(line, problem) for every broken journal constraint."""
    versioned = journal.where(F.col("op").isin("commit", "undo"))
    placed = running_total(versioned.withColumn("_one", F.lit(1)), "_one", "line", "place")
    first = journal.where("op = 'commit'").orderBy("line").limit(1)
    kept = first.select(F.struct("learning_rate", "nuisance_threshold", "collapse_window_s")).scalar()
    per_rule = journal.groupBy(F.coalesce("rule.rule_id", "rule_id").alias("rule_id")).agg(
        F.min(F.when(F.col("op") == "learn", F.col("line"))).alias("learn_line"),
        F.max(F.when(F.col("op") == "learn", F.col("line"))).alias("last_learn_line"),
        F.min(F.when(F.col("op") == "commit", F.col("line"))).alias("commit_line"),
        F.min(F.when(F.col("op") == "undo", F.col("line"))).alias("undo_line"),
        F.max_by(F.when(F.col("op") == "learn", F.col("rule.reversible")), F.when(F.col("op") == "learn", F.col("line"))).alias("reversible"),
    )
    bad_example = F.exists(
        F.coalesce("examples", F.array().cast("array<struct<features:map<string,double>,label:int,weight:double>>")),
        lambda e: ~F.coalesce(e["label"].isin(0, 1), F.lit(False))
        | (F.coalesce(e["weight"], F.lit(1.0)) <= 0)
        | F.isnan(F.coalesce(e["weight"], F.lit(1.0)))
        | e["features"].isNull()
        | F.exists(F.map_values(e["features"]), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))),
    )
    settings_ok = (
        (F.col("learning_rate") > 0)
        & (F.col("nuisance_threshold") > 0.5)
        & (F.col("nuisance_threshold") <= 1)
        & (F.col("collapse_window_s") > 0)
    )
    named = F.coalesce("rule.rule_id", "rule_id")
    rows = (
        journal.withColumn("_id", named)
        .join(per_rule.withColumnRenamed("rule_id", "_id"), "_id", "left")
        .join(placed.select("line", "place"), "line", "left")
        .withColumn("_kept", kept)
    )
    op = F.col("op")
    checks = {
        "schema_version": ~F.coalesce(F.col("schema_version") == 1, F.lit(False)),
        "unknown_op": ~F.coalesce(op.isin(*OPERATIONS), F.lit(False)),
        "nonsequential_version": op.isin("commit", "undo") & ~F.coalesce(F.col("model_version") == F.col("place") + FIRST_REVISION, F.lit(False)),
        "commit_without_learn": (op == "commit") & ~F.coalesce(F.col("learn_line") < F.col("line"), F.lit(False)),
        "reused_rule_id": ((op == "learn") & F.coalesce(F.col("line") > F.col("commit_line"), F.lit(False)))
        | ((op == "commit") & F.coalesce(F.col("line") > F.col("commit_line"), F.lit(False))),
        "encoding_version": (op == "commit") & ~F.coalesce(F.col("feature_encoding_version") == 1, F.lit(False)),
        "invalid_settings": (op == "commit") & ~F.coalesce(settings_ok, F.lit(False)),
        "changed_settings": (op == "commit")
        & ~F.coalesce(F.struct("learning_rate", "nuisance_threshold", "collapse_window_s") == F.col("_kept"), F.lit(False)),
        "invalid_example": (op == "commit") & bad_example,
        "undo_inactive": (op == "undo")
        & ~F.coalesce((F.col("commit_line") < F.col("line")) & (F.col("undo_line") == F.col("line")), F.lit(False)),
        "undo_irreversible": (op == "undo") & ~F.coalesce(F.col("reversible"), F.lit(False)),
    }
    problems = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in checks.items()]))
    return rows.select("line", F.explode(problems).alias("problem"))


def revision_starts(revisions: DataFrame, ring_size: int) -> DataFrame:
    """lo, version: from which ``seq`` on a revision gives the final verdict; one row per position.

    A revision applied after n observations rescores the last B of them, so it reaches back to
    seq n - B; older verdicts stay frozen.
    """
    base = revisions.sparkSession.range(1).select(F.col("id").alias("lo"), F.lit(FIRST_REVISION).cast("bigint").alias("version"))
    reach = F.greatest(F.col("applied_at") - ring_size, F.lit(0)).cast("bigint")
    return base.unionByName(revisions.select(reach.alias("lo"), F.col("version").cast("bigint").alias("version"))).groupBy("lo").agg(F.max("version").alias("version"))


def with_revision(events: DataFrame, revisions: DataFrame, ring_size: int, bits: int = RUN_BITS) -> DataFrame:
    """Add ``revision``: the newest revision that could still rescore the event.

    An as-of merge: events and revision starts are united and ordered inside runs of 2**bits arrivals, where each event
    takes the newest start so far. The newest start of all earlier runs is carried on as one row per run, so no event meets
    a range that does not cover it.
    """
    starts = revision_starts(revisions, ring_size).withColumn("_run", run_of("lo", bits))
    newest = starts.groupBy("_run").agg(F.max("version").alias("version"))
    inside = W.orderBy("_run")  # one row per run that has a start
    upto = F.max("version").over(inside.rowsBetween(W.unboundedPreceding, 0))
    last_run = events.agg(F.coalesce(run_of(F.max("seq"), bits), F.lit(0))).scalar()
    until = F.coalesce(F.lead("_run").over(inside), F.greatest(last_run, F.col("_run") + 1))
    spans = newest.select((F.col("_run") + 1).alias("first"), until.alias("last"), upto.alias("_carried"))
    carried = spans.select(F.explode(F.sequence("first", "last", F.lit(1).cast("bigint"))).alias("_run"), "_carried")
    rows = events.select("seq", F.struct(*events.columns).alias("_event"), F.lit(None).cast("bigint").alias("version"))
    marks = starts.select(F.col("lo").alias("seq"), F.lit(None).cast(rows.schema["_event"].dataType).alias("_event"), "version")
    merged = rows.unionByName(marks).withColumn("_run", run_of("seq", bits))
    order = W.partitionBy("_run").orderBy("seq", F.col("_event").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    placed = merged.withColumn("_here", F.max("version").over(order)).where("_event IS NOT NULL")
    return placed.join(carried, "_run", "left").select("_event.*", F.greatest(F.coalesce("_here", F.lit(0)), F.coalesce("_carried", F.lit(0))).cast("bigint").alias("revision"))


def rescored(
    events: DataFrame,
    journal: DataFrame,
    revisions: DataFrame,
    settings: PolicySettings | None = None,
    keep: list[str] | None = None,
    probability: Column | None = None,
    bits: int = RUN_BITS,
    models: DataFrame | None = None,
) -> DataFrame:
    """Final verdict of every event after all learn and undo steps.

    ``models`` (rows of ``models.fit_revisions``) give each event the probability of its own revision's classifier,
    in place of one ``probability`` for the whole history.

    Each event is judged once, by the rules of its final revision. Final revisions never
    decrease along ``seq``, so one collapse fold over all events equals rescoring the ring
    after every step with the anchor of the last evicted event.
    """
    s = settings or PolicySettings()
    placed = with_revision(events, revisions, s.ring_size, bits)
    if models is not None:
        placed, probability = with_revision_probability(placed, models), F.col("probability")
    placed = materialize(placed, "revised")  # matching reads it several times
    lifetimes = materialize(leading_rules(rule_lifetimes(checked(journal)), ("v_from", "v_to")), "lifetimes")
    matched = match_rules(placed, lifetimes, active=F.col("revision"), interval=("v_from", "v_to"), shapes=shapes_of(lifetimes))
    return verdicts(
        decide(matched),
        [*(keep or KEEP), "revision"],
        probability=probability,
        threshold=s.nuisance_threshold,
        collapse_window_s=s.collapse_window_s,
        bits=bits,
    )


def newly_suppressed(events: DataFrame, journal: DataFrame, revisions: DataFrame, version: int, settings: PolicySettings | None = None, models: DataFrame | None = None) -> DataFrame:
    """Ring events shown before a revision and hidden after it, by the rules and, with ``models``, the classifiers of both."""
    s = settings or PolicySettings()
    at = revisions.where(F.col("version") == version).select("applied_at").scalar()
    seen = events.where(F.col("seq") < at)
    sides = {}
    for name, upto in (("before", version - 1), ("after", version)):
        lines = journal.where((F.col("op") == "learn") | (F.col("model_version") <= upto))
        steps = revisions.where(F.col("version") <= upto)
        sides[name] = rescored(seen, lines, steps, s, models=models).where(F.col("seq") >= at - s.ring_size)
    shown = sides["before"].where("show").select("seq")
    return sides["after"].where("NOT show").join(shown, "seq", "left_semi")
