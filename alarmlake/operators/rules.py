"""Rule matching, verdict precedence and rule-table validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alarmlake.functions.text import strip
from alarmlake.functions.conditions import is_critical, rule_matches
from alarmlake.operators.throttle import throttle
from alarmlake.plans.segments import RUN_BITS, micros
from alarmlake.session import materialize
from alarmlake.settings import COLLAPSE_WINDOW_S, NUISANCE_THRESHOLD

RULE_FIELDS = ["rule_order", "rule_id", "scope", "pattern", "action", "confidence"]
WILDCARD_SALTS = 64


def _brief(rule: Column) -> Column:
    return F.struct(
        rule["rule_order"].alias("rule_order"),
        rule["rule_id"].alias("rule_id"),
        rule["action"].alias("action"),
        rule["pattern"]["kind"].alias("kind"),
        rule["confidence"].alias("confidence"),
        rule["pattern"]["window_s"].alias("window_s"),
    )


def _key(shape: str, value: Column) -> Column:
    return F.concat(F.lit(f"{shape}:"), value.cast("string"))


SHAPES = ("code", "station", "signal", "any")


def rule_shape() -> Column:
    """What a rule is filed under: the first of code, station, signal that its scope names, or nothing."""
    shape = F.lit("any")
    for name, field in (("signal", "signal"), ("station", "turbine_id"), ("code", "alarm_code")):
        shape = F.when(F.col(f"scope.{field}").isNotNull(), F.lit(name)).otherwise(shape)
    return shape


def shapes_of(rules: DataFrame) -> frozenset[str]:
    """The shapes that occur, so that matching leaves out the joins no rule needs. Runs a job over the rule table."""
    return frozenset(r["shape"] for r in rules.select(rule_shape().alias("shape")).distinct().collect())


def matching_pairs(events: DataFrame, rules: DataFrame, active: Column | None = None, interval: tuple[str, str] | None = None, shapes: frozenset[str] = frozenset(SHAPES)) -> DataFrame:
    """seq and rule of every match.

    A rule is filed under its shape; events meet the rules filed under their own values by equi-joins, and the rest of the
    scope is tested on those pairs only. Rules that name nothing are filed under 64 salts, so the events that all meet them
    are spread. ``shapes`` may name the only shapes that occur.
    """
    extra = list(interval) if interval else []
    filed = rules.select(F.struct(*RULE_FIELDS, *extra).alias("_rule"), rule_shape().alias("_shape"))
    code, station, signal = (F.col(f"_rule.scope.{f}") for f in ("alarm_code", "turbine_id", "signal"))
    salts = F.transform(F.sequence(F.lit(0), F.lit(WILDCARD_SALTS - 1)), lambda i: _key("any", i))
    shape = F.col("_shape")
    keys = F.when(shape == "code", F.array(_key("code", code))).when(shape == "station", F.array(_key("station", station))).when(shape == "signal", F.array(_key("signal", signal))).otherwise(salts)
    filed = filed.select("_rule", F.explode(keys).alias("_key"))
    values = {"code": F.col("alarm_code"), "station": F.col("turbine_id"), "any": F.pmod(F.xxhash64("seq"), F.lit(WILDCARD_SALTS))}
    own = F.array_compact(F.array(*[_key(name, value) for name, value in values.items() if name in shapes])).cast("array<string>")
    test = rule_matches(F.col("_rule"))
    if interval:
        test = (F.col(f"_rule.{interval[0]}") <= active) & (active < F.col(f"_rule.{interval[1]}")) & test
    found = []
    if shapes - {"signal"} or not shapes:
        found.append(events.withColumn("_key", F.explode(own)).join(filed, "_key").where(test).select("seq", "_rule"))
    if "signal" in shapes:
        # Signals can be many per event: only their names travel to the rules filed under a signal.
        names = F.array_union(F.array_compact(F.array("signal")), F.array_union(_names("signals"), _names("features")))
        named = events.select("seq", F.explode(F.array_distinct(names)).alias("_name")).select("seq", _key("signal", F.col("_name")).alias("_key")).join(filed, "_key").drop("_key")
        found.append(events.join(named, "seq").where(test).select("seq", "_rule"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _names(column: str) -> Column:
    return F.coalesce(F.map_keys(column), F.array().cast("array<string>"))


def match_rules(events: DataFrame, rules: DataFrame, active: Column | None = None, interval: tuple[str, str] | None = None, shapes: frozenset[str] = frozenset(SHAPES)) -> DataFrame:
    """Add ``matches``: the matching rules of each event in learn order.

    ``interval`` names rule columns bounding a revision range and ``active`` is the event's revision. No job runs
    before the action. Streams are matched batch by batch.
    """
    found = matching_pairs(events, rules, active, interval, shapes).groupBy("seq").agg(F.array_sort(F.collect_list(_brief(F.col("_rule")))).alias("_found"))
    joined = events.join(found, "seq", "left")
    kind = joined.schema["_found"].dataType
    return joined.select(*events.columns, F.coalesce("_found", F.array().cast(kind)).alias("matches"))


def leading_rules(rules: DataFrame, interval: tuple[str, str] | None = None) -> DataFrame:
    """The rules that can ever decide an event.

    Rules of equal scope and conditions match the same events. Of those with one action and kind only the first in learn
    order can be picked, and the most confident one can raise the confidence of an escalation; the others never show in
    ``decide``. So an event meets a few rules for each different predicate, however many rules repeat it.

    With ``interval`` a rule stands back only for an earlier one that is active in the whole of its revision range. Learn
    order must then be the order of the range starts, as in ``journal.rule_lifetimes``.
    """
    brief = F.struct("rule_order", "rule_id", "confidence", "pattern.window_s")
    alike = {"scope": F.col("scope"), "_conditions": F.col("pattern.conditions"), "action": F.col("action"), "_kind": F.col("pattern.kind")}
    if interval:
        start, end = interval
        sure = F.when(F.col("action") == "escalate", F.col("confidence"))
        earlier = W.partitionBy(*alike.values(), sure).orderBy(start, brief).rowsBetween(W.unboundedPreceding, -1)
        seen = rules.select(*RULE_FIELDS, start, end, F.max(end).over(earlier).alias("_seen"))
        return seen.where(F.col("_seen").isNull() | (F.col("_seen") < F.col(end))).drop("_seen")
    named = rules.select(brief.alias("_brief"), *[c.alias(n) for n, c in alike.items()])
    best = F.when(F.col("action") == "escalate", F.max_by("_brief", "_brief.confidence"))
    kept = named.groupBy(*alike).agg(F.array_distinct(F.array_compact(F.array(F.min("_brief"), best))).alias("_kept"))
    pattern = F.struct(F.col("_kind").alias("kind"), F.col("_brief.window_s").alias("window_s"), F.col("_conditions").alias("conditions")).alias("pattern")
    return kept.withColumn("_brief", F.explode("_kept")).select("_brief.rule_order", "_brief.rule_id", "scope", pattern, "action", "_brief.confidence")


def _predicate() -> Column:
    return F.to_json(F.struct("scope", "pattern.conditions"))


def matching_predicates(events: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, predicate) of every match, as often as ``match_rules`` lists it, and the rules with their ``predicate``.

    Events meet each different scope with conditions once. What the rules that repeat it add is a join on ``predicate``,
    so nothing is tested again for them and counts need no pairs at all.
    """
    named = materialize(rules.select(*RULE_FIELDS, _predicate().alias("predicate")), "predicates")
    one = named.groupBy("predicate").agg(F.first(F.struct(*RULE_FIELDS)).alias("r")).select(*[f"r.{c}" for c in RULE_FIELDS if c != "rule_id"], F.col("predicate").alias("rule_id"))
    one = materialize(one, "distinct-predicates")
    stored = materialize(events, "events")
    found = matching_pairs(stored, one, shapes=shapes_of(one)).select("seq", F.col("_rule.rule_id").alias("predicate"))
    return found.join(stored.select("seq"), "seq"), named


def _with_action(*tests) -> Column:
    return F.filter("matches", lambda r: _all([t(r) for t in tests]))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _is(action: str):
    return lambda r: r["action"] == action


def _learned(r: Column) -> Column:
    return r["kind"] == "learned"


def match_leading(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``match_rules`` with ``leading_rules``. Events and rules are written once, since matching reads them several times."""
    leading = materialize(leading_rules(rules), "leading")
    return match_rules(materialize(events, "events"), leading, shapes=shapes_of(leading))


def decide(matched: DataFrame) -> DataFrame:
    """Add ``stage`` (first applicable step of the fixed precedence), the deciding rule and
    its window. The choice is stateless; only collapse needs history afterwards."""
    first = lambda *tests: F.try_element_at(_with_action(*tests), F.lit(1))
    picked = matched.select(
        "*",
        is_critical().alias("is_critical"),
        F.array_max(F.transform(_with_action(_is("escalate")), lambda r: r["confidence"])).alias("_esc"),
        first(_is("suppress"), lambda r: ~_learned(r)).alias("_sup"),
        first(_is("collapse")).alias("_col"),
        first(_is("suppress"), _learned).alias("_lea"),
    )
    stage = (
        F.when(F.col("is_critical"), "critical")
        .when(F.col("_esc").isNotNull(), "escalate")
        .when(F.col("_sup").isNotNull(), "suppress")
        .when(F.col("_col").isNotNull(), "collapse")
        .otherwise("classify")
    )
    picked = picked.withColumn("stage", stage)
    by_stage = lambda field: (
        F.when(F.col("stage") == "suppress", F.col(f"_sup.{field}"))
        .when(F.col("stage") == "collapse", F.col(f"_col.{field}"))
        .when(F.col("stage") == "classify", F.col(f"_lea.{field}"))
    )
    return picked.select(
        *matched.columns,
        "is_critical",
        (F.col("is_critical") | F.col("_esc").isNotNull()).alias("protected"),
        "stage",
        by_stage("rule_id").alias("rule_id"),
        F.when(F.col("stage") == "critical", F.lit(1.0))
        .when(F.col("stage") == "escalate", F.col("_esc"))
        .otherwise(by_stage("confidence"))
        .alias("rule_confidence"),
        by_stage("window_s").alias("window_s"),
    )


def _flat(decided: DataFrame, keep: list[str], probability: Column | None, collapse_window_s: int) -> DataFrame:
    """What a verdict needs of a decided event, written once: matching is the costly step and is read several times."""
    p = F.lit(0.5) if probability is None else probability
    window = F.coalesce(F.nullif("window_s", F.lit(0)), F.lit(collapse_window_s))
    flat = decided.select(
        *keep,
        "stage",
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("rule_confidence", F.lit(0.0)).alias("rule_confidence"),
        p.alias("probability"),
        micros("ts").alias("us"),
        (window * 1_000_000).cast("bigint").alias("width_us"),
    )
    return materialize(flat, "decided")


def _judged(rest: DataFrame, repeats: DataFrame, keep: list[str], threshold: float) -> DataFrame:
    """show, suppressed_by, confidence; ``repeats`` are the events of collapse rules with ``hidden``."""
    stage, rule = F.col("stage"), F.col("rule_id")
    by_classifier = (stage == "classify") & (rule != "") & (F.col("probability") >= threshold)
    hidden = F.when(stage == "suppress", F.lit(True)).when(stage == "collapse", F.col("hidden")).otherwise(by_classifier)
    return rest.withColumn("hidden", F.lit(None).cast("boolean")).unionByName(repeats).select(
        *keep,
        "stage",
        (~hidden).alias("show"),
        F.when(hidden & by_classifier, F.concat(F.lit("classifier:"), rule)).when(hidden, rule).alias("suppressed_by"),
        F.when(stage != "classify", F.col("rule_confidence"))
        .when(hidden, F.col("probability"))
        .otherwise(F.lit(1.0) - F.col("probability"))
        .alias("confidence"),
    )


def verdicts(
    decided: DataFrame,
    keep: list[str],
    probability: Column | None = None,
    threshold: float = NUISANCE_THRESHOLD,
    collapse_window_s: int = COLLAPSE_WINDOW_S,
    bits: int = RUN_BITS,
    generation: str | None = None,
) -> DataFrame:
    """show / suppressed_by / confidence for decided events.

    Only events whose deciding rule is a collapse take the stateful branch. ``generation``
    restarts collapse state after a stream reset. Without a trained classifier the nuisance
    probability is one half.
    """
    flat = _flat(decided, keep, probability, collapse_window_s)
    keys = ["rule_id", "turbine_id", *([generation] if generation else [])]
    collapse = F.col("stage") == "collapse"
    return _judged(flat.where(~collapse), throttle(flat.where(collapse), keys, bits=bits), keep, threshold)


def verdicts_from(decided: DataFrame, keep: list[str], anchors: DataFrame, probability: Column | None, threshold: float, collapse_window_s: int, generation: str | None, fold) -> tuple[DataFrame, DataFrame]:
    """``verdicts`` of one batch of a stream by ``fold`` (rows, keys, anchors before), and the anchors it leaves."""
    flat = _flat(decided, keep, probability, collapse_window_s)
    keys = ["rule_id", "turbine_id", *([generation] if generation else [])]
    collapse = F.col("stage") == "collapse"
    repeats, after = fold(flat.where(collapse), keys, anchors)
    return _judged(flat.where(~collapse), repeats, keep, threshold), after


KEEP = ["seq", "ts", "turbine_id", "alarm_code"]


def score(events: DataFrame, rules: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Match, decide and give a verdict for every event. Events meet the rules that can decide only."""
    return verdicts(decide(match_leading(events, rules)), keep or KEEP, **options)


# Allowed names and shapes of rule fields.
ACTIONS = ("suppress", "collapse", "escalate")
KINDS = ("code_match", "conditions", "learned")
OPS = ("eq", "ne", "lt", "lte", "gt", "gte")
ORDERED_OPS = ("lt", "lte", "gt", "gte")
FIELD_PATTERN = r"^(signals\.|features\.)?[A-Za-z][A-Za-z0-9_]*\z"
AWARE_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)\z"


def rule_violations(rules: DataFrame) -> DataFrame:
    """rule_id and the list of broken constraints; valid rules give an empty list."""
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    blank_if_set = lambda c: c.isNotNull() & (strip(c) == "")
    conditions = F.coalesce(F.col("pattern.conditions"), F.array().cast("array<struct<field:string,op:string,value_num:double,value_str:string,value_bool:boolean,value_null:boolean>>"))
    checks = {
        "blank_text": blank(F.col("rule_id")) | blank(F.col("utterance")) | blank(F.col("taught_by")),
        "blank_scope": blank_if_set(F.col("scope.turbine_id")) | blank_if_set(F.col("scope.signal")),
        "action": ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)),
        "kind": ~F.coalesce(F.col("pattern.kind").isin(*KINDS), F.lit(False)),
        "window": ~F.coalesce(F.col("pattern.window_s") >= 0, F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "taught_at": ~F.coalesce(F.col("taught_at").rlike(AWARE_PATTERN), F.lit(False)),
        "reversible": F.col("reversible").isNull(),
        "needs_condition": F.col("pattern.kind").isin("conditions", "learned") & (F.size(conditions) == 0),
        "condition_field": F.exists(conditions, lambda c: ~F.coalesce(c["field"].rlike(FIELD_PATTERN), F.lit(False))),
        "condition_op": F.exists(conditions, lambda c: ~F.coalesce(c["op"].isin(*OPS), F.lit(False))),
        "ordered_number": F.exists(
            conditions, lambda c: F.coalesce(c["op"].isin(*ORDERED_OPS), F.lit(False)) & (c["value_num"].isNull() | F.isnan(c["value_num"]))
        ),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    repeated = F.col("_copies") > 1
    copies = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_copies"))
    return rules.join(copies, "rule_id").select("rule_id", F.when(repeated, F.array_append(named, F.lit("repeated_id"))).otherwise(named).alias("problems"))


def counters(scored: DataFrame) -> DataFrame:
    """Shown, suppressed and suppression rate of alarm events; sensor events never count."""
    alarm = F.col("alarm_code").isNotNull()
    return scored.agg(
        F.count_if(alarm & F.col("show")).alias("shown"), F.count_if(alarm & ~F.col("show")).alias("suppressed")
    ).withColumn(
        "suppression_rate",
        F.coalesce(F.col("suppressed") / F.nullif(F.col("shown") + F.col("suppressed"), F.lit(0)), F.lit(0.0)),
    )


def trailing_visible_rate(scored: DataFrame, ring_size: int) -> DataFrame:
    """Shown alarms within one hour before the newest time of the last ``ring_size`` events."""
    recent = scored.orderBy(F.desc("seq")).limit(ring_size)
    last = recent.agg(F.max("ts")).scalar()
    shown = F.col("alarm_code").isNotNull() & F.col("show") & (micros("ts") > micros(last) - 3_600_000_000)
    return recent.agg(F.count_if(shown).alias("visible_per_hour"))
