"""Rule predicates as column expressions.

Three-valued logic is closed: a missing, non-scalar or non-finite observation makes every
predicate false, ``ne`` included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event fields by kind. The first four are part of every event, so a null there
# is an observed null; the others are absent when null.
ALWAYS_TEXT = ("turbine_id", "description")
ALWAYS_NUMBER = ("alarm_code", "stopping")
OPTIONAL_TEXT = ("signal", "severity")
OPTIONAL_NUMBER = ("value",)
OPTIONAL_FLAG = ("critical",)
NOT_SCALAR = ("ts", "signals", "features")
CRITICAL_SEVERITIES = ("critical", "emergency")

_MISSING, _NULL, _NUMBER, _TEXT, _FLAG = range(5)


def _false_if_null(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def scope_matches(rule: Column) -> Column:
    """Every non-null scope field must equal the event's; a signal may be the event's own
    signal or a key of its maps."""
    scope = rule["scope"]
    signal = scope["signal"]
    named = (
        _false_if_null(F.col("signal") == signal)
        | _false_if_null(F.map_contains_key("signals", signal))
        | _false_if_null(F.map_contains_key("features", signal))
    )
    return (
        (scope["turbine_id"].isNull() | _false_if_null(F.col("turbine_id") == scope["turbine_id"]))
        & (scope["alarm_code"].isNull() | _false_if_null(F.col("alarm_code") == scope["alarm_code"]))
        & (signal.isNull() | named)
    )


def scope_overlaps(rule: Column) -> Column:
    """Scope test of station and code only, ignoring conditions and signals."""
    scope = rule["scope"]
    return (scope["turbine_id"].isNull() | _false_if_null(F.col("turbine_id") == scope["turbine_id"])) & (
        scope["alarm_code"].isNull() | _false_if_null(F.col("alarm_code") == scope["alarm_code"])
    )


def _number_kind(value: Column) -> Column:
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(value.isNull(), F.lit(_NULL)).when(finite, F.lit(_NUMBER)).otherwise(F.lit(_MISSING))


def _seen(kind: Column, number: Column | None = None, text: Column | None = None, flag: Column | None = None) -> Column:
    """An observation: its kind and the one value of that kind."""
    parts = (("number", number, "double"), ("text", text, "string"), ("flag", flag, "boolean"))
    return F.struct(kind.alias("kind"), *[(F.lit(None) if value is None else value).cast(form).alias(name) for name, value, form in parts])


def _direct(field: Column) -> Column:
    """Observation of a field of the event itself; null where the field is no such field or is absent."""
    found = F.when(field.isin(*NOT_SCALAR), _seen(F.lit(_MISSING)))
    for name in ALWAYS_TEXT:
        found = found.when(field == name, _seen(F.when(F.col(name).isNull(), _NULL).otherwise(_TEXT), text=F.col(name)))
    for name in ALWAYS_NUMBER:
        found = found.when(field == name, _seen(F.when(F.col(name).isNull(), _NULL).otherwise(_NUMBER), number=F.col(name)))
    for name in OPTIONAL_FLAG:
        found = found.when((field == name) & F.col(name).isNotNull(), _seen(F.lit(_FLAG), flag=F.col(name)))
    for name in OPTIONAL_TEXT:
        found = found.when((field == name) & F.col(name).isNotNull(), _seen(F.lit(_TEXT), text=F.col(name)))
    for name in OPTIONAL_NUMBER:
        found = found.when((field == name) & F.col(name).isNotNull(), _seen(_number_kind(F.col(name)), number=F.col(name)))
    return found


def _mapped(field: Column) -> Column:
    """Observation from the signals or the features; missing where neither has the key."""
    inner = F.substring_index(field, ".", -1)
    found = []
    for column in ("signals", "features"):
        named = (inner == field) | (F.substring_index(field, ".", 1) == column)
        value = F.try_element_at(F.col(column), inner)
        found.append(F.when(named & _false_if_null(F.map_contains_key(column, inner)), _seen(_number_kind(value), number=value)))
    return F.coalesce(*found, _seen(F.lit(_MISSING)))


def condition_holds(condition: Column) -> Column:
    """One declared condition: direct fields first, then signals, then features; an explicit
    ``signals.x`` or ``features.x`` selects just that map. Booleans never equal numbers.

    Branches are lazy, so a condition on a map never tests the fields one by one for their values. A one-element
    array binds the observation to a name, so it is resolved once per condition.
    """
    field = condition["field"]
    return F.exists(F.array(F.coalesce(_direct(field), _mapped(field))), lambda a: _compare(a, condition))


def _compare(actual: Column, condition: Column) -> Column:
    kind, op = actual["kind"], condition["op"]
    equal = _false_if_null(
        F.when(kind == _NULL, condition["value_null"])
        .when(kind == _NUMBER, actual["number"] == condition["value_num"])
        .when(kind == _TEXT, actual["text"] == condition["value_str"])
        .when(kind == _FLAG, actual["flag"] == condition["value_bool"])
    )
    number, wanted = actual["number"], condition["value_num"]
    ordered = (kind == _NUMBER) & _false_if_null(
        F.when(op == "lt", number < wanted)
        .when(op == "lte", number <= wanted)
        .when(op == "gt", number > wanted)
        .when(op == "gte", number >= wanted)
    )
    verdict = F.when(op == "eq", equal).when(op == "ne", ~equal).otherwise(ordered)
    return (kind != _MISSING) & _false_if_null(verdict)


def rule_matches(rule: Column) -> Column:
    return scope_matches(rule) & F.forall(rule["pattern"]["conditions"], condition_holds)


def is_critical() -> Column:
    """Marked critical, or a severity that says so. A stopping code is not critical."""
    return _false_if_null(F.col("critical")) | _false_if_null(F.lower("severity").isin(*CRITICAL_SEVERITIES))
