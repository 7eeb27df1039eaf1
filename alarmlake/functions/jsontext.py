"""Canonical and strict JSON, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_map_json(values: Column) -> Column:
    """Key-sorted compact JSON of a numeric map; null values stay null."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(values)))
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


#: A string with the colon that makes it a key, or a brace; braces and colons inside strings are part of the string.
KEY_OR_BRACE = r'"(?:\\.|[^"\\])*"\s*:?|[{}]'


#: A key as it is written, without the colon (first group); other strings are passed over.
KEY_NAME = r'("(?:\\.|[^"\\])*")\s*:|"(?:\\.|[^"\\])*"'


def has_duplicate_keys(json: Column) -> Column:
    """True when any object of a JSON text repeats a key, at whatever depth; null when the text is no object.

    One walk over the keys and braces numbers the objects and keeps the open ones on a stack; a key belongs to the
    innermost. Keys are compared as the text they stand for, so an escaped spelling is the same key. Texts without escapes or
    control characters whose keys all differ as they are written repeat none in any object, and are not walked.
    """
    names = F.array_remove(F.regexp_extract_all(json, F.lit(KEY_NAME), F.lit(1)), "")
    differ = ~json.rlike(r"[\\\x00-\x1F]") & (F.size(names) == F.size(F.array_distinct(names)))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("count"), F.array().cast("array<struct<of:int,key:string>>").alias("keys"))

    def step(state: Column, token: Column) -> Column:
        opens, closes, key = token == "{", token == "}", F.endswith(token, F.lit(":"))
        inner = F.when(opens, F.array_append(state["open"], state["count"])).when(closes & (F.size(state["open"]) > 0), F.slice(state["open"], 1, F.size(state["open"]) - 1)).otherwise(state["open"])
        name = F.try_element_at(F.from_json(F.concat(F.lit("["), F.regexp_replace(token, r"\s*:$", ""), F.lit("]")), "array<string>"), F.lit(1))
        found = F.struct(F.try_element_at(state["open"], F.lit(-1)).alias("of"), name.alias("key"))
        return F.struct(inner.alias("open"), F.when(opens, state["count"] + 1).otherwise(state["count"]).alias("count"), F.when(key, F.array_append(state["keys"], found)).otherwise(state["keys"]).alias("keys"))

    repeated = F.aggregate(F.regexp_extract_all(json, F.lit(KEY_OR_BRACE), F.lit(0)), start, step, lambda s: F.size(s["keys"]) != F.size(F.array_distinct(s["keys"])))
    return F.when(json.rlike(r"^\s*\{"), F.when(differ, F.lit(False)).otherwise(repeated))


# Fixed value: bare tokens that strict JSON does not allow as values.
NONFINITE_PATTERN = r'[:\[,]\s*-?(NaN|Infinity)\b'


def has_nonfinite(json: Column) -> Column:
    """True when NaN or Infinity stands outside quoted text."""
    unquoted = F.regexp_replace(json, r'"(\\.|[^"\\])*"', '""')
    numbers = F.regexp_extract_all(unquoted, F.lit(r"-?\d+(\.\d+)?([eE][+-]?\d+)?"), F.lit(0))
    too_large = F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")))
    return unquoted.rlike(NONFINITE_PATTERN) | too_large


def one_value(json: Column) -> Column:
    """The text as a variant, null unless it is exactly one JSON value: inside brackets, whatever follows the value
    is a fault or a second member."""
    listed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


CONDITION_JSON = "field STRING, op STRING, value STRING"


def rule_json(rule: str = "") -> Column:
    """Strict rule JSON with keys in name order and compact separators."""
    p = f"{rule}." if rule else ""
    condition = F.transform(
        F.col(f"{p}pattern.conditions"),
        lambda c: F.concat(
            F.lit('{"field":'),
            _quoted(c["field"]),
            F.lit(',"op":'),
            _quoted(c["op"]),
            F.lit(',"value":'),
            F.coalesce(c["value_num"].cast("string"), c["value_bool"].cast("string"), _quoted(c["value_str"]), F.lit("null")),
            F.lit("}"),
        ),
    )
    text = lambda name: F.coalesce(_quoted(F.col(f"{p}{name}")), F.lit("null"))
    plain = lambda name: F.coalesce(F.col(f"{p}{name}").cast("string"), F.lit("null"))
    return F.concat(
        F.lit('{"action":'), text("action"),
        F.lit(',"confidence":'), plain("confidence"),
        F.lit(',"pattern":{"conditions":['), F.array_join(condition, ","),
        F.lit('],"kind":'), text("pattern.kind"),
        F.lit(',"window_s":'), plain("pattern.window_s"),
        F.lit('},"reversible":'), plain("reversible"),
        F.lit(',"rule_id":'), text("rule_id"),
        F.lit(',"scope":{"alarm_code":'), plain("scope.alarm_code"),
        F.lit(',"signal":'), text("scope.signal"),
        F.lit(',"turbine_id":'), text("scope.turbine_id"),
        F.lit('},"taught_at":'), text("taught_at"),
        F.lit(',"taught_by":'), text("taught_by"),
        F.lit(',"utterance":'), text("utterance"),
        F.lit("}"),
    )


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), array.substr(F.lit(2), F.length(array) - 2))
