"""Sparse feature maps for the classifier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from alarmlake.functions.text import strip


def soft_sign(value: Column) -> Column:
    return value / (F.lit(1.0) + F.abs(value))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _observed(values: Column) -> Column:
    """Map without null or NaN values; infinities and blank names raise."""
    empty = F.create_map().cast("map<string,double>")
    present = F.map_filter(F.coalesce(values, empty), lambda k, v: v.isNotNull() & ~F.isnan(v))
    bad = F.exists(F.map_entries(present), lambda e: (F.abs(e["value"]) == F.lit(float("inf"))) | (strip(e["key"]) == ""))
    return F.when(bad, F.raise_error(F.lit("feature names must be nonblank and values finite")).cast("map<string,double>")).otherwise(present)


def _merge(left: Column, right: Column) -> Column:
    """Union of two numeric maps; one name with two values raises."""
    clash = F.raise_error(F.lit("conflicting signal/feature values")).cast("double")
    return F.map_zip_with(
        left,
        right,
        lambda k, a, b: F.when(a.isNull(), b).when(b.isNull() | (a == b), a).otherwise(clash),
    )


def numeric_features() -> Column:
    """One numeric map from signals, features and the scalar signal/value pair."""
    scalar = F.when(
        F.col("signal").isNotNull() & F.col("value").isNotNull(), F.create_map("signal", "value")
    ).otherwise(F.create_map().cast("map<string,double>"))
    return _merge(_merge(_observed(F.col("signals")), _observed(F.col("features"))), _observed(scalar))


def encoded_features(numeric: Column) -> Column:
    """Categorical ids become indicator names, never magnitudes.

    Fixed values: feature name prefixes and the entity_code JSON layout.
    """
    one = F.lit(1.0)
    code = F.col("alarm_code").cast("string")
    pair = F.concat(F.lit("entity_code="), F.lit("["), F.to_json(F.array("turbine_id")).substr(F.lit(2), F.length(F.to_json(F.array("turbine_id"))) - 2), F.lit(","), code, F.lit("]"))
    coded = F.when(
        F.col("alarm_code").isNotNull(), F.create_map(F.concat(F.lit("code="), code), one, pair, one)
    ).otherwise(F.create_map().cast("map<string,double>"))
    channel = F.when(
        F.col("signal").isNotNull(), F.create_map(F.concat(F.lit("channel="), F.col("signal")), one)
    ).otherwise(F.create_map().cast("map<string,double>"))
    values = F.transform_keys(F.transform_values(numeric, lambda k, v: soft_sign(v)), lambda k, v: F.concat(F.lit("value="), k))
    present = F.transform_keys(F.transform_values(numeric, lambda k, v: one), lambda k, v: F.concat(F.lit("present="), k))
    return F.map_concat(F.create_map(F.concat(F.lit("entity="), F.col("turbine_id")), one), coded, values, present, channel)


def linear_score(features: Column, weight_of: Callable[[Column], Column], intercept: Column) -> Column:
    """intercept + sum of weight * value over the features the model knows."""
    terms = F.transform(F.map_entries(features), lambda e: e["value"] * F.coalesce(weight_of(e["key"]), F.lit(0.0)))
    return intercept + F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
