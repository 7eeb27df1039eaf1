"""Canonical alarm and sensor tables derived from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlake.operators.lookup import with_code_labels
from alarmlake.plans.segments import dense_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def station_of(user: str = "user_id", stations: int = 27) -> Column:
    return (F.col(user) % stations).cast("string")


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size <= 35")  # larger sizes have no documentation
    return part.select(
        F.col("p_partkey").cast("bigint").alias("alarm_code"),
        F.concat(F.trim("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("description"),
        (F.col("p_size") % 2).cast("int").alias("stopping"),
    )


def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("station_id"),
        F.concat(F.lit("T"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("turbine_name"),
    )


def raw_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", station_of().alias("turbine_id"), code_of().alias("alarm_code")
    )


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_code_labels(raw_alarms(spark, sf_dir), code_lookup(spark, sf_dir))


def alarms_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = alarms(spark, sf_dir)
    return base.unionByName(base.where(F.col("seq") % 29 == 0))


def scada_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        station_of().alias("turbine_id"),
        F.col("event_type").alias("signal"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
    )


def scada_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor rows on day boundaries with repeated (ts, station, signal) readings."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
        station_of().alias("turbine_id"),
        F.col("event_type").alias("signal"),
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
    )


def scada_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_suppkey") % 27).cast("string").alias("turbine_id"),
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        "l_tax",
    )


def raw_alarm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw monthly alarm rows as text: start, nullable end, station, code."""
    line = table(spark, sf_dir, "lineitem")
    start = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.date_format(F.expr("l_shipdate + make_dt_interval(0, 0, CAST(l_quantity AS INT), 0)"), "yyyy-MM-dd'T'HH:mm:ss")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        start.alias("TimeOn"),
        F.when(F.col("l_returnflag") != "N", end).alias("TimeOff"),
        (F.col("l_suppkey") % 27).cast("string").alias("StationNr"),
        F.col("l_partkey").cast("string").alias("Alarmcode"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm events carrying one measurement, a feature map and severity marks."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        "ts",
        station_of().alias("turbine_id"),
        code_of().alias("alarm_code"),
        F.col("event_type").alias("signal"),
        "value",
        "user_id",
    )
    labelled = with_code_labels(events, code_lookup(spark, sf_dir))
    sensor = F.col("user_id") % 10 == 9
    blank = lambda name, kind: F.when(~sensor, F.col(name)).cast(kind).alias(name)
    return labelled.select(
        "seq",
        "ts",
        "turbine_id",
        blank("alarm_code", "bigint"),
        blank("description", "string"),
        blank("stopping", "int"),
        F.create_map("signal", "value").alias("signals"),
        F.create_map(F.lit("load"), F.round(F.col("value") * 2, 2)).alias("features"),
        F.lit(None).cast("string").alias("signal"),
        F.lit(None).cast("double").alias("value"),
        (F.col("value") > 60).alias("critical"),
        F.when((F.col("user_id") % 37 == 5), F.lit("Emergency")).otherwise(F.col("signal")).alias("severity"),
    )


def sample_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part, in code order, covering every action and scope shape."""
    part = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 7
    station = (F.col("p_partkey") % 270).cast("string")  # rules name 270 stations; 27 of them report
    cond = lambda field, op, num: F.struct(
        F.lit(field).alias("field"),
        F.lit(op).alias("op"),
        F.lit(num).cast("double").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
        F.lit(None).cast("boolean").alias("value_bool"),
        F.lit(False).alias("value_null"),
    )
    none = F.array().cast("array<struct<field:string,op:string,value_num:double,value_str:string,value_bool:boolean,value_null:boolean>>")
    code = F.col("p_partkey").cast("bigint")
    return part.select(
        code.alias("rule_order"),
        F.concat(F.lit("r"), code.cast("string")).alias("rule_id"),
        F.concat(F.lit("rule for "), code.cast("string")).alias("utterance"),
        F.struct(
            F.when(kind.isin(1, 4, 6), station).alias("turbine_id"),
            F.when(kind != 6, code).alias("alarm_code"),
            F.when(kind == 6, F.lit("click")).alias("signal"),
        ).alias("scope"),
        F.struct(
            F.when(kind == 5, F.lit("learned")).when(kind.isin(3, 6), F.lit("conditions")).otherwise(F.lit("code_match")).alias("kind"),
            F.when(kind.isin(2, 4), F.lit(14400)).otherwise(F.lit(0)).cast("bigint").alias("window_s"),
            F.when(kind == 3, F.array(cond("features.load", "gte", 30.0)))
            .when(kind == 5, F.array(cond("load", "lt", 40.0)))
            .when(kind == 6, F.array(cond("signals.click", "lt", 5.0), cond("alarm_code", "ne", 7.0)))
            .otherwise(none)
            .alias("conditions"),
        ).alias("pattern"),
        F.when(kind.isin(2, 4), F.lit("collapse")).when(kind == 3, F.lit("escalate")).otherwise(F.lit("suppress")).alias("action"),
        F.round(F.lit(0.5) + (F.col("p_partkey") % 5) / 10.0, 2).alias("confidence"),
        F.lit("operator").alias("taught_by"),
        F.lit("2024-01-01T00:00:00+00:00").alias("taught_at"),
        (F.col("p_partkey") % 3 != 0).alias("reversible"),
    )


def sample_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal that teaches every sample rule in code order, then undoes some reversible ones."""
    rules = sample_rules(spark, sf_dir)
    taught = rules.withColumn("i", F.col("rule_order") + 1)  # part keys count from 0 without gaps
    count = rules.agg(F.count(F.lit(1))).scalar()
    undone = (
        dense_sequence(rules.where(F.col("reversible") & (F.col("rule_order") % 4 == 1)), [F.col("rule_order")], "i")
        .withColumn("i", F.col("i") + 1)
        .select((count * 2 + F.col("i")).alias("line"), F.lit("undo").alias("op"), "rule_id", (count + F.col("i") + 1).alias("model_version"))
    )
    example = lambda name, label: F.struct(
        F.create_map(F.concat(F.lit(name), F.col("rule_order").cast("string")), F.lit(1.0)).alias("features"),
        F.lit(label).alias("label"),
        F.lit(1.0).alias("weight"),
    )
    learn = taught.select(
        (F.col("i") * 2 - 1).cast("bigint").alias("line"), F.lit("learn").alias("op"), F.struct(*[c for c in rules.columns if c != "rule_order"]).alias("rule")
    )
    commit = taught.select(
        (F.col("i") * 2).cast("bigint").alias("line"),
        F.lit("commit").alias("op"),
        "rule_id",
        (F.col("i") + 1).cast("bigint").alias("model_version"),
        F.lit(0.1).alias("learning_rate"),
        F.lit(0.9).alias("nuisance_threshold"),
        F.lit(60).cast("bigint").alias("collapse_window_s"),
        F.lit(1).alias("feature_encoding_version"),
        F.array(example("code=", 1), example("entity=", 0)).alias("examples"),
    )
    return (
        learn.unionByName(commit, allowMissingColumns=True)
        .unionByName(undone, allowMissingColumns=True)
        .withColumn("schema_version", F.lit(1))
    )


def sample_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each journal revision was applied, spread evenly over the event history."""
    steps = sample_journal(spark, sf_dir).where("model_version IS NOT NULL")
    events, last = table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar(), steps.agg(F.max("model_version")).scalar()
    return steps.select(F.col("model_version").alias("version"), F.expr("model_version").cast("bigint").alias("_v")).select(
        "version", F.floor(F.col("_v") * events / last).cast("bigint").alias("applied_at")
    )
