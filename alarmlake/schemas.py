"""Canonical table types as DDL text. Timestamps are timezone-naive UTC (TIMESTAMP_NTZ)."""

from __future__ import annotations

# Column and field names of the tables, rules and journal lines.
ALARM_COLUMNS = ["ts", "turbine_id", "alarm_code", "description", "stopping"]
SCADA_COLUMNS = ["ts", "turbine_id", "signal", "value"]
ALARM_KEY = ["ts", "turbine_id", "alarm_code"]

ALARM = (
    "ts TIMESTAMP_NTZ, turbine_id STRING, alarm_code BIGINT, description STRING, stopping INT"
)
SCADA = "ts TIMESTAMP_NTZ, turbine_id STRING, signal STRING, value DOUBLE"
EVENT = (
    "seq BIGINT, ts TIMESTAMP_NTZ, turbine_id STRING, alarm_code BIGINT, description STRING, stopping INT, "
    "signals MAP<STRING,DOUBLE>, features MAP<STRING,DOUBLE>, signal STRING, value DOUBLE, "
    "critical BOOLEAN, severity STRING"
)
CONDITION_DDL = (
    "STRUCT<field:STRING,op:STRING,value_num:DOUBLE,value_str:STRING,value_bool:BOOLEAN,value_null:BOOLEAN>"
)
RULE = (
    "rule_order BIGINT, rule_id STRING, utterance STRING, "
    "scope STRUCT<turbine_id:STRING,alarm_code:BIGINT,signal:STRING>, "
    f"pattern STRUCT<kind:STRING,window_s:BIGINT,conditions:ARRAY<{CONDITION_DDL}>>, "
    "action STRING, confidence DOUBLE, taught_by STRING, taught_at STRING, reversible BOOLEAN"
)
EXAMPLE_DDL = "STRUCT<features:MAP<STRING,DOUBLE>,label:INT,weight:DOUBLE>"
JOURNAL = (
    "line BIGINT, schema_version INT, op STRING, rule_id STRING, rule_json STRING, model_version BIGINT, "
    "learning_rate DOUBLE, nuisance_threshold DOUBLE, collapse_window_s BIGINT, "
    f"feature_encoding_version INT, examples ARRAY<{EXAMPLE_DDL}>"
)
