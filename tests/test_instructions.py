"""Operator sentences: accepted rules and rejection reasons."""

import pytest

from alarmlake.operators.instructions import propose_rules
from alarmlake.operators.vocabulary import aliases

CODES = [
    (10105, "Stopped, untwisting cables"),
    (20, "Large generator Cut-in"),
    (8230, "Ice detection: Low torque"),
    (1005, "Availability - low wind"),
    (3130, "Pitch lubrication"),
    (8000, "Windspeed too high to operate"),
    (25, "Fast cut-out of generator"),
    (999, "(undocumented)"),
]
LABELS = [("2304513", "T04"), ("2304514", "T21"), ("2304515", "T20")]

ACCEPTED = {
    "ignore the cable untwist alarm on turbine four": ("suppress", 10105, "2304513"),
    "generator cut-in is just the wind changing, stop showing me those": ("suppress", 20, None),
    "when it is icing give me one line per turbine not six": ("collapse", 8230, None),
    "mute the low wind alarm on T04": ("suppress", 1005, "2304513"),
    "group the pitch lubrication alarm on turbine 4": ("collapse", 3130, "2304513"),
    "always tell me about high wind on number four": ("escalate", 8000, "2304513"),
    "don't ignore generator cut-in on turbine four": ("escalate", 20, "2304513"),
    "don’t ignore generator cut-in on turbine four": ("escalate", 20, "2304513"),
    "ignore fast cut-out of generator on T04": ("suppress", 25, "2304513"),
    "ignore alarm code 999 on station 2304513": ("suppress", 999, "2304513"),
    "mute low wind on turbine twenty one": ("suppress", 1005, "2304514"),
    "mute low wind on turbine twenty": ("suppress", 1005, "2304515"),
    "MUTE THE LOW WIND ALARM ON Ｔ04": ("suppress", 1005, "2304513"),
}
REJECTED = {
    "never suppress the generator winding temperature alarms": "no_matching_alarm",
    "what is the weather like": "missing_intent",
    "ignore low wind on turbine 99": "ambiguous_reference",
    "ignore low wind on turbine four and 5": "ambiguous_reference",
    "ignore low wind on T04 and T21": "ambiguous_reference",
    "ignore low wind on turbine twenty two": "ambiguous_reference",
    "ignore alarm code 4242": "ambiguous_reference",
    "ignore alarm code 20 and 25": "ambiguous_reference",
    "ignore low wind and high wind": "ambiguous_reference",
    "ignore low wind at night": "unsupported_restriction",
    "ignore low wind for 5 minutes": "unsupported_restriction",
    "ignore low wind without ice": "unsupported_restriction",
    "low wind on T04": "missing_intent",
    "ignore and always tell me about low wind": "missing_intent",
    "ignore the coffee machine": "no_matching_alarm",
    "   ": "invalid_input",
    "x" * 4001: "invalid_input",
}


@pytest.fixture(scope="module")
def proposed(spark):
    texts = list(ACCEPTED) + list(REJECTED)
    codes = spark.createDataFrame(CODES, "alarm_code bigint, description string")
    labels = spark.createDataFrame(LABELS, "turbine_id string, label string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = propose_rules(rows, codes, aliases(labels), labels.select("turbine_id")).collect()
    return {texts[r.id]: r for r in out}


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(proposed, text):
    row = proposed[text]
    assert (row.reason, row.action, row.alarm_code, row.turbine_id) == (None, *ACCEPTED[text])
    assert row.window_s == (60 if row.action == "collapse" else 0)


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(proposed, text):
    row = proposed[text]
    assert row.reason == REJECTED[text] and row.action is None
