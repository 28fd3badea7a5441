"""Typed-result validation and prompt filling."""

from pyspark.sql import functions as F

from filinglens.operators.results import insights_prompt, validate_decisions, validate_insights
from filinglens.options import DISCLAIMER_DEFAULT, THESIS_DEFAULT

BASE = '"time_horizon":"6m","positives":[],"negatives":[],"uncertainties":[],"risk_profile":"low"'


def test_validation_codes(spark):
    rows = [
        (1, '{"decision":"buy","confidence":0.7,' + BASE + "}"),
        (2, '{"decision":"maybe","confidence":0.7,' + BASE + "}"),
        (3, '{"decision":"hold","confidence":1.4,' + BASE + "}"),
        (4, '{"decision":"sell","confidence":"high",' + BASE + "}"),
        (5, '{"confidence":0.2,' + BASE + "}"),
        (6, "not json"),
        (7, '{"decision":"buy","confidence":0.7,' + BASE + ',"disclaimer":"mine"}'),
    ]
    df = spark.createDataFrame(rows, "id int, json string")
    got = {r.id: (r.errors, r.valid, r.disclaimer) for r in validate_decisions(df).collect()}
    assert got[1] == ("", True, DISCLAIMER_DEFAULT)
    assert got[2][0] == "enum:decision"
    assert got[3][0] == "range:confidence"
    assert got[4][0] == "type:confidence"
    assert got[5][0] == "missing:decision"
    assert got[6][0] == "malformed"
    assert got[7][2] == "mine"


def test_wrong_types_are_reported(spark):
    good = {
        "decision": '"buy"', "confidence": "0.5", "time_horizon": '"6m"', "positives": "[]", "negatives": "[]",
        "uncertainties": "[]", "risk_profile": '"low"',
    }
    cases = [
        ({}, ""),
        ({"positives": '"oops"'}, "type:positives"),
        ({"positives": "[1,null]"}, "type:positives"),
        ({"positives": "[null]"}, "type:positives"),
        ({"time_horizon": "5"}, "type:time_horizon"),
        ({"disclaimer": "null"}, "type:disclaimer"),
        ({"risk_profile": "null"}, "type:risk_profile"),
        ({"confidence": '" 0.25 "'}, ""),
        ({"confidence": '"0.5d"'}, "type:confidence"),
        ({"confidence": "true"}, ""),
        ({"confidence": "[]"}, "type:confidence"),
        ({"confidence": '"7"'}, "range:confidence"),
        ({"decision": "3"}, "type:decision"),
    ]
    rows = [(i, "{" + ",".join(f'"{k}":{v}' for k, v in (good | c).items()) + "}") for i, (c, _) in enumerate(cases)]
    rows += [(90, "[1]"), (91, None), (92, "")]
    got = {r.id: r.errors for r in validate_decisions(spark.createDataFrame(rows, "id int, json string")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)} | {90: "type:record", 91: "malformed", 92: "malformed"}


def test_insights_without_parents(spark):
    df = spark.createDataFrame([(1, '{"risk_summary":[null,{"title":1}]}')], "id int, json string")
    assert validate_insights(df).first().errors == (
        "missing:company_profile,missing:filing_metadata,missing:high_level_summary,missing:financial_summary,"
        "missing:liquidity_and_capital_structure,missing:guidance_and_outlook,item:risk_summary"
    )


def test_prompt_defaults(spark):
    df = spark.createDataFrame([("AAPL", None), ("MSFT", ""), ("X", "{goal} stays")], "t string, th string")
    out = [r.p for r in df.select(insights_prompt(F.col("t"), F.col("th"), F.lit(None).cast("string")).alias("p")).collect()]
    assert "Stock Ticker / Company Name: AAPL" in out[0] and THESIS_DEFAULT in out[0]
    assert THESIS_DEFAULT in out[1]
    assert "Investment Thesis: {goal} stays" in out[2]
