"""Prompt table (C13), nested response JSON (K7, P28) and typed-result
validation (V1-V6).

The reference hands prompts to a remote model and lets a schema library
reject bad replies one at a time. Here prompts are a column and replies are
validated as a table: parse once into a variant, test the JSON type of every
field, and list error codes with native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens.functions.text import default_if_blank
from filinglens.operators.joins import spread
from filinglens.options import DECISIONS, DISCLAIMER_DEFAULT, GOAL_DEFAULT, THESIS_DEFAULT
from filinglens.templates import DECISION_PROMPT_PREFIX, INSIGHTS_PROMPT_TEMPLATE

PLACEHOLDERS = ("{ticker}", "{thesis}", "{goal}")


def _template_parts(template: str) -> list[str]:
    parts, rest = [], template
    for ph in PLACEHOLDERS:
        head, rest = rest.split(ph, 1)
        parts.append(head)
    parts.append(rest)
    return parts


def insights_prompt(ticker: Column, thesis: Column, goal: Column) -> Column:
    """Fill the report template in one pass (a value containing a
    placeholder is not substituted again). Null or empty thesis/goal get the
    defaults."""
    p = _template_parts(INSIGHTS_PROMPT_TEMPLATE)
    return F.concat(
        F.lit(p[0]), ticker,
        F.lit(p[1]), default_if_blank(thesis, THESIS_DEFAULT),
        F.lit(p[2]), default_if_blank(goal, GOAL_DEFAULT),
        F.lit(p[3]),
    )


def prompt_table(requests: DataFrame, ticker_col: str = "ticker_norm", thesis_col: str = "thesis", goal_col: str = "goal") -> DataFrame:
    cols = set(requests.columns)
    thesis = F.col(thesis_col) if thesis_col in cols else F.lit(None).cast("string")
    goal = F.col(goal_col) if goal_col in cols else F.lit(None).cast("string")
    return requests.withColumn("prompt", insights_prompt(F.col(ticker_col), thesis, goal))


# ---------------------------------------------------------------------------
# Nested result record and JSON response
# ---------------------------------------------------------------------------


def filing_metadata_struct() -> Column:
    return F.struct(
        F.col("ticker"), F.col("cik"), F.col("company_name"), F.col("form_type"), F.col("filing_date"),
        F.col("period_of_report"), F.col("accession_number"), F.col("primary_document"),
        F.lit(None).cast("string").alias("xbrl_instance_document"),
    )


def insights_struct(sector: Column, summary: Column) -> Column:
    """The report record with every field present (defaults where the data
    has nothing to say): nested structs, arrays of structs and maps."""
    empty_map = F.create_map().cast("map<string,double>")
    return F.struct(
        F.struct(
            F.col("company_name").alias("name"), F.col("ticker"), F.col("cik"), sector.alias("sector"),
            F.lit(None).cast("string").alias("industry"),
        ).alias("company_profile"),
        filing_metadata_struct().alias("filing_metadata"),
        summary.alias("high_level_summary"),
        F.struct(empty_map.alias("key_metrics"), F.lit("").alias("narrative")).alias("financial_summary"),
        F.array().cast("array<struct<title:string,description:string,changed_since_prior:boolean>>").alias("risk_summary"),
        F.array().cast("array<struct<category:string,summary:string>>").alias("notable_events"),
        F.struct(F.lit("").alias("narrative"), empty_map.alias("leverage_metrics")).alias("liquidity_and_capital_structure"),
        F.struct(F.lit("").alias("narrative"), F.lit(None).cast("string").alias("time_horizon")).alias("guidance_and_outlook"),
        F.array().cast("array<string>").alias("open_questions"),
    )


def to_json_keep_nulls(col: Column) -> Column:
    return F.to_json(col, {"ignoreNullFields": "false"})


def decision_prompt(insights_json: Column) -> Column:
    return F.concat(F.lit(DECISION_PROMPT_PREFIX), insights_json)


# ---------------------------------------------------------------------------
# Record validation: every field's JSON type, nested records included
# ---------------------------------------------------------------------------

# Fields of the records as (path, kind, required). A kind that
# ends in "?" takes null. Numbers may come as numeric text or booleans, and
# booleans as 0, 1 or the usual words, as a lax reader takes them.
DECISION_FIELDS = (
    ("decision", "str", True),
    ("confidence", "float", True),
    ("time_horizon", "str", True),
    ("positives", "list[str]", True),
    ("negatives", "list[str]", True),
    ("uncertainties", "list[str]", True),
    ("risk_profile", "str", True),
    ("disclaimer", "str", False),
)
INSIGHTS_FIELDS = (
    ("company_profile", "record", True),
    ("company_profile.name", "str", True),
    ("company_profile.ticker", "str", True),
    ("company_profile.cik", "str", True),
    ("company_profile.sector", "str?", False),
    ("company_profile.industry", "str?", False),
    ("filing_metadata", "record", True),
    ("filing_metadata.ticker", "str", True),
    ("filing_metadata.cik", "str", True),
    ("filing_metadata.company_name", "str", True),
    ("filing_metadata.form_type", "str", True),
    ("filing_metadata.filing_date", "date", True),
    ("filing_metadata.period_of_report", "date?", True),
    ("filing_metadata.accession_number", "str", True),
    ("filing_metadata.primary_document", "str", True),
    ("filing_metadata.xbrl_instance_document", "str?", False),
    ("high_level_summary", "str", True),
    ("financial_summary", "record", True),
    ("financial_summary.key_metrics", "map[float]", False),
    ("financial_summary.narrative", "str", False),
    ("risk_summary", "list[record]", False),
    ("notable_events", "list[record]", False),
    ("liquidity_and_capital_structure", "record", True),
    ("liquidity_and_capital_structure.narrative", "str", True),
    ("liquidity_and_capital_structure.leverage_metrics", "map[float]", False),
    ("guidance_and_outlook", "record", True),
    ("guidance_and_outlook.narrative", "str", True),
    ("guidance_and_outlook.time_horizon", "str?", False),
    ("open_questions", "list[str]", False),
)
INSIGHTS_ITEMS = {
    "risk_summary": (("title", "str", True), ("description", "str", True), ("changed_since_prior", "bool", False)),
    "notable_events": (("category", "str", True), ("summary", "str", True)),
}
BOOL_WORDS = ("true", "t", "yes", "y", "on", "1", "false", "f", "no", "n", "off", "0")
_NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _shape(v: Column) -> Column:
    """JSON type name of a value; a JSON null is VOID, an absent one null."""
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _shape(v).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")


def _is_kind(v: Column, kind: str) -> Column:
    """Does a present value have this kind?"""
    text = F.when(_shape(v) == "STRING", _at(v, "", "string"))
    if kind.endswith("?"):
        return (_shape(v) == "VOID") | _is_kind(v, kind[:-1])
    if kind == "str":
        ok = _shape(v) == "STRING"
    elif kind == "float":
        ok = _is_number(v) | (_shape(v) == "BOOLEAN") | F.coalesce(text.rlike(_NUMBER_TEXT), F.lit(False))
    elif kind == "bool":
        number = F.when(_is_number(v), _at(v, "", "double"))
        ok = (_shape(v) == "BOOLEAN") | F.coalesce(number.isin(0.0, 1.0), F.lower(text).isin(*BOOL_WORDS))
    elif kind == "date":
        ok = text.rlike(_DATE_TEXT) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    elif kind == "record":
        ok = _shape(v).startswith("OBJECT")
    elif kind == "list[str]":
        ok = F.forall(_at(v, "", "array<variant>"), lambda x: _shape(x) == "STRING")
    elif kind == "list[record]":
        ok = _at(v, "", "array<variant>").isNotNull()
    elif kind == "map[float]":
        ok = F.forall(F.map_values(_at(v, "", "map<string,variant>")), lambda x: _is_kind(x, "float"))
    else:
        raise ValueError(kind)
    return F.coalesce(ok, F.lit(False))


def _field_error(v: Column, path: str, kind: str, required: bool) -> Column:
    """``missing:`` or ``type:`` code of one field; a field of an absent or
    wrong parent has none (the parent has)."""
    f = _at(v, path)
    out = F.when(f.isNotNull() & ~_is_kind(f, kind), F.lit(f"type:{path}"))
    if required:
        parent, _, _ = path.rpartition(".")
        absent = f.isNull() & _shape(_at(v, parent) if parent else v).startswith("OBJECT")
        out = F.when(absent, F.lit(f"missing:{path}")).otherwise(out)
    return out


def _item_error(v: Column, path: str, fields) -> Column:
    """``item:`` code of a list of records with a wrong item."""

    def wrong(x):
        bad = ~_is_kind(x, "record")
        for name, kind, required in fields:
            bad = bad | _field_error(x, name, kind, required).isNotNull()
        return bad

    return F.when(F.exists(_at(v, path, "array<variant>"), wrong), F.lit(f"item:{path}"))


def _parsed(df: DataFrame, json_col: str) -> DataFrame:
    return spread(df).withColumn("_v", F.try_parse_json(F.col(json_col)))


def _errors(checks: list[Column]) -> Column:
    """``malformed`` (not JSON), ``type:record`` (JSON, but no object), or the
    codes of all checks in order."""
    v = F.col("_v")
    return (
        F.when(v.isNull(), F.array(F.lit("malformed")))
        .when(~_is_kind(v, "record"), F.array(F.lit("type:record")))
        .otherwise(F.array_compact(F.array(*checks)))
    )


def _text(path: str) -> Column:
    v = _at(F.col("_v"), path)
    return F.when(_shape(v) == "STRING", _at(v, "", "string"))


def _length(path: str) -> Column:
    return F.coalesce(F.size(_at(F.col("_v"), path, "array<variant>")), F.lit(0))


def validate_decisions(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse decision records and list what is wrong with each.

    Codes, in order: ``malformed`` or ``type:record`` (nothing else is
    checked), ``missing:<field>`` and ``type:<field>`` per field,
    ``enum:decision`` (text, but not buy/sell/hold), ``range:confidence``
    (outside [0, 1]). An explicit null is a wrong type; an absent disclaimer
    gets its default.
    """
    v = F.col("_v")
    conf = _at(v, "confidence")
    number = (
        F.when(_shape(conf) == "STRING", _at(conf, "", "string").try_cast("double"))
        .when(_shape(conf) == "BOOLEAN", _at(conf, "", "boolean").cast("double"))
        .otherwise(_at(conf, "", "double"))
    )
    confidence = F.when(_is_kind(conf, "float"), number)
    checks = [_field_error(v, *f) for f in DECISION_FIELDS]
    checks += [
        F.when(~_text("decision").isin(*DECISIONS), F.lit("enum:decision")),
        F.when(~confidence.between(0.0, 1.0), F.lit("range:confidence")),
    ]
    return _parsed(df, json_col).withColumn("_e", _errors(checks)).select(
        *df.columns,
        F.array_join("_e", ",").alias("errors"),
        (F.size("_e") == 0).alias("valid"),
        _text("decision").alias("decision"),
        confidence.alias("confidence"),
        F.coalesce(_text("disclaimer"), F.lit(DISCLAIMER_DEFAULT)).alias("disclaimer"),
        _length("positives").alias("n_positives"),
    )


def validate_insights(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse insights records (nested records, lists of records, maps) and
    list what is wrong with each.

    Codes, in order: ``malformed`` or ``type:record`` (nothing else is
    checked), then per field ``missing:<path>`` or ``type:<path>``, then
    ``item:<path>`` for a list of records with a wrong item. Dates are ISO
    text. Fields the record does not name are ignored.
    """
    v = F.col("_v")
    checks = [_field_error(v, *f) for f in INSIGHTS_FIELDS]
    checks += [_item_error(v, path, fields) for path, fields in INSIGHTS_ITEMS.items()]
    return _parsed(df, json_col).withColumn("_e", _errors(checks)).select(
        *df.columns,
        F.array_join("_e", ",").alias("errors"),
        (F.size("_e") == 0).alias("valid"),
        _text("company_profile.name").alias("company_name"),
        _text("high_level_summary").alias("high_level_summary"),
        _length("risk_summary").alias("n_risks"),
        _length("open_questions").alias("n_questions"),
    )
