"""Answers of a model against the fields that it may return: what is wrong with each, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.text import let

#: The fields of an answer and their kinds. All may be missing or null; other keys are ignored.
FIELDS = {
    "title": "string", "company_name": "string", "location": "string", "employment_type": "any", "work_mode": "any", "experience_min_years": "int", "experience_max_years": "int", "salary_raw": "string", "salary_currency": "string",
    "salary_min": "number", "salary_max": "number", "salary_period": "string", "required_skills": "list", "preferred_skills": "list", "responsibilities": "list", "description_summary": "string", "benefits": "list", "posted_date": "string",
    "apply_url": "string", "apply_email": "string", "seniority": "string",
}
EXPECTED = {"string": "a string", "int": "a whole number", "number": "a number", "list": "a list of strings"}
NOT_AN_OBJECT = "not an object"
_SQL = {"string": "string", "any": "string", "int": "int", "number": "double", "list": "array<string>"}
#: Schema of an answer that has no errors.
SCHEMA = ", ".join(f"{f} {_SQL[k]}" for f, k in FIELDS.items()) + ", corrupt string"
INT_TEXT, NUMBER_TEXT = r"^\s*[+-]?\d+(\.0+)?\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _clean(value: object, kind: str) -> object:
    """``value`` as its kind; ValueError if it is none."""
    if kind == "any":
        return value if isinstance(value, str) else str(value)
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "list" and isinstance(value, list) and all(isinstance(x, str) for x in value):
        return value
    if kind in ("int", "number"):
        if isinstance(value, str) and re.search(INT_TEXT if kind == "int" else NUMBER_TEXT, value):
            value = float(value)
        if isinstance(value, (bool, int, float)) and (kind == "number" or value == int(value)):
            return float(value) if kind == "number" else int(value)
    raise ValueError(kind)


def check(value: object) -> tuple[dict | None, list[str]]:
    """The answer with its known fields in their kinds, and what is wrong with it, field by field; numbers may be written as text."""
    if not isinstance(value, dict):
        return None, [NOT_AN_OBJECT]
    out, errors = {}, []
    for f, kind in FIELDS.items():
        if value.get(f) is not None:
            try:
                out[f] = _clean(value[f], kind)
            except (ValueError, OverflowError):
                errors.append(f"{f}: not {EXPECTED[kind]}")
    return (None if errors else out), errors


def _entry(f: str, kind: str) -> Callable[[Column], Column]:
    """What is wrong with the value of a field, null if nothing is."""

    def entry(value: Column) -> Column:
        is_, as_ = F.schema_of_variant(value), lambda t: F.try_variant_get(value, "$", t)
        number = is_.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | is_.startswith("DECIMAL")
        if kind == "string":
            right = is_ == "STRING"
        elif kind == "list":
            right = (is_ == "ARRAY<VOID>") & (F.size(as_("array<string>")) == 0) | (is_ == "ARRAY<STRING>") & ~F.exists(as_("array<string>"), lambda x: x.isNull())
        elif kind == "int":
            right = number & (as_("double") == F.floor(as_("double"))) | (is_ == "STRING") & as_("string").rlike(INT_TEXT)
        else:
            right = number | (is_ == "STRING") & as_("string").rlike(NUMBER_TEXT)
        return F.when(is_.isNotNull() & (is_ != "VOID") & ~right, F.lit(f"{f}: not {EXPECTED[kind]}"))

    return entry


def _wrong(answer: Column) -> Column:
    """One entry or null for each field of a parsed answer."""
    found = []
    for f, kind in FIELDS.items():
        if kind == "any":
            continue
        found.append(let(F.try_variant_get(answer, f"$.{f}", "variant"), _entry(f, kind)))
    return F.array_compact(F.array(*found))


def errors(raw: Column) -> Column:
    """The same list for a column of JSON texts, empty where an answer is right; what is no JSON or no object has one entry. A text is parsed once."""

    def of(answer: Column) -> Column:
        bad = ~F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False))
        return F.when(bad, F.array(F.lit(NOT_AN_OBJECT))).otherwise(_wrong(answer))

    return let(F.try_parse_json(raw), of)
