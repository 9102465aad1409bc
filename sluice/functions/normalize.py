"""Normalisers of locations, salaries, skills and model output, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import answers, fixed
from sluice.functions.text import blank_to_null, let, squeeze, strip


def mapping(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def location(raw: Column) -> Column:
    """struct(city, state, country, is_remote, original_text): at most three comma parts; known cities fill state and country."""
    text = strip(raw)
    parts = F.transform(F.split(text, ","), strip)
    city, state, country = (blank_to_null(F.get(parts, F.lit(i))) for i in range(3))
    home = F.try_element_at(mapping(fixed.CITIES), F.lower(city))
    full = F.struct(
        city.alias("city"),
        F.coalesce(F.try_element_at(mapping(fixed.STATES), F.upper(state)), state, home).alias("state"),
        F.coalesce(country, F.when(home.isNotNull(), fixed.COUNTRY)).alias("country"),
        F.coalesce(text.rlike("(?iu)" + fixed.REMOTE), F.lit(False)).alias("is_remote"),
        text.alias("original_text"),
    )
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("city"), none.alias("state"), none.alias("country"), F.lit(False).alias("is_remote"), raw.alias("original_text"))
    return F.when(F.length(text) > 0, full).otherwise(empty)


def location_display(loc: Column) -> Column:
    base = F.concat_ws(", ", loc["city"], loc["state"], loc["country"])
    return F.when(loc["is_remote"] & (F.length(base) > 0), F.concat(F.lit("Remote — "), base)).when(loc["is_remote"], "Remote").when(F.length(base) > 0, base).otherwise(F.coalesce(loc["original_text"], F.lit("")))


def _amount(token: Column, unit: Column) -> Column:
    """Number in a token times its own unit, else the unit of the whole text."""
    number = F.regexp_replace(F.regexp_extract(token, "(?iu)" + fixed.AMOUNT, 1), ",", "").try_cast("double")
    own = blank_to_null(F.regexp_extract(token, "(?iu)" + fixed.AMOUNT, 2))
    name = F.regexp_replace(F.lower(F.coalesce(own, unit, F.lit(""))), "s+$", "")
    factor = F.create_map(*[F.lit(x) for kv in fixed.UNIT_VALUE.items() for x in kv])
    return number * F.coalesce(F.try_element_at(factor, name), F.lit(1.0))


def salary(raw: Column) -> Column:
    """struct(currency, min_amount, max_amount, period, annual_inr, original_text) of a salary text; the currency is always INR. Each step is computed once: spelled out in every column, the steps outgrow compiled code."""

    def parts(text: Column) -> Column:
        period = F.when(text.rlike("(?iu)" + fixed.ANNUAL), "annual").when(text.rlike("(?iu)" + fixed.MONTHLY), "monthly").when(text.rlike("(?iu)" + fixed.HOURLY), "hourly")
        unit = blank_to_null(F.lower(F.regexp_extract(text, "(?iu)" + fixed.UNIT, 1)))
        bare = strip(F.regexp_replace(F.regexp_replace(text, "[₹$€£]", ""), "(?iu)" + fixed.SALARY_NOISE, " "))
        return F.struct(text.alias("text"), period.alias("period"), unit.alias("unit"), bare.alias("bare"), F.transform(F.split(bare, "(?iu)" + fixed.RANGE, 2), strip).alias("ends"))

    def amounts(p: Column) -> Column:
        is_range = (F.size(p["ends"]) == 2) & (F.length(F.get(p["ends"], F.lit(1))) > 0)
        low = _amount(F.when(is_range, F.get(p["ends"], F.lit(0))).otherwise(p["bare"]), p["unit"])
        high = F.when(is_range, _amount(F.get(p["ends"], F.lit(1)), p["unit"]))
        return F.struct(p["text"].alias("text"), p["period"].alias("period"), low.alias("low"), high.alias("high"))

    def out(p: Column) -> Column:
        some = F.length(p["text"]) > 0
        annual = F.when(p["period"] == "annual", p["low"]).when(p["period"] == "monthly", p["low"] * 12)
        return F.struct(
            F.when(some, "INR").alias("currency"), F.when(some, p["low"]).alias("min_amount"), F.when(some, p["high"]).alias("max_amount"), F.when(some, p["period"]).alias("period"), F.when(some, annual).alias("annual_inr"),
            F.when(some, p["text"]).otherwise(raw).alias("original_text"),
        )

    return let(strip(raw), lambda text: let(parts(text), lambda p: let(amounts(p), out)))


def clean_skill(raw: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(strip(raw)), r"(?U)[^\w\s.#+\-/]", " "))


def skills(raw: Column) -> Column:
    """array(struct(canonical, original, alias)): blank entries dropped, aliases resolved, the first of equal names kept."""
    known = mapping(fixed.SKILLS)
    named = F.transform(
        F.filter(F.transform(raw, strip), lambda x: F.length(x) > 0),
        lambda x: F.struct(F.coalesce(F.try_element_at(known, clean_skill(x)), x).alias("canonical"), x.alias("original")),
    )
    none = F.array().cast("array<struct<canonical:string,original:string>>")
    first = F.aggregate(named, none, lambda have, x: F.when(F.exists(have, lambda y: F.lower(y["canonical"]) == F.lower(x["canonical"])), have).otherwise(F.array_append(have, x)))
    return F.transform(first, lambda x: F.struct(x["canonical"].alias("canonical"), x["original"].alias("original"), F.when(F.lower(x["original"]) != F.lower(x["canonical"]), x["original"]).alias("alias")))


def distinct_skills(df: DataFrame, key: str, raw: Column) -> DataFrame:
    """(key, pos, canonical, original, alias): what ``skills`` keeps of each row's entries, one row each; an aggregate by name, for long arrays. pos counts distinct entries."""
    each = df.select(key, F.posexplode(F.array_distinct(raw)).alias("pos", "_raw")).select(key, "pos", strip(F.col("_raw")).alias("original")).where(F.length("original") > 0)
    known = df.sparkSession.createDataFrame(list(fixed.SKILLS.items()), "_clean string, _known string")  # a fixed table of names
    named = each.withColumn("_clean", clean_skill(F.col("original"))).join(F.broadcast(known), "_clean", "left").withColumn("canonical", F.coalesce("_known", "original"))
    first = named.groupBy(key, F.lower("canonical").alias("_name")).agg(F.min_by(F.struct("pos", "canonical", "original"), "pos").alias("s"))
    return first.select(key, "s.*", F.when(F.lower("s.original") != F.lower("s.canonical"), F.col("s.original")).alias("alias"))


def skill_names(df: DataFrame, key: str, raw: Column) -> DataFrame:
    """(key, names, first): per key, the distinct lower-cased names of its rows' entries as ``skills`` gives them, and the canonical name of the first entry.

    Entries are named inside their row, so that only a row's distinct names
    are shuffled, to meet those of further rows of its key. Keys without an
    entry have no row.
    """
    known = mapping(fixed.SKILLS)
    entries = F.filter(F.transform(F.array_distinct(raw), strip), lambda x: F.length(x) > 0)
    clean = lambda x: F.when(x.rlike(r"^[A-Za-z0-9_.#+\-/]+$"), F.lower(x)).otherwise(clean_skill(x))  # noqa: E731  (the same, in one look at most entries)
    named = F.transform(entries, lambda x: F.coalesce(F.try_element_at(known, clean(x)), x))
    row = df.select(key, let(named, lambda n: F.struct(F.array_distinct(F.transform(n, F.lower)).alias("names"), F.get(n, F.lit(0)).alias("first"))).alias("s"))
    rows = row.select(key, "s.*").where("first is not null").repartition(key)
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.min("first").alias("first"))


def employment_type(x: Column) -> Column:
    v = F.lower(strip(x))
    return F.when(v.isin("fulltime", "full time"), "full-time").when(v.isin("parttime", "part time"), "part-time").otherwise(v)


def work_mode(x: Column) -> Column:
    v = F.lower(strip(x))
    return F.when(v.isin("wfh", "work from home"), "remote").otherwise(v)


#: Fields that a model may return; anything else in its answer is ignored.
LLM_SCHEMA = answers.SCHEMA


def llm_output(raw: Column, schema: str = LLM_SCHEMA) -> Column:
    """Model answer as a struct: code fences removed, unknown keys ignored, bad JSON whole in ``corrupt``."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
