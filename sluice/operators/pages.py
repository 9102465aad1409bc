"""Fields of a raw page: clean text, sections, and evidence found by patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluice.functions import fixed
from sluice.functions.text import blank_to_null, first_match, let, strip

_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


class _Text(HTMLParser):
    """Text pieces outside the noise elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.noise: list[str] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in fixed.NOISE_TAGS or (self.noise and tag not in _VOID):
            self.noise.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.noise:
            while self.noise.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.pieces.append(data)


def clean_page(html: str | None) -> str | None:
    """Page text without noise elements: pieces on lines of their own, at most one empty line, single spaces."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(parser.pieces))
    return re.sub(r"[ \t]+", " ", text).strip()


def clean_html(html: Column) -> Column:
    """``clean_page`` of a string or binary column; bad UTF-8 is replaced."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: clean_page(x.decode("utf-8", "replace") if isinstance(x, (bytes, bytearray)) else x if isinstance(x, str) else None))

    return run(html)


def heading(line: Column) -> Column:
    """Label of the section that a stripped line opens, or null. One look with all patterns lets most lines pass."""
    tests = [F.when(line.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), label) for label, patterns in fixed.HEADINGS.items()]
    any_ = "(?iu)" + "|".join(f"(?:{p})" for patterns in fixed.HEADINGS.values() for p in patterns)
    return F.when((F.length(line) < fixed.HEADING_LENGTH) & line.rlike(any_), F.coalesce(*tests))


LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def blocks(text: Column) -> Column:
    """array(struct(block, label, text)) of a text's sections with text, in order; lines before the first heading are 'body'."""

    def cut(lines: Column) -> Column:
        found = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), let(strip(x), heading).alias("label"))), lambda x: x["label"].isNotNull())

        def between(starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1)["at"], F.size(lines))
                own = strip(F.array_join(F.slice(lines, s["at"] + 2, end - s["at"] - 1), "\n"))
                return F.struct(k.cast("long").alias("block"), s["label"].alias("label"), own.alias("text"))

            return F.filter(F.transform(starts, one), lambda b: b["text"] != "")

        return let(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("body").alias("label"))), found), between)

    return let(F.split(text, LINE_ENDS, -1), cut)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, label, text) of every section with text, in order; lines before the first heading are 'body'."""
    return df.select(key, F.explode(blocks(F.col(text))).alias("b")).select(key, "b.block", "b.label", "b.text")


def first_sections(found: Column) -> Column:
    """struct with the text of the first section of each label, from ``blocks``."""
    first = lambda k: F.get(F.filter(found, lambda b: b["label"] == k), F.lit(0))["text"]
    return F.struct(*[first(k).alias(k) for k in [*fixed.HEADINGS, "body"]])


def list_items(text: Column) -> Column:
    """Lines of a section without their bullets, longer than four characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(strip(x), fixed.BULLET, "")))
    return F.filter(lines, lambda x: F.length(x) > 4)


def title(page: Column) -> Column:
    lines = F.filter(F.transform(F.split(page, "\n"), strip), lambda x: F.length(x) > 0)
    fit = F.filter(F.slice(lines, 1, 10), lambda x: (F.length(x) > 3) & (F.length(x) < 120) & ~x.endswith(":") & ~x.rlike("(?i)" + fixed.NOT_TITLE))
    return F.get(fit, F.lit(0))


def _bounded(page: Column, pattern: str, low: int, high: int, flags: str) -> Column:
    found = strip(F.regexp_extract(F.substring(page, 1, 3000), flags + pattern, 1))
    return F.when((F.length(found) > low) & (F.length(found) < high), found)


def company(page: Column) -> Column:
    return F.coalesce(_bounded(page, fixed.COMPANY_LABEL, 2, 80, "(?iu)"), _bounded(page, fixed.COMPANY_AT, 2, 80, "(?iu)"))


def location(page: Column) -> Column:
    return F.coalesce(_bounded(page, fixed.LOCATION_LABEL, 2, 100, "(?iu)"), _bounded(page, fixed.LOCATION_CITY, 2, 100, "(?u)"))


def evidence(value: Column, section: str, confidence: float = 1.0) -> Column:
    """struct(value, original_text, source_section, confidence), null where nothing was found."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), value.alias("original_text"), F.lit(section).alias("source_section"), F.lit(confidence).alias("confidence")))


def fields(page: Column, sec: Column) -> dict[str, Column]:
    """Evidence of each field from the page text and its first sections (a map from label to text)."""
    top = F.substring(page, 1, 2000)
    part = lambda label, n: F.coalesce(sec[label], F.substring(page, 1, n))
    apply_text = F.coalesce(sec["application"], page)
    return {
        "title": evidence(title(page), "page_top", 0.7), "company_name": evidence(company(page), "page_top", 0.6), "location": evidence(location(page), "page_top"),
        "employment_type": evidence(first_match(top, fixed.EMPLOYMENT_TEXT), "page_top"), "work_mode": evidence(first_match(top, fixed.WORK_MODE_TEXT), "page_top"),
        "salary_raw": evidence(first_match(part("salary", 4000), fixed.SALARY_TEXT), "salary"), "experience_raw": evidence(first_match(part("requirements", 3000), fixed.EXPERIENCE_TEXT), "requirements"),
        "posted_date": evidence(first_match(page, fixed.POSTED_TEXT), "page_top"), "apply_url": evidence(first_match(apply_text, fixed.APPLY_URL_TEXT), "application"),
        "apply_email": evidence(first_match(apply_text, fixed.EMAIL_TEXT, flags=""), "application"),
        "description_text": F.coalesce(blank_to_null(sec["description"]), sec["body"]), "responsibilities": list_items(sec["responsibilities"]), "requirements_text": sec["requirements"],
        "preferred_text": sec["preferred_qualifications"], "benefits_text": sec["benefits"],
    }


def extract(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, page_text, and one column per field) of every page; each page is parsed once, and nothing is shuffled."""
    rows = df.select(key, clean_html(F.col(html)).alias("page_text")).withColumn("_b", blocks(F.col("page_text"))).withColumn("_s", first_sections(F.col("_b")))
    return rows.select(key, "page_text", *[v.alias(k) for k, v in fields(F.col("page_text"), F.col("_s")).items()])
