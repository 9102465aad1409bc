"""Responses of a search engine: their class, and the results on them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REDIRECT = "//duckduckgo.com/l/?"
BOT_TEXT = "unfortunately, bots use duckduckgo too|select all squares containing a duck|challenge|anomaly"
BOT_FORMS = r"id\s*=\s*[\"']?(?:challenge-form|anomaly-form|img-form)\b"
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


def looks_malformed(body: Column) -> Column:
    """A result page whose tags do not add up."""
    t = F.lower(body)
    n = lambda s: F.regexp_count(t, F.lit(s))
    unclosed = (
        (t.contains("<a ") & ~t.contains("</a>")) | (t.contains('<h2 class="result__title"') & ~t.contains("</h2>")) | ((t.contains('<div class="result__title"') | t.contains('<div class="result__snippet"')) & ~t.contains("</div>"))
        | (n("<a ") > n("</a>")) | (n('<div class="result"') > n("</div>"))
    )
    return F.coalesce(t.contains('class="result') & unclosed, F.lit(False))


def classify(status: Column, body: Column, error: Column) -> Column:
    """Class of a response, the first that holds."""
    bots = F.lower(body).rlike(BOT_TEXT) | F.lower(body).rlike(BOT_FORMS)
    return (
        F.when(error.isNotNull(), "SEARCH_NETWORK_ERROR").when((status == 200) & looks_malformed(body), "SEARCH_PARSE_ERROR").when(status == 429, "SEARCH_RATE_LIMITED").when(status == 403, "SEARCH_HTTP_ERROR")
        .when(status == 202, "SEARCH_CHALLENGED").when(status.isNull() | (status != 200), "SEARCH_HTTP_ERROR").when(bots, "SEARCH_CHALLENGED").otherwise("SEARCH_SUCCESS")
    )


class _Results(HTMLParser):
    """Result nodes with the link and text of their title, and their snippet."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.found: list[dict] = []

    def _inside(self, name: str) -> bool:
        return any(name in classes for _, classes in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        if "result" in classes:
            self.found.append({"url": None, "title": "", "snippet": None})
        if self.found and tag == "a" and self.found[-1]["url"] is None and ("result__a" in classes or self._inside("result__title")):
            classes.add("#title")
            self.found[-1]["url"] = a.get("href") or ""
        if "result__snippet" in classes and self.found and self.found[-1]["snippet"] is None:
            self.found[-1]["snippet"] = ""
            classes.add("#snippet")
        if tag not in _VOID:
            self.open.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.found:
            for mark, field in (("#title", "title"), ("#snippet", "snippet")):
                if self._inside(mark):
                    self.found[-1][field] += data.strip()


def unwrap(href: str) -> str:
    """Target of an engine's redirect link."""
    return parse_qs(urlsplit(href).query).get("uddg", [href])[0] if href.startswith(REDIRECT) else href


def parse(body: str | None, most: int) -> list[dict]:
    parser = _Results()
    parser.feed(body or "")
    parser.close()
    return [{"title": r["title"], "url": unwrap(r["url"]), "snippet": r["snippet"]} for r in parser.found if r["url"] is not None][:most]


def results(body: Column, most: int = 10) -> Column:
    """array(struct(title, url, snippet)) of a result page; nodes without a title link are skipped."""

    @F.pandas_udf("array<struct<title:string,url:string,snippet:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: parse(x if isinstance(x, str) else None, most))

    return run(body)
