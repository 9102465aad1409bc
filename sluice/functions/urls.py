"""URL validation, canonical forms, source detection and per-source identifiers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.functions.text import blank_to_null, let, strip

SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """Scheme, authority, path or query (1 to 4) of a URL; '' where it is missing."""
    return F.regexp_extract(url, "(?s)" + SPLIT, group)


def parts(url: Column) -> Column:
    """Scheme, authority, path and query as an array, from one match."""
    return F.split(F.regexp_replace(url, "(?s)" + SPLIT, "$1\x01$2\x01$3\x01$4"), "\x01", 4)


def reason(url: Column) -> Column:
    """Why a URL cannot be fetched, or null: empty, scheme, host."""
    scheme = F.lower(part(url, 1))
    return (
        F.when(url.isNull() | (F.length(strip(url)) == 0), "URL is empty")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Invalid scheme '"), scheme, F.lit("' — only http/https allowed")))
        .when(F.length(part(url, 2)) == 0, F.concat(F.lit("URL has no host: '"), url, F.lit("'")))
    )


def valid(url: Column) -> Column:
    return reason(url).isNull()


def decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def encode(x: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(query: Column) -> Column:
    """Decoded (k, v) of a query string in order; pairs without a value are dropped."""
    with_value = F.filter(F.split(query, "&"), lambda x: F.instr(x, "=") > 0)
    both = F.transform(with_value, lambda x, i: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), i.alias("i"), decode(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    return F.filter(both, lambda p: F.length(p["v"]) > 0)


def form(params: Column) -> Column:
    return F.array_join(F.transform(params, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")


def param(url: Column, name: str) -> Column:
    """First value of a query parameter."""
    return F.get(F.filter(pairs(part(url, 4)), lambda p: p["k"] == name), F.lit(0))["v"]


def join(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """A URL from its parts; a path after an authority starts with a slash."""
    slash = F.when((F.length(path) > 0) & ~path.startswith("/"), "/").otherwise("")
    head = F.when(F.length(host) > 0, F.concat(scheme, F.lit("://"), host, slash)).when(F.length(scheme) > 0, F.concat(scheme, F.lit(":"))).otherwise("")
    return F.concat(head, path, let(query, lambda q: F.when(F.length(q) > 0, F.concat(F.lit("?"), q)).otherwise("")))


def canonical(url: Column) -> Column:
    """One form per page: lower-case scheme and host, no default port, no tracking parameters, the rest sorted by name, no fragment, no trailing slash."""
    tracking = F.array(*[F.lit(x) for x in fixed.TRACKING_PARAMS])

    def rebuilt(p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
        scheme = F.lower(at(0))
        host = F.regexp_replace(F.concat(scheme, F.lit("|"), F.lower(at(1))), r"^(http\|.*):80$|^(https\|.*):443$", "$1$2")
        path = F.regexp_replace(at(2), ";[^/]*$", "")
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
        kept = F.array_sort(F.filter(pairs(at(3)), lambda x: ~F.array_contains(tracking, x["k"])))
        return join(scheme, F.substring_index(host, "|", -1), path, form(kept))

    return let(parts(strip(url)), rebuilt)


def source_of(url: Column) -> Column:
    """Source whose domain the host is or ends in (one ``www.`` removed), else 'generic'."""
    name = lambda host: F.coalesce(*[F.when((host == d) | host.endswith("." + d), s) for d, s in fixed.SOURCE_HOSTS.items()], F.lit("generic"))
    return let(F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), name)


def scoped_query(query: Column, source: Column) -> Column:
    scopes = F.create_map(*[F.lit(x) for kv in fixed.SOURCE_SCOPES.items() for x in kv])
    return F.concat(query, F.lit(" site:"), F.try_element_at(scopes, source))


def scoped_url(query: Column, source: Column) -> Column:
    return F.concat(F.lit("https://html.duckduckgo.com/html/?q="), encode(scoped_query(query, source)))


def _group(url: Column, pattern: str, ignore_case: bool = True) -> Column:
    return blank_to_null(F.regexp_extract(url, ("(?i)" if ignore_case else "") + pattern, 1))


def _moved(url: Column, host: str, keep_query: list[str] | None = None) -> Column:
    """The URL on https at ``host``, without fragment and without query, or with a query stripped of ``keep_query``'s names."""
    query = F.lit("")
    if keep_query is not None:
        query = form(F.filter(pairs(part(url, 4)), lambda p: ~F.array_contains(F.array(*[F.lit(x) for x in keep_query]), p["k"])))
    return join(F.lit("https"), F.lit(host), part(url, 3), query)


def _linkedin_id(url: Column) -> Column:
    numeric = [F.when(param(url, n).rlike(r"^\d+$"), param(url, n)) for n in ("currentJobId", "jobId", "f_JT")]
    return F.coalesce(*numeric, *[_group(url, p) for p in fixed.LINKEDIN_PATHS])


def _indeed_id(url: Column) -> Column:
    return F.coalesce(param(url, "jk"), _group(url, fixed.INDEED_KEY))


def _path(url: Column) -> Column:
    return part(url, 3)


#: Adapter: hosts that select it, external id, canonical form.
ADAPTERS: dict[str, tuple[list[str], Callable[[Column], Column], Callable[[Column], Column]]] = {
    "linkedin": (["linkedin.com"], _linkedin_id, lambda u: F.coalesce(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), _linkedin_id(u), F.lit("/")), _moved(u, "www.linkedin.com", fixed.LINKEDIN_STRIPPED))),
    "indeed": (["indeed.com"], _indeed_id, lambda u: F.coalesce(F.concat(F.lit("https://www.indeed.com/viewjob?jk="), _indeed_id(u)), _moved(u, "www.indeed.com", fixed.TRACKING_PARAMS))),
    "naukri": (["naukri.com"], lambda u: F.coalesce(*[_group(u, p) for p in fixed.NAUKRI_IDS]), lambda u: _moved(u, "www.naukri.com")),
    "cutshort": (["cutshort.io"], lambda u: _group(_path(u), fixed.CUTSHORT_ID), lambda u: _moved(u, "cutshort.io")),
    "instahyre": (["instahyre.com"], lambda u: _group(_path(u), fixed.INSTAHYRE_ID), lambda u: _moved(u, "www.instahyre.com")),
    "hirist": (["hirist.tech", "hirist.com"], lambda u: _group(_path(u), fixed.HIRIST_ID), lambda u: _moved(u, "www.hirist.tech")),
    "wellfound": (["wellfound.com", "angel.co"], lambda u: F.coalesce(*[_group(_path(u), p) for p in fixed.WELLFOUND_IDS]), lambda u: _moved(u, "wellfound.com")),
    "hirect": (["hirect.in"], lambda u: _group(_path(u), fixed.HIRECT_ID), lambda u: _moved(u, "hirect.in")),
    "generic": ([], lambda u: blank_to_null(F.regexp_replace(_path(u), "^/+|/+$", "")), lambda u: join(F.lit("https"), F.lower(part(u, 2)), part(u, 3), F.lit(""))),
}


def adapter_of(url: Column) -> Column:
    """First adapter one of whose hosts occurs in the URL's host; generic takes the rest of the nonempty URLs."""
    name = lambda host: F.coalesce(*[F.when(reduce(lambda a, b: a | b, [host.contains(h) for h in hosts]), k) for k, (hosts, _, _) in ADAPTERS.items() if hosts], F.lit("generic"))
    return F.when(F.length(url) > 0, let(F.lower(part(url, 2)), name))


def _by_adapter(url: Column, at: int) -> Column:
    def chosen(name: Column) -> Column:
        return reduce(lambda out, k: out.when(name == k, ADAPTERS[k][at](url)), ADAPTERS, F.when(F.lit(False), F.lit(None).cast("string")))

    return let(adapter_of(url), chosen)


def external_id(url: Column) -> Column:
    return _by_adapter(url, 1)


def adapter_canonical(url: Column) -> Column:
    return _by_adapter(url, 2)
