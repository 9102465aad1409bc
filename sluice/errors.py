"""Errors that callers can tell apart. Outcomes of single pages and queries are columns; these are raised for calls that cannot be made at all."""

from __future__ import annotations


class SluiceError(Exception):
    """Any error of the engine's own."""


class InvalidUrl(SluiceError, ValueError):
    """A URL that is empty, not HTTP, or without a host."""


class ModelUnreachable(SluiceError):
    """The model did not answer."""


class SourceUnavailable(SluiceError):
    """A source whose pages cannot be fetched directly."""


class SearchError(SluiceError):
    """A search that failed, with the class of its response."""

    classification = "SEARCH_HTTP_ERROR"

    def __init__(self, message: str = "", *, classification: str | None = None, source: str | None = None, query: str | None = None, http_status: int | None = None):
        super().__init__(message)
        self.classification = classification or self.classification
        self.source, self.query, self.http_status = source, query, http_status

    def as_dict(self) -> dict[str, object]:
        return {"classification": self.classification, "source": self.source, "query": self.query, "http_status": self.http_status, "reason": str(self)}


class RateLimited(SearchError):
    classification = "SEARCH_RATE_LIMITED"


class Challenged(SearchError):
    classification = "SEARCH_CHALLENGED"


class NetworkFailure(SearchError):
    classification = "SEARCH_NETWORK_ERROR"


class UnreadablePage(SearchError):
    classification = "SEARCH_PARSE_ERROR"


BY_CLASS = {e.classification: e for e in (SearchError, RateLimited, Challenged, NetworkFailure, UnreadablePage)}


def of_class(classification: str, message: str = "", **more: object) -> SearchError:
    """The error for a response's class."""
    return BY_CLASS.get(classification, SearchError)(message, classification=classification, **more)
