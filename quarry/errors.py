"""Errors that a request can meet; `kind` is the error type that a client of the query language expects."""

from __future__ import annotations


class SearchError(Exception):
    kind, status = "exception", 400


class IllegalArgument(SearchError):
    kind = "illegal_argument_exception"


class Parsing(SearchError):
    kind = "parsing_exception"


class Unsupported(SearchError):
    """Something that isn't answered faithfully is refused, never ignored."""

    kind = "illegal_argument_exception"


class ValueUnreadable(IllegalArgument):
    """A query value that the field's type can't hold; `lenient` swallows this one only."""


class QueryShard(SearchError):
    kind = "query_shard_exception"


class MapperParsing(SearchError):
    kind = "mapper_parsing_exception"


class DocumentParsing(SearchError):
    kind = "document_parsing_exception"


class StrictMapping(SearchError):
    kind = "strict_dynamic_mapping_exception"


class IndexNotFound(SearchError):
    kind, status = "index_not_found_exception", 404


class AlreadyExists(SearchError):
    kind = "resource_already_exists_exception"


class VersionConflict(SearchError):
    kind, status = "version_conflict_engine_exception", 409


class ScrollMissing(SearchError):
    kind, status = "search_context_missing_exception", 404


def expect_only(where: str, given: dict, *allowed: str) -> None:
    for key in given:
        if key not in allowed:
            raise Unsupported(f"[{where}] does not support [{key}]")
