"""Errors that say at which stage, and where in the text, a query went wrong."""

from __future__ import annotations


class QueryError(Exception):
    """stage: parse, filters, resolve, emit or execute. line and column count from 1; 0 if there is no place."""

    def __init__(self, stage: str, message: str, at: tuple[int, int] | None = None) -> None:
        self.stage, self.message = stage, message
        self.line, self.column = at or (0, 0)
        place = f" at line {self.line}, column {self.column}" if at else ""
        super().__init__(f"{stage}: {message}{place}")


class AmbiguousPathError(QueryError):
    """Two relationship paths of the same length."""


class ServerBusy(QueryError):
    """No query lane came free in time."""


class QueryTimeout(QueryError):
    """The time limit was reached, and the query was cancelled."""
