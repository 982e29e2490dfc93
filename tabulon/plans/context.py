"""What an expression is evaluated in: points, filter context, row context.

*Points* are the rows of a DataFrame at which a scalar has a value: the cells of a group-by, or the rows of an iterated
table. The filter context says, in terms of model columns, which rows an aggregate sees at each point: by *keys* (a
model column equals a column of the points) and by *filters*. The row context are the frames of the tables that are
being iterated, each with the columns of the points that hold its values.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.nodes import Node

ModelColumn = tuple[str, str]
_numbers = itertools.count()


def fresh(prefix: str) -> str:
    return f"_{prefix}{next(_numbers)}"


@dataclass(frozen=True)
class Out:
    """A column of a table expression: its name, the DataFrame's column, and the model column that it comes from."""

    name: str
    col: str
    lineage: ModelColumn | None = None


@dataclass
class Rel:
    """A table expression's rows. corr: columns of the outer points that its rows belong to."""

    df: DataFrame
    outs: list[Out]
    corr: tuple[str, ...] = ()
    #: the model table whose rows these are, with all their columns
    table: str | None = None


@dataclass(frozen=True)
class Key:
    """The model column equals (null equals null) the points' column."""

    table: str
    column: str
    col: str

    @property
    def of(self) -> ModelColumn:
        return (self.table, self.column)


@dataclass(frozen=True)
class Filter:
    """kind expr: payload is a bound expression over model columns. in: columns and tuples of values. semi: columns, and a
    Rel with the columns that match them. window: a date column and bounds, each a column of the points or None."""

    kind: str
    columns: tuple[ModelColumn, ...]
    payload: Any = field(compare=False)
    corr: tuple[str, ...] = ()
    ident: str = ""

    @property
    def tables(self) -> set[str]:
        return {t for t, _ in self.columns}


@dataclass(frozen=True)
class PointRef(Node):
    """A column of the points, in a bound expression."""

    col: str


@dataclass(frozen=True)
class Frame:
    """A row of an iterated table. done: a context transition has made filters of it."""

    outs: tuple[Out, ...]
    table: str | None = None
    done: bool = False


@dataclass(frozen=True)
class Context:
    keys: tuple[Key, ...] = ()
    filters: tuple[Filter, ...] = ()
    rows: tuple[Frame, ...] = ()

    # filters

    def without_all(self) -> Context:
        return replace(self, keys=(), filters=())

    def without_table(self, table: str, but: set[str] | None = None) -> Context:
        """No filters on the table, but those on the columns `but`."""
        but = but or set()
        goes = lambda t, c: t == table and c not in but
        return replace(self, keys=tuple(k for k in self.keys if not goes(*k.of)), filters=tuple(f for f in self.filters if not (f.columns and all(goes(*c) for c in f.columns))))

    def without_columns(self, columns: set[ModelColumn]) -> Context:
        return replace(self, keys=tuple(k for k in self.keys if k.of not in columns), filters=tuple(f for f in self.filters if not (f.columns and set(f.columns) <= columns)))

    def overridden(self, columns: set[ModelColumn]) -> Context:
        """No filter that says anything of these columns."""
        return replace(self, keys=tuple(k for k in self.keys if k.of not in columns), filters=tuple(f for f in self.filters if not set(f.columns) & columns))

    def adding(self, *filters: Filter) -> Context:
        return replace(self, filters=(*self.filters, *filters))

    # columns of the points that matter

    def point_columns(self) -> tuple[str, ...]:
        found = [k.col for k in self.keys] + [c for f in self.filters for c in f.corr] + [o.col for r in self.rows for o in r.outs]
        return tuple(dict.fromkeys(found))

    def detached(self) -> Context:
        """The same without anything that depends on points."""
        return Context((), tuple(f for f in self.filters if not f.corr), ())


@dataclass
class Request:
    """Aggregates that have the same rows: alias, function and argument of each, over the joined model tables."""

    context: Context
    roots: tuple[str, ...]
    needed: set[str] = field(default_factory=set)
    corr: set[str] = field(default_factory=set)
    aggregates: list[tuple[str, str, Column]] = field(default_factory=list)


class Points:
    """The points' rows; columns are joined on as they are asked for. A column asked for twice is one."""

    def __init__(self, df: DataFrame | None, corr: tuple[str, ...] = ()) -> None:
        self.df, self.corr = df, corr
        self.pending: dict[Any, Request] = {}
        self.memo: dict[Any, Any] = {}
        self.expanded: dict[tuple, dict[ModelColumn, str]] = {}

    def distinct(self, columns: tuple[str, ...]) -> DataFrame:
        return self.df.select(*columns).distinct()

    def add(self, column: Column, prefix: str = "x") -> str:
        name = fresh(prefix)
        self.df = self.df.withColumn(name, column)
        return name

    def attach(self, found: DataFrame, on: tuple[str, ...]) -> None:
        """Left join `found`, which has the columns `on` of these points (null equals null) and new ones; without `on` it is one row."""
        if not on:
            self.df = self.df.crossJoin(F.broadcast(found))
            return
        names = {c: fresh("j") for c in on}
        right = found.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in found.columns if c not in names])
        condition = None
        for c, n in names.items():
            one = F.col(c).eqNullSafe(F.col(n))
            condition = one if condition is None else condition & one
        self.df = self.df.join(right, condition, "left").drop(*names.values())
