"""Tables, relationships and measures of a model, and the paths between tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..errors import AmbiguousPathError, QueryError
from ..lang.nodes import Node
from ..lang.parser import parse_expression

FORMAT_KINDS = ("number", "decimal", "percent", "currency", "compact")


@dataclass(frozen=True)
class Format:
    """How a measure is shown; it changes no value."""

    kind: str
    decimals: int | None = None
    currency: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in FORMAT_KINDS:
            raise QueryError("resolve", f"unknown format kind {self.kind!r}")
        if self.decimals is not None and not 0 <= self.decimals <= 10:
            raise QueryError("resolve", "format decimals must be from 0 to 10")
        if (self.kind == "currency") != (self.currency is not None):
            raise QueryError("resolve", "a currency code goes with the currency format, and only with it")
        if self.currency is not None and not (len(self.currency) == 3 and self.currency.isascii() and self.currency.isupper()):
            raise QueryError("resolve", f"{self.currency!r} is no ISO currency code")


@dataclass(frozen=True)
class Measure:
    table: str
    name: str
    text: str
    expr: Node = field(compare=False)
    format: Format | None = None


@dataclass(frozen=True)
class Relationship:
    """from: the many side; to: the one side. Metadata, not a constraint; blank keys match blank keys."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    bidirectional: bool = False


@dataclass(frozen=True)
class Step:
    """One relationship on a path; forward is from the many side to the one side."""

    rel: Relationship
    forward: bool

    @property
    def source(self) -> tuple[str, str]:
        return (self.rel.from_table, self.rel.from_column) if self.forward else (self.rel.to_table, self.rel.to_column)

    @property
    def target(self) -> tuple[str, str]:
        return (self.rel.to_table, self.rel.to_column) if self.forward else (self.rel.from_table, self.rel.from_column)


@dataclass
class Table:
    name: str
    df: DataFrame
    is_view: bool = False
    #: for variables: where a column comes from, by column
    lineage: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def column(self, name: str) -> str | None:
        if name in self.df.columns:
            return name
        return next((c for c in self.df.columns if c.lower() == name.lower()), None)


@dataclass
class Model:
    """A model is changed by copies (`with_...`), so a query sees one state of it."""

    tables: dict[str, Table] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    measures: dict[str, Measure] = field(default_factory=dict)
    #: table to date column
    date_tables: dict[str, str] = field(default_factory=dict)
    #: (table, None) or (table, column or measure)
    hidden: set[tuple[str, str | None]] = field(default_factory=set)

    def copy(self) -> Model:
        return Model(dict(self.tables), list(self.relationships), dict(self.measures), dict(self.date_tables), set(self.hidden))

    # tables and columns

    def add_table(self, name: str, df: DataFrame, is_view: bool = False) -> Table:
        self.tables[name] = Table(name, df, is_view)
        return self.tables[name]

    def find_table(self, name: str, at=None) -> Table | None:
        """By name, in any case; a bare name also finds the only table with that last part."""
        if name in self.tables:
            return self.tables[name]
        same = [t for t in self.tables.values() if t.name.lower() == name.lower()]
        if not same:
            same = [t for t in self.tables.values() if t.name.lower().endswith("." + name.lower())]
        if len(same) > 1:
            raise QueryError("resolve", f"table {name!r} is ambiguous: {', '.join(sorted(t.name for t in same))}", at)
        return same[0] if same else None

    def table(self, name: str, at=None) -> Table:
        if (t := self.find_table(name, at)) is None:
            raise QueryError("resolve", f"unknown table {name!r}", at)
        return t

    def column(self, table: str, column: str, at=None) -> tuple[str, str]:
        t = self.table(table, at)
        if (c := t.column(column)) is None:
            raise QueryError("resolve", f"unknown column {column!r} in table {t.name!r}", at)
        return t.name, c

    # measures

    def add_measure(self, table: str, name: str, text: str, format: Format | None = None) -> Measure:
        t = self.table(table)
        if t.column(name) is not None:
            raise QueryError("resolve", f"{t.name}[{name}] is a column")
        m = Measure(t.name, name, text, parse_expression(text), format)
        self.measures[f"{t.name}\n{name}".lower()] = m
        return m

    def find_measure(self, table: str | None, name: str, at=None) -> Measure | None:
        found = [m for m in self.measures.values() if m.name.lower() == name.lower()]
        if table is not None:
            t = self.find_table(table, at)
            found = [m for m in found if t is not None and m.table == t.name]
        if len(found) > 1:
            raise QueryError("resolve", f"measure [{name}] is ambiguous: {', '.join(sorted(m.table for m in found))}", at)
        return found[0] if found else None

    # relationships

    def relate(self, from_table: str, from_column: str, to_table: str, to_column: str, bidirectional: bool = False) -> Relationship:
        """Add or replace the relationship of these columns; refused if both-way filters would form a cycle."""
        f, t = self.column(from_table, from_column), self.column(to_table, to_column)
        r = Relationship(*f, *t, bidirectional)
        if f[0] == t[0]:
            raise QueryError("resolve", "a table can't be related to itself")
        before = list(self.relationships)
        self.relationships = [x for x in before if replace(x, bidirectional=bidirectional) != r] + [r]
        try:
            self.check()
        except QueryError:
            self.relationships = before
            raise
        return r

    def check(self) -> None:
        """Both-way relationships must leave one way between any two tables that they connect."""
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for r in self.relationships:
            if r.bidirectional:
                a, b = find(r.from_table), find(r.to_table)
                if a == b:
                    raise QueryError("resolve", f"the both-way relationship {r.from_table}[{r.from_column}] - {r.to_table}[{r.to_column}] closes a cycle")
                root[a] = b

    def steps(self, table: str, allowed: Callable[[Step], bool]) -> list[Step]:
        out = [Step(r, True) for r in self.relationships if r.from_table == table]
        out += [Step(r, False) for r in self.relationships if r.to_table == table]
        return [s for s in out if allowed(s)]

    def path(self, sources: list[str], target: str, allowed: Callable[[Step], bool], at=None) -> list[Step] | None:
        """The shortest path from any source; AmbiguousPathError if two are as short; None if there is none."""
        if target in sources:
            return []
        level: dict[str, list[Step]] = {s: [] for s in sources}
        seen, unclear = set(sources), set()
        while level:
            after: dict[str, list[Step]] = {}
            for t, way in level.items():
                for s in self.steps(t, allowed):
                    n = s.target[0]
                    if n in seen:
                        continue
                    if n in after or t in unclear:
                        unclear.add(n)
                    after.setdefault(n, [*way, s])
            if target in after:
                if target in unclear:
                    raise AmbiguousPathError("emit", f"more than one relationship path leads from {', '.join(sources)} to {target}; name the tables between them or remove a relationship", at)
                return after[target]
            seen |= set(after)
            level = after
        return None

    @staticmethod
    def filters(step: Step) -> bool:
        """Followed from a table to those that filter it: many to one always, back only over both-way relationships."""
        return step.forward or step.rel.bidirectional

    @staticmethod
    def expands(step: Step) -> bool:
        """Followed from a table to its one side only."""
        return step.forward

    def filter_reaches(self, filtering: str, filtered: str) -> bool:
        return self.path([filtered], filtering, self.filters) is not None if filtering != filtered else True

    def expanded(self, table: str) -> list[str]:
        """The table and all tables on its one sides, near ones first."""
        found, todo = [table], [table]
        while todo:
            t = todo.pop(0)
            for s in self.steps(t, self.expands):
                if s.target[0] not in found:
                    found.append(s.target[0])
                    todo.append(s.target[0])
        return found

    # date tables

    def set_date_table(self, table: str, column: str) -> None:
        t, c = self.column(table, column)
        kind = dict(self.tables[t].df.dtypes)[c]
        if kind not in ("date", "timestamp", "timestamp_ntz"):
            raise QueryError("resolve", f"{t}[{c}] is {kind}, not a date")
        self.date_tables = {t: c}
