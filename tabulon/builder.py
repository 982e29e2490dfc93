"""Query text from fields, filters, sort and top-n; and shaping of results for display."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from .errors import QueryError
from .external import ExternalFilter
from .lang.parser import KEYWORDS
from .model.schema import Format, Model

AGGREGATES = ("SUM", "COUNT", "AVERAGE", "MIN", "MAX", "DISTINCTCOUNT", "VALUES")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class Field:
    """A column or a measure. aggregate: None groups by a text column and sums a numeric one; VALUES always groups."""

    table: str
    name: str
    aggregate: str | None = None
    alias: str | None = None


def quoted(name: str) -> str:
    plain = re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*", name) and name.upper() not in KEYWORDS | {"TRUE", "FALSE", "NOT", "AND", "OR"}
    return name if plain else "'" + name.replace("'", "''") + "'"


def reference(table: str, name: str) -> str:
    return f"{quoted(table)}[{name.replace(']', ']]')}]"


def literal(v: Any) -> str:
    if v is None:
        return "BLANK()"
    if isinstance(v, bool):
        return "TRUE()" if v else "FALSE()"
    return str(v) if isinstance(v, int | float | Decimal) else '"' + str(v).replace('"', '""') + '"'


def build_query(model: Model, fields: Iterable[Field], filters: dict[tuple[str, str], list] | None = None, order: list[tuple[str, bool]] | None = None, top: tuple[int, str] | None = None) -> str:
    """fields in order; filters: values of a column; order: output names and whether descending; top: n rows by an output name."""
    groups, pairs = [], []
    for f in fields:
        if f.aggregate is not None and f.aggregate not in AGGREGATES:
            raise QueryError("parse", f"unknown aggregate {f.aggregate!r}")
        ref = reference(f.table, f.name)
        column = (t := model.find_table(f.table)) is not None and t.column(f.name)
        if not column:
            if model.find_measure(f.table, f.name) is None:
                raise QueryError("resolve", f"unknown field {ref}")
            pairs.append((f.alias or f.name, ref))
            continue
        numeric = dict(t.df.dtypes)[column].startswith(NUMERIC)
        how = f.aggregate or ("SUM" if numeric else "VALUES")
        if how == "VALUES":
            groups.append(ref)
        else:
            pairs.append((f.alias or f"{how.title()} of {f.name}", f"{how}({ref})"))
    for (t, c), values in (filters or {}).items():
        groups.append(f"TREATAS({{{', '.join(literal(v) for v in values)}}}, {reference(t, c)})")
    text = "SUMMARIZECOLUMNS(\n    " + ",\n    ".join([*groups, *[f"{literal(n)}, {x}" for n, x in pairs]]) + "\n)"
    if top is not None:
        text = f"TOPN({int(top[0])}, {text}, [{top[1].replace(']', ']]')}])"
    if order:
        text += "\nORDER BY " + ", ".join(f"[{n.replace(']', ']]')}]{' DESC' if down else ''}" for n, down in order)
    return "EVALUATE " + text


def slicer_query(model: Model, table: str, column: str, filters: dict[tuple[str, str], list] | None = None, measure: tuple[str, str] | None = None) -> str:
    """The values that a slicer offers, in order: those left by the other slicers' filters (its own is left out), and with a
    measure only those for which it has a value."""
    others = {k: v for k, v in (filters or {}).items() if (k[0].lower(), k[1].lower()) != (table.lower(), column.lower())}
    fields = [Field(table, column, "VALUES"), *([Field(*measure)] if measure else [])]
    return build_query(model, fields, others, [(column, False)])


def level_queries(model: Model, rows: list[Field], values: list[Field], filters: dict[tuple[str, str], list] | None = None) -> list[str]:
    """A query for each level of a pivot's subtotals: for the grand total, the first row field, the first two, and so on.
    Each level is aggregated by itself, so averages and distinct counts of a level are right."""
    return [build_query(model, [*rows[:n], *values], filters) for n in range(len(rows) + 1)]


def marks_filter(marks: list[dict[tuple[str, str], Any]]) -> list[ExternalFilter]:
    """What a selection of marks filters elsewhere: each mark has a value for some columns, the same for all. One column
    gives `in`, several columns of a table `in_tuples`, columns of several tables a filter for each table."""
    if not marks:
        return []
    tables: dict[str, list[str]] = {}
    for t, c in marks[0]:
        tables.setdefault(t, []).append(c)
    if any(m.keys() != marks[0].keys() for m in marks):
        raise QueryError("filters", "the marks name different columns")
    out = []
    for t, columns in tables.items():
        picked = tuple(dict.fromkeys(tuple(m[t, c] for c in columns) for m in marks))
        out.append(ExternalFilter(t, columns[0], "in", tuple(p[0] for p in picked)) if len(columns) == 1 else ExternalFilter(t, op="in_tuples", values=picked, columns=tuple(columns)))
    return out


def sort_key(v: Any, descending: bool = False):
    """Blanks are last both ways; numbers by size, text without regard to case."""
    if v is None:
        return (1, 0, "")
    if isinstance(v, int | float | Decimal):
        return (0, -float(v) if descending else float(v), "")
    return (0, 0, str(v).casefold())


def without_empty_rows(columns: list[str], rows: list[list], values: list[str]) -> list[list]:
    at = [columns.index(v) for v in values]
    return [r for r in rows if any(r[i] is not None for i in at)]


def pivoted(columns: list[str], rows: list[list], by: str, series: str, value: str, top: int | None = None, blank: str = "(blank)") -> tuple[list[str], list[list]]:
    """One row for each value of `by`, one column for each of `series`; with `top`, the rows of the greatest totals."""
    b, s, v = (columns.index(c) for c in (by, series, value))
    name = lambda x: blank if x is None else x
    heads = sorted({name(r[s]) for r in rows}, key=sort_key)
    cells: dict[Any, dict[Any, Any]] = {}
    for r in rows:
        cells.setdefault(name(r[b]), {})[name(r[s])] = r[v]
    order = list(cells)
    if top is not None:
        order = sorted(order, key=lambda k: -sum(float(x) for x in cells[k].values() if x is not None))[:top]
    return [by, *map(str, heads)], [[k, *[cells[k].get(h) for h in heads]] for k in order]


def formatted(v: Any, f: Format | None) -> str:
    """A number as its measure is shown."""
    if v is None:
        return ""
    if f is None or isinstance(v, str | bool):
        return str(v)
    d = Decimal(str(v))

    def fixed(x: Decimal, n: int) -> str:
        return f"{x.quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP):,f}"

    match f.kind:
        case "percent":
            return fixed(d * 100, 1 if f.decimals is None else f.decimals) + "%"
        case "currency":
            return f"{f.currency} {fixed(d, 2 if f.decimals is None else f.decimals)}"
        case "compact":
            for size, suffix in ((Decimal(10) ** 9, "B"), (Decimal(10) ** 6, "M"), (Decimal(10) ** 3, "T")):
                if abs(d) >= size:
                    return fixed(d / size, 1 if f.decimals is None else f.decimals) + suffix
            return fixed(d, f.decimals or 0)
        case "decimal":
            return fixed(d, 2 if f.decimals is None else f.decimals)
    return fixed(d, f.decimals or 0)


def to_csv(columns: list[str], rows: list[list]) -> str:
    """Comma-separated lines that end in CR LF; blanks are empty."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()
