"""Table expressions as DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..lang.nodes import Call, ColumnRef, Literal, Node, TableRef, children, walk
from ..plans.context import Context, Out, Points, Rel, fresh
from ..plans.timeintel import TIME_FUNCTIONS
from . import summarize

DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


def evaluate(e, n: Node, pts: Points, ctx: Context, honor: bool = False) -> Rel:
    """honor: tables and values are read in the filter context, not whole."""
    if isinstance(n, TableRef):
        t = e.model.table(n.name, n.at)
        return contextual(e, t.name, pts, ctx) if honor else _own_names(Rel(e.base(t.name), e.outs_of(t.name), (), None if t.lineage else t.name))
    if not isinstance(n, Call):
        raise QueryError("emit", "a table is needed here", n.at)
    if n.name in TIME_FUNCTIONS:
        return _own_names(e.time.dates(n, pts, ctx))
    make = TABLES.get(n.name)
    if make is None:
        known = n.name in _all_functions()
        raise QueryError("emit", f"{n.name} gives a value, not a table" if known else f"unknown function {n.name}", n.at)
    return make(e, n, pts, ctx, honor)


def _own_names(rel: Rel) -> Rel:
    """Columns under names of their own, so that rows which are iterated can be joined with the model tables again."""
    outs = [replace(o, col=fresh("n")) for o in rel.outs]
    return replace(rel, df=rel.df.select(*rel.corr, *[F.col(o.col).alias(x.col) for o, x in zip(rel.outs, outs, strict=True)]), outs=outs)


def _all_functions() -> set[str]:
    from ..plans.evaluate import FUNCTIONS

    return FUNCTIONS


def arity(n: Call, least: int, most: int | None = None) -> None:
    most = least if most is None else most
    if not least <= len(n.args) <= most:
        raise QueryError("emit", f"{n.name} takes {least if least == most else f'{least} or more'} argument{'s' * (least > 1)}, not {len(n.args)}", n.at)


def contextual(e, table: str, pts: Points, ctx: Context) -> Rel:
    """A table's rows in the filter context, at each point that the context depends on."""
    keys, filters = e._routes(ctx, (table,))
    df, waiting = e.scan((table,), keys, filters, set())
    outs = e.outs_of(table)
    own = None if e.model.tables[table].lineage else table
    if not keys and not waiting:
        return _own_names(Rel(df, outs, (), own))
    e.flush(pts)
    df, used = e.matched(df, keys, waiting, pts, set())
    return _own_names(Rel(df, outs, used, own))


def named(e, n: Call, args: tuple[Node, ...]) -> list[tuple[str, Node]]:
    if len(args) % 2 or not all(isinstance(a, Literal) and isinstance(a.value, str) for a in args[::2]):
        raise QueryError("emit", f"{n.name} takes pairs of a name and an expression", n.at)
    return [(a.value, x) for a, x in zip(args[::2], args[1::2], strict=True)]


def filter_(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    arity(n, 2)
    rel = evaluate(e, n.args[0], pts, ctx, honor)
    inner, inner_ctx, rel = e.inside(rel, [n.args[1]], pts, ctx)
    test = e.scalar(n.args[1], inner, inner_ctx)
    e.flush(inner)
    return replace(rel, df=inner.df.where(test).select(*rel.corr, *[o.col for o in rel.outs]))


def _with_columns(e, n: Call, pts: Points, ctx: Context, honor: bool) -> tuple[Rel, Points, list[Out], list[Column]]:
    if not n.args:
        raise QueryError("emit", f"{n.name} takes a table", n.at)
    rel = evaluate(e, n.args[0], pts, ctx, honor)
    pairs = named(e, n, n.args[1:])
    inner, inner_ctx, rel = e.inside(rel, [x for _, x in pairs], pts, ctx)
    columns, outs = [], []
    for name, x in pairs:
        c = e.scalar(x, inner, inner_ctx)
        alias = fresh("c")
        lineage = next((o.lineage for o in rel.outs if isinstance(x, ColumnRef) and e.measure_of(x) is None and e.frame_column(x, inner_ctx.rows[-1:]) == o.col), None)
        columns.append(c.alias(alias))
        outs.append(Out(name, alias, lineage))
    e.flush(inner)
    return rel, inner, outs, columns


def add_columns(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    rel, inner, outs, columns = _with_columns(e, n, pts, ctx, honor)
    df = inner.df.select(*rel.corr, *[o.col for o in rel.outs], *columns)
    return Rel(df, [*rel.outs, *outs], rel.corr, rel.table)


def select_columns(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    rel, inner, outs, columns = _with_columns(e, n, pts, ctx, honor)
    return Rel(inner.df.select(*rel.corr, *columns), outs, rel.corr)


def row(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    named(e, n, n.args)
    return summarize.summarize(e, n, pts, ctx)


def values(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    arity(n, 1)
    if not isinstance(n.args[0], ColumnRef):
        rel = evaluate(e, n.args[0], pts, ctx, honor)
        return replace(rel, df=rel.df.distinct())
    return _distinct_columns(e, [e.model_column(n.args[0])], pts, ctx, honor)


def _distinct_columns(e, columns: list[tuple[str, str]], pts: Points, ctx: Context, honor: bool) -> Rel:
    table = columns[0][0]
    rel = evaluate(e, TableRef(table), pts, ctx, honor)
    outs = [o for _, c in columns for o in rel.outs if o.name == c]
    return Rel(rel.df.select(*rel.corr, *[o.col for o in outs]).distinct(), outs, rel.corr)


def all_(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    if not n.args:
        raise QueryError("emit", f"{n.name} as a table takes a table or columns", n.at)
    if isinstance(n.args[0], TableRef):
        return evaluate(e, n.args[0], pts, ctx, False)
    columns = [e.model_column(c) if isinstance(c, ColumnRef) else e._bad_column(c) for c in n.args]
    if len({t for t, _ in columns}) > 1:
        raise QueryError("emit", "ALL takes columns of one table", n.at)
    return _distinct_columns(e, columns, pts, ctx, False)


def _aligned(a: Rel, b: Rel, n: Call) -> None:
    if len(a.outs) != len(b.outs):
        raise QueryError("emit", f"{n.name} needs tables with as many columns: {len(a.outs)} and {len(b.outs)}", n.at)
    if set(a.corr) != set(b.corr) and a.corr and b.corr:
        raise QueryError("emit", f"{n.name} of tables that depend on different rows", n.at)


def _both(e, n: Call, pts: Points, ctx: Context, honor: bool) -> tuple[Rel, Rel]:
    arity(n, 2)
    a, b = (evaluate(e, x, pts, ctx, honor) for x in n.args)
    _aligned(a, b, n)
    return a, b


def union(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    a, b = _both(e, n, pts, ctx, honor)
    outs = [Out(o.name, fresh("u"), o.lineage if o.lineage == p.lineage else None) for o, p in zip(a.outs, b.outs, strict=True)]
    corr = a.corr or b.corr
    parts = [r.df.select(*corr, *[F.col(o.col).alias(u.col) for o, u in zip(r.outs, outs, strict=True)]) for r in (a, b)]
    return Rel(parts[0].union(parts[1]), outs, corr)


def _matching(how: str):
    def make(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
        a, b = _both(e, n, pts, ctx, honor)
        names = [fresh("i") for _ in b.outs]
        together = {c: fresh("j") for c in b.corr}
        right = b.df.select(*[F.col(c).alias(x) for c, x in together.items()], *[F.col(o.col).alias(x) for o, x in zip(b.outs, names, strict=True)]).distinct()
        condition = None
        for left, x in [*together.items(), *((o.col, x) for o, x in zip(a.outs, names, strict=True))]:
            one = F.col(left).eqNullSafe(F.col(x))
            condition = one if condition is None else condition & one
        return replace(a, df=a.df.join(right, condition, how))

    return make


def _distinct_names(rels: list[Rel], n: Call) -> None:
    names = [o.name.lower() for r in rels for o in r.outs]
    if twice := sorted({x for x in names if names.count(x) > 1}):
        raise QueryError("emit", f"{n.name} would have the column {twice[0]!r} twice", n.at)


def cross_join(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    if len(n.args) < 2:
        raise QueryError("emit", "CROSSJOIN takes two tables or more", n.at)
    rels = [evaluate(e, x, pts, ctx, honor) for x in n.args]
    _distinct_names(rels, n)
    one = rels[0]
    for other in rels[1:]:
        one = _joined(one, other, "inner")
    return Rel(one.df, one.outs, one.corr)


def _joined(a: Rel, b: Rel, how: str) -> Rel:
    """All pairs of rows that belong to the same outer row."""
    shared = [c for c in b.corr if c in a.corr or any(o.col == c for o in a.outs)]
    # columns of b are given names of their own, as both sides may come from one table
    again = {o.col: fresh("g") for o in b.outs}
    keys = {c: fresh("j") for c in shared}
    rest = [c for c in b.corr if c not in shared]
    right = b.df.select(*[F.col(c).alias(x) for c, x in keys.items()], *rest, *[F.col(c).alias(x) for c, x in again.items()])
    condition = None
    for c, x in keys.items():
        one = F.col(c).eqNullSafe(F.col(x))
        condition = one if condition is None else condition & one
    if condition is None:
        df = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
    else:
        df = a.df.join(right, condition, how)
    outs = [*a.outs, *[replace(o, col=again[o.col]) for o in b.outs]]
    return Rel(df.drop(*keys.values()), outs, tuple(dict.fromkeys([*a.corr, *rest])))


def _generate(how: str):
    def make(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
        arity(n, 2)
        a = evaluate(e, n.args[0], pts, ctx, honor)
        inner, inner_ctx, a = e.inside(a, [n.args[1]], pts, ctx)
        b = evaluate(e, n.args[1], inner, inner_ctx, honor)
        e.flush(inner)
        # columns that were joined to the rows for the second table's sake are there now
        a = replace(a, df=inner.df)
        _distinct_names([a, b], n)
        found = _joined(a, b, how)
        return Rel(found.df.select(*a.corr, *[o.col for o in found.outs]), found.outs, a.corr)

    return make


def top_n(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    """The first n rows and all that tie with the last of them."""
    if len(n.args) < 2:
        raise QueryError("emit", "TOPN takes a number, a table and keys", n.at)
    count = e.literal(n.args[0])
    if not isinstance(count, int) or isinstance(count, bool):
        raise QueryError("emit", "the number of TOPN must be a whole literal", n.args[0].at)
    rel = evaluate(e, n.args[1], pts, ctx, honor)
    keys: list[tuple[Node, bool]] = []
    for a in n.args[2:]:
        if isinstance(a, TableRef) and a.name.upper() in ("ASC", "DESC"):
            if not keys:
                raise QueryError("emit", f"{a.name.upper()} needs a key before it", a.at)
            keys[-1] = (keys[-1][0], a.name.upper() == "DESC")
        else:
            keys.append((a, True))
    inner, inner_ctx, rel = e.inside(rel, [k for k, _ in keys], pts, ctx)
    columns = [e.scalar(k, inner, inner_ctx) for k, _ in keys]
    e.flush(inner)
    names = [inner.add(c, "t") for c in columns]
    df = inner.df
    order = [F.col(x).desc_nulls_last() if down else F.col(x).asc_nulls_last() for x, (_, down) in zip(names, keys, strict=True)]
    keep = [*rel.corr, *[o.col for o in rel.outs]]
    if not order:
        return replace(rel, df=df.select(*keep))
    if rel.corr:
        rank = fresh("r")
        df = df.withColumn(rank, F.rank().over(Window.partitionBy(*rel.corr).orderBy(*order))).where(F.col(rank) <= count)
        return replace(rel, df=df.select(*keep))
    if count <= 0:
        return replace(rel, df=df.where(F.lit(False)).select(*keep))
    # no window over all rows: the n-th key comes from a top-n that each task prunes, then rows are filtered by it
    last = {x: fresh("r") for x in names}
    marks = df.select(*names).orderBy(*order).limit(count)
    backward = [F.col(x).asc_nulls_first() if down else F.col(x).desc_nulls_first() for x, (_, down) in zip(names, keys, strict=True)]
    worst = marks.orderBy(*backward).limit(1).select(*[F.col(x).alias(y) for x, y in last.items()])
    test, same = F.lit(False), F.lit(True)
    for (x, y), (_, down) in zip(last.items(), keys, strict=True):
        better = F.col(x) > F.col(y) if down else F.col(x) < F.col(y)
        better = F.when(F.col(x).isNull(), F.lit(False)).when(F.col(y).isNull(), F.lit(True)).otherwise(better)
        test = test | (same & better)
        same = same & F.col(x).eqNullSafe(F.col(y))
    return replace(rel, df=df.crossJoin(F.broadcast(worst)).where(test | same).select(*keep))


def calculate_table(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    if not n.args:
        raise QueryError("emit", f"{n.name} takes a table", n.at)
    here = pts if pts.df is not None else Points(e.spark.range(1).select())
    inside = [t for r in walk(n.args[0]) if isinstance(r, TableRef) and (t := e.model.find_table(r.name)) is not None]
    tables = list(dict.fromkeys([t.name for t in inside] + [e.model_column(r)[0] for r in walk(n.args[0]) if isinstance(r, ColumnRef) and r.table and e.measure_of(r) is None] + e.value_tables(n.args[0])))
    after = e.modified(n.args[1:], here, ctx, tables)
    return evaluate(e, n.args[0], here, after, True)


def related_table(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    arity(n, 1)
    return calculate_table(e, n, pts, ctx, honor)


def treatas(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    f = e.treatas(n, pts, ctx)
    if f.kind == "in":
        columns, rows = f.payload
        outs = [Out(c, fresh("v"), (t, c)) for t, c in columns]
        df = e.spark.createDataFrame([tuple(r) for r in rows], [o.col for o in outs])
        return Rel(df.distinct(), outs)
    columns, rel, cols = f.payload
    outs = [Out(c, x, (t, c)) for (t, c), x in zip(columns, cols, strict=True)]
    return Rel(rel.df.select(*rel.corr, *cols).distinct(), outs, rel.corr)


def _days(low: Column, high: Column, source) -> Rel:
    col = fresh("v")
    # as timestamps at midnight, which is what a generated series of days is
    return Rel(source.select(F.explode(F.sequence(low, high, F.expr("interval 1 day"))).alias(col)), [Out("Date", col)])


def calendar(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    arity(n, 2)
    here = Points(e.spark.range(1).select())
    low, high = (e.time.bound(a, here, Context()) for a in n.args)
    if low is None or high is None:
        raise QueryError("emit", "CALENDAR needs two dates", n.at)
    e.flush(here)
    return _days(F.to_date(low), F.to_date(high), here.df)


def calendar_auto(e, n: Call, pts: Points, ctx: Context, honor: bool) -> Rel:
    arity(n, 0)
    ends = None
    for t in e.model.tables.values():
        dates = [c for c, kind in t.df.dtypes if kind in DATE_TYPES]
        if t.lineage or not dates:
            continue
        one = t.df.agg(F.least(*[F.min(c) for c in dates]) if len(dates) > 1 else F.min(dates[0]), F.greatest(*[F.max(c) for c in dates]) if len(dates) > 1 else F.max(dates[0])).toDF("lo", "hi")
        one = one.select(F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
        ends = one if ends is None else ends.union(one)
    if ends is None:
        raise QueryError("emit", "CALENDARAUTO finds no date column in the model", n.at)
    whole = ends.agg(F.trunc(F.min("lo"), "year").alias("lo"), F.date_sub(F.add_months(F.trunc(F.max("hi"), "year"), 12), 1).alias("hi")).where("lo is not null")
    return _days(F.col("lo"), F.col("hi"), whole)


TABLES = {
    "ADDCOLUMNS": add_columns,
    "ALL": all_,
    "ALLEXCEPT": all_,
    "CALCULATETABLE": calculate_table,
    "CALENDAR": calendar,
    "CALENDARAUTO": calendar_auto,
    "CROSSJOIN": cross_join,
    "DISTINCT": values,
    "EXCEPT": _matching("left_anti"),
    "FILTER": filter_,
    "GENERATE": _generate("inner"),
    "GENERATEALL": _generate("left"),
    "INTERSECT": _matching("left_semi"),
    "RELATEDTABLE": related_table,
    "ROW": row,
    "SELECTCOLUMNS": select_columns,
    "SUMMARIZECOLUMNS": lambda e, n, pts, ctx, honor: summarize.summarize(e, n, pts, ctx),
    "TOPN": top_n,
    "TREATAS": treatas,
    "UNION": union,
    "VALUES": values,
}

__all__ = ["TABLES", "children", "evaluate"]
