"""The evaluator: syntax trees to DataFrames, set at a time.

No correlated subquery is ever built. An aggregate at some points becomes one grouped aggregation of the joined model
tables by its keys, which is joined back to the points; aggregates with the same context and tables share it. Only
contexts that depend on the points in another way than by equality (windows of dates, predicates on an outer row)
join the distinct points to the tables first; a window does so over days, so that the fact table is joined by equality.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AmbiguousPathError, QueryError
from ..functions import scalar as scalars
from ..lang.nodes import Binary, Call, ColumnRef, Literal, Node, TableConstructor, TableRef, Unary, children, rebuilt, walk
from ..model.schema import Model, Step, Table
from .context import Context, Filter, Frame, Key, ModelColumn, Out, PointRef, Points, Rel, Request, fresh
from .timeintel import PERIODS, TIME_FUNCTIONS, TimeIntelligence

AGGREGATES = {"SUM", "AVERAGE", "MIN", "MAX", "MEDIAN", "COUNT", "COUNTA", "COUNTBLANK", "DISTINCTCOUNT"}
#: Aggregates that can be taken of parts first, and the aggregate of the parts.
IN_PARTS = {"SUM": "SUM", "MIN": "MIN", "MAX": "MAX", "COUNT": "SUM", "COUNTA": "SUM", "ROWS": "SUM"}
ITERATORS = {"SUMX": "SUM", "AVERAGEX": "AVERAGE", "COUNTX": "COUNT", "MINX": "MIN", "MAXX": "MAX"}
TO_DATE = {"TOTALYTD": "DATESYTD", "TOTALQTD": "DATESQTD", "TOTALMTD": "DATESMTD"}
TABLE_FUNCTIONS = {"ADDCOLUMNS", "ALL", "ALLEXCEPT", "CALCULATETABLE", "CALENDAR", "CALENDARAUTO", "CROSSJOIN", "DISTINCT", "EXCEPT", "FILTER", "GENERATE", "GENERATEALL", "INTERSECT", "RELATEDTABLE", "ROW", "SELECTCOLUMNS", "SUMMARIZECOLUMNS", "TOPN", "TREATAS", "UNION", "VALUES"} | TIME_FUNCTIONS
ONLY_INSIDE = {"KEEPFILTERS": "CALCULATE", "REMOVEFILTERS": "CALCULATE", "ROLLUPADDISSUBTOTAL": "SUMMARIZECOLUMNS", "ROLLUPGROUP": "ROLLUPADDISSUBTOTAL", "LASTNONBLANK": "a date bound", "LASTDATE": "a date bound", "FIRSTDATE": "a date bound"}
FUNCTIONS = set(scalars.REGISTRY) | AGGREGATES | set(ITERATORS) | set(TO_DATE) | TABLE_FUNCTIONS | {"CALCULATE", "COUNTROWS", "CONCATENATEX", "RELATED", "KEEPFILTERS", "REMOVEFILTERS", "ROLLUPADDISSUBTOTAL", "ROLLUPGROUP", "LASTNONBLANK"}


class _NotRowLevel(Exception):
    pass


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _all(conditions: Iterable[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


class Evaluator:
    def __init__(self, spark: SparkSession, model: Model) -> None:
        self.spark, self.model = spark, model.copy()
        self._names: dict[ModelColumn, str] = {}
        #: computed group keys, as columns of a table
        self._virtual: dict[ModelColumn, Node] = {}
        self.time = TimeIntelligence(self)
        self._expanding: list[str] = []

    # model tables

    def mcol(self, table: str, column: str) -> str:
        return self._names.setdefault((table, column), f"m{len(self._names)}")

    def base(self, table: str) -> DataFrame:
        t = self.model.table(table)
        df = t.df.select(*[F.col(f"`{c}`").alias(self.mcol(table, c)) for c in t.columns])
        for (vt, name), node in self._virtual.items():
            if vt == table:
                df = df.withColumn(self.mcol(vt, name), self.row_column(node))
        return df

    def base_types(self, of: ModelColumn) -> tuple[ModelColumn, str]:
        """The column, and its type."""
        return of, self.base(of[0]).select(self.mcol(*of)).dtypes[0][1]

    def outs_of(self, table: str) -> list[Out]:
        t = self.model.table(table)
        return [Out(c, self.mcol(table, c), t.lineage.get(c, (table, c))) for c in t.columns]

    def _join(self, df: DataFrame, step: Step, how: str = "left") -> DataFrame:
        return df.join(self.base(step.target[0]), _same(self.mcol(*step.source), self.mcol(*step.target)), how)

    def tree(self, roots: tuple[str, ...], wanted: Iterable[str], allowed, at=None) -> tuple[DataFrame, list[str]]:
        """The roots' rows with the wanted tables left joined along relationships; and the joined tables."""
        joined, df = [roots[0]], self.base(roots[0])
        for t in [*roots[1:], *wanted]:
            if t in joined:
                continue
            way = self.model.path(joined, t, allowed, at)
            if way is None and t in roots:
                way = self.model.path(joined, t, lambda s: True, at)
            if way is None:
                raise QueryError("emit", f"no relationship path from {', '.join(joined)} to {t}", at)
            for step in way:
                if step.target[0] not in joined:
                    df = self._join(df, step)
                    joined.append(step.target[0])
        return df, joined

    def reaches(self, filtering: str, roots: Iterable[str]) -> bool:
        return any(self.model.filter_reaches(filtering, r) for r in roots)

    # references

    def measure_of(self, n: Node) -> Node | None:
        """The expression of a measure reference."""
        if not isinstance(n, ColumnRef):
            return None
        if n.table is not None and (t := self.model.find_table(n.table, n.at)) is not None and t.column(n.name) is not None:
            return None
        m = self.model.find_measure(n.table, n.name, n.at)
        return m.expr if m is not None else None

    def model_column(self, n: ColumnRef) -> ModelColumn:
        if n.table is None:
            raise QueryError("resolve", f"unknown measure [{n.name}]", n.at)
        t, c = self.model.column(n.table, n.name, n.at)
        return t, c

    def frame_column(self, n: ColumnRef, rows: tuple[Frame, ...]) -> str | None:
        """The points' column that holds the reference's value in the innermost row that has it."""
        of = None
        if n.table is not None:
            t = self.model.find_table(n.table, n.at)
            if t is None or (c := t.column(n.name)) is None:
                of = None
            else:
                of = (t.name, c)
        for frame in reversed(rows):
            for o in frame.outs:
                if of is not None and (o.lineage == of or (self.model.tables[of[0]].lineage.get(of[1]) == o.lineage and o.lineage is not None)):
                    return o.col
                if n.table is None and o.name.lower() == n.name.lower():
                    return o.col
        return None

    def is_set_level(self, n: Node) -> bool:
        """Whether the node itself needs aggregation or a table."""
        return (isinstance(n, Call) and (n.name in AGGREGATES or n.name in ITERATORS or n.name in TO_DATE or n.name in ("CALCULATE", "COUNTROWS", "CONCATENATEX") or n.name in TABLE_FUNCTIONS)) or self.measure_of(n) is not None

    def has_set_level(self, n: Node) -> bool:
        return any(self.is_set_level(x) for x in walk(n))

    def value_tables(self, n: Node) -> list[str]:
        """The tables that the aggregates in an expression, measures expanded, read."""
        found: dict[str, None] = {}

        def visit(x: Node, seen: tuple[Node, ...]) -> None:
            if (m := self.measure_of(x)) is not None:
                if m in seen:
                    raise QueryError("resolve", f"circular measure reference [{x.name}]", x.at)
                visit(m, (*seen, m))
                return
            if isinstance(x, Call) and x.name in AGGREGATES:
                for r in walk(x):
                    if isinstance(r, ColumnRef) and r.table is not None and self.measure_of(r) is None:
                        found[self.model_column(r)[0]] = None
                return
            if isinstance(x, Call) and (x.name in ITERATORS or x.name in ("COUNTROWS", "CONCATENATEX", "CALCULATETABLE", "RELATEDTABLE")):
                for r in walk(x.args[0] if x.args else x):
                    if isinstance(r, TableRef) and (t := self.model.find_table(r.name, r.at)) is not None:
                        found[t.name] = None
                    elif isinstance(r, ColumnRef) and r.table is not None and self.measure_of(r) is None and not isinstance(x.args[0], TableRef):
                        found[self.model_column(r)[0]] = None
            if isinstance(x, Call) and x.name == "CALCULATE":
                visit(x.args[0], seen)
                return
            for c in children(x):
                visit(c, seen)

        visit(n, ())
        return list(found)

    # row-level expressions over model columns

    def row_column(self, n: Node, needed: set[str] | None = None, corr: set[str] | None = None) -> Column:
        """A bound expression as a column over joined model tables."""

        def leaf(x: Node) -> Column | None:
            if isinstance(x, PointRef):
                if corr is not None:
                    corr.add(x.col)
                return F.col(x.col)
            if isinstance(x, Call) and x.name == "RELATED":
                x = x.args[0]
            if isinstance(x, ColumnRef):
                t, c = self.model_column(x)
                if needed is not None:
                    needed.add(t)
                return F.col(self.mcol(t, c))
            if self.is_set_level(x):
                raise _NotRowLevel
            return None

        return self._operators(n, leaf)

    def _operators(self, n: Node, leaf) -> Column:
        if (found := leaf(n)) is not None:
            return found
        go = lambda x: self._operators(x, leaf)
        match n:
            case Literal():
                return F.lit(n.value)
            case Unary():
                return -go(n.arg)
            case Binary():
                return self._binary(n, go)
            case Call() if n.name in scalars.REGISTRY:
                return self._scalar_call(n, go)
            case Call() if n.name in ONLY_INSIDE:
                raise QueryError("emit", f"{n.name} is supported only in {ONLY_INSIDE[n.name]}", n.at)
            case Call():
                raise QueryError("emit", f"unknown function {n.name}" if n.name not in FUNCTIONS else f"{n.name} gives a table, not a value", n.at)
            case TableRef():
                raise QueryError("emit", f"table {n.name!r} stands where a value is needed", n.at)
        raise QueryError("emit", "unexpected expression", n.at)

    def _binary(self, n: Binary, go) -> Column:
        a, b = go(n.left), go(n.right)
        match n.op:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return scalars.divide(a, b)
            case "^":
                return F.pow(scalars.number(a), scalars.number(b))
            case "&":
                return scalars.concat(a, b)
            case "=":
                return a == b
            case "==":
                return a.eqNullSafe(b)
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "&&":
                return a & b
            case "||":
                return a | b
        raise QueryError("emit", f"unknown operator {n.op}", n.at)

    def _scalar_call(self, n: Call, go) -> Column:
        f = scalars.REGISTRY[n.name]
        if not f.least <= len(n.args) <= f.most:
            wanted = str(f.least) if f.least == f.most else f"{f.least} to {f.most}"
            raise QueryError("emit", f"{n.name} takes {wanted} arguments, not {len(n.args)}", n.at)
        args = []
        for i, a in enumerate(n.args):
            if i in f.literal:
                if isinstance(a, TableRef):
                    args.append(a.name)
                elif isinstance(a, Literal):
                    args.append(a.value)
                else:
                    raise QueryError("emit", f"argument {i + 1} of {n.name} must be a literal", a.at)
            else:
                args.append(go(a))
        try:
            return f.make(*args)
        except QueryError as e:
            raise QueryError("emit", e.message, n.at) from e

    # scalar expressions at points

    def scalar(self, n: Node, pts: Points, ctx: Context) -> Column:
        def leaf(x: Node) -> Column | None:
            if isinstance(x, PointRef):
                return F.col(x.col)
            if isinstance(x, ColumnRef):
                return self._reference(x, pts, ctx)
            if isinstance(x, Call):
                return self._set_level(x, pts, ctx)
            return None

        return self._operators(n, leaf)

    def _reference(self, n: ColumnRef, pts: Points, ctx: Context) -> Column:
        own = n.table is None and self.frame_column(n, tuple(Frame(tuple(o for o in f.outs if o.lineage is None)) for f in ctx.rows))
        if own:
            return F.col(own)
        if (m := self.measure_of(n)) is not None:
            return self._measure(n, m, pts, ctx)
        if (c := self.frame_column(n, ctx.rows)) is not None:
            return F.col(c)
        of = self.model_column(n)
        for k in reversed(ctx.keys):
            if k.of == of:
                return F.col(k.col)
        if (c := self._expanded_column(of, pts, ctx)) is not None:
            return F.col(c)
        raise QueryError("emit", f"{of[0]}[{of[1]}] has no single value here: there is no row of {of[0]}", n.at)

    def _measure(self, n: ColumnRef, m: Node, pts: Points, ctx: Context) -> Column:
        name = n.name.lower()
        if name in self._expanding:
            raise QueryError("resolve", f"circular measure reference [{n.name}]", n.at)
        self._expanding.append(name)
        try:
            return self.scalar(m, pts, self.transition(pts, ctx, self.value_tables(m)))
        finally:
            self._expanding.pop()

    def _set_level(self, n: Call, pts: Points, ctx: Context) -> Column | None:
        name = n.name
        if name in AGGREGATES:
            if len(n.args) != 1:
                raise QueryError("emit", f"{name} takes 1 argument, not {len(n.args)}", n.at)
            return self.aggregate(name, n.args[0], None, pts, ctx, n)
        if name in ITERATORS:
            if len(n.args) != 2:
                raise QueryError("emit", f"{name} takes 2 arguments, not {len(n.args)}", n.at)
            return self.iterate(ITERATORS[name], n.args[0], n.args[1], pts, ctx, n)
        if name == "CONCATENATEX":
            if len(n.args) not in (2, 3):
                raise QueryError("emit", f"CONCATENATEX takes 2 or 3 arguments, not {len(n.args)}", n.at)
            delimiter = n.args[2] if len(n.args) == 3 else Literal(", ")
            if not isinstance(delimiter, Literal):
                raise QueryError("emit", "the delimiter of CONCATENATEX must be a literal", n.at)
            return self.iterate(f"CONCAT {delimiter.value}", n.args[0], n.args[1], pts, ctx, n)
        if name == "COUNTROWS":
            if len(n.args) != 1:
                raise QueryError("emit", f"COUNTROWS takes 1 argument, not {len(n.args)}", n.at)
            if isinstance(n.args[0], TableRef) and self._is_model_table(n.args[0]):
                return self.aggregate("ROWS", Literal(1), self.model.table(n.args[0].name, n.at).name, pts, ctx, n)
            return F.coalesce(self.iterate("COUNT", n.args[0], Literal(1), pts, ctx, n), F.lit(0).cast("long"))
        if name == "CALCULATE":
            return self.calculate(n, pts, ctx)
        if name in TO_DATE:
            if len(n.args) < 2:
                raise QueryError("emit", f"{name} takes an expression and a date column", n.at)
            return self.calculate(Call("CALCULATE", (n.args[0], Call(TO_DATE[name], (n.args[1],), at=n.at), *n.args[2:]), at=n.at), pts, ctx)
        if name == "RELATED":
            if len(n.args) != 1 or not isinstance(n.args[0], ColumnRef):
                raise QueryError("emit", "RELATED takes a column", n.at)
            of = self.model_column(n.args[0])
            if (c := self.frame_column(n.args[0], ctx.rows)) is not None:
                return F.col(c)
            if (c := self._expanded_column(of, pts, ctx)) is not None:
                return F.col(c)
            raise QueryError("emit", f"RELATED({of[0]}[{of[1]}]) needs a row of a table on the many side", n.at)
        return None

    def _is_model_table(self, n: Node) -> bool:
        return isinstance(n, TableRef) and self.model.find_table(n.name, n.at) is not None

    def _expanded_column(self, of: ModelColumn, pts: Points, ctx: Context) -> str | None:
        """A column of a table on the one side of an iterated row's table."""
        for frame in reversed(ctx.rows):
            if frame.table is not None and of[0] in self.model.expanded(frame.table)[1:]:
                return self._expand(pts, frame, [of[0]])[of]
        return None

    def _expand(self, pts: Points, frame: Frame, tables: list[str]) -> dict[ModelColumn, str]:
        """Join tables on the one sides of a frame's table to the points; the points' column of each of their columns."""
        known = pts.expanded.setdefault((frame.outs, frame.table), {})
        cols = {o.lineage: o.col for o in frame.outs}
        for target in tables:
            for step in self.model.path([frame.table], target, self.model.expands) or []:
                t = step.target[0]
                if any(k[0] == t for k in known):
                    continue
                names = {c: fresh("e") for c in self.model.table(t).columns}
                right = self.base(t).select(*[F.col(self.mcol(t, c)).alias(x) for c, x in names.items()])
                left = cols.get(step.source) or known.get(step.source)
                self.flush(pts)
                pts.df = pts.df.join(right, _same(left, names[step.target[1]]), "left")
                known.update({(t, c): x for c, x in names.items()})
        return known

    # aggregates

    def bind(self, n: Node, pts: Points, ctx: Context, own: set[str]) -> Node:
        """References to outer rows and aggregates become columns of the points; those to the tables `own` stay model columns."""
        if isinstance(n, ColumnRef):
            if self.measure_of(n) is None:
                if n.table is not None and (t := self.model.find_table(n.table, n.at)) is not None and t.name in own:
                    self.model_column(n)
                    return n
                if (c := self.frame_column(n, ctx.rows)) is not None:
                    return PointRef(c, at=n.at)
                self.model_column(n)
                return n
        if isinstance(n, Call) and n.name == "RELATED":
            return n
        if self.is_set_level(n):
            c = self.scalar(n, pts, ctx)
            self.flush(pts)
            return PointRef(pts.add(c), at=n.at)
        return rebuilt(n, tuple(self.bind(c, pts, ctx, own) for c in children(n)))

    def _aggregate_column(self, name: str, c: Column) -> Column:
        rows = F.count(F.lit(1))
        match name:
            case "SUM":
                return F.sum(c)
            case "AVERAGE":
                return F.avg(c.cast("double"))
            case "MIN":
                return F.min(c)
            case "MAX":
                return F.max(c)
            case "MEDIAN":
                return F.median(c.cast("double"))
            case "COUNT" | "COUNTA":
                return F.count(c)
            case "ROWS":
                return rows
            case "COUNTBLANK":
                return F.when(rows > 0, F.count_if(c.isNull()))
            case "DISTINCTCOUNT":
                return F.when(rows > 0, F.count_distinct(c) + F.max(c.isNull().cast("int")))
        if name.startswith("CONCAT "):
            return F.array_join(F.array_sort(F.collect_list(scalars.text(c))), name[7:])
        raise AssertionError(name)

    def aggregate(self, name: str, arg: Node, root: str | None, pts: Points, ctx: Context, n: Node) -> Column:
        """An aggregate of a row-level expression over one table (or the tables that it names), in the filter context."""
        own = {root} if root else {self.model_column(r)[0] for r in walk(arg) if isinstance(r, ColumnRef) and r.table is not None and self.measure_of(r) is None}
        bound = self.bind(arg, pts, ctx, own)
        needed: set[str] = set()
        corr: set[str] = set()
        column = self.row_column(bound, needed, corr)
        roots = (root,) if root else tuple(sorted(own))
        if not roots:
            raise QueryError("emit", f"{name} needs a column", n.at)
        key = (ctx.keys, ctx.filters, roots, tuple(sorted(corr)))
        memo = (key, name, bound)
        if memo in pts.memo:
            return F.col(pts.memo[memo])
        alias = fresh("a")
        request = pts.pending.get(key)
        if request is None:
            request = pts.pending[key] = Request(Context(ctx.keys, ctx.filters), roots)
        request.needed |= needed
        request.corr |= corr
        request.aggregates.append((alias, name, column))
        pts.memo[memo] = alias
        return F.col(alias)

    def flush(self, pts: Points) -> None:
        """Join all aggregates that were asked for to the points."""
        if pts.df is None:
            return
        pending, pts.pending = pts.pending, {}
        for request in pending.values():
            found, on = self.grouped(request, pts)
            pts.attach(found, on)

    def _routes(self, ctx: Context, roots: tuple[str, ...]) -> tuple[list[Key], list[Filter]]:
        """The keys and filters that reach the tables; others don't change what is aggregated."""
        keys = [k for k in ctx.keys if self.reaches(k.table, roots)]
        filters = [f for f in ctx.filters if all(self.reaches(t, roots) for t in f.tables)]
        return keys, filters

    def scan(self, roots: tuple[str, ...], keys: list[Key], filters: list[Filter], needed: set[str]) -> tuple[DataFrame, list[Filter]]:
        """Rows of the roots, joined with all that keys and filters name, under the filters that don't depend on points; and the filters that do.

        A table beyond a both-way relationship is never joined row by row: filters there keep the rows that have a
        match, and keys there are joined by their distinct values for each row's anchor.
        """
        wanted = list(dict.fromkeys([*sorted(needed - set(roots)), *[k.table for k in keys], *[t for f in filters for t in sorted(f.tables)]]))
        near, far = [], {}
        for t in wanted:
            if t in roots or self.model.path(list(roots), t, self.model.expands) is not None:
                near.append(t)
                continue
            way = self.model.path(list(roots), t, self.model.filters)
            if way is None:
                near.append(t)  # an error there
                continue
            i = next(i for i, s in enumerate(way) if not s.forward)
            far[t] = (way[i], way[i + 1 :])
            near.append(way[i].source[0])
        df, _ = self.tree(roots, list(dict.fromkeys(near)), self.model.expands)
        mine = [f for f in filters if not f.tables & set(far)]
        waiting = []
        for f in mine:
            if f.corr:
                waiting.append(f)
            else:
                df = self.filtered(df, f)
        for bridge in dict.fromkeys(step for step, _ in far.values()):
            tables = [t for t, (s, _) in far.items() if s == bridge]
            there = [f for f in filters if f.tables & set(tables)]
            if any(f.corr for f in there):
                raise QueryError("emit", "a filter beyond a both-way relationship can't depend on a row")
            sub, _ = self.tree((bridge.target[0],), [t for t in tables if t != bridge.target[0]], self.model.filters)
            for f in there:
                sub = self.filtered(sub, f)
            anchor = fresh("b")
            cols = [self.mcol(*k.of) for k in keys if k.table in tables]
            link = sub.select(F.col(self.mcol(*bridge.target)).alias(anchor), *dict.fromkeys(cols)).distinct()
            match = _same(self.mcol(*bridge.source), anchor)
            df = df.join(link, match, ("inner" if there else "left") if cols else "left_semi")
        return df, waiting

    def filtered(self, df: DataFrame, f: Filter) -> DataFrame:
        """Rows of joined model tables that pass a filter which doesn't depend on points."""
        if f.kind == "expr":
            return df.where(self.row_column(f.payload))
        if f.kind == "in":
            columns, rows = f.payload
            if len(columns) == 1:
                c = F.col(self.mcol(*columns[0]))
                values = [r[0] for r in rows if r[0] is not None]
                test = c.isin(values) if values else F.lit(False)
                return df.where(test | c.isNull() if len(values) < len(rows) else test)
            test = None
            for r in rows:
                one = _all(F.col(self.mcol(*c)).eqNullSafe(F.lit(v)) for c, v in zip(columns, r, strict=True))
                test = one if test is None else test | one
            return df.where(test)
        if f.kind == "semi":
            columns, rel, cols = f.payload
            names = [fresh("s") for _ in cols]
            right = rel.df.select(*[F.col(c).alias(x) for c, x in zip(cols, names, strict=True)]).distinct()
            return df.join(right, _all(_same(self.mcol(*c), x) for c, x in zip(columns, names, strict=True)), "left_semi")
        if f.kind == "window":
            return df.where(self.time.inside(F.col(self.mcol(*f.columns[0])), f.payload))
        raise AssertionError(f.kind)

    def matched(self, df: DataFrame, keys: list[Key], waiting: list[Filter], pts: Points, extra: set[str]) -> tuple[DataFrame, tuple[str, ...]]:
        """Rows of joined model tables with the distinct points that see them."""
        used = tuple(dict.fromkeys([*[k.col for k in keys], *[c for f in waiting for c in f.corr], *sorted(extra)]))
        seen = pts.distinct(used)
        conditions = [_same(self.mcol(*k.of), k.col) for k in keys]
        for f in waiting:
            if f.kind == "window":
                # distinct bounds meet days first, then rows by their day, and points by their bounds. There are no more days than dates: under 30 MB
                t, c = f.columns[0]
                day, own = fresh("d"), {x: fresh("w") for x in f.corr}
                payload = tuple(own.get(x, x) if isinstance(x, str) else x for x in f.payload)
                days = self.base(t).select(F.to_date(self.mcol(t, c)).alias(day)).where(F.col(day).isNotNull()).distinct()
                windows = pts.distinct(f.corr).select(*[F.col(x).alias(y) for x, y in own.items()]).join(F.broadcast(days), self.time.near(F.col(day), payload))
                df = df.join(windows, (F.to_date(self.mcol(t, c)) == F.col(day)) & self.time.inside(F.col(self.mcol(t, c)), payload))
                conditions += [_same(x, y) for x, y in own.items()]
            elif f.kind == "expr":
                conditions.append(self.row_column(f.payload))
            elif f.kind == "semi":
                columns, rel, cols = f.payload
                names = {c: fresh("s") for c in (*cols, *rel.corr)}
                right = rel.df.select(*[F.col(c).alias(x) for c, x in names.items()]).distinct()
                seen = seen.join(right, _all(_same(c, names[c]) for c in rel.corr))
                conditions += [_same(self.mcol(*m), names[c]) for m, c in zip(columns, cols, strict=True)]
        condition = _all(conditions)
        return (seen.join(df, condition) if condition is not None else seen.crossJoin(df)), used

    def grouped(self, request: Request, pts: Points) -> tuple[DataFrame, tuple[str, ...]]:
        """The aggregates of a request by columns of the points."""
        keys, filters = self._routes(request.context, request.roots)
        df, waiting = self.scan(request.roots, keys, filters, request.needed)
        columns = self.columns_of(request)
        if not waiting and not request.corr:
            by: dict[ModelColumn, str] = {}
            same = []
            for k in keys:
                if k.of in by:
                    same.append((k.col, by[k.of]))
                else:
                    by[k.of] = k.col
            if same:  # one column at two points' columns: both must be equal
                df, used = self.matched(df, keys, [], pts, set())
                return df.groupBy(*used).agg(*columns), used
            found = df.groupBy(*[F.col(self.mcol(*of)).alias(col) for of, col in by.items()]).agg(*columns)
            return found, tuple(by.values())
        if not request.corr and all(f.kind == "window" for f in waiting) and all(name in IN_PARTS for _, name, _ in request.aggregates):
            # a row may be in many windows: sums of each day go into them, not rows
            by = list(dict.fromkeys([self.mcol(*k.of) for k in keys] + [self.mcol(*f.columns[0]) for f in waiting]))
            parts = [(alias, name, fresh("p")) for alias, name, _ in request.aggregates]
            df = df.groupBy(*by).agg(*[self._aggregate_column(name, c).alias(p) for (_, name, p), (_, _, c) in zip(parts, request.aggregates, strict=True)])
            columns = [self._aggregate_column(IN_PARTS[name], F.col(p)).alias(alias) for alias, name, p in parts]
        df, used = self.matched(df, keys, waiting, pts, request.corr)
        return df.groupBy(*used).agg(*columns), used

    def columns_of(self, request: Request) -> list[Column]:
        return [self._aggregate_column(name, c).alias(alias) for alias, name, c in request.aggregates]

    # context transition and CALCULATE

    def transition(self, pts: Points, ctx: Context, values: list[str]) -> Context:
        """Every column of the rows that are iterated becomes a filter; a row of a table brings the tables on its one sides."""
        if all(f.done for f in ctx.rows):
            return ctx
        keys = list(ctx.keys)
        for frame in ctx.rows:
            if frame.done:
                continue
            keys += [Key(*o.lineage, o.col) for o in frame.outs if o.lineage is not None and o.lineage[0] in self.model.tables]
            if frame.table is None:
                continue
            beyond = [t for t in self.model.expanded(frame.table)[1:]]
            wanted = [t for t in beyond for v in values if not self.model.filter_reaches(frame.table, v) and self.model.filter_reaches(t, v)]
            if wanted:
                keys += [Key(*of, c) for of, c in self._expand(pts, frame, list(dict.fromkeys(wanted))).items() if of[0] in wanted]
        return replace(ctx, keys=tuple(dict.fromkeys(keys)), rows=tuple(replace(f, done=True) for f in ctx.rows))

    def calculate(self, n: Call, pts: Points, ctx: Context) -> Column:
        if not n.args:
            raise QueryError("emit", "CALCULATE takes an expression", n.at)
        inner = self.modified(n.args[1:], pts, ctx, [*self.value_tables(n.args[0]), *[t for a in n.args[1:] for t in self.value_tables(a)]])
        return self.scalar(n.args[0], pts, inner)

    def modified(self, args: tuple[Node, ...], pts: Points, ctx: Context, values: list[str]) -> Context:
        """The context after a transition and the filter arguments: all are evaluated in the context before them, then what they clear goes, then what they add comes."""
        before = self.transition(pts, ctx, values)
        clears, adds = [], []
        for a in args:
            self._argument(a, pts, before, clears, adds)
        after = before
        for clear in clears:
            after = clear(after)
        return after.adding(*adds)

    def _argument(self, a: Node, pts: Points, ctx: Context, clears: list, adds: list, keep: bool = False) -> None:
        if isinstance(a, Call) and a.name == "KEEPFILTERS":
            if len(a.args) != 1:
                raise QueryError("emit", "KEEPFILTERS takes 1 argument", a.at)
            self._argument(a.args[0], pts, ctx, clears, adds, True)
            return
        if isinstance(a, Call) and a.name in ("ALL", "REMOVEFILTERS", "ALLEXCEPT"):
            clears.append(self._clearing(a))
            return
        if isinstance(a, Call) and a.name in TIME_FUNCTIONS:
            f = self.time.window(a, pts, ctx)
            (t, c) = f.columns[0]
            if not keep:
                clears.append((lambda x, t=t: x.without_table(t)) if self.model.date_tables.get(t) == c else (lambda x, of=(t, c): x.without_columns({of})))
            adds.append(f)
            return
        if isinstance(a, Call) and a.name == "FILTER":
            source = a.args[0]
            if isinstance(source, Call) and source.name in ("ALL", "ALLEXCEPT") and not keep:
                clears.append(self._clearing(source))
            if len(a.args) == 2 and not self.has_set_level(a.args[1]) and (self._is_model_table(source) or (isinstance(source, Call) and source.name == "ALL")):
                adds.append(self.predicate(a.args[1], pts, ctx))
                return
            adds.append(self._semi(a, pts, ctx))
            return
        if isinstance(a, Call) and a.name == "TREATAS":
            f = self.treatas(a, pts, ctx)
        elif isinstance(a, Call) and a.name in TABLE_FUNCTIONS:
            f = self._semi(a, pts, ctx)
        elif isinstance(a, TableRef):
            f = self._semi(a, pts, ctx)
        else:
            f = self.predicate(a, pts, ctx)
        if not keep:
            clears.append(lambda x, of=set(f.columns): x.overridden(of))
        adds.append(f)

    def _clearing(self, a: Call):
        if not a.args:
            return lambda x: x.without_all()
        if a.name == "ALLEXCEPT":
            t = self.model.table(a.args[0].name, a.at).name if isinstance(a.args[0], TableRef) else None
            if t is None:
                raise QueryError("emit", "ALLEXCEPT takes a table, then columns", a.at)
            but = {self.model_column(c)[1] for c in a.args[1:]}
            return lambda x: x.without_table(t, but)
        tables = [self.model.table(x.name, x.at).name for x in a.args if isinstance(x, TableRef)]
        columns = {self.model_column(x) for x in a.args if isinstance(x, ColumnRef)}
        if len(tables) + sum(isinstance(x, ColumnRef) for x in a.args) < len(a.args):
            raise QueryError("emit", f"{a.name} takes tables or columns", a.at)

        def clear(x: Context) -> Context:
            for t in tables:
                x = x.without_table(t)
            return x.without_columns(columns) if columns else x

        return clear

    def predicate(self, n: Node, pts: Points, ctx: Context) -> Filter:
        """A boolean expression over model columns as a filter. If it names several tables, those that are iterated stand for their row."""
        refs = [r for r in walk(n) if isinstance(r, ColumnRef) and r.table is not None and self.measure_of(r) is None]
        tables = {self.model_column(r)[0] for r in refs}
        iterated = {t for t in tables if any(o.lineage is not None and o.lineage[0] == t for f in ctx.rows for o in f.outs)}
        own = tables - iterated if len(tables) > 1 and tables - iterated else tables
        bound = self.bind(n, pts, ctx, own)
        needed: set[str] = set()
        corr: set[str] = set()
        self.row_column(bound, needed, corr)
        columns = tuple(dict.fromkeys(self.model_column(r) for r in walk(bound) if isinstance(r, ColumnRef)))
        if not columns:
            raise QueryError("emit", "a filter must name a column", n.at)
        return Filter("expr", columns, bound, tuple(sorted(corr)), repr(bound))

    def _semi(self, n: Node, pts: Points, ctx: Context) -> Filter:
        rel = self.table(n, pts, ctx)
        outs = [o for o in rel.outs if o.lineage is not None]
        if not outs:
            raise QueryError("emit", "a table that filters must have columns of the model", n.at)
        return Filter("semi", tuple(o.lineage for o in outs), (tuple(o.lineage for o in outs), rel, tuple(o.col for o in outs)), rel.corr, fresh("f"))

    def treatas(self, n: Call, pts: Points, ctx: Context) -> Filter:
        if len(n.args) < 2:
            raise QueryError("emit", "TREATAS takes values, then columns", n.at)
        columns = tuple(self.model_column(c) if isinstance(c, ColumnRef) else self._bad_column(c) for c in n.args[1:])
        source = n.args[0]
        if isinstance(source, TableConstructor):
            if not source.rows:
                raise QueryError("emit", "TREATAS of an empty set", n.at)
            if any(len(r) != len(columns) for r in source.rows):
                raise QueryError("emit", f"TREATAS has {len(columns)} columns, but a row of another size", n.at)
            rows = tuple(tuple(self.literal(v) for v in r) for r in source.rows)
            return Filter("in", columns, (columns, rows), (), repr((columns, rows)))
        rel = self.table(source, pts, ctx)
        if len(rel.outs) != len(columns):
            raise QueryError("emit", f"TREATAS has {len(columns)} columns for {len(rel.outs)}", n.at)
        return Filter("semi", columns, (columns, rel, tuple(o.col for o in rel.outs)), rel.corr, fresh("f"))

    def _bad_column(self, n: Node):
        raise QueryError("emit", "a column is needed here", n.at)

    def literal(self, n: Node):
        """A value known when the query is planned."""
        if isinstance(n, Literal):
            return n.value
        if isinstance(n, Unary) and isinstance(n.arg, Literal):
            return -n.arg.value
        if isinstance(n, Call) and not any(isinstance(x, ColumnRef | TableRef) for x in walk(n)):
            c = self.row_column(n)
            return self.spark.range(1).select(c.alias("v")).first().v
        raise QueryError("emit", "a literal is needed here", n.at)

    # iteration

    def needs(self, nodes: Iterable[Node], ctx: Context, frame: Frame | None = None) -> tuple[str, ...]:
        """The outer points' columns that expressions depend on, inside a row of `frame`."""
        found: dict[str, None] = {}
        for n in nodes:
            if self.has_set_level(n):
                found.update(dict.fromkeys(ctx.point_columns()))
            for r in walk(n):
                if isinstance(r, PointRef):
                    found[r.col] = None
                elif isinstance(r, ColumnRef) and self.measure_of(r) is None:
                    if frame is not None and self.frame_column(r, (frame,)) is not None:
                        continue
                    if (c := self.frame_column(r, ctx.rows)) is not None:
                        found[c] = None
                    elif r.table is not None:
                        of = self.model_column(r)
                        found.update({k.col: None for k in ctx.keys if k.of == of})
        return tuple(found)

    def inside(self, rel: Rel, nodes: Iterable[Node], pts: Points | None, ctx: Context) -> tuple[Points, Context, Rel]:
        """Points and context for expressions in each row of `rel`; the rows are joined with the outer points that the expressions depend on."""
        frame = Frame(tuple(rel.outs), rel.table)
        needs = self.needs(nodes, ctx, frame) if pts is not None and pts.df is not None else ()
        if not needs and not rel.corr:
            return Points(rel.df), replace(ctx.detached(), rows=(frame,)), rel
        if not set(needs) <= set(rel.corr):
            self.flush(pts)
            every = tuple(dict.fromkeys([*rel.corr, *needs]))
            seen = pts.distinct(every)
            if rel.corr:
                names = {c: fresh("j") for c in rel.corr}
                right = rel.df.withColumnsRenamed(names)
                df = seen.join(right, _all(_same(c, x) for c, x in names.items())).drop(*names.values())
            else:
                df = seen.crossJoin(rel.df)
            rel = replace(rel, df=df, corr=every)
        has = set(rel.corr)
        keys = tuple(k for k in ctx.keys if k.col in has)
        filters = tuple(f for f in ctx.filters if set(f.corr) <= has)
        rows = tuple(f for f in ctx.rows if any(o.col in has for o in f.outs))
        return Points(rel.df, rel.corr), Context(keys, filters, (*rows, frame)), rel

    def iterate(self, name: str, table: Node, body: Node, pts: Points, ctx: Context, n: Node) -> Column:
        """An aggregate of an expression in each row of a table."""
        bare = self._is_model_table(table)
        if bare and not self.has_set_level(body):
            return self.aggregate(name, body, self.model.table(table.name, n.at).name, pts, ctx, n)
        memo = ("iterate", name, table, body, ctx.keys, ctx.filters, ctx.rows)
        if memo in pts.memo:
            return F.col(pts.memo[memo])
        if pts.df is None:
            raise _NotRowLevel
        rel = self.table(table, pts, ctx, honor=bare)
        inner, inner_ctx, rel = self.inside(rel, [body], pts, ctx)
        v = self.scalar(body, inner, inner_ctx)
        self.flush(inner)
        alias = fresh("a")
        found = inner.df.groupBy(*rel.corr).agg(self._aggregate_column(name, v).alias(alias))
        self.flush(pts)
        pts.attach(found, rel.corr)
        pts.memo[memo] = alias
        return F.col(alias)

    # tables: see operators.tables

    def table(self, n: Node, pts: Points | None = None, ctx: Context | None = None, honor: bool = False) -> Rel:
        from ..operators import tables

        return tables.evaluate(self, n, pts if pts is not None else Points(None), ctx or Context(), honor)

    def variable(self, name: str, rel: Rel) -> None:
        """From now on `name` is a table with these rows."""
        if self.model.find_table(name) is not None:
            raise QueryError("resolve", f"variable {name!r} has the name of a table")
        df = rel.df.select(*[F.col(o.col).alias(o.name) for o in rel.outs])
        self.model.tables[name] = Table(name, df, lineage={o.name: o.lineage for o in rel.outs if o.lineage is not None})


__all__ = ["AGGREGATES", "FUNCTIONS", "ITERATORS", "PERIODS", "AmbiguousPathError", "Evaluator", "Window"]
