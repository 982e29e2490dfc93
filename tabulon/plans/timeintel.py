"""Time intelligence: windows of dates between bounds that come from the first and last date in context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..lang.nodes import Call, ColumnRef, Literal, Node, TableRef, Unary
from .context import Context, Filter, Frame, Key, Out, Points, Rel, fresh

TO_DATE = {"DATESYTD": "YEAR", "DATESQTD": "QUARTER", "DATESMTD": "MONTH"}
PREVIOUS = {"PREVIOUSYEAR": "YEAR", "PREVIOUSQUARTER": "QUARTER", "PREVIOUSMONTH": "MONTH", "PREVIOUSDAY": "DAY"}
NEXT = {"NEXTYEAR": "YEAR", "NEXTQUARTER": "QUARTER", "NEXTMONTH": "MONTH", "NEXTDAY": "DAY"}
PERIODS = {"YEAR": 12, "QUARTER": 3, "MONTH": 1, "DAY": 0}
TIME_FUNCTIONS = {*TO_DATE, *PREVIOUS, *NEXT, "SAMEPERIODLASTYEAR", "DATEADD", "DATESBETWEEN", "DATESINPERIOD"}


def shift(c: Column, n: int, unit: str) -> Column:
    """n units later; the end of a month is kept within the month."""
    if unit == "DAY":
        return c + F.make_dt_interval(F.lit(n))
    return c + F.make_ym_interval(F.lit(0), F.lit(n * PERIODS[unit]))


def begin(c: Column, unit: str) -> Column:
    return F.date_trunc(unit.lower(), c)


class TimeIntelligence:
    def __init__(self, evaluator) -> None:
        self.e = evaluator

    def inside(self, c: Column, payload: tuple) -> Column:
        """payload: column of the lower bound or None, whether it belongs to the window; the same of the upper one."""
        low, low_in, high, high_in = payload
        test = c.isNotNull()
        if low is not None:
            test = test & ((c >= F.col(low)) if low_in else (c > F.col(low)))
        if high is not None:
            test = test & ((c <= F.col(high)) if high_in else (c < F.col(high)))
        return test

    def near(self, day: Column, payload: tuple) -> Column:
        """Days that may hold times inside."""
        low, _, high, _ = payload
        test = day.isNotNull()
        if low is not None:
            test = test & (day >= F.to_date(F.col(low)))
        if high is not None:
            test = test & (day <= F.to_date(F.col(high)))
        return test

    def window(self, n: Call, pts: Points, ctx: Context) -> Filter:
        """The window of a time function as a filter; its bounds become columns of the points."""
        if not n.args or not isinstance(n.args[0], ColumnRef):
            raise QueryError("emit", f"{n.name} takes a date column", n.at)
        of = self.e.model_column(n.args[0])
        column = n.args[0]
        wants = {"DATEADD": 3, "DATESBETWEEN": 3, "DATESINPERIOD": 4}.get(n.name, 1)
        if len(n.args) != wants:
            raise QueryError("emit", f"{n.name} takes {wants} argument{'s' * (wants > 1)}, not {len(n.args)}", n.at)
        low_in = high_in = True
        first = lambda: self.bound(Call("FIRSTDATE", (column,), at=n.at), pts, ctx)
        last = lambda: self.bound(Call("LASTDATE", (column,), at=n.at), pts, ctx)
        if n.name in TO_DATE:
            high = last()
            low = begin(high, TO_DATE[n.name])
        elif n.name in PREVIOUS:
            unit = PREVIOUS[n.name]
            high, high_in = begin(first(), unit), False
            low = shift(high, -1, unit)
        elif n.name in NEXT:
            unit = NEXT[n.name]
            low = shift(begin(last(), unit), 1, unit)
            high, high_in = shift(low, 1, unit), False
        elif n.name == "SAMEPERIODLASTYEAR":
            low, high = shift(first(), -1, "YEAR"), shift(last(), -1, "YEAR")
        elif n.name == "DATEADD":
            step, unit = self._count(n.args[1]), self._unit(n.args[2])
            low, high = shift(first(), step, unit), shift(last(), step, unit)
        elif n.name == "DATESBETWEEN":
            low, high = (self.bound(a, pts, ctx) for a in n.args[1:])
            if low is None and high is None:
                raise QueryError("emit", "DATESBETWEEN needs a bound that is not blank", n.at)
        else:
            start, step, unit = self.bound(n.args[1], pts, ctx), self._count(n.args[2]), self._unit(n.args[3])
            if start is None:
                raise QueryError("emit", "DATESINPERIOD needs a start date", n.at)
            end = shift(start, step, unit)
            low, low_in, high, high_in = (end, False, start, True) if step < 0 else (start, True, end, False)
        self.e.flush(pts)
        names = []
        for c in (low, high):
            names.append(None if c is None else pts.add(c, "w"))
        payload = (names[0], low_in, names[1], high_in)
        return Filter("window", (of,), payload, tuple(x for x in names if x), repr(payload))

    def _count(self, n: Node) -> int:
        v = self.e.literal(n) if isinstance(n, Literal | Unary) else None
        if not isinstance(v, int) or isinstance(v, bool):
            raise QueryError("emit", "the number of periods must be a whole literal", n.at)
        return v

    def _unit(self, n: Node) -> str:
        if not isinstance(n, TableRef) or n.name.upper() not in PERIODS:
            raise QueryError("emit", f"the period must be one of {', '.join(PERIODS)}", n.at)
        return n.name.upper()

    def bound(self, n: Node, pts: Points, ctx: Context) -> Column | None:
        """A date bound at each point; None for BLANK()."""
        if isinstance(n, Call) and n.name == "BLANK" and not n.args:
            return None
        if isinstance(n, Call) and n.name in ("LASTDATE", "FIRSTDATE"):
            if len(n.args) != 1 or not isinstance(n.args[0], ColumnRef):
                raise QueryError("emit", f"{n.name} takes a date column", n.at)
            return self.e.aggregate("MAX" if n.name == "LASTDATE" else "MIN", n.args[0], None, pts, ctx, n)
        if isinstance(n, Call) and n.name == "LASTNONBLANK":
            return self.last_non_blank(n, pts, ctx)
        if isinstance(n, Literal) and isinstance(n.value, str):
            return F.lit(n.value).cast("date")
        return self.e.scalar(n, pts, ctx)

    def last_non_blank(self, n: Call, pts: Points, ctx: Context) -> Column:
        """The last date in context at which the expression is not blank: the dates in context become points of their own."""
        if len(n.args) != 2 or not isinstance(n.args[0], ColumnRef):
            raise QueryError("emit", "LASTNONBLANK takes a date column and an expression", n.at)
        if pts.df is None:
            raise QueryError("emit", "LASTNONBLANK is supported only in a date bound", n.at)
        t, c = self.e.model_column(n.args[0])
        self.e.flush(pts)
        keys, filters = self.e._routes(ctx, (t,))
        df, waiting = self.e.scan((t,), keys, filters, set())
        every = ctx.point_columns()
        date = fresh("l")
        if every:
            # every point with the dates that its keys on the dates' table allow
            seen, used = self.e.matched(df.select(*[self.e.mcol(*k.of) for k in keys if k.of != (t, c)], self.e.mcol(t, c)).distinct() if not waiting else df, keys, waiting, pts, set())
            dates = seen.select(*used, F.col(self.e.mcol(t, c)).alias(date)).distinct()
            rest = [x for x in every if x not in used]
            if rest:
                names = {x: fresh("j") for x in used}
                condition = None
                for x, y in names.items():
                    one = F.col(x).eqNullSafe(F.col(y))
                    condition = one if condition is None else condition & one
                cells, right = pts.distinct(every), dates.withColumnsRenamed(names)
                dates = (cells.crossJoin(right) if condition is None else cells.join(right, condition)).drop(*names.values())
        else:
            dates = df.select(F.col(self.e.mcol(t, c)).alias(date)).distinct()
        inner = Points(dates.where(F.col(date).isNotNull()))
        at_date = Context((*ctx.keys, Key(t, c, date)), ctx.filters, ctx.rows)
        v = self.e.scalar(n.args[1], inner, at_date)
        self.e.flush(inner)
        alias = fresh("a")
        found = inner.df.where(v.isNotNull()).groupBy(*every).agg(F.max(date).alias(alias))
        pts.attach(found, every)
        return F.col(alias)

    def dates(self, n: Call, pts: Points, ctx: Context) -> Rel:
        """A time function as a table: the distinct dates in its window."""
        here = pts if pts.df is not None else Points(self.e.spark.range(1).select())
        f = self.window(n, here, ctx)
        t, c = f.columns[0]
        col = self.e.mcol(t, c)
        dates = self.e.base(t).select(col).distinct()
        seen = here.distinct(f.corr)
        df = seen.join(dates, self.inside(F.col(col), f.payload))
        corr = f.corr if pts.df is not None else ()
        return Rel(df.select(*corr, col).distinct(), [Out(c, col, (t, c))], corr)


__all__ = ["PERIODS", "TIME_FUNCTIONS", "Frame", "TimeIntelligence"]
