"""The engine: a model and the queries on it."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import external
from .errors import QueryError, QueryTimeout, ServerBusy
from .lang.nodes import Call, ColumnRef, Literal, Node, Query, TableRef, rebuilt, children
from .lang.parser import parse
from .model.schema import Format, Measure, Model, Relationship
from .plans.context import Context, Out, Points, Rel
from .plans.evaluate import TABLE_FUNCTIONS, Evaluator


class Engine:
    """Holds one model, which changes as a whole: a query sees the model that there was when it began."""

    def __init__(self, spark: SparkSession, model: Model | None = None, lanes: int = 4, admission_s: float = 5.0, timeout_s: float = 60.0) -> None:
        self.spark, self._model, self._lock = spark, model or Model(), threading.RLock()
        self._seen: dict[int, tuple[int, int]] = {}
        self.lanes, self.admission_s, self.timeout_s = threading.BoundedSemaphore(lanes), admission_s, timeout_s

    @property
    def model(self) -> Model:
        return self._model

    # the model

    def _change(self, change):
        with self._lock:
            new = self._model.copy()
            result = change(new)
            self._model = new
            return result

    def add_table(self, name: str, df: DataFrame, is_view: bool = False) -> None:
        self._change(lambda m: m.add_table(name, df, is_view))

    def add_parquet(self, name: str, path: str) -> None:
        self.add_table(name, self.spark.read.parquet(path))

    def refresh(self, lake) -> bool:
        """Take over a lake's tables if it has a new snapshot since the last call; whether anything was taken. Measures and
        relationships stay; tables that are gone from the lake stay as they were last read."""
        now = lake.snapshot()
        if self._seen.get(id(lake)) == now:
            return False
        for name in lake.tables():
            self.add_table(name, lake.read(name))
        self._seen[id(lake)] = now
        return True

    def relate(self, from_table: str, from_column: str, to_table: str, to_column: str, bidirectional: bool = False) -> Relationship:
        return self._change(lambda m: m.relate(from_table, from_column, to_table, to_column, bidirectional))

    def unrelate(self, from_table: str, from_column: str, to_table: str, to_column: str) -> None:
        def change(m: Model) -> None:
            kept = [r for r in m.relationships if (r.from_table, r.from_column, r.to_table, r.to_column) != (from_table, from_column, to_table, to_column)]
            if len(kept) == len(m.relationships):
                raise QueryError("resolve", "there is no such relationship")
            m.relationships = kept

        self._change(change)

    def replace_relationship(self, old: tuple[str, str, str, str], new: tuple[str, str, str, str], bidirectional: bool = False) -> Relationship:
        """One relationship for another; nothing changes if the old one is missing, the new one is there in either direction, or the graph would be wrong."""

        def change(m: Model) -> Relationship:
            ends = [(r.from_table, r.from_column, r.to_table, r.to_column) for r in m.relationships]
            if old not in ends:
                raise QueryError("resolve", "the relationship to replace is not there")
            rest = [e for e in ends if e != old]
            if new in rest or (*new[2:], *new[:2]) in rest:
                raise QueryError("resolve", "the new relationship is there already")
            m.relationships = [r for r, e in zip(m.relationships, ends, strict=True) if e != old]
            return m.relate(*new, bidirectional)

        return self._change(change)

    def add_measure(self, table: str, name: str, text: str, format: Format | None = None) -> Measure:
        def change(m: Model) -> Measure:
            found = m.add_measure(table, name, text, format)
            e = Evaluator(self.spark, m)
            e.value_tables(ColumnRef(found.table, found.name))  # refuses circles and unknown columns
            return found

        return self._change(change)

    def drop_measure(self, table: str, name: str) -> None:
        def change(m: Model) -> None:
            if m.measures.pop(f"{m.table(table).name}\n{name}".lower(), None) is None:
                raise QueryError("resolve", f"there is no measure {table}[{name}]")

        self._change(change)

    def set_date_table(self, table: str, column: str) -> None:
        self._change(lambda m: m.set_date_table(table, column))

    def clear_date_table(self) -> None:
        self._change(lambda m: m.date_tables.clear())

    def hide(self, table: str, name: str | None = None, hidden: bool = True) -> None:
        """Hidden objects are left out of listings; queries may still name them."""
        self._change(lambda m: (m.hidden.add if hidden else m.hidden.discard)((m.table(table).name, name)))

    def schema(self, with_hidden: bool = False) -> dict:
        """Tables, columns, measures and relationships as plain values."""
        m = self._model
        shown = lambda t, x=None: with_hidden or ((t, None) not in m.hidden and (t, x) not in m.hidden)
        return {
            "tables": [{"name": t.name, "view": t.is_view, "columns": [{"name": c, "type": k} for c, k in t.df.dtypes if shown(t.name, c)]} for t in m.tables.values() if shown(t.name)],
            "measures": [{"table": x.table, "name": x.name, "expression": x.text, "format": x.format.__dict__ if x.format else None} for x in m.measures.values() if shown(x.table, x.name)],
            "relationships": [r.__dict__ for r in m.relationships],
            "dateTables": dict(m.date_tables),
        }

    # queries

    def query(self, text: str, filters: Iterable[external.ExternalFilter] = ()) -> DataFrame:
        """The result of a query as a DataFrame. Scalar variables are computed at once, all else when the result is read."""
        model = self._model.copy()
        q = external.apply(model, parse(text), list(filters))
        for d in q.measures:
            t = model.table(d.table, d.at)
            model.measures = {k: m for k, m in model.measures.items() if (m.table, m.name.lower()) != (t.name, d.name.lower())}
            model.measures[f"{t.name}\n{d.name}".lower()] = Measure(t.name, d.name, "", d.expr)
        e = Evaluator(self.spark, model)
        scalars: dict[str, Literal] = {}
        for v in q.variables:
            expr = _with_scalars(v.expr, scalars)
            if _is_table(e, expr):
                e.variable(v.name, e.table(expr))
            else:
                scalars[v.name.lower()] = Literal(self._scalar(e, expr), at=v.at)
        table = _with_scalars(q.table, scalars)
        rel = e.table(table) if _is_table(e, table) else self._one(e, table)
        df = _ordered(e, q, rel)
        return df

    def _one(self, e: Evaluator, n: Node) -> Rel:
        pts = Points(self.spark.range(1).select())
        c = e.scalar(n, pts, Context())
        e.flush(pts)
        return Rel(pts.df.select(c.alias("_value")), [Out("Value", "_value")])

    def _scalar(self, e: Evaluator, n: Node):
        rel = self._one(e, n)
        return rel.df.first()[0]

    def execute(self, text: str, filters: Iterable[external.ExternalFilter] = ()) -> dict:
        """Columns and rows as plain values: decimals as exact text, binary as hex. Takes a lane, or ServerBusy after the admission time; cancelled after the time limit."""
        if not self.lanes.acquire(timeout=self.admission_s):
            raise ServerBusy("execute", "all query lanes are busy")
        group = f"tabulon-{threading.get_ident()}-{time.monotonic_ns()}"
        over = threading.Event()
        late = threading.Timer(self.timeout_s, lambda: (over.set(), self.spark.sparkContext.cancelJobGroup(group)))
        try:
            self.spark.sparkContext.setJobGroup(group, text[:200], interruptOnCancel=True)
            late.start()
            df = self.query(text, filters)
            return {"columns": df.columns, "rows": [[_plain(v) for v in r] for r in df.toLocalIterator()]}
        except QueryError:
            raise
        except Exception as error:
            if over.is_set():
                raise QueryTimeout("execute", f"cancelled after {self.timeout_s:g} s") from error
            said = next((line.strip() for line in str(error).splitlines() if line.strip()), type(error).__name__)
            raise QueryError("execute", said) from error
        finally:
            late.cancel()
            self.lanes.release()

    def values(self, table: str, column: str, contains: str = "", limit: int = 50) -> list[str]:
        """Distinct values as text that hold `contains` in any case, the first `limit` in order - numbers by size."""
        t, c = self._model.column(table, column)
        df = self._model.tables[t].df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct()
        if contains:
            df = df.where(F.lower(F.col("v").cast("string")).contains(contains.lower()))
        return [r.t for r in df.orderBy("v").limit(limit).select(F.col("v").cast("string").alias("t")).collect()]


def _plain(v):
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return v


def _is_table(e: Evaluator, n: Node) -> bool:
    return isinstance(n, TableRef) or (isinstance(n, Call) and (n.name in TABLE_FUNCTIONS))


def _with_scalars(n: Node, scalars: dict[str, Literal]) -> Node:
    """Names of scalar variables replaced by their values."""
    if isinstance(n, TableRef) and n.name.lower() in scalars:
        found = scalars[n.name.lower()]
        return Call("BLANK", (), at=n.at) if found.value is None else found
    return rebuilt(n, tuple(_with_scalars(c, scalars) for c in children(n))) if not isinstance(n, TableRef) and children(n) else n


def _ordered(e: Evaluator, q: Query, rel: Rel) -> DataFrame:
    """Output names, ORDER BY and START AT."""
    names = [o.name for o in rel.outs]
    df = rel.df.select(*[F.col(o.col).alias(o.name) if names.count(o.name) == 1 else F.col(o.col).alias(f"{o.lineage[0]}[{o.name}]" if o.lineage else o.col) for o in rel.outs])
    if not q.order:
        return df
    keys = [(_output(q_key.expr, rel), q_key.descending) for q_key in q.order]
    if q.start:
        starts = [F.lit(e.literal(s)) for s in q.start]
        test, same = F.lit(False), F.lit(True)
        for (k, _), v in zip(keys, starts, strict=False):
            test = test | (same & (k > v))
            same = same & (k == v)
        df = df.where(test | same)
    return df.orderBy(*[k.desc_nulls_last() if down else k.asc_nulls_last() for k, down in keys])


def _output(n: Node, rel: Rel) -> Column:
    if isinstance(n, ColumnRef):
        for o in rel.outs:
            of_table = n.table is None or (o.lineage is not None and o.lineage[0].lower() == n.table.lower())
            if o.name.lower() == n.name.lower() and of_table:
                return F.col(f"`{o.name}`")
        for o in rel.outs:
            if o.name.lower() == n.name.lower():
                return F.col(f"`{o.name}`")
    raise QueryError("emit", "ORDER BY names a column that the result doesn't have", n.at)
