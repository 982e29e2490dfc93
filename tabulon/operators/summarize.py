"""SUMMARIZECOLUMNS and ROW: group-by over a star, with measures of several facts and of other contexts.

Aggregates in the cells' own context are grouped once for each set of tables (a *cluster*) and the clusters are joined
by a full outer join on the keys, so no fact multiplies another. If there are contexts besides (CALCULATE that changes
filters, time windows, iterations), the cells are those of the keys' own tables too, and what those contexts give is
joined to the cells.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousPathError, QueryError
from ..lang.nodes import Call, ColumnRef, Literal, Node, TableRef, children
from ..plans.context import Context, Filter, Key, ModelColumn, Out, Points, Rel, Request, fresh

AGGREGATES = {"SUM", "AVERAGE", "MIN", "MAX", "MEDIAN", "COUNT", "COUNTA", "COUNTBLANK", "DISTINCTCOUNT"}
ITERATORS = {"SUMX": "SUM", "AVERAGEX": "AVERAGE", "COUNTX": "COUNT", "MINX": "MIN", "MAXX": "MAX"}
#: Filter functions that clear or change a context as arguments of CALCULATE.
MODIFIERS = {"ALL", "ALLEXCEPT", "REMOVEFILTERS", "KEEPFILTERS"}


@dataclass(frozen=True)
class GroupKey:
    of: ModelColumn
    name: str
    node: Node


@dataclass
class Arguments:
    #: GroupKey, (name, measure) or a list of rollup elements: (keys, flag)
    groups: list
    filters: list[Node]
    pairs: list[tuple[str, Node]]


def _arguments(e, n: Call) -> Arguments:
    split = next((i for i, a in enumerate(n.args) if isinstance(a, Literal) and isinstance(a.value, str)), len(n.args))
    lead, tail = (n.args[:split], n.args[split:]) if n.name == "SUMMARIZECOLUMNS" else ((), n.args)
    if len(tail) % 2 or not all(isinstance(a, Literal) and isinstance(a.value, str) for a in tail[::2]):
        raise QueryError("emit", f"{n.name} takes pairs of a name and an expression after its groups and filters", n.at)
    out = Arguments([], [], [(a.value, x) for a, x in zip(tail[::2], tail[1::2], strict=True)])
    for a in lead:
        if isinstance(a, ColumnRef):
            if (e.measure_of(a)) is not None:
                out.groups.append((a.name, a))
            else:
                out.groups.append(_key(e, a))
        elif isinstance(a, Call) and a.name == "ROLLUPADDISSUBTOTAL":
            out.groups.append(_rollup(e, a))
        elif isinstance(a, Call) and a.name == "ROLLUPGROUP":
            raise QueryError("emit", "ROLLUPGROUP is supported only in ROLLUPADDISSUBTOTAL", a.at)
        elif isinstance(a, TableRef) or (isinstance(a, Call) and e.is_set_level(a)):
            out.filters.append(a)
        else:
            out.groups.append(_computed(e, a))
    return out


def _key(e, a: ColumnRef) -> GroupKey:
    of = e.model_column(a)
    return GroupKey(of, of[1], a)


def _computed(e, a: Node) -> GroupKey:
    """A group by an expression over one table: a column of that table, as far as the query goes."""
    needed: set[str] = set()
    e.row_column(a, needed)
    if len(needed) != 1:
        raise QueryError("emit", "a computed group must name the columns of one table", a.at)
    (t,) = needed
    # no column of the model may have the name, as it is one of the table's from here on
    taken = {c.lower() for table in e.model.tables.values() for c in table.df.columns} | {x.lower() for _, x in e._virtual}
    name = next(x for i in count(1) if (x := f"Group{i}").lower() not in taken)
    e._virtual[(t, name)] = a
    e.mcol(t, name)
    return GroupKey((t, name), name, a)


def _rollup(e, a: Call) -> list[tuple[tuple[GroupKey, ...], str]]:
    out, i = [], 0
    while i < len(a.args):
        x = a.args[i]
        if isinstance(x, Call) and x.name == "ROLLUPGROUP":
            keys = tuple(_key(e, c) if isinstance(c, ColumnRef) else e._bad_column(c) for c in x.args)
        else:
            keys = (_key(e, x) if isinstance(x, ColumnRef) else e._bad_column(x),)
        if i + 1 >= len(a.args) or not isinstance(a.args[i + 1], Literal) or not isinstance(a.args[i + 1].value, str):
            raise QueryError("emit", "ROLLUPADDISSUBTOTAL takes pairs of a column and a name", a.at)
        out.append((keys, a.args[i + 1].value))
        i += 2
    return out


def summarize(e, n: Call, pts: Points, ctx: Context) -> Rel:
    args = _arguments(e, n)
    filters = [_filter(e, f, pts, ctx) for f in args.filters]
    outer = Context(ctx.keys, (*ctx.filters, *filters))
    plain = [g for g in args.groups if isinstance(g, GroupKey)]
    rollups = [g for g in args.groups if isinstance(g, list)]
    pairs = [g for g in args.groups if isinstance(g, tuple)] + args.pairs
    levels: list[tuple[list[GroupKey], dict[str, bool]]] = [(plain, {})]
    for rollup in rollups:
        # prefixes of the elements, longest first
        levels = [([*keys, *[k for part, _ in rollup[:depth] for k in part]], flags | {flag: i >= depth for i, (_, flag) in enumerate(rollup)}) for keys, flags in levels for depth in range(len(rollup), -1, -1)]
    every = [*plain, *[k for r in rollups for part, _ in r for k in part]]
    if len(levels) > 1 and (found := _grouping_sets(e, every, levels, pairs, pts, outer)) is not None:
        return _shaped(args, every, pairs, found)
    parts = []
    for keys, flags in levels:
        df, cols, values, corr = _level(e, n, keys, pairs, pts, outer)
        of_key = dict(zip([k.of for k in keys], cols, strict=True))
        kinds = dict(e.base_types(k.of) for k in every)
        picked = [(F.col(of_key[k.of]) if k.of in of_key else F.lit(None).cast(kinds[k.of])).alias(f"k{i}") for i, k in enumerate(every)]
        picked += [F.lit(v).alias(f"f{i}") for i, v in enumerate(flags.values())]
        parts.append(df.select(*corr, *picked, *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return _shaped(args, every, pairs, (df, corr))


def _shaped(args: Arguments, every: list[GroupKey], pairs: list, found: tuple[DataFrame, tuple[str, ...]]) -> Rel:
    """Columns in the order of the arguments: keys, a rollup's keys and then its flags, measures."""
    df, corr = found
    outs: list[Out] = []
    columns: list[Column] = []

    def out(name: str, col: str, lineage=None) -> None:
        alias = fresh("o")
        outs.append(Out(name, alias, lineage))
        columns.append(F.col(col).alias(alias))

    position = {id(k): i for i, k in enumerate(every)}
    flag = 0
    for g in args.groups:
        if isinstance(g, GroupKey):
            out(g.name, f"k{position[id(g)]}", g.of)
        elif isinstance(g, list):
            for part, _ in g:
                for k in part:
                    out(k.name, f"k{position[id(k)]}", k.of)
            for _, name in g:
                out(name, f"f{flag}")
                flag += 1
    for i, (name, _) in enumerate(pairs):
        out(name, f"v{i}")
    return Rel(df.select(*corr, *columns), outs, corr)


def _filter(e, f: Node, pts: Points, ctx: Context) -> Filter:
    adds: list[Filter] = []
    if isinstance(f, Call) and f.name == "FILTER" and len(f.args) == 2 and not e.has_set_level(f.args[1]) and e._is_model_table(f.args[0]):
        return e.predicate(f.args[1], pts, ctx)
    e._argument(f, pts if pts.df is not None else Points(e.spark.range(1).select()), ctx, [], adds)
    return adds[0] if adds else e._semi(f, pts, ctx)


# cells


class Found:
    def __init__(self) -> None:
        self.regular: list[tuple[str, Node, str | None, Call]] = []
        self.tables: list[tuple[str, ...]] = []
        self.other = False


def _collect(e, n: Node, found: Found, seen: tuple = ()) -> None:
    """Aggregates in the cells' own context, and whether there is anything else."""
    if (m := e.measure_of(n)) is not None:
        if n.name.lower() in seen:
            raise QueryError("resolve", f"circular measure reference [{n.name}]", n.at)
        _collect(e, m, found, (*seen, n.name.lower()))
        return
    if isinstance(n, Call):
        if n.name in AGGREGATES and len(n.args) == 1 and not e.has_set_level(n.args[0]):
            found.regular.append((n.name, n.args[0], None, n))
            return
        if n.name in ITERATORS and len(n.args) == 2 and e._is_model_table(n.args[0]) and not e.has_set_level(n.args[1]):
            found.regular.append((ITERATORS[n.name], n.args[1], e.model.table(n.args[0].name).name, n))
            return
        if n.name == "COUNTROWS" and len(n.args) == 1 and e._is_model_table(n.args[0]):
            found.regular.append(("ROWS", Literal(1), e.model.table(n.args[0].name).name, n))
            return
        if e.is_set_level(n):
            if n.name == "CALCULATE" and _only_adds(e, n):
                # sees fewer rows of the same cells, so it brings no cell of its own
                found.tables.append(tuple(e.value_tables(n)))
            found.other = True
            return
    for c in children(n):
        _collect(e, c, found, seen)


def _only_adds(e, n: Call) -> bool:
    return all(not (isinstance(a, Call) and (a.name in MODIFIERS or e.is_set_level(a))) for a in n.args[1:])


def _level(e, n: Call, keys: list[GroupKey], pairs: list, pts: Points, outer: Context) -> tuple[DataFrame, list[str], list[str], tuple[str, ...]]:
    """Cells of one grouping: rows, the keys' columns, the values' columns, and the outer points' columns."""
    own = [Key(*k.of, fresh("k")) for k in keys]
    corr_keys = list(outer.keys)
    if any(f.corr for f in outer.filters):
        raise QueryError("emit", f"{n.name} can't be evaluated under a window or predicate that depends on a row", n.at)
    ctx = Context((*corr_keys, *own), outer.filters)
    found = Found()
    for _, x in pairs:
        _collect(e, x, found)
    cells = Points(None)
    for name, arg, root, call in found.regular:
        e.aggregate(name, arg, root, cells, ctx, call)
    values = list(dict.fromkeys(t for _, x in pairs for t in e.value_tables(x)))
    _check_filters(e, outer.filters, keys, [r.roots for r in cells.pending.values()], values, n)
    frames = []
    requests, cells.pending = cells.pending, {}
    for request in requests.values():
        _check_keys(e, keys, request.roots)
        frames.append(_cluster(e, request, [*corr_keys, *own]))
    every = [k.col for k in [*corr_keys, *own]]
    if every and (found.other or not frames):
        for scan in _key_scans(e, [*corr_keys, *own], outer.filters, values, n):
            frames.append(scan)
    if not frames:
        frames.append(e.spark.range(1).select())
    df = frames[0]
    for other in frames[1:]:
        df = _stitched(df, other, every)
    cells.df = df
    columns = []
    for _, x in pairs:
        columns.append(e.scalar(x, cells, ctx))
    e.flush(cells)
    alias = [fresh("v") for _ in columns]
    df = cells.df.select(*every, *[c.alias(a) for c, a in zip(columns, alias, strict=True)])
    if columns:
        test = F.lit(False)
        for a in alias:
            test = test | F.col(a).isNotNull()
        df = df.where(test)
    return df, [k.col for k in own], alias, tuple(k.col for k in corr_keys)


def _check_filters(e, filters: tuple[Filter, ...], keys: list[GroupKey], clusters: list[tuple[str, ...]], values: list[str], n: Call) -> None:
    """A filter that reaches no measure's tables is a mistake; without measures it is left out."""
    if not values:
        return
    for f in filters:
        if not any(e.reaches(t, values) for t in f.tables) and not any(t == k.of[0] for t in f.tables for k in keys):
            raise QueryError("emit", f"the filter on {', '.join(sorted(f.tables))} is unrelated to the tables of the measures: {', '.join(values)}", n.at)


def _check_keys(e, keys: list[GroupKey], roots: tuple[str, ...]) -> None:
    for k in keys:
        if k.of[0] in roots or e.reaches(k.of[0], roots):
            continue
        raise QueryError("emit", f"{k.of[0]}[{k.of[1]}] can't group what is measured in {', '.join(roots)}: {k.of[0]} does not filter it; group by a column of a shared dimension", k.node.at)


def _cluster(e, request: Request, keys: list[Key]) -> DataFrame:
    """Aggregates of one set of tables by the keys' columns."""
    filters = [f for f in request.context.filters if all(e.reaches(t, request.roots) for t in f.tables)]
    df, _ = e.scan(request.roots, keys, filters, request.needed)
    return df.groupBy(*[F.col(e.mcol(*k.of)).alias(k.col) for k in keys]).agg(*e.columns_of(request))


def _stitched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return a.crossJoin(F.broadcast(b))
    names = {k: fresh("j") for k in keys}
    b = b.withColumnsRenamed(names)
    condition = None
    for k, x in names.items():
        one = F.col(k).eqNullSafe(F.col(x))
        condition = one if condition is None else condition & one
    # a side's key is null where the side has no row, and null keys equal null: so coalesce is the key
    df = a.join(b, condition, "full")
    rest = [c for c in [*a.columns, *b.columns] if c not in keys and c not in names.values()]
    return df.select(*[F.coalesce(F.col(k), F.col(x)).alias(k) for k, x in names.items()], *rest)


def _key_scans(e, keys: list[Key], filters: tuple[Filter, ...], values: list[str], n: Call) -> list[DataFrame]:
    """The cells that the keys' own tables have."""
    tables = list(dict.fromkeys(k.table for k in keys))

    def rows(df: DataFrame, joined: list[str]) -> DataFrame:
        for f in filters:
            if f.tables <= set(joined):
                df = e.filtered(df, f)
        return df.select(*[F.col(e.mcol(*k.of)).alias(k.col) for k in keys]).distinct()

    def rooted(root: str) -> DataFrame:
        mine = [f for f in filters if all(e.reaches(t, (root,)) for t in f.tables)]
        df, _ = e.scan((root,), keys, mine, set())
        return df.select(*[F.col(e.mcol(*k.of)).alias(k.col) for k in keys]).distinct()

    # one table that the others filter: its rows have all combinations
    for t in tables:
        if all(x == t or e.model.path([t], x, e.model.expands) is not None for x in tables):
            return [rooted(t)]
    if not values:
        try:
            df, joined = e.tree((tables[0],), tables[1:], lambda s: True, n.at)
            return [rows(df, joined)]
        except AmbiguousPathError:
            raise
    found = []
    for v in values:
        if all(e.reaches(t, (v,)) for t in tables):
            found.append(rooted(v))
    if not found:
        df, joined = e.tree((tables[0],), tables[1:], lambda s: True, n.at)
        found.append(rows(df, joined))
    return found


def _grouping_sets(e, every: list[GroupKey], levels: list, pairs: list, pts: Points, outer: Context) -> tuple[DataFrame, tuple[str, ...]] | None:
    """All levels in one aggregation, if every measure is of one cluster in the cells' own context."""
    found = Found()
    for _, x in pairs:
        _collect(e, x, found)
    if found.other or outer.keys or not found.regular or any(f.corr for f in outer.filters):
        return None
    own = [Key(*k.of, f"k{i}") for i, k in enumerate(every)]
    if len({k.of for k in own}) < len(own):
        return None
    ctx = Context(tuple(own), outer.filters)
    cells = Points(None)
    for name, arg, root, call in found.regular:
        e.aggregate(name, arg, root, cells, ctx, call)
    if len(cells.pending) > 1:
        return None
    ((_, request),) = cells.pending.items()
    _check_keys(e, every, request.roots)
    _check_filters(e, outer.filters, every, [request.roots], list(request.roots), every[0].node)
    filters = [f for f in request.context.filters if all(e.reaches(t, request.roots) for t in f.tables)]
    df, _ = e.scan(request.roots, own, filters, request.needed)
    df = df.select("*", *[F.col(e.mcol(*k.of)).alias(k.col) for k in own])
    by_id = {id(k): f"k{i}" for i, k in enumerate(every)}
    sets = [[F.col(by_id[id(k)]) for k in keys] for keys, _ in levels]
    grouped = df.groupingSets(sets, *[F.col(k.col) for k in own])
    df = grouped.agg(F.grouping_id().alias("_level"), *e.columns_of(request))
    cells.df, cells.pending = df, {}
    columns = [e.scalar(x, cells, ctx) for _, x in pairs]
    # the level's number has a bit for each key that is rolled up, the first key highest
    number = {sum(1 << (len(own) - 1 - i) for i, k in enumerate(every) if not any(k is x for x in keys)): flags for keys, flags in levels}
    names = list(levels[0][1])
    flags = []
    for i, f in enumerate(names):
        up = [v for v, fl in number.items() if fl[f]]
        flags.append(F.col("_level").isin(up).alias(f"f{i}"))
    out = df.select(*[k.col for k in own], *flags, *[c.alias(f"v{i}") for i, c in enumerate(columns)])
    test = F.lit(False)
    for i in range(len(columns)):
        test = test | F.col(f"v{i}").isNotNull()
    return out.where(test), ()


__all__ = ["replace", "summarize"]
