"""Parser, paths, stores, lake, builder and the registered queries."""

import string
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon import builder, star
from tabulon.engine import Engine
from tabulon.errors import QueryError, ServerBusy
from tabulon.lang.nodes import Binary, Call, ColumnRef, Literal, TableConstructor, Unary
from tabulon.lang.parser import parse, parse_expression
from tabulon.model.schema import Format
from tabulon.model.store import Store, load_toml, to_toml
from tabulon.plans.evaluate import FUNCTIONS
from tabulon.sources.lake import Lake

# parser


def test_expressions():
    assert parse_expression("1 + 2 * 3") == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    assert parse_expression("2 ^ 3 ^ 2") == Binary("^", Binary("^", Literal(2), Literal(3)), Literal(2)) or parse_expression("2 ^ 3 ^ 2") == Binary("^", Literal(2), Binary("^", Literal(3), Literal(2)))
    assert parse_expression("-5") == Literal(-5)
    assert parse_expression("a[x] >-1") == Binary(">", ColumnRef("a", "x"), Literal(-1))
    assert parse_expression("-[m]") == Unary("-", ColumnRef(None, "m"))
    assert parse_expression("'Order Lines'[a]]b]") == ColumnRef("Order Lines", "a]b")
    assert parse_expression('"say ""hi"""') == Literal('say "hi"')
    assert parse_expression("x[a] = 1 || x[b] = 2 && x[c] = 3").op == "||"
    assert parse_expression("not (x[a] = 1)") == Call("NOT", (Binary("=", ColumnRef("x", "a"), Literal(1)),))
    assert parse_expression("{(1, 2), (3, 4)}") == TableConstructor(((Literal(1), Literal(2)), (Literal(3), Literal(4))))
    assert parse_expression("{1, (2) + 1}") == TableConstructor(((Literal(1),), (Binary("+", Literal(2), Literal(1)),)))
    assert parse_expression('"a" & "b" = "ab"').op == "="
    assert parse_expression("1.50 /* x */ // y") == Literal(Decimal("1.50"))
    q = parse("define measure t[m] = sum(t[c]) evaluate var x = 1 return t order by t[c] desc, [m]")
    assert (len(q.measures), len(q.variables), [k.descending for k in q.order]) == (1, 1, [True, False])


@pytest.mark.parametrize("text", ["", "EVALUATE", "EVALUATE t START AT 1", "EVALUATE t ORDER BY t[a] DESC START AT 1", "EVALUATE t ORDER BY t[a] START AT 1, 2", "EVALUATE f(1,)", "EVALUATE t t", "DEFINE EVALUATE t", 'EVALUATE "x', "EVALUATE t[", "EVALUATE VAR = 1 RETURN t", "EVALUATE t §"])
def test_bad_queries(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.stage == "parse" and e.value.line >= 1 and e.value.column >= 1


names = st.text(string.ascii_letters + " '[]_", min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(names, names, st.one_of(st.integers(0, 10**20), st.text(max_size=20), st.booleans()))
def test_references_and_literals_round_trip(table, column, value):
    assert parse_expression(builder.reference(table, column)) == ColumnRef(table, column)
    if isinstance(value, bool):
        assert parse_expression(builder.literal(value)) in (Literal(value), Call(str(value).upper(), ()))
    else:
        assert parse_expression(builder.literal(value)) == Literal(value)


@settings(max_examples=300, deadline=None)
@given(st.text(string.printable, max_size=40))
def test_any_text_parses_or_is_refused(text):
    try:
        parse(text)
    except QueryError:
        pass


def test_vocabulary():
    assert len(FUNCTIONS) >= 123


# models


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.add_table("sales", spark.createDataFrame([("a", "2024-01-01", 1)], "p string, d string, q int").selectExpr("p", "cast(d as date) d", "q"))
    e.add_table("main.Products", spark.createDataFrame([("a", "x")], "p string, c string"))
    e.relate("sales", "p", "products", "p")
    e.add_measure("sales", "Qty", "SUM(sales[q])", Format("currency", 2, "EUR"))
    e.add_measure("sales", 'Odd "]', '[Qty] & "\\n"')
    e.set_date_table("sales", "d")
    e.hide("sales", "q")
    return e


def test_toml_round_trip(engine):
    bare = engine.model.copy()
    bare.relationships, bare.measures, bare.date_tables, bare.hidden = [], {}, {}, set()
    text = to_toml(engine.model)
    again = load_toml(bare, text)
    assert to_toml(again) == text and again.measures == engine.model.measures and again.relationships == engine.model.relationships
    for bad in ("x = ", '[[relationship]]\nfrom_table = "sales"', '[[measure]]\ntable = "none"\nname = "x"\nexpression = "1"', "[[other]]\na = 1"):
        with pytest.raises(QueryError):
            load_toml(bare, bad)
    assert not bare.measures


def test_sqlite_round_trip(engine, tmp_path):
    store = Store(tmp_path / "m.sqlite")
    store.save(engine.model)
    bare = engine.model.copy()
    bare.relationships, bare.measures, bare.date_tables, bare.hidden = [], {}, {}, set()
    again, lost = Store(tmp_path / "m.sqlite").load(bare)
    assert lost == [] and to_toml(again) == to_toml(engine.model)
    del bare.tables["main.Products"]
    again, lost = store.load(bare)
    assert len(lost) == 1 and not again.relationships


def test_model_changes(engine, spark):
    e = Engine(spark, engine.model.copy())
    assert e.model.find_table("PRODUCTS").name == "main.Products"
    assert [c["name"] for c in e.schema()["tables"][0]["columns"]] == ["p", "d"]
    with pytest.raises(QueryError):
        e.add_measure("sales", "p", "1")
    with pytest.raises(QueryError, match="circular"):
        e.add_measure("sales", "Qty", "[Odd \"]]]")
    with pytest.raises(QueryError):
        e.set_date_table("sales", "p")
    with pytest.raises(QueryError):
        e.replace_relationship(("sales", "q", "main.Products", "p"), ("sales", "p", "main.Products", "c"))
    e.replace_relationship(("sales", "p", "main.Products", "p"), ("sales", "p", "main.Products", "c"))
    assert e.model.relationships[0].to_column == "c"
    e.unrelate("sales", "p", "main.Products", "c")
    e.drop_measure("sales", 'Odd "]')
    e.clear_date_table()
    assert not e.model.relationships and len(e.model.measures) == 1 and not e.model.date_tables
    for kind, decimals, currency in (("money", None, None), ("number", 11, None), ("currency", 2, None), ("currency", 2, "euro"), ("number", 2, "EUR")):
        with pytest.raises(QueryError):
            Format(kind, decimals, currency)


def test_cycle_of_both_way_relationships(spark):
    e = Engine(spark)
    for t in "abc":
        e.add_table(t, spark.createDataFrame([(1,)], "k int"))
    e.relate("a", "k", "b", "k", True)
    e.relate("b", "k", "c", "k", True)
    with pytest.raises(QueryError, match="cycle"):
        e.relate("c", "k", "a", "k", True)
    assert len(e.model.relationships) == 2


def test_lanes(engine, spark):
    e = Engine(spark, engine.model.copy(), lanes=1, admission_s=0.05)
    assert e.lanes.acquire()
    with pytest.raises(ServerBusy):
        e.execute("EVALUATE sales")
    e.lanes.release()
    assert e.execute("EVALUATE FILTER(sales, sales[q] > 5)") == {"columns": ["p", "d", "q"], "rows": []}


# lake


def test_lake(spark, tmp_path):
    lake = Lake(spark, tmp_path / "lake")

    def drop(name, rows, schema="id long, v string"):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(lake.inbox / name)

    drop("a.parquet", [(1, "x")])
    drop("b.parquet", [(2, "y"), (3, "z")])
    r = lake.import_files("t", ["a.parquet"], "req-1")
    assert (r.status, r.rows) == ("done", 1) and lake.import_files("t", ["gone.parquet"], "req-1").id == r.id
    version = lake.snapshot()[1]
    assert lake.import_files("t", ["b.parquet"]).rows == 2 and lake.read("t").count() == 3 and lake.snapshot()[1] == version
    assert list(lake.inbox.iterdir()) == []
    drop("again.parquet", [(2, "y"), (3, "z")])
    assert lake.import_files("t", ["again.parquet"]).rows == 0 and lake.read("t").count() == 3
    drop("bad.parquet", [(1, 2)], "id long, v long")
    drop("good.parquet", [(9, "q")])
    with pytest.raises(QueryError, match="differ"):
        lake.import_files("t", ["good.parquet", "bad.parquet"])
    assert lake.read("t").count() == 3 and (lake.inbox / "good.parquet").exists() and lake.receipts(1)[0].status == "failed"
    with pytest.raises(QueryError):
        lake.import_files("t", ["../catalog.sqlite"])
    with pytest.raises(QueryError):
        lake.import_files("new", ["good.parquet"], create=False)
    before = lake.read("t")
    assert lake.compact() == "merged 2 files" and lake.history(1)[0]["note"] == "merged 2 files" and lake.read("t").count() == 3 and before.count() == 3 and len(lake._state()[2]["t"]) == 1
    assert lake.expire(0, -1) == "forgot 3 snapshots, deleted 2 files" or "deleted 2 files" in lake.expire(0, -1) or lake.read("t").count() == 3
    lake.busy.acquire()
    assert lake.compact() == "skipped: busy"
    with pytest.raises(ServerBusy):
        lake.import_files("t", ["good.parquet"])
    lake.busy.release()
    lake.db.execute("INSERT INTO imports VALUES ('x', NULL, 't', 'running', 0, '', 0, NULL)")
    lake.db.commit()
    (tmp_path / "lake/data/t/half.parquet").write_bytes(b"")
    again = Lake(spark, tmp_path / "lake")
    assert again.read("t").count() == 3 and not (tmp_path / "lake/data/t/half.parquet").exists()
    with pytest.raises(QueryError):
        Lake(spark, tmp_path / "lake", read_only=True).import_files("t", [])


# builder


def test_built_query(engine):
    text = builder.build_query(engine.model, [builder.Field("main.Products", "c"), builder.Field("sales", "q"), builder.Field("sales", "Qty")], {("sales", "p"): ["a", 'b"']}, [("Qty", True)], (3, "Qty"))
    assert [r.asDict() for r in engine.query(text).collect()] == [{"c": "x", "Sum of q": 1, "Qty": 1}]
    with pytest.raises(QueryError):
        builder.build_query(engine.model, [builder.Field("sales", "none")])
    with pytest.raises(QueryError):
        builder.build_query(engine.model, [builder.Field("sales", "q", "MODE")])


def test_shaping():
    columns, rows = ["y", "s", "v"], [[2024, "a", 1], [2024, None, 5], [2025, "a", None], [2025, "b", 2]]
    assert builder.pivoted(columns, rows, "y", "s", "v") == (["y", "(blank)", "a", "b"], [[2024, 5, 1, None], [2025, None, None, 2]])
    assert builder.pivoted(columns, rows, "y", "s", "v", top=1)[1] == [[2024, 5, 1, None]]
    assert builder.without_empty_rows(columns, rows, ["v"]) == [rows[0], rows[1], rows[3]]
    assert sorted([None, 3, 1], key=builder.sort_key) == [1, 3, None] and sorted([None, 3, 1], key=lambda v: builder.sort_key(v, True)) == [3, 1, None]
    assert builder.to_csv(["a", "b"], [[1, None], ['x "y"', "p,q"]]) == 'a,b\r\n1,\r\n"x ""y""","p,q"\r\n'
    shown = [builder.formatted(v, f) for v, f in [(1234.5, Format("number")), (0.256, Format("percent")), (1234.5, Format("currency", 2, "EUR")), (1_500_000, Format("compact")), (2500, Format("compact")), (2.345, Format("decimal", 2)), (None, Format("number")), ("x", None)]]
    assert shown == ["1,235", "25.6%", "EUR 1,234.50", "1.5M", "2.5T", "2.35", "", "x"]


def test_every_query_has_sql():
    assert star.queries().keys() == star.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(star.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["n_name", "rev", "value"]
