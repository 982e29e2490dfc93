"""What a front end asks of the engine: slicers, marks, subtotals, and tables that follow a lake."""

import pytest

from tabulon import builder
from tabulon.builder import Field
from tabulon.engine import Engine
from tabulon.errors import QueryError
from tabulon.external import ExternalFilter


@pytest.fixture(scope="module")
def shop(spark):
    e = Engine(spark)
    e.add_table("main.orders", spark.createDataFrame([(1, "tea", "jan", 3.0), (2, "tea", "feb", 5.0), (3, "rye", "jan", 4.0), (4, "oat", "mar", None)], "nr int, good string, month string, price double"))
    e.add_table("other.goods", spark.createDataFrame([("tea", "drink"), ("rye", "grain"), ("oat", "grain"), ("fig", "fruit")], "good string, kind string"))
    e.relate("main.orders", "good", "other.goods", "good")
    e.add_measure("main.orders", "Paid", "SUM(main.orders[price])")
    return e


def column(engine, text):
    return [r[0] for r in engine.query(text).collect()]


def test_slicers_cascade_and_are_trimmed(shop):
    assert column(shop, builder.slicer_query(shop.model, "other.goods", "good")) == ["fig", "oat", "rye", "tea"]
    assert column(shop, builder.slicer_query(shop.model, "other.goods", "good", {("other.goods", "kind"): ["grain"], ("other.goods", "good"): ["tea"]})) == ["oat", "rye"]
    assert column(shop, builder.slicer_query(shop.model, "other.goods", "good", {}, ("main.orders", "Paid"))) == ["rye", "tea"]
    assert column(shop, builder.slicer_query(shop.model, "other.goods", "good", {("main.orders", "month"): ["feb"]}, ("main.orders", "Paid"))) == ["tea"]


def test_a_query_for_each_level(shop):
    rows, values = [Field("other.goods", "kind"), Field("other.goods", "good")], [Field("main.orders", "price", "AVERAGE", "a")]
    got = [sorted(tuple(r) for r in shop.query(q).collect()) for q in builder.level_queries(shop.model, rows, values)]
    assert got[0] == [(4.0,)] and got[1] == [("drink", 4.0), ("grain", 4.0)] and got[2] == [("drink", "tea", 4.0), ("grain", "rye", 4.0)]


def test_marks_filter_elsewhere(shop):
    total = lambda marks: shop.query('EVALUATE SUMMARIZECOLUMNS("p", [Paid], "n", COUNTROWS(main.orders))', builder.marks_filter(marks)).collect()
    good, month = ("main.orders", "good"), ("main.orders", "month")
    assert builder.marks_filter([{good: "tea"}, {good: "rye"}, {good: "tea"}]) == [ExternalFilter("main.orders", "good", "in", ("tea", "rye"))]
    assert total([{good: "tea"}, {good: "rye"}])[0]["p"] == 12.0
    assert total([{good: "tea", month: "jan"}, {good: "rye", month: "jan"}])[0]["p"] == 7.0
    assert total([{good: "tea", ("other.goods", "kind"): "drink"}])[0]["n"] == 2
    assert builder.marks_filter([]) == []
    with pytest.raises(QueryError):
        builder.marks_filter([{good: "tea"}, {month: "jan"}])


def test_names_with_schemas(shop, spark):
    """A table is found by its whole name, and by its last part if only one has it."""
    assert column(shop, 'EVALUATE ROW("x", SUM(orders[price]))') == column(shop, 'EVALUATE ROW("x", SUM(main.orders[price]))') == [12.0]
    e = Engine(spark)
    for schema in ("a", "b"):
        e.add_table(f"{schema}.t", spark.createDataFrame([(schema,)], "v string"))
    assert column(e, "EVALUATE b.t") == ["b"]
    with pytest.raises(QueryError) as err:
        e.query("EVALUATE t")
    assert err.value.stage == "resolve"


def test_engine_follows_a_lake(spark):
    class Changing:
        version, rows = (1, 1), 2

        def snapshot(self):
            return self.version

        def tables(self):
            return ["t"]

        def read(self, name):
            return spark.range(self.rows).toDF("v")

    e, lake = Engine(spark), Changing()
    assert e.refresh(lake) and not e.refresh(lake)
    e.add_measure("t", "N", "COUNTROWS(t)")
    lake.version, lake.rows = (2, 1), 5
    assert column(e, 'EVALUATE ROW("n", [N])') == [2] and e.refresh(lake) and column(e, 'EVALUATE ROW("n", [N])') == [5]
