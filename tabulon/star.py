"""The order-line star over the standard tables, as a model; and one query for each operator, with its SQL.

The tables' graph has two ways from an order line to a nation, so nation and region play two roles: of the customer and
of the supplier. A date table covers the order dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .external import ExternalFilter

TABLES = ("lineitem", "orders", "customer", "supplier", "part")
#: Whole years that the date table covers.
FIRST_YEAR, LAST_YEAR = 1992, 2001


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t in TABLES:
        e.add_table(t, read(t).withColumn("o_date", F.to_date("o_orderdate")) if t == "orders" else read(t))
    for role in ("cust", "supp"):
        e.add_table(f"{role}_nation", read("nation"), is_view=True)
        e.add_table(f"{role}_region", read("region"), is_view=True)
    days = spark.sql(f"select explode(sequence(date'{FIRST_YEAR}-01-01', date'{LAST_YEAR}-12-31')) as date")
    e.add_table("dates", days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month")))
    for r in [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("orders", "o_date", "dates", "date"),
        ("customer", "c_nationkey", "cust_nation", "n_nationkey"),
        ("cust_nation", "n_regionkey", "cust_region", "r_regionkey"),
        ("supplier", "s_nationkey", "supp_nation", "n_nationkey"),
        ("supp_nation", "n_regionkey", "supp_region", "r_regionkey"),
    ]:
        e.relate(*r)
    e.set_date_table("dates", "date")
    e.add_measure("lineitem", "Revenue", "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))")
    e.add_measure("lineitem", "Quantity", "SUM(lineitem[l_quantity])")
    e.add_measure("orders", "Order Value", "SUM(orders[o_totalprice])")
    e.add_measure("orders", "Order Count", "COUNTROWS(orders)")
    return e


REV = "sum(l_extendedprice * (1 - l_discount))"
LINES = "lineitem LEFT JOIN orders ON l_orderkey IS NOT DISTINCT FROM o_orderkey LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey LEFT JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey LEFT JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey"
ORDERS = "orders LEFT JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey LEFT JOIN nation ON c_nationkey IS NOT DISTINCT FROM n_nationkey"
DAYS = "(SELECT CAST(d AS DATE) AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month FROM generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d))"
DAILY = f"(SELECT dd.date, dd.year, dd.quarter, dd.month, CAST(count(o_orderkey) AS BIGINT) AS n, sum(o_totalprice) AS v FROM {DAYS} dd LEFT JOIN orders ON CAST(o_orderdate AS DATE) = dd.date GROUP BY ALL)"
CELLS = f"(SELECT year, month, min(date) AS lo, max(date) AS hi FROM {DAYS} x GROUP BY year, month)"


def _window(low: str, high: str) -> str:
    """Order value by year and month in a window of dates."""
    return f"WITH dy AS {DAILY}, c AS {CELLS} SELECT year, month, x FROM (SELECT c.year AS year, c.month AS month, (SELECT sum(v) FROM dy WHERE dy.date >= {low} AND dy.date <= {high}) AS x FROM c) WHERE x IS NOT NULL"


def _scalars(pairs: list[tuple[str, str, str]]) -> tuple[str, str]:
    """A query of scalar functions over the parts, and its SQL. pairs: name, expression, SQL."""
    text = "EVALUATE SELECTCOLUMNS(part, \"p_partkey\", part[p_partkey], " + ", ".join(f'"{n}", {x}' for n, x, _ in pairs) + ")"
    return text, "SELECT p_partkey, " + ", ".join(f"{s} AS {n}" for n, _, s in pairs) + " FROM part"


D = "CAST(o_orderdate AS DATE)"

#: name: query text, SQL
QUERIES: dict[str, tuple[str, str]] = {
    # scans and projections
    "scan_table": ("EVALUATE part", "SELECT * FROM part"),
    "scan_view": ("EVALUATE cust_nation", "SELECT * FROM nation"),
    "select_columns": ('EVALUATE SELECTCOLUMNS(customer, "key", customer[c_custkey], "seg", customer[c_mktsegment])', "SELECT c_custkey AS key, c_mktsegment AS seg FROM customer"),
    "add_columns": ('EVALUATE ADDCOLUMNS(supplier, "twice", supplier[s_acctbal] * 2)', "SELECT *, s_acctbal * 2 AS twice FROM supplier"),
    "filter_rows": ('EVALUATE FILTER(customer, customer[c_acctbal] > 5000 && customer[c_mktsegment] = "BUILDING")', "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "filter_or_not": ('EVALUATE FILTER(customer, OR(customer[c_acctbal] < 0, NOT(customer[c_mktsegment] <> "MACHINERY")))', "SELECT * FROM customer WHERE c_acctbal < 0 OR NOT (c_mktsegment <> 'MACHINERY')"),
    "values_column": ("EVALUATE VALUES(customer[c_mktsegment])", "SELECT DISTINCT c_mktsegment FROM customer"),
    "distinct_column": ("EVALUATE DISTINCT(part[p_brand])", "SELECT DISTINCT p_brand FROM part"),
    "all_columns": ("EVALUATE ALL(orders[o_orderstatus], orders[o_orderpriority])", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "all_table": ("EVALUATE ALL(supplier)", "SELECT * FROM supplier"),
    "all_except_table": ("EVALUATE ALLEXCEPT(supplier, supplier[s_name])", "SELECT * FROM supplier"),
    "related_column": ('EVALUATE SELECTCOLUMNS(customer, "key", customer[c_custkey], "nation", RELATED(cust_nation[n_name]), "region", RELATED(cust_region[r_name]))', "SELECT c_custkey AS key, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "row_values": ('EVALUATE ROW("n", [Order Count], "v", [Order Value])', "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS v FROM orders"),
    # aggregation
    "group_by_dimension": ('EVALUATE SUMMARIZECOLUMNS(cust_nation[n_name], "rev", [Revenue])', f"SELECT n_name, {REV} AS rev FROM {LINES} GROUP BY n_name"),
    "group_by_two_dimensions": ('EVALUATE SUMMARIZECOLUMNS(cust_region[r_name], part[p_brand], "rev", [Revenue], "qty", [Quantity])', f"SELECT r_name, p_brand, {REV} AS rev, sum(l_quantity) AS qty FROM {LINES} LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "aggregates": ('EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], "s", SUM(customer[c_acctbal]), "a", AVERAGE(customer[c_acctbal]), "lo", MIN(customer[c_acctbal]), "hi", MAX(customer[c_acctbal]), "md", MEDIAN(customer[c_acctbal]), "n", COUNT(customer[c_custkey]), "na", COUNTA(customer[c_name]), "r", COUNTROWS(customer))', "SELECT c_mktsegment, sum(c_acctbal) AS s, avg(c_acctbal) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, median(c_acctbal) AS md, CAST(count(c_custkey) AS BIGINT) AS n, CAST(count(c_name) AS BIGINT) AS na, CAST(count(*) AS BIGINT) AS r FROM customer GROUP BY 1"),
    "distinct_and_blank_counts": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], "d", DISTINCTCOUNT(orders[o_custkey]), "b", COUNTBLANK(orders[o_custkey]))', "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS d, CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT) AS b FROM orders GROUP BY 1"),
    "iterators": ('EVALUATE SUMMARIZECOLUMNS(lineitem[l_returnflag], "s", SUMX(lineitem, lineitem[l_quantity] * 2), "a", AVERAGEX(lineitem, lineitem[l_quantity] * 2), "n", COUNTX(lineitem, lineitem[l_quantity]), "lo", MINX(lineitem, lineitem[l_extendedprice] * (1 + lineitem[l_tax])), "hi", MAXX(lineitem, lineitem[l_extendedprice] * (1 + lineitem[l_tax])))', "SELECT l_returnflag, sum(l_quantity * 2) AS s, avg(l_quantity * 2) AS a, CAST(count(l_quantity) AS BIGINT) AS n, min(l_extendedprice * (1 + l_tax)) AS lo, max(l_extendedprice * (1 + l_tax)) AS hi FROM lineitem GROUP BY 1"),
    "iterate_filtered_table": ('EVALUATE SUMMARIZECOLUMNS(lineitem[l_returnflag], "x", SUMX(FILTER(lineitem, lineitem[l_quantity] > 45), lineitem[l_quantity]))', "SELECT l_returnflag, (SELECT sum(l_quantity) FROM lineitem WHERE l_quantity > 45) AS x FROM lineitem GROUP BY 1"),
    "concatenatex": ('EVALUATE SUMMARIZECOLUMNS(cust_region[r_name], "names", CONCATENATEX(cust_nation, cust_nation[n_name], "; "))', "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "count_rows_of_table": ('EVALUATE ROW("n", COUNTROWS(FILTER(orders, orders[o_totalprice] > 200000)))', "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 200000"),
    "group_only": ("EVALUATE SUMMARIZECOLUMNS(cust_region[r_name], customer[c_mktsegment])", "SELECT DISTINCT r_name, c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "measure_as_group": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], [Order Value], "n", [Order Count])', 'SELECT o_orderstatus, sum(o_totalprice) AS "Order Value", CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1'),
    "computed_group": ('EVALUATE SELECTCOLUMNS(SUMMARIZECOLUMNS(YEAR(orders[o_orderdate]), "n", COUNTROWS(orders)), "y", [Group1], "n", [n])', "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY year(o_orderdate)"),
    "blank_rows_pruned": ('EVALUATE SUMMARIZECOLUMNS(part[p_brand], "x", CALCULATE(SUM(lineitem[l_quantity]), part[p_size] > 48))', "SELECT p_brand, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 48 GROUP BY 1"),
    # filters
    "treatas_values": ('EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], TREATAS({"ASIA", "EUROPE"}, cust_region[r_name]), "rev", [Revenue])', f"SELECT c_mktsegment, {REV} AS rev FROM {LINES} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1"),
    "treatas_tuples": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderpriority], TREATAS({("F", "1-URGENT"), ("O", "5-LOW")}, orders[o_orderstatus], orders[o_orderpriority]), "n", [Order Count])', "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '5-LOW') GROUP BY 1"),
    "treatas_table": ('EVALUATE SUMMARIZECOLUMNS(cust_nation[n_name], TREATAS(VALUES(supplier[s_nationkey]), cust_nation[n_nationkey]), "n", COUNTROWS(customer))', "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "filter_argument": ('EVALUATE SUMMARIZECOLUMNS(lineitem[l_returnflag], FILTER(lineitem, lineitem[l_quantity] >= 30), "qty", [Quantity])', "SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity >= 30 GROUP BY 1"),
    "calculate_predicate": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], "x", CALCULATE([Order Value], orders[o_orderstatus] = "F"))', "SELECT o_orderstatus, (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F') AS x FROM orders GROUP BY 1"),
    "keepfilters": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], "x", CALCULATE([Order Value], KEEPFILTERS(orders[o_orderstatus] = "F")))', "SELECT o_orderstatus, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "share_of_all": ('EVALUATE SUMMARIZECOLUMNS(cust_nation[n_name], "share", DIVIDE([Revenue], CALCULATE([Revenue], ALL(cust_nation))))', f"SELECT n_name, {REV} / (SELECT {REV} FROM lineitem) AS share FROM {LINES} GROUP BY 1"),
    "all_column": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], orders[o_orderpriority], "x", CALCULATE([Order Value], ALL(orders[o_orderpriority])))', "SELECT DISTINCT o_orderstatus, o_orderpriority, sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS x FROM orders"),
    "all_except": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], orders[o_orderpriority], "x", CALCULATE([Order Value], ALLEXCEPT(orders, orders[o_orderpriority])))', "SELECT DISTINCT o_orderstatus, o_orderpriority, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS x FROM orders"),
    "remove_filters": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], "x", CALCULATE([Order Value], REMOVEFILTERS()))', "SELECT DISTINCT o_orderstatus, (SELECT sum(o_totalprice) FROM orders) AS x FROM orders"),
    "filter_all": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], "x", CALCULATE([Order Value], FILTER(ALL(orders), orders[o_totalprice] > 100000)))', "SELECT DISTINCT o_orderstatus, (SELECT sum(o_totalprice) FROM orders WHERE o_totalprice > 100000) AS x FROM orders"),
    "filter_by_measure": ("EVALUATE SELECTCOLUMNS(FILTER(customer, [Order Value] > 1000000), \"key\", customer[c_custkey])", "SELECT c_custkey AS key FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING sum(o_totalprice) > 1000000"),
    "calculate_filter_values": ('EVALUATE SUMMARIZECOLUMNS(cust_region[r_name], "x", CALCULATE([Order Value], FILTER(VALUES(cust_nation[n_name]), [Order Count] > 60)))', f"WITH b AS (SELECT n_name FROM {ORDERS} GROUP BY 1 HAVING count(*) > 60) SELECT r_name, sum(o_totalprice) AS x FROM {ORDERS} LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_name IN (SELECT n_name FROM b) GROUP BY 1"),
    # several facts
    "two_facts": ('EVALUATE SUMMARIZECOLUMNS(cust_nation[n_name], "rev", [Revenue], "value", [Order Value])', f"WITH a AS (SELECT n_name, {REV} AS rev FROM {LINES} GROUP BY 1), b AS (SELECT n_name, sum(o_totalprice) AS value FROM {ORDERS} GROUP BY 1) SELECT coalesce(a.n_name, b.n_name) AS n_name, rev, value FROM a FULL JOIN b ON a.n_name IS NOT DISTINCT FROM b.n_name"),
    "arithmetic_over_facts": ('EVALUATE SUMMARIZECOLUMNS(dates[year], "x", [Order Value] - [Revenue])', f"WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {REV} AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value FROM orders GROUP BY 1) SELECT b.year AS year, value - rev AS x FROM a FULL JOIN b ON a.year = b.year WHERE value - rev IS NOT NULL"),
    # subtotals
    "rollup": ('EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(cust_region[r_name], "rt", cust_nation[n_name], "nt"), "rev", [Revenue])', f"SELECT r_name, n_name, grouping(r_name) = 1 AS rt, grouping(n_name) = 1 AS nt, {REV} AS rev FROM {LINES} GROUP BY ROLLUP (r_name, n_name)"),
    "rollup_group": ('EVALUATE SUMMARIZECOLUMNS(orders[o_orderstatus], ROLLUPADDISSUBTOTAL(ROLLUPGROUP(cust_nation[n_name], customer[c_mktsegment]), "t"), "v", [Order Value])', f"SELECT o_orderstatus, n_name, c_mktsegment, grouping(n_name) = 1 AS t, sum(o_totalprice) AS v FROM {ORDERS} GROUP BY GROUPING SETS ((o_orderstatus, n_name, c_mktsegment), (o_orderstatus))"),
    "rollup_with_context": ('EVALUATE SUMMARIZECOLUMNS(ROLLUPADDISSUBTOTAL(orders[o_orderstatus], "t"), "v", [Order Value], "all", CALCULATE([Order Value], ALL(orders)))', "SELECT o_orderstatus, grouping(o_orderstatus) = 1 AS t, sum(o_totalprice) AS v, (SELECT sum(o_totalprice) FROM orders) AS \"all\" FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    # context transition
    "transition": ('EVALUATE ADDCOLUMNS(VALUES(customer[c_mktsegment]), "v", [Order Value])', "SELECT c_mktsegment, sum(o_totalprice) AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "transition_rows": ('EVALUATE SELECTCOLUMNS(supplier, "key", supplier[s_suppkey], "q", [Quantity])', "SELECT s_suppkey AS key, sum(l_quantity) AS q FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"),
    "iterate_measure": ('EVALUATE ROW("x", AVERAGEX(VALUES(cust_nation[n_name]), [Order Value]), "top", MAXX(customer, [Order Count]))', f"SELECT (SELECT avg(v) FROM (SELECT n_name, sum(o_totalprice) AS v FROM {ORDERS} GROUP BY 1)) AS x, (SELECT max(n) FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey)) AS top"),
    "naked_aggregate": ('EVALUATE ROW("x", SUMX(cust_region, COUNTROWS(cust_nation)))', "SELECT CAST((SELECT count(*) FROM region) * (SELECT count(*) FROM nation) AS BIGINT) AS x"),
    "related_table": ('EVALUATE SELECTCOLUMNS(cust_nation, "nation", cust_nation[n_name], "n", COUNTROWS(RELATEDTABLE(customer)))', "SELECT n_name AS nation, CAST(count(c_custkey) AS BIGINT) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "calculate_table": ('EVALUATE SELECTCOLUMNS(CALCULATETABLE(customer, cust_region[r_name] = "ASIA", customer[c_acctbal] > 0), "key", customer[c_custkey])', "SELECT c_custkey AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0"),
    "summarize_in_measure": ('DEFINE MEASURE orders[Kinds] = COUNTROWS(SUMMARIZECOLUMNS(orders[o_orderstatus], "n", COUNTROWS(orders))) EVALUATE ADDCOLUMNS(VALUES(customer[c_mktsegment]), "k", [Kinds])', "SELECT c_mktsegment, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    # joins of tables, sets, ranks
    "cross_join": ("EVALUATE CROSSJOIN(VALUES(cust_region[r_name]), VALUES(orders[o_orderstatus]))", "SELECT r_name, o_orderstatus FROM (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT o_orderstatus FROM orders)"),
    "generate": ('EVALUATE GENERATE(VALUES(customer[c_mktsegment]), SELECTCOLUMNS(TOPN(2, CALCULATETABLE(customer), customer[c_acctbal]), "key", customer[c_custkey]))', "SELECT c_mktsegment, key FROM (SELECT c_mktsegment, c_custkey AS key, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST) AS r FROM customer) WHERE r <= 2"),
    "generate_all": ('EVALUATE GENERATEALL(SELECTCOLUMNS(cust_region, "region", cust_region[r_name], "rk", cust_region[r_regionkey]), SELECTCOLUMNS(FILTER(supp_nation, supp_nation[n_regionkey] = [rk] && supp_nation[n_nationkey] > 20), "nation", supp_nation[n_name]))', "SELECT r_name AS region, r_regionkey AS rk, n_name AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20"),
    "union_all": ('EVALUATE UNION(SELECTCOLUMNS(supplier, "n", supplier[s_nationkey]), SELECTCOLUMNS(customer, "n", customer[c_nationkey]))', "SELECT s_nationkey AS n FROM supplier UNION ALL SELECT c_nationkey FROM customer"),
    "intersect_rows": ('EVALUATE INTERSECT(SELECTCOLUMNS(supplier, "n", supplier[s_nationkey]), SELECTCOLUMNS(FILTER(cust_nation, cust_nation[n_regionkey] = 2), "n", cust_nation[n_nationkey]))', "SELECT s_nationkey AS n FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "except_rows": ('EVALUATE EXCEPT(SELECTCOLUMNS(supplier, "n", supplier[s_nationkey]), SELECTCOLUMNS(FILTER(cust_nation, cust_nation[n_regionkey] = 2), "n", cust_nation[n_nationkey]))', "SELECT s_nationkey AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "top_n": ('EVALUATE TOPN(10, SELECTCOLUMNS(orders, "key", orders[o_orderkey], "price", orders[o_totalprice]), [price])', "SELECT key, price FROM (SELECT o_orderkey AS key, o_totalprice AS price, rank() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS r FROM orders) WHERE r <= 10"),
    "top_n_ties": ('EVALUATE TOPN(3, SELECTCOLUMNS(part, "key", part[p_partkey], "size", part[p_size]), [size], ASC)', "SELECT key, size FROM (SELECT p_partkey AS key, p_size AS size, rank() OVER (ORDER BY p_size ASC NULLS LAST) AS r FROM part) WHERE r <= 3"),
    "top_n_by_measure": ('EVALUATE SELECTCOLUMNS(TOPN(5, cust_nation, [Order Value]), "n", cust_nation[n_name])', f"SELECT n_name AS n FROM (SELECT n_name, rank() OVER (ORDER BY sum(o_totalprice) DESC NULLS LAST) AS r FROM {ORDERS} GROUP BY 1) WHERE r <= 5"),
    "order_by": ('EVALUATE SUMMARIZECOLUMNS(cust_nation[n_name], "v", [Order Value]) ORDER BY [v] DESC', f"SELECT n_name, sum(o_totalprice) AS v FROM {ORDERS} GROUP BY 1 ORDER BY v DESC"),
    "start_at": ('EVALUATE SUMMARIZECOLUMNS(cust_region[r_name], customer[c_mktsegment], "n", COUNTROWS(customer)) ORDER BY cust_region[r_name], customer[c_mktsegment] START AT "ASIA", "FURNITURE"', "SELECT * FROM (SELECT r_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) WHERE r_name > 'ASIA' OR (r_name = 'ASIA' AND c_mktsegment >= 'FURNITURE')"),
    # variables and definitions
    "table_variable": ('EVALUATE VAR big = FILTER(orders, orders[o_totalprice] > 250000) RETURN SUMMARIZECOLUMNS(big[o_orderstatus], "n", COUNTROWS(big), "s", SUM(big[o_totalprice]))', "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS s FROM orders WHERE o_totalprice > 250000 GROUP BY 1"),
    "scalar_variable": ('EVALUATE VAR mean = CALCULATE(AVERAGE(orders[o_totalprice])) RETURN SUMMARIZECOLUMNS(orders[o_orderstatus], "x", [Order Value] / mean)', "SELECT o_orderstatus, sum(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) AS x FROM orders GROUP BY 1"),
    "defined_measure": ('DEFINE MEASURE lineitem[Margin] = DIVIDE([Revenue], SUM(lineitem[l_extendedprice])) EVALUATE SUMMARIZECOLUMNS(lineitem[l_shipdate], "m", [Margin])', f"SELECT l_shipdate, {REV} / sum(l_extendedprice) AS m FROM lineitem GROUP BY 1"),
    # time
    "year_to_date": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", TOTALYTD([Order Value], dates[date]))', _window("date_trunc('year', c.hi)", "c.hi")),
    "quarter_to_date": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATESQTD(dates[date])))', _window("date_trunc('quarter', c.hi)", "c.hi")),
    "month_to_date": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", TOTALMTD([Order Value], dates[date]))', _window("date_trunc('month', c.hi)", "c.hi")),
    "total_quarter_to_date": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", TOTALQTD([Order Value], dates[date]))', _window("date_trunc('quarter', c.hi)", "c.hi")),
    "same_period_last_year": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], SAMEPERIODLASTYEAR(dates[date])))', _window("c.lo - INTERVAL 1 YEAR", "c.hi - INTERVAL 1 YEAR")),
    "date_add": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATEADD(dates[date], -2, QUARTER)))', _window("c.lo - INTERVAL 6 MONTH", "c.hi - INTERVAL 6 MONTH")),
    "dates_between": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATESBETWEEN(dates[date], DATE(1995, 1, 1), MAX(dates[date]))))', _window("DATE '1995-01-01'", "c.hi")),
    "dates_in_period": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATESINPERIOD(dates[date], LASTDATE(dates[date]), -3, MONTH)))', _window("c.hi - INTERVAL 3 MONTH + INTERVAL 1 DAY", "c.hi")),
    "last_non_blank": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATESINPERIOD(dates[date], LASTNONBLANK(dates[date], [Order Value]), 1, DAY)))', f"WITH dy AS {DAILY}, c AS (SELECT year, month, max(date) AS d FROM dy WHERE v IS NOT NULL GROUP BY 1, 2) SELECT c.year AS year, c.month AS month, dy.v AS x FROM c JOIN dy ON dy.date = c.d"),
    "calendar": ('EVALUATE CALENDAR(DATE(1996, 2, 1), "1996-03-15")', "SELECT CAST(d AS DATE) AS \"Date\" FROM generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1996-03-15', INTERVAL 1 DAY) t(d)"),
    "dates_of_window": ("EVALUATE DATESMTD(dates[date])", "SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2001-12-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY) t(d)"),
    "dates_between_ends": ('EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], DATESBETWEEN(dates[date], FIRSTDATE(dates[date]), LASTDATE(dates[date]))))', _window("c.lo", "c.hi")),
    "today_and_now": ('EVALUATE ROW("d", TODAY(), "y", YEAR(NOW()))', "SELECT current_date AS d, CAST(year(current_date) AS INTEGER) AS y"),
} | {
    f"{way.lower()}_{unit.lower()}": (f'EVALUATE SUMMARIZECOLUMNS(dates[year], dates[month], "x", CALCULATE([Order Value], {way}{unit}(dates[date])))', _window(f"date_trunc('{unit.lower()}', c.lo) - INTERVAL {n}", f"date_trunc('{unit.lower()}', c.lo) - INTERVAL 1 DAY") if way == "PREVIOUS" else _window(f"date_trunc('{unit.lower()}', c.hi) + INTERVAL {n}", f"date_trunc('{unit.lower()}', c.hi) + INTERVAL {n} + INTERVAL {n} - INTERVAL 1 DAY"))
    for way in ("PREVIOUS", "NEXT")
    for unit, n in (("YEAR", "1 YEAR"), ("QUARTER", "3 MONTH"), ("MONTH", "1 MONTH"), ("DAY", "1 DAY"))
} | {
    "calendar_auto": ("EVALUATE CALENDARAUTO()", "WITH e AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT CAST(o_orderdate AS DATE) AS x FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT DATE '1992-01-01' UNION ALL SELECT DATE '2001-12-31')) SELECT CAST(d AS DATE) AS \"Date\" FROM e, generate_series(CAST(date_trunc('year', lo) AS TIMESTAMP), CAST(date_trunc('year', hi) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS TIMESTAMP), INTERVAL 1 DAY) t(d)"),
    "scalar_text": _scalars([
        ("a", "UPPER(LEFT(part[p_name], 3))", "upper(left(p_name, 3))"), ("b", "LOWER(RIGHT(part[p_brand], 2))", "lower(right(p_brand, 2))"), ("c", "LEN(part[p_name])", "CAST(length(p_name) AS INTEGER)"),
        ("d", "MID(part[p_type], 2, 4)", "substr(p_type, 2, 4)"), ("e", 'SEARCH("A", part[p_name])', "CAST(strpos(lower(p_name), 'a') AS INTEGER)"), ("f", 'FIND("a", part[p_name])', "CAST(strpos(p_name, 'a') AS INTEGER)"),
        ("g", 'SUBSTITUTE(part[p_brand], "Brand", "B")', "replace(p_brand, 'Brand', 'B')"), ("h", 'REPLACE(part[p_brand], 1, 2, "x")', "concat('x', substr(p_brand, 3))"), ("i", 'REPT("ab", 2)', "repeat('ab', 2)"),
        ("j", 'CONCATENATE(part[p_brand], "!", part[p_size])', "concat(p_brand, '!', CAST(p_size AS VARCHAR))"), ("k", 'EXACT(part[p_brand], "Brand#11")', "p_brand = 'Brand#11'"), ("l", "UNICHAR(8364)", "chr(8364)"),
        ("m", 'TRIM("  a   b ")', "'a b'"), ("n", 'part[p_brand] & "-" & part[p_size]', "concat(p_brand, '-', CAST(p_size AS VARCHAR))"), ("o", 'VALUE("12.5")', "CAST('12.5' AS DOUBLE)"), ("p", 'FORMAT(part[p_retailprice], "0.0")', "printf('%.1f', p_retailprice)"), ("q", 'FORMAT(0.25, "Percent")', "'25.00%'"),
    ]),
    "scalar_numbers": _scalars([
        ("a", "ABS(0 - part[p_size])", "abs(0 - p_size)"), ("b", "ROUND(part[p_retailprice] / 7, 2)", "round(CAST(p_retailprice / 7 AS DECIMAL(38,15)), 2)::DOUBLE"), ("c", "INT(part[p_retailprice])", "CAST(floor(p_retailprice) AS BIGINT)"), ("d", "MOD(part[p_size], 7)", "p_size % 7"),
        ("e", "POWER(part[p_size], 2)", "pow(p_size, 2)"), ("f", "SQRT(part[p_size])", "sqrt(p_size)"), ("g", "SIGN(part[p_size] - 25)", "CAST(sign(p_size - 25) AS INTEGER)"), ("h", "EXP(part[p_size] / 50)", "exp(p_size / 50)"), ("i", "LN(part[p_size])", "ln(p_size)"),
        ("j", "LOG(part[p_size], 2)", "ln(p_size) / ln(2)"), ("k", "LOG(part[p_size])", "log10(p_size)"), ("l", "CEILING(part[p_retailprice], 10)", "ceil(p_retailprice / 10) * 10"), ("m", "FLOOR(part[p_retailprice], 10)", "floor(p_retailprice / 10) * 10"),
        ("n", "ROUNDUP(part[p_retailprice], 0)", "ceil(p_retailprice)"), ("o", "ROUNDDOWN(part[p_retailprice], 0)", "floor(p_retailprice)"), ("p", "TRUNC(part[p_retailprice])", "floor(p_retailprice)"), ("q", "PI()", "pi()"), ("r", "part[p_size] ^ 2 + 1", "pow(p_size, 2) + 1"), ("s", "DIVIDE(part[p_size], 0, 9)", "CAST(9 AS DOUBLE)"), ("t", "-part[p_size] / 4", "-p_size / 4"),
    ]),
    "scalar_logic": _scalars([
        ("a", 'IF(part[p_size] > 25, "big", "small")', "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"), ("b", 'SWITCH(part[p_size], 1, "one", 2, "two", "more")', "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END"), ("c", 'SWITCH(TRUE(), part[p_size] < 10, "s", part[p_size] < 30, "m", "l")', "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END"),
        ("d", "COALESCE(BLANK(), part[p_size])", "p_size"), ("e", "ISBLANK(part[p_size])", "p_size IS NULL"), ("f", "AND(part[p_size] > 5, part[p_size] < 20)", "p_size > 5 AND p_size < 20"), ("g", "BLANK() == BLANK()", "true"), ("h", "FALSE()", "false"),
    ]),
    "scalar_dates": ("EVALUATE SELECTCOLUMNS(orders, \"k\", orders[o_orderkey], " + ", ".join(f'"{n}", {x}' for n, x in [
        ("y", "YEAR(orders[o_date])"), ("m", "MONTH(orders[o_date])"), ("d", "DAY(orders[o_date])"), ("q", "QUARTER(orders[o_date])"), ("w", "WEEKNUM(orders[o_date])"), ("wd", "WEEKDAY(orders[o_date])"), ("wm", "WEEKDAY(orders[o_date], 2)"), ("h", "HOUR(orders[o_orderdate])"), ("mi", "MINUTE(orders[o_orderdate])"), ("s", "SECOND(orders[o_orderdate])"),
        ("em", "EOMONTH(orders[o_date], 1)"), ("ed", "EDATE(orders[o_date], -1)"), ("dm", 'DATEDIFF(orders[o_date], DATE(1999, 1, 1), MONTH)'), ("dd", 'DATEDIFF(orders[o_date], DATEVALUE("1999-01-01"), DAY)'), ("dy", 'DATEDIFF(orders[o_date], DATE(1999, 1, 1), YEAR)'), ("dw", 'DATEDIFF(orders[o_date], DATE(1999, 1, 1), WEEK)'), ("dq", 'DATEDIFF(orders[o_date], DATE(1999, 1, 1), QUARTER)'), ("t", "TIME(1, 2, 3)"), ("f", 'FORMAT(orders[o_date], "yyyy-mm-dd")'),
    ]) + ")", f"SELECT o_orderkey AS k, CAST(year({D}) AS INTEGER) AS y, CAST(month({D}) AS INTEGER) AS m, CAST(day({D}) AS INTEGER) AS d, CAST(quarter({D}) AS INTEGER) AS q, CAST(weekofyear({D}) AS INTEGER) AS w, CAST(dayofweek({D}) + 1 AS INTEGER) AS wd, CAST(isodow({D}) AS INTEGER) AS wm, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(minute(o_orderdate) AS INTEGER) AS mi, CAST(second(o_orderdate) AS INTEGER) AS s, last_day({D} + INTERVAL 1 MONTH) AS em, CAST({D} - INTERVAL 1 MONTH AS TIMESTAMP) AS ed, CAST(date_diff('month', {D}, DATE '1999-01-01') AS INTEGER) AS dm, CAST(date_diff('day', {D}, DATE '1999-01-01') AS INTEGER) AS dd, CAST(date_diff('year', {D}, DATE '1999-01-01') AS INTEGER) AS dy, CAST(date_diff('day', date_trunc('week', {D}), date_trunc('week', DATE '1999-01-01')) / 7 AS INTEGER) AS dw, CAST(date_diff('quarter', {D}, DATE '1999-01-01') AS INTEGER) AS dq, '01:02:03' AS t, strftime({D}, '%Y-%m-%d') AS f FROM orders"),
}

#: Queries under filters from outside: text, filters, SQL.
FILTERED: dict[str, tuple[str, list[ExternalFilter], str]] = {
    "external_in": ('EVALUATE SUMMARIZECOLUMNS(customer[c_mktsegment], "v", [Order Value])', [ExternalFilter("cust_region", "r_name", "in", ("ASIA", "AFRICA"))], f"SELECT c_mktsegment, sum(o_totalprice) AS v FROM {ORDERS} LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AFRICA') GROUP BY 1"),
    "external_between": ("EVALUATE orders", [ExternalFilter("orders", "o_totalprice", "between", (100000, 120000))], "SELECT *, CAST(o_orderdate AS DATE) AS o_date FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000"),
    "external_contains": ('EVALUATE SUMMARIZECOLUMNS(part[p_brand], "n", COUNTROWS(part))', [ExternalFilter("part", "p_type", "contains", ("CON",))], "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part WHERE lower(p_type) LIKE '%con%' GROUP BY 1"),
    "external_tuples": ('EVALUATE SUMMARIZECOLUMNS("n", [Order Count])', [ExternalFilter("orders", "", "in_tuples", (("F", "1-URGENT"), ("O", "2-HIGH")), ("o_orderstatus", "o_orderpriority"))], "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH')"),
}


#: Queries on a model in which order lines filter orders too.
BOTH_WAYS: dict[str, tuple[str, str]] = {
    "both_ways_filter": ('EVALUATE ROW("v", CALCULATE([Order Value], part[p_size] = 7))', "SELECT sum(o_totalprice) AS v FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7)"),
    "both_ways_group": ('EVALUATE SUMMARIZECOLUMNS(part[p_type], "v", [Order Value])', "SELECT p_type, sum(o_totalprice) AS v FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, p_type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey GROUP BY 1"),
}


def _both_ways(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    e.relate("lineitem", "l_orderkey", "orders", "o_orderkey", True)
    return e


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(text: str, filters: list[ExternalFilter]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: engine(spark, sf_dir).query(text, filters)

    both = {n: (lambda spark, sf_dir, t=t: _both_ways(spark, sf_dir).query(t)) for n, (t, _) in BOTH_WAYS.items()}
    return {n: make(t, []) for n, (t, _) in QUERIES.items()} | {n: make(t, f) for n, (t, f, _) in FILTERED.items()} | both


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in (QUERIES | BOTH_WAYS).items()} | {n: s for n, (_, _, s) in FILTERED.items()}
