"""Context transition and stock measures, held against plain Python over the same rows."""

import datetime as dt
import random

import pytest

from tabulon.engine import Engine

# a lending library: loans of titles at branches

GENRES = {"Atlas": "map", "Ballad": "verse", "Chart": "map", "Diary": "prose", "Elegy": "verse"}


def _loans():
    rng = random.Random(21)
    return [(i, rng.choice([t for t in GENRES if t != "Diary"]), rng.choice(["hill", "port", "mill"]), rng.randrange(1, 40)) for i in range(70)]


LOANS = _loans()


def days(test=lambda loan: True):
    return sum(x[3] for x in LOANS if test(x)) or None


@pytest.fixture(scope="module")
def library(spark):
    e = Engine(spark)
    e.add_table("loans", spark.createDataFrame(LOANS, "loan int, title string, branch string, length int"))
    e.add_table("titles", spark.createDataFrame(list(GENRES.items()), "title string, genre string"))
    e.relate("loans", "title", "titles", "title")
    e.add_measure("loans", "Days", "SUM(loans[length])")
    e.add_measure("loans", "Twice", "2 * [Days]")
    e.add_measure("loans", "Days Of All", "CALCULATE([Days], ALL(titles))")
    e.add_measure("loans", "Branches Used", 'COUNTROWS(SUMMARIZECOLUMNS(loans[branch], "d", SUM(loans[length])))')
    return e


def per_title(library, expr):
    return {r["title"]: r["x"] for r in library.query(f'EVALUATE ADDCOLUMNS(titles, "x", {expr})').collect()}


def scalar(library, expr):
    return library.query(f'EVALUATE ROW("x", {expr})').first()["x"]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        # a measure, or CALCULATE, sees the row; a plain aggregate doesn't
        ("[Days]", lambda t: days(lambda x: x[1] == t)),
        ("CALCULATE(MAX(loans[length]))", lambda t: max((x[3] for x in LOANS if x[1] == t), default=None)),
        ("SUM(loans[length])", lambda t: days()),
        # through a measure of a measure
        ("[Twice] - [Days]", lambda t: days(lambda x: x[1] == t)),
        # the row's filter is cleared, replaced, or kept beside another
        ("[Days Of All]", lambda t: days()),
        # (the row's genre stays)
        ('CALCULATE([Days], titles[title] = "Chart")', lambda t: days(lambda x: x[1] == "Chart" and GENRES[t] == "map")),
        ('CALCULATE([Days], KEEPFILTERS(titles[title] = "Chart"))', lambda t: days(lambda x: x[1] == t == "Chart")),
        ('CALCULATE([Days], loans[branch] = "mill")', lambda t: days(lambda x: x[1] == t and x[2] == "mill")),
        # tables
        ("COUNTROWS(RELATEDTABLE(loans)) + 0", lambda t: sum(x[1] == t for x in LOANS)),
        ("COUNTROWS(CALCULATETABLE(loans, loans[length] >= 20)) + 0", lambda t: sum(x[1] == t and x[3] >= 20 for x in LOANS)),
        ("COUNTROWS(CALCULATETABLE(loans, ALL(titles))) + 0", lambda t: len(LOANS)),
        ("[Branches Used] + 0", lambda t: len({x[2] for x in LOANS if x[1] == t})),
    ],
)
def test_rows_become_filters(library, expr, want):
    got = per_title(library, expr)
    assert got.keys() == GENRES.keys()
    for t, x in got.items():
        assert (x or None) == (want(t) or None), t


def test_iterators_over_rows(library):
    assert scalar(library, "SUMX(titles, [Days])") == days()
    assert scalar(library, "SUMX(titles, SUM(loans[length]))") == len(GENRES) * days()
    assert scalar(library, 'SUMX(SELECTCOLUMNS(titles, "t", titles[title]), [Twice])') == 2 * days()
    best = {g: max(days(lambda x, t=t: x[1] == t) or 0 for t in GENRES if GENRES[t] == g) for g in set(GENRES.values())}
    assert scalar(library, "SUMX(VALUES(titles[genre]), MAXX(VALUES(titles[title]), [Days]))") == sum(best.values())
    got = {r["genre"]: r["m"] for r in library.query('EVALUATE SUMMARIZECOLUMNS(titles[genre], "m", MAXX(VALUES(titles[title]), [Days]))').collect()}
    assert got == {g: m for g, m in best.items() if m}
    assert library.query("VAR some = FILTER(titles, titles[genre] = \"map\") EVALUATE ROW(\"x\", SUMX(some, [Days]))".replace("VAR some", "EVALUATE VAR some").replace("EVALUATE ROW", "RETURN ROW")).first()["x"] == days(lambda x: GENRES[x[1]] == "map")
    totals = sorted(((days(lambda x, t=t: x[1] == t) or 0, t) for t in GENRES), reverse=True)
    assert [r["title"] for r in library.query("EVALUATE TOPN(1, titles, [Days])").collect()] == [totals[0][1]]
    bound = totals[2][0]
    assert {r["title"] for r in library.query(f"EVALUATE FILTER(titles, [Days] >= {bound})").collect()} == {t for n, t in totals if n >= bound}


# tanks whose level is read on some days, and what flows out each day

START = dt.date(2023, 11, 20)


def _tanks():
    rng = random.Random(22)
    level = {(START + dt.timedelta(i), t): rng.randrange(50, 900) for t in ("east", "west") for i in sorted(rng.sample(range(75), 9))}
    flow = [(START + dt.timedelta(i), t, rng.randrange(1, 9)) for i in range(75) for t in ("east", "west") if rng.random() < 0.8]
    return level, flow


LEVEL, FLOW = _tanks()


def last_level(tanks, test):
    """The sum of what was read on the last day with any reading."""
    read = {d for (d, t) in LEVEL if t in tanks and test(d)}
    return sum(v for (d, t), v in LEVEL.items() if t in tanks and d == max(read)) if read else None


@pytest.fixture(scope="module")
def water(spark):
    e = Engine(spark)
    days_ = [START + dt.timedelta(i) for i in range(75)]
    e.add_table("calendar", spark.createDataFrame([(d, d.strftime("%Y-%m"), d.isocalendar()[1]) for d in days_], "day date, month string, week int"))
    e.add_table("tanks", spark.createDataFrame([("east", "steel"), ("west", "clay")], "tank string, kind string"))
    e.add_table("readings", spark.createDataFrame([(d, t, v) for (d, t), v in LEVEL.items()], "day date, tank string, litres int"))
    e.add_table("outflow", spark.createDataFrame(FLOW, "day date, tank string, litres int"))
    for fact in ("readings", "outflow"):
        e.relate(fact, "day", "calendar", "day")
        e.relate(fact, "tank", "tanks", "tank")
    e.set_date_table("calendar", "day")
    e.add_measure("readings", "Read", "SUM(readings[litres])")
    e.add_measure("readings", "Level", "CALCULATE([Read], DATESINPERIOD(calendar[day], LASTNONBLANK(calendar[day], [Read]), 1, DAY))")
    e.add_measure("readings", "Latest", "CALCULATE(SUM(readings[litres]), DATESINPERIOD(readings[day], MAX(readings[day]), 1, DAY))")
    e.add_measure("outflow", "Out", "SUM(outflow[litres])")
    return e


def test_levels_by_month_and_kind(water):
    got = {(r["month"], r["kind"]): (r["l"], r["m"], r["o"]) for r in water.query('EVALUATE SUMMARIZECOLUMNS(calendar[month], tanks[kind], "l", [Level], "m", [Latest], "o", [Out])').collect()}
    months = sorted({(START + dt.timedelta(i)).strftime("%Y-%m") for i in range(75)})
    want = {}
    for m in months:
        for tank, kind in (("east", "steel"), ("west", "clay")):
            inside = lambda d, m=m: d.strftime("%Y-%m") == m
            level = last_level([tank], inside)
            out = sum(v for d, t, v in FLOW if t == tank and inside(d)) or None
            if level is not None or out is not None:
                want[(m, kind)] = (level, level, out)
    assert got == want


def test_levels_in_total_and_summed(water):
    both = ["east", "west"]
    r = water.query('EVALUATE ROW("l", [Level], "m", [Latest], "s", SUMX(VALUES(tanks[kind]), [Level]), "o", SUMX(VALUES(tanks[tank]), [Out]))').first()
    assert (r["l"], r["m"]) == (last_level(both, lambda d: True),) * 2
    assert r["s"] == sum(last_level([t], lambda d: True) for t in both) and r["o"] == sum(v for *_, v in FLOW)


def test_levels_under_a_filter(water):
    month = "2023-12"
    got = {r["tank"]: r["l"] for r in water.query(f'EVALUATE SUMMARIZECOLUMNS(tanks[tank], TREATAS({{"{month}"}}, calendar[month]), "l", [Level])').collect()}
    want = {t: last_level([t], lambda d: d.strftime("%Y-%m") == month) for t in ("east", "west")}
    assert got == {t: v for t, v in want.items() if v is not None}


def test_window_on_a_facts_own_date_is_no_cartesian_product(water):
    """Bounds meet days, days meet the fact by equality: at a month's end, what flowed out in the 20 days before."""
    df = water.query('EVALUATE SUMMARIZECOLUMNS(calendar[month], tanks[tank], "x", CALCULATE([Out], DATESINPERIOD(outflow[day], MAX(outflow[day]), -20, DAY)))')
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan
    got = {(r["month"], r["tank"]): r["x"] for r in df.collect()}
    want = {}
    for m, tank in {(d.strftime("%Y-%m"), t) for d, t, _ in FLOW}:
        mine = [(d, v) for d, t, v in FLOW if t == tank and d.strftime("%Y-%m") == m]
        end = max(d for d, _ in mine)
        want[(m, tank)] = sum(v for d, v in mine if end - dt.timedelta(20) < d <= end)
    assert got == want
