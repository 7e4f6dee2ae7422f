"""Queries that cover every row of their job, against brute force on a small market.
"""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import catalog, views

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier orders lineitem".split()


@pytest.fixture(scope="module")
def market(tmp_path_factory):
    """A folder of small tables: 9 instruments, days of 1996 to 2001, a customer in seven has an open interval."""
    r = np.random.default_rng(7)
    days = [dt.datetime(1996, 1, 1) + dt.timedelta(days=45 * k) for k in range(46)]
    n = 1500
    price = r.integers(100, 900, n).astype(float)
    quantity = r.integers(1, 9, n).astype(float)
    tables = {
        "nation": pd.DataFrame({"n_nationkey": range(9), "n_name": [f"n{k}" for k in range(9)], "n_regionkey": 0}),
        "supplier": pd.DataFrame({"s_suppkey": range(1, 19), "s_nationkey": [k % 9 for k in range(18)]}),
        "customer": pd.DataFrame({"c_custkey": range(1, 61), "c_mktsegment": [f"seg{k % 4}" for k in range(60)], "c_acctbal": 1.0}),
        "orders": pd.DataFrame({"o_orderkey": range(150), "o_custkey": r.integers(1, 61, 150), "o_orderdate": [days[k] for k in r.integers(0, 46, 150)]}),
        "lineitem": pd.DataFrame({"l_orderkey": range(n), "l_suppkey": r.integers(1, 19, n), "l_shipdate": [days[k] for k in r.integers(0, 46, n)], "l_quantity": quantity, "l_extendedprice": price * quantity, "l_returnflag": "N"}),
    }
    folder = tmp_path_factory.mktemp("market")
    for name, df in tables.items():
        df.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def of_sql(name):
    """The rows of a query's SQL on the smallest tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(catalog.ORACLES[name]).df()


def plain(df, *columns):
    """Sorted rows of a pandas frame, days as text."""
    return sorted(tuple(str(v)[:10] if isinstance(v, (dt.date, pd.Timestamp)) else v for v in row) for row in df[list(columns)].itertuples(index=False))


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_every_closed_interval_is_expanded(spark, market):
    got = catalog.QUERIES["join_14_range_expansion"](spark, market).collect()
    days = [r.d for r in views.calendar(spark, market).collect()]
    want = sorted((m.id, d) for m in views.membership(spark, market).collect() if m.end for d in days if m.start <= d < m.end)
    assert sorted((r.id, r.d) for r in got) == want and len({i for i, _ in want}) > 20


@needs_tables
def test_expansion_holds_what_the_sql_covers(spark):
    got = catalog.QUERIES["join_14_range_expansion"](spark, SF).toPandas()
    assert plain(got, "id", "d") == plain(of_sql("join_14_range_expansion"), "id", "d")


def industry_of(spark, folder):
    """The industry of an instrument on a day: of the intervals that hold it, the latest start wins."""
    held = views.membership(spark, folder).collect()

    def find(i, d):
        found = [(m.start, m.industry) for m in held if m.i == i and m.start <= d and (m.end is None or m.end >= d)]
        return max(found)[1] if found else "UNKNOWN"

    return find


def test_industries_of_all_days(spark, market):
    got = catalog.QUERIES["join_08_interval_join"](spark, market).collect()
    find = industry_of(spark, market)
    want = sorted((b.i, b.d, find(b.i, b.d)) for b in views.bars(spark, market).collect())
    assert sorted((r.i, r.d, r.industry) for r in got) == want
    assert min(d for _, d, _ in want).year == 1996 and len({x for _, _, x in want}) == 5


def test_industry_pnl_of_all_days(spark, market):
    got = {(r.d, r.industry): r.pnl for r in catalog.QUERIES["ana_06_industry_pnl"](spark, market).collect()}
    find, last, want = industry_of(spark, market), {}, {}
    for b in sorted(views.bars(spark, market).collect(), key=lambda b: (b.i, b.d)):
        volume, close = last.get(b.i, (0.0, 0.0))
        key = (b.d, find(b.i, b.d))
        want[key] = want.get(key, 0.0) + volume * (b.close - close)
        last[b.i] = (b.volume, b.close)
    assert got.keys() == want.keys() and min(got)[0].year == 1996
    assert all(abs(got[k] - want[k]) < 2e-3 for k in want)


@needs_tables
@pytest.mark.parametrize("name, columns", [("join_08_interval_join", "i d industry"), ("ana_06_industry_pnl", "d industry pnl")])
def test_industries_hold_what_the_sql_covers(spark, name, columns):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert plain(got, *columns.split()) == plain(of_sql(name), *columns.split())


def test_covariances_of_all_instruments(spark, market):
    got = {(r.x, r.y): r["cov"] for r in catalog.QUERIES["agg_17_covariance"](spark, market).collect()}
    wide = views.bars(spark, market).toPandas().pivot(index="d", columns="i", values="close")
    want = {(x, y): (1.0 if x == y else 0.9) * float(v) for x, own in wide.cov().to_dict().items() for y, v in own.items() if not np.isnan(v)}
    assert got.keys() == want.keys() and len(want) == 81
    assert all(abs(got[k] - want[k]) < 6e-3 for k in want)


def test_risk_parity_of_all_instruments(spark, tmp_path):
    days = [dt.datetime(2000, 1, 1) + dt.timedelta(days=k) for k in range(70)]
    r = np.random.default_rng(3)
    rows = [(s, d, 1.0, float(np.exp(r.normal(0, 0.01 * s))) * 100, "N") for s in range(1, 10) for d in days]
    pd.DataFrame(rows, columns="l_suppkey l_shipdate l_quantity l_extendedprice l_returnflag".split()).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    pd.DataFrame({"s_suppkey": range(1, 10), "s_nationkey": range(9)}).to_parquet(tmp_path / "supplier.parquet")
    got = {r.i: r.weight for r in catalog.QUERIES["por_04_risk_parity"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(9)) and abs(sum(got.values()) - 1) < 1e-9
    wide = views.bars(spark, str(tmp_path)).toPandas().pivot(index="d", columns="i", values="close").sort_index()
    cov = wide.pct_change().tail(60).cov().to_numpy()
    w = np.array([got[k] for k in range(9)])
    part = w * ((0.9 * cov + 0.1 * np.diag(np.diag(cov))) @ w)
    assert np.allclose(part, part.mean(), rtol=1e-4)


def test_unpivot_of_all_instruments(spark, market):
    got = catalog.QUERIES["agg_19_unpivot"](spark, market).collect()
    want = sorted((b.i, b.d, f, b[f]) for b in views.bars(spark, market).collect() for f in ("open", "close"))
    assert sorted((r.i, r.d, r.field, r.value) for r in got) == want and {w[0] for w in want} == set(range(9))


@needs_tables
@pytest.mark.parametrize("name, columns", [("agg_17_covariance", "x y cov"), ("agg_19_unpivot", "i d field value")])
def test_all_instruments_hold_what_the_sql_covers(spark, name, columns):
    got, want = (plain(x, *columns.split()) for x in (catalog.QUERIES[name](spark, SF).toPandas(), of_sql(name)))
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=1e-9)


def test_a_run_streams_by_session():
    """The fold asks for a session's rows when it plays it, and hands on ledger rows before the run ends."""
    from tidemark.operators.backtest import Rules, _played

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(50)]
    read = []

    def panel():
        blank = (None,) * 8
        yield (1, "instrument", None, 7, *blank, None, "stock", "2020-02-10")
        for d in days:
            read.append(d)
            yield (1, "action", d, 7, 1.0, 0.0, *blank[2:], None, "cash_dividend", f"record|{d}")
            yield (1, "bar", d, 7, 10.0, 10.0, 10.0, 10.0, 1e9, 1e10, None, None, False, None, None)
            yield (1, "session", d, None, *blank, None, None, None)
            if d == days[0]:
                yield (1, "target", d, 7, 0.5, *blank[1:], None, None, "main")

    told = _played(panel(), Rules(), most=10)
    first = next(told)
    assert len(read) < 10 and len(first) < 20
    rows = first + [r for part in told for r in part]
    assert [r[2] for r in rows if r[1] == "nav"] == days
    assert [r[2] for r in rows if r[7] == "delisted"] == [dt.date(2020, 2, 10)]


def below_zero(name, spark, folder):
    """A query's rows and its SQL's, of accounts that fall below zero and whose days end in half cents."""
    days = [dt.datetime(1996 + k // 4, 1 + k % 4, 1) for k in range(16)]
    loses = lambda run, k: run < 2 and k == 5  # noqa: E731  more than all it has
    rows = [(20 * k + 2 * run + loses(run, k), run, 1.5e8 if loses(run, k) else 1000.5 + k + run, d) for k, d in enumerate(days) for run in range(5)]
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]).to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.sql(catalog.ORACLES[name]).df()
    plain = lambda df: sorted((tuple("nan" if v != v else float(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    return plain(ours), plain(theirs)


def test_benchmark_below_zero(spark, tmp_path):
    ours, theirs = below_zero("ana_02_benchmark", spark, tmp_path)
    assert ours == theirs and len(ours) == 4 and all("nan" in r for r in ours)


def test_years_below_zero(spark, tmp_path):
    ours, theirs = below_zero("ana_08_yearly", spark, tmp_path)
    assert ours == theirs and sum("nan" in r for r in ours) == 2


def test_without_best_days_below_zero(spark, tmp_path):
    ours, theirs = below_zero("ana_08_without_best_days", spark, tmp_path)
    assert ours == theirs and sum("nan" in r for r in ours) == 2


def test_equal_intervals_follow_by_id(spark, tmp_path):
    """Equal intervals of one key in any order of rows: the last id alone sees the next interval."""
    ids = [350 * k + 50 for k in (5, 2, 4, 1, 3)]  # one instrument and bucket, closed intervals
    pd.DataFrame({"c_custkey": ids, "c_mktsegment": "x"}).to_parquet(tmp_path / "customer.parquet")
    when = [(1, 9) if c != max(ids) else (5, 12) for c in ids]
    rows = [(c, dt.datetime(1996, 1, day)) for c, days in zip(ids, when, strict=True) for day in days]
    pd.DataFrame(rows, columns=["o_custkey", "o_orderdate"]).to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    got = catalog.QUERIES["dq_05_overlaps"](spark, str(tmp_path)).collect()
    first = dt.date(1996, 1, 1)
    assert sorted((r.id, r.next_start) for r in got) == [(400, first), (750, first), (1100, first), (1450, dt.date(1996, 1, 5))]


def test_an_account_beyond_doubles_is_played_and_reconciled(spark):
    """A holding that doubles on each of 1,100 sessions, and pays a dividend on the last, leaves the range of doubles."""
    from pyspark.sql import functions as F

    from tidemark.operators import backtest as bt

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(1100)]
    bars = spark.createDataFrame([(7, d, 10.0, 10.0, 10.0, 10.0, 1e9, 1e10, False) for d in days], "i long, d date, open double, high double, low double, close double, volume double, amount double, paused boolean")
    targets = spark.createDataFrame([(1, days[0], 7, 0.5)], "run long, d date, i long, weight double")
    events = [(k, 7, "split", d, 0.0, 2.0, True) for k, d in enumerate(days[2:])] + [(9999, 7, "cash_dividend", days[-1], 1.0, 0.0, True)]
    actions = spark.createDataFrame(events, "id long, i long, kind string, ex date, cash double, share double, active boolean")
    rows = bt.run_backtests(bars, targets, actions, spark.createDataFrame([(7, None)], "i long, delisted date"), {1: bt.Rules()}).cache()
    held = bt.ledger(rows, "position").orderBy("d").collect()
    assert len(held) == 1099 and held[0].wide is None and held[-1].quantity == float("inf")
    n = held[0].quantity
    assert held[-1].wide[0].m * 2.0 ** (held[-1].wide[0].e - 1098) == n and held[1000].quantity == n * 2.0**1000
    assert bt.reconcile(rows, {1: bt.Rules()}).count() == 0
    off = rows.withColumn("wide", F.when((F.col("ledger") == "position") & (F.col("d") == F.lit(days[-1])), F.transform("wide", lambda x: x.withField("m", x["m"] * 0.999))).otherwise(F.col("wide")))
    assert [tuple(r) for r in bt.reconcile(off, {1: bt.Rules()}).select("d", "wrong").collect()] == [(days[-1], ["shares", "value"])]


def test_wide_numbers_follow_doubles_and_fractions():
    from fractions import Fraction

    from tidemark.operators import wide

    exact = lambda x: Fraction(x) if not isinstance(x, wide.Wide) else Fraction(x.m) * Fraction(2) ** x.e
    near = lambda a, b: abs(exact(a) - b) <= abs(b) * Fraction(1, 2**50)
    numbers = [3.5, -0.25, 10**320, -(7**400), wide.Wide(0.75, 3000), wide.Wide(-0.5, 1500), wide.Wide(0.6, -2000), 1e308]
    for a in numbers:
        for b in numbers:
            assert near(wide.times(a, b), exact(a) * exact(b)) and near(wide.over(wide.number(a), wide.number(b)), exact(a) / exact(b))
            if exact(a) + exact(b):
                assert near(wide.plus(a, b), exact(a) + exact(b))
            assert (wide.number(a) < wide.number(b)) == (exact(wide.number(a)) < exact(wide.number(b)))
    assert wide.times(3, 0.1) == 3 * 0.1 and wide.plus(0.1, 0.2) == 0.1 + 0.2 and wide.total([0.1] * 10) == sum([0.1] * 10)
    assert wide.ratio(10**400, 3, 10**399) == 30 and wide.share(10**400, 0.5).bit_length() == (5 * 10**399).bit_length()
