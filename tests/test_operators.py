"""Hand-computed cases of operators that SQL does not cover."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConstraintError, ContractError
from tidemark.operators import backtest as bt
from tidemark.operators import execution as exe
from tidemark.operators import factors as fac
from tidemark.operators import portfolio as por
from tidemark.operators import search
from tidemark.operators.execution import Impact
from tidemark.operators.intervals import next_session, root_of

D = [dt.date(2025, 1, 1) + dt.timedelta(days=k) for k in range(30)]


FREE = {"commission_bps": 0.0, "minimum_commission": 0.0, "sell_tax_bps": 0.0, "transfer_fee_bps": 0.0}


def bar(price, volume=1e9, paused=False, open=None, **more):
    open = price if open is None else open
    return {"open": open, "close": price, "high": max(open, price), "low": min(open, price), "volume": volume, "amount": volume * price, "paused": paused, "limit_up": None, "limit_down": None} | more


def play(bars, targets, actions=None, delisted=None, rules=None, days=None):
    """Ledger rows of a run; targets of one sleeve need not name it."""
    goals = {d: w if w and all(isinstance(x, dict) for x in w.values()) else {"main": w} for d, w in targets.items()}
    return bt.simulate(days or sorted(bars), bars, goals, actions or {}, delisted or {}, rules or bt.Rules())


def rows_of(rows, ledger, sleeve="main"):
    return [r[2:] for r in rows if r[1] == ledger and r[0] == sleeve]


def test_buy_and_hold_with_dividend_and_split():
    bars = {d: {1: bar(10.0 if k < 4 else 5.0)} for k, d in enumerate(D[:8])}
    paid = {"id": "p", "i": 1, "kind": "cash_dividend", "cash": 1.0, "share": 0.0}
    cut = {"id": "s", "i": 1, "kind": "split", "cash": 0.0, "share": 2.0}
    actions = {D[1]: [("record", paid)], D[2]: [("ex", paid)], D[3]: [("pay", paid), ("record", cut)], D[4]: [("ex", cut)]}
    rows = play(bars, {D[0]: {1: 0.5}}, actions, rules=bt.Rules(cash=100_000.0, costs=FREE))
    assert [f[:4] for f in rows_of(rows, "fill")] == [(D[1], 1, 5000.0, 10.0)]
    nav = {r[0]: (r[2], r[3]) for r in rows_of(rows, "nav")}
    assert nav[D[1]] == (100_000.0, 50_000.0) and nav[D[2]] == (105_000.0, 50_000.0) and nav[D[3]] == (105_000.0, 55_000.0) and nav[D[7]][0] == 105_000.0
    assert rows_of(rows, "position")[-1][2] == 10_000.0


def test_entitlement_is_what_was_held_at_the_record_date():
    bars = {d: {1: bar(10.0)} for d in D[:8]}
    paid = {"id": "p", "i": 1, "kind": "cash_dividend", "cash": 1.0, "share": 0.0}
    actions = {D[2]: [("record", paid)], D[4]: [("ex", paid)], D[6]: [("pay", paid)]}
    # Sold between record and ex date: still paid. Bought between them: not paid.
    sold = play(bars, {D[0]: {1: 0.5}, D[2]: {}}, actions, rules=bt.Rules(cash=100_000.0, costs=FREE))
    assert [r[2] for r in rows_of(sold, "cashflow")] == [-50_000.0, 5_000.0] or [r[2] for r in rows_of(sold, "cashflow")] == [-50_000.0, 50_000.0, 5_000.0]
    bought = play(bars, {D[2]: {1: 0.5}}, actions, rules=bt.Rules(cash=100_000.0, costs=FREE))
    assert [r[2] for r in rows_of(bought, "cashflow")] == [-50_000.0] and rows_of(bought, "action") == []


def test_sessions_without_bars_count():
    bars = {d: {1: bar(10.0)} for k, d in enumerate(D[:8]) if k not in (2, 3)}
    rows = play(bars, {D[0]: {1: 0.5}, D[1]: {}}, rules=bt.Rules(cash=10_000.0, costs=FREE, sell_delay=3), days=D[:8])
    assert [r[0] for r in rows_of(rows, "nav")] == D[:8]
    assert rows_of(rows, "residual")[0][0] == D[2] and rows_of(rows, "residual")[0][-1] == "no_price"


def test_sale_waits_for_the_delay_and_pause():
    bars = {d: {1: bar(10.0, paused=k == 3), 2: bar(20.0)} for k, d in enumerate(D[:8])}
    rules = bt.Rules(cash=10_000.0, costs=FREE, sell_delay=2)
    rows = play(bars, {D[0]: {1: 1.0}, D[1]: {2: 1.0}, D[2]: {2: 1.0}, D[4]: {2: 1.0}}, rules=rules)
    sold = [r for r in rows_of(rows, "fill") if r[2] < 0]
    assert [r[0] for r in sold] == [D[5]]
    assert {r[5] for r in rows_of(rows, "residual") if r[2] < 0} >= {"not_sellable", "halted"}


def test_minimum_commission_and_cash_limit():
    bars = {d: {1: bar(10.0)} for d in D[:3]}
    rows = play(bars, {D[0]: {1: 1.0}}, rules=bt.Rules(cash=1000.0))
    assert rows_of(rows, "fill") == []  # 100 shares cost 1005
    rows = play(bars, {D[0]: {1: 1.0}}, rules=bt.Rules(cash=1006.0))
    assert rows_of(rows, "fill")[0][4] == 5.0


@pytest.mark.parametrize("policy, nav", [("cash", 10_000.0), ("write_off", 5_000.0), ("carry", 10_000.0)])
def test_delisting(policy, nav):
    bars = {d: ({1: bar(10.0), 2: bar(1.0)} if k < 4 else {2: bar(1.0)}) for k, d in enumerate(D[:6])}
    rows = play(bars, {D[0]: {1: 0.5}}, delisted={1: D[4]}, rules=bt.Rules(cash=10_000.0, costs=FREE, delisting=policy))
    assert rows_of(rows, "nav")[-1][2] == nav


def test_sleeves_cross_before_the_market():
    """What one sleeve sells another buys, at the price of the day and without costs; the rest is one order."""
    bars = {d: {1: bar(10.0)} for d in D[:6]}
    rules = bt.Rules(cash=100_000.0, sleeves={"a": 0.5, "b": 0.5}, impact=Impact(per_root=0.0))
    rows = play(bars, {D[0]: {"a": {1: 0.8}, "b": {}}, D[2]: {"a": {1: 0.2}, "b": {1: 0.8}}}, rules=rules)
    assert rows_of(rows, "fill", "a") == [(D[1], 1, 4000.0, 10.0, pytest.approx(40_000 * 2.6 / 1e4), "")]
    assert rows_of(rows, "cross", "a")[0][:4] == (D[3], 1, -3100.0, 10.0) and rows_of(rows, "cross", "b")[0][2] == 3100.0
    assert [f[2] for f in rows_of(rows, "fill", "b")] == [900.0]
    total = sum(r[-1][2] for r in (rows_of(rows, "nav", "a"), rows_of(rows, "nav", "b")))
    costs = sum(f[4] for s in "ab" for f in rows_of(rows, "fill", s))
    assert math.isclose(total, 100_000.0 - costs)


def test_a_cross_needs_the_buyers_cash():
    """A buyer that could not pay for its crosses steps back, and the seller goes to the market."""
    session = bt.Session(D[0], 5, {1: bar(10.0)}, "close", {}, {}, bt.Rules(costs=FREE))
    a, b = bt.Sleeve("a", 0.0, []), bt.Sleeve("b", 500.0, [])
    a.add(1, 200, 0, 1)
    wanted = {"a": {1: -200}, "b": {1: 200}}
    session.cross([a, b], wanted)
    assert wanted == {"a": {1: -200}, "b": {1: 200}} and a.cash == 0.0
    b.cash = 2000.0
    session.cross([a, b], wanted)
    assert wanted == {"a": {1: 0}, "b": {1: 0}} and (a.cash, b.cash) == (2000.0, 0.0) and b.quantity(1) == 200


def test_fill_allocation_and_lots():
    assert bt.allocate(500, [300, 300, 400], 100) == [200, 100, 200] or sum(bt.allocate(500, [300, 300, 400], 100)) == 500
    assert bt.allocate(1000, [300, 700], 100) == [300, 700]
    s = bt.Sleeve("x", 0.0, [])
    s.add(1, 100, 0, 1)
    s.add(1, 200, 1, 1)
    s.scale(1, 30)
    assert [x[2] for x in s.lots[1]] == [110, 220]
    s.remove(1, 150, 5)
    assert [x[2] for x in s.lots[1]] == [180]


def test_one_fill_model_for_tables_and_the_loop(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(300):
        low, high = sorted(r.uniform(5, 15, 2))
        price = float(r.uniform(low, high))
        up, down = (float(r.uniform(low, high + 1)) if r.random() < 0.3 else None for _ in range(2))
        volume = float(r.integers(0, 40_000))
        rows.append((k, int(r.choice([-1, 1])), int(r.integers(1, 60)) * 50, 100, price, float(high), float(low), up, down, volume, volume * price, bool(r.random() < 0.1), str(r.choice(["stock", "etf"]))))
    names = "id int, side int, quantity long, lot int, price double, high double, low double, limit_up double, limit_down double, volume double, amount double, paused boolean, asset_type string"
    impact = Impact(participation=0.2, slippage=3.0, per_root=15.0, most=50.0)
    got = {x.id: x for x in exe.fills(exe.resolve_costs(spark.createDataFrame(rows, names)), impact).collect()}
    for x in (dict(zip([n.split()[0] for n in names.split(", ")], row, strict=True)) for row in rows):
        filled, price, commission, tax, reason = exe.fill_order(x["side"], x["quantity"], x["price"], 100, x, exe.costs_of(x["asset_type"]), impact)
        g = got[x["id"]]
        assert (g.filled, g.reason or "") == (filled, reason)
        assert np.allclose([g.fill_price or 0.0, g.commission, g.tax], [price, commission, tax])


def test_cost_chain_of_one_order():
    assert exe.costs_of("etf", {"sell_tax_bps": 9.0})["sell_tax_bps"] == 0.0 and exe.costs_of("stock", {"sell_tax_bps": 9.0})["sell_tax_bps"] == 9.0
    own = exe.costs_of("bond", {}, {"bond": {"commission_bps": 1.0}}, {"commission_bps": 2.0, "sell_tax_bps": math.nan})
    assert own["commission_bps"] == 1.0 and own["sell_tax_bps"] == exe.DEFAULTS["stock"]["sell_tax_bps"]


def test_fingerprint_covers_rules_and_cash():
    assert bt.Rules().fingerprint("x") == bt.Rules().fingerprint("x") != bt.Rules(cash=2.0).fingerprint("x") != bt.Rules().fingerprint("y")


def test_constraints():
    w, _ = por.constrain({"a": 0.5, "b": 0.3, "c": 0.2}, por.Limits(instrument=0.4))
    assert max(w.values()) <= 0.4 + 1e-12 and math.isclose(sum(w.values()), 1.0)
    w, _ = por.constrain({"a": 0.5, "b": 0.5}, por.Limits(industry=0.6), industry={"a": "x", "b": "x"})
    assert math.isclose(sum(w.values()), 0.6)
    w, told = por.constrain({"a": 1.0}, por.Limits(turnover=0.25), previous={"b": 1.0})
    assert math.isclose(w["a"], 0.25) and math.isclose(w["b"], 0.75) and ("turnover", 0.25) in told["changes"]
    # A shorter step would leave too much in b, so the whole step is kept and reported.
    w, told = por.constrain({"a": 0.5, "c": 0.5}, por.Limits(instrument=0.6, turnover=0.25), previous={"b": 1.0})
    assert w == {"a": 0.5, "c": 0.5} and told["turnover_kept"] == 1.0
    w, told = por.constrain({"a": 0.9, "b": 0.1}, por.Limits(least_cash=0.2, least_holdings=3))
    assert math.isclose(sum(w.values()), 0.8) and told["too_few_holdings"] == 2 and told["changes"][0][0] == "min_cash"
    with pytest.raises(ConstraintError):
        por.constrain({"a": 1.0}, por.Limits(industry=0.5))
    with pytest.raises(ConstraintError):
        por.constrain({"a": 1.0}, por.Limits(), universe={"b"})
    with pytest.raises(ConstraintError):
        por.constrain({"a": 1.2}, por.Limits())
    with pytest.raises(ConstraintError):
        por.Limits(least_cash=0.5, most_cash=0.1)
    with pytest.raises(ConstraintError):
        por.constrain({"a": 0.2}, por.Limits(most_cash=0.1))


def test_dropout_and_risk_parity():
    # Names within the best k + buffer stay; the others' places are filled in order of rank.
    assert por.top_k_dropout(list("abcdef"), ["c", "f"], 2, 2, 1) == (["c", "a"], ["c"], ["a"])
    assert por.top_k_dropout(list("abcdef"), ["e", "f"], 2, 2, 1) == (["a", "b"], [], ["a"])
    assert por.top_k_dropout(list("abcdef"), ["d", "c", "b"], 2, 2) == (["d", "c"], ["d", "c", "b"], [])
    assert por.top_k_dropout(list("ab"), [], 3) == (["a", "b"], [], ["a", "b"])
    r = np.random.default_rng(1).normal(size=(60, 3)) * np.array([1.0, 2.0, 4.0])
    w = por.risk_parity(r)
    cov = np.cov(r, rowvar=False) * 0.9 + 0.1 * np.diag(np.diag(np.cov(r, rowvar=False)))
    part = w * (cov @ w)
    assert np.allclose(part, part.mean(), rtol=1e-4) and math.isclose(w.sum(), 1.0)


def test_factor_values_do_not_depend_on_the_end(spark):
    r = np.random.default_rng(5)
    rows = [(k % 3, D[0] + dt.timedelta(days=k // 3), float(np.exp(r.normal())), 10.0, 100.0, bool(r.random() < 0.05)) for k in range(900)]
    bars = spark.createDataFrame(rows, "i long, d date, close double, volume double, amount double, paused boolean")
    cal = bars.select("d").distinct().withColumn("idx", F.datediff("d", F.lit(D[0])).cast("long") + 1)
    end = D[0] + dt.timedelta(days=280)
    for make in (lambda b, c: fac.beta(fac.session_returns(b, c).withColumn("cap", F.col("amount")), 60, 20), lambda b, c: fac.total_volatility(fac.session_returns(b, c), 60, 40), lambda b, c: fac.worst_loss(fac.session_returns(b, c), 60, 40)):
        whole = make(bars, cal).where(F.col("d") <= F.lit(end)).orderBy("d", "i").collect()
        short = make(bars.where(F.col("d") <= F.lit(end)), cal.where(F.col("d") <= F.lit(end))).orderBy("d", "i").collect()
        assert len(whole) == len(short) > 100
        assert np.allclose([x.value for x in whole], [x.value for x in short], rtol=1e-9)


def test_hierarchy_and_next_session(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "n long, p long")
    assert {r.n: r.top for r in root_of(tree, "n", "p").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    cal = spark.createDataFrame([(dt.date(2025, 1, 3),), (dt.date(2025, 1, 7),)], "d date")
    days = spark.createDataFrame([(dt.date(2025, 1, 3),), (dt.date(2025, 1, 10),), (dt.date(2025, 1, 11),)], "x date")
    got = {r.x.day: r.y.day for r in next_session(days, cal, "x", "y").collect()}
    assert got == {3: 7, 10: 13, 11: 13}  # beyond the calendar: the next weekday


def test_search_reuses_and_ranks(tmp_path):
    store = search.Store(str(tmp_path / "runs.db"))
    calls = []

    def run(p):
        calls.append(p)
        if p["x"] == 3:
            raise ValueError("no")
        return {"gain": float(p["x"] * p["y"])}

    points = list(search.grid({"x": [1, 2, 3], "y": [1, 5]}))
    best = search.search(points, run, "gain", store, "s")
    assert best[0]["params"] == {"x": 2, "y": 5} and len(best) == 4
    n = len(calls)
    search.search(points[:4], run, "gain", store, "s")
    assert len(calls) == n
    a, b = (list(search.sample({"k": {"low": 1, "high": 100, "log": True, "int": True}, "c": {"choices": "ab"}}, 10, 3)) for _ in range(2))
    assert a == b and len({search.key_of(p) for p in a}) == 10
    store.start("r1", "backtest", "f", {"a": 1})
    store.finish("r1", {"nav": 2.0})
    assert store.succeeded("f") == "r1" and store.compare(["r1"]) == {"nav": {"r1": 2.0}}


def test_quality_helpers(spark):
    from tidemark.operators.quality import check_factor, quarantine

    df = spark.createDataFrame([(D[0], 1, 1.0), (D[0], 1, 2.0)], "d date, i long, value double")
    with pytest.raises(ContractError):
        check_factor(df)
    with pytest.raises(ContractError):
        quarantine(df, {"low": F.col("value") < 5}, least=1)


def test_factor_engine(spark, tmp_path):
    from tidemark.errors import CacheMissError, FactorError, FutureDataError
    from tidemark.operators.engine import Factor, FactorEngine

    bars = spark.createDataFrame([(1, d, float(k + 1)) for k, d in enumerate(D)], "i long, d date, close double")
    calls = []

    def ret(context, needed):
        calls.append(context.start)
        return fac.two_point_return(context.bars, 2)

    base = Factor("ret", ret, lookback=2)
    twice = Factor("twice", lambda c, needed: needed[0].withColumn("value", F.col("value") * 2), needs=(base,))
    engine = FactorEngine(spark, bars, D, "f", str(tmp_path))
    got = engine.compute(twice, D[10], D[20])
    assert got.count() == 11 and math.isclose(got.where(F.col("d") == F.lit(D[10])).first().value, 2 * (11 / 9 - 1))
    n = len(calls)
    assert engine.compute(twice, D[10], D[20]).count() == 11 and len(calls) == n
    assert engine.compute(twice, D[12], D[15], cutoff=D[20]).count() == 4 and len(calls) == n
    with pytest.raises(CacheMissError):
        engine.compute(twice, D[5], D[6], policy="require")
    with pytest.raises(FutureDataError):
        engine.compute(twice, D[5], D[6], cutoff=D[5])
    with pytest.raises(FactorError):
        engine.compute(Factor("x", ret, needs=(Factor("ret", ret, version="2"), base)), D[5], D[6])
    assert engine.purge([]) == 2


def test_run_folder(spark, tmp_path):
    import os

    from tidemark.operators.report import write_run

    rows = [(1, *r) for r in play({d: {1: bar(10.0)} for d in D[:3]}, {D[0]: {1: 0.5}})]
    df = spark.createDataFrame(rows, bt.LEDGER)
    folder = write_run(df, {"total_return": 0.0}, {}, str(tmp_path / "run"))
    assert spark.read.parquet(os.path.join(folder, "nav")).count() == 3 and "Account" in open(os.path.join(folder, "report.html")).read()
    assert bt.reconcile(df, {1: bt.Rules()}).count() == 0


def test_progressive_fill_is_the_highest_level():
    """One level for all: found by bisection too, for caps on names and on groups."""
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 9))
        base = {k: float(x) for k, x in enumerate(r.random(n))}
        group = {k: int(r.integers(0, 3)) for k in base}
        caps = [(frozenset([k]), 0.3) for k in base] + [(frozenset(k for k in base if group[k] == g), 0.4) for g in set(group.values())]
        budget = float(r.random())

        def filled(level, base=base, group=group):
            top = {}
            for g in set(group.values()):
                own = [k for k in base if group[k] == g]
                low, high = 0.0, level
                if sum(min(0.3, base[k] * high) for k in own) > 0.4:
                    for _ in range(80):
                        mid = (low + high) / 2
                        low, high = (mid, high) if sum(min(0.3, base[k] * mid) for k in own) <= 0.4 else (low, mid)
                top |= {k: min(0.3, base[k] * high) for k in own}
            return top

        low, high = 0.0, 1e6
        for _ in range(120):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(filled(mid).values()) <= budget else (low, mid)
        got, want = por.progressive_fill(base, budget, caps), filled(low)
        assert all(abs(got.get(k, 0.0) - want[k]) < 1e-6 for k in base)
