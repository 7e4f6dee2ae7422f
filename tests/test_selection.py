"""Folds and limits that SQL does not express, against plain Python on the test tables."""

import os

import pytest

from tidemark.errors import ConstraintError
from tidemark.functions.windows import ewm
from tidemark.operators import execution as exe
from tidemark.operators import portfolio as por
from tidemark.operators.catalog import catalog
from tidemark.plans import catalog as plans
from tidemark.plans import catalog_plans, selection_plans

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def by_day(rows):
    out = {}
    for r in rows:
        out.setdefault(r.d, []).append(r)
    return out


@needs_tables
def test_dropout_path_against_a_plain_fold(spark):
    got = {d: sorted((r.i, r.kept) for r in rows) for d, rows in by_day(plans.QUERIES["por_02_top_k_dropout"](spark, SF).collect()).items()}
    held, want = [], {}
    for d, rows in sorted(by_day(selection_plans.month_signal(spark, SF).collect()).items()):
        ranked = [r.i for r in sorted(rows, key=lambda r: (-r.score, r.i))]
        stay = [i for i in held if i in ranked[:8]]
        held = (stay + [i for i in ranked if i not in stay])[: max(5, min(5, len(stay)))]
        want[d] = sorted((i, i in stay) for i in held)
    assert got == want and len(got) > 10


@needs_tables
def test_limits_hold_on_every_date(spark):
    got, limits = by_day(plans.QUERIES["con_01_limits"](spark, SF).collect()), selection_plans.LIMITS
    signal = by_day(selection_plans.month_signal(spark, SF).collect())
    assert got.keys() <= signal.keys() and len(got) > 10
    for d, rows in got.items():
        w = {r.i: r.weight for r in rows}
        assert max(w.values()) <= limits.instrument + 1e-9 and sum(w.values()) <= 0.95 + 1e-9 and len(w) <= limits.holdings
        for g in range(5):
            assert sum(v for i, v in w.items() if i % 5 == g) <= limits.industry + 1e-9
        assert sum(v for i, v in w.items() if i % 2 == 0) <= 0.5 + 1e-9
        n = len(signal[d])
        rank = {r.i: k for k, r in enumerate(sorted(signal[d], key=lambda r: (r.score, -r.i)), 1)}
        base = {i: k / (n * (n + 1) / 2) for i, k in rank.items()}
        want, _ = por.constrain(base, limits, None, {i: str(i % 5) for i in base}, {i: "x" if i % 2 == 0 else "y" for i in base})
        assert w.keys() == want.keys() and all(abs(w[i] - want[i]) < 1e-9 for i in w)


def test_dates_that_cannot_be_met_have_no_rows(spark):
    rows = spark.sql("select date'2020-01-01' d, 1L i, 0.2D weight, 'a' industry, 'x' asset")
    assert por.constrain_by_date(rows, por.Limits(most_cash=0.1)).count() == 0
    with pytest.raises(ConstraintError):
        por.constrain({1: 0.2}, por.Limits(most_cash=0.1))


def test_keys_that_are_not_unique_raise(spark):
    a, b = spark.range(5), spark.range(5).unionAll(spark.range(2))
    assert exe.one_to_one(a, a.withColumnRenamed("id", "id"), ["id"]).count() == 5
    with pytest.raises(Exception, match="not unique"):
        exe.one_to_one(a, b, ["id"]).collect()


def test_ewm_over_nulls_and_spans(spark):
    rows = [(1, k, None if k in (3, 4) else float(k * k)) for k in range(40)] + [(2, 0, 5.0)]
    got = {(r.k, r.t): (r.a, r.b) for r in ewm(spark.createDataFrame(rows, "k int, t int, x double"), "k", "t", {"a": ("x", 3), "b": ("x", 9)}).collect()}
    for n, span in enumerate((3, 9)):
        a, mean, far = 2 / (span + 1), None, 0
        for _, t, x in rows[:40]:
            if x is not None:  # the old mean's weight has decayed over the rows without a value
                old = (1 - a) ** (far + 1)
                mean = x if mean is None else (old * mean + a * x) / (old + a)
                far = 0
            else:
                far += 1
            assert abs(got[1, t][n] - mean) < 1e-9
    assert got[2, 0] == (5.0, 5.0)


def test_catalog_has_the_published_factors():
    names = list(catalog())
    assert len(names) == len(set(names)) == 35 and names[0] == "dividend_yield_l12m" and names[-1] == "roe_ttm"
    assert {n for n in plans.QUERIES if n.startswith("fac_23")} == {"fac_23_catalog"}


@needs_tables
def test_every_factor_gives_day_instrument_value(spark):
    market = catalog_plans.market(spark, SF)
    for name, build in catalog().items():
        assert build(market).columns == ["d", "i", "value"], name
