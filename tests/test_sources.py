"""Contracts, snapshots, guards and connectors."""

import datetime as dt
import json
import os

import pytest

from tidemark.errors import ContractError, FutureDataError
from tidemark.functions.asof import metric_panel
from tidemark.operators.quality import normalise
from tidemark.sources import connectors
from tidemark.sources.snapshot import Snapshot, list_snapshots, publish, scan

D = [dt.date(2025, 1, 1) + dt.timedelta(days=k) for k in range(9)]


def market(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    bars = [(d, i, 10.0, 10.1, 9.9, 10.0, 10.0, 1000, 10000.0, False, None, None) for d in D for i in ("A", "B")]
    return {
        "instruments": df([("A", "A", "XSHG", "stock", D[0], None, 100, 1), ("B", "B", "XSHE", "etf", D[0], None, 100, 0)], "instrument_id string, symbol string, exchange string, asset_type string, list_date date, delist_date date, lot_size long, sell_delay_days long"),
        "trade_calendar": df([(d, "XSHG") for d in D], "trade_date date, exchange string"),
        "daily_raw": df(bars, "trade_date date, instrument_id string, open double, high double, low double, close double, pre_close double, volume long, amount double, paused boolean, limit_up double, limit_down double"),
        "corporate_actions": df([("e", "A", "cash_dividend", D[2], D[3], D[4], 1.0, 0.0, "active", D[1])], "event_id string, instrument_id string, event_type string, record_date date, ex_date date, pay_date date, cash_per_share double, share_ratio double, status string, announced_at date"),
        "universe_membership": df([("u", "A", D[0], None, D[0])], "universe_id string, instrument_id string, effective_from date, effective_to date, known_at date"),
        "industry_membership": df([("c", "x", "A", D[0], None, D[0])], "classification string, industry_id string, instrument_id string, effective_from date, effective_to date, known_at date"),
        "market_rules": df([("r", "XSHG", "stock", D[0], None, 3.0, 5.0, 10.0, 0.0, 0.0, "CNY")], "rule_id string, exchange string, asset_type string, effective_from date, effective_to date, commission_bps double, minimum_commission double, sell_tax_bps double, buy_tax_bps double, transfer_fee_bps double, currency string"),
        "fundamental_metrics": df([("m1", "A", "revenue", D[0], "ttm", 1.0, "CNY", D[4], "v1", "[]", "ok"), ("m2", "A", "revenue", D[1], "ttm", 2.0, "CNY", D[5], "v1", "[]", "ok"), ("m3", "A", "revenue", D[0], "ttm", 9.0, "CNY", D[7], "v1", "[]", "ok")], "metric_id string, instrument_id string, metric_code string, fiscal_period_end date, basis string, value double, unit string, available_at date, calculation_version string, source_report_ids string, quality_status string"),
    }


def test_publish_read_and_guards(spark, tmp_path):
    snap = publish(spark, market(spark), str(tmp_path), "one", coverage=["A", "B"])
    assert list_snapshots(str(tmp_path)) == ["one"]
    assert Snapshot(spark, snap.path, verify=True).table("instruments").count() == 2
    with pytest.raises(ContractError):
        publish(spark, market(spark), str(tmp_path), "one")
    with pytest.raises(FutureDataError):
        snap.table("daily_raw")
    with pytest.raises(FutureDataError):
        snap.table("daily_raw", cutoff=D[2], end=D[3])
    with pytest.raises(ContractError):
        snap.table("daily_raw", cutoff=D[2], fields=["nothing"])
    with pytest.raises(ContractError):
        snap.bars(False, D[0], D[1], D[1], ["Z"])
    assert snap.table("daily_raw", cutoff=D[2]).count() == 6  # a cutoff alone bounds bars
    assert snap.table("corporate_actions", cutoff=D[0]).count() == 0
    assert snap.table("daily_raw", cutoff=D[8], fields=["close"]).columns == ["trade_date", "instrument_id", "close"]
    assert snap.market_rule(D[1], "XSHG", "stock").rule_id == "r"
    with pytest.raises(ContractError):
        snap.market_rule(D[1], "XSHE", "stock")
    with pytest.raises(ContractError):
        snap.research(D[5]).table("daily_raw")
    assert "year" in snap._read("daily_raw").where("year = 2025")._jdf.queryExecution().toString()


def test_late_revision_of_an_old_period_loses(spark, tmp_path):
    snap = publish(spark, market(spark), str(tmp_path), "one")
    view = snap.financial(D[8])
    assert [r.value for r in view.latest_metrics(D[8]).collect()] == [2.0]
    assert [r.value for r in view.latest_metrics(D[4]).collect()] == [1.0]
    with pytest.raises(FutureDataError):
        view.latest_metrics(D[8] + dt.timedelta(days=1))
    cells = spark.createDataFrame([("A", d) for d in D], "instrument_id string, trade_date date")
    got = {r.trade_date: r.value for r in view.metric_panel("revenue", "ttm", cells).collect()}
    assert [got[d] for d in D] == [None] * 4 + [1.0] + [2.0] * 4


def test_panel_tie_takes_newest_period_then_largest_id(spark):
    m = spark.createDataFrame([(1, D[0], D[3], "a", 10.0), (1, D[1], D[3], "b", 20.0), (1, D[1], D[3], "c", 30.0)], "i long, period date, available date, id string, value double")
    cells = spark.createDataFrame([(1, D[2]), (1, D[3])], "i long, d date")
    got = {r.d: r.value for r in metric_panel(m, cells, ["i"], "d", "period", "available", "id", "value").collect()}
    assert got == {D[2]: None, D[3]: 30.0}


@pytest.mark.parametrize("change, word", [("cast('NASDAQ' as string) exchange", "not allowed"), ("cast(0 as long) lot_size", "too small"), ("cast(null as date) list_date", "null")])
def test_contract_violations(spark, change, word):
    df = market(spark)["instruments"]
    name = change.split()[-1]
    broken = df.selectExpr(*[c for c in df.columns if c != name], change)
    with pytest.raises(ContractError, match=word):
        normalise(broken, "instruments")


def test_contract_keys_and_columns(spark):
    df = market(spark)["instruments"]
    with pytest.raises(ContractError, match="repeat"):
        normalise(df.union(df), "instruments")
    with pytest.raises(ContractError, match="unknown"):
        normalise(df.withColumnRenamed("symbol", "ticker"), "instruments")
    text = df.selectExpr("*").withColumn("lot_size", df.lot_size.cast("string"))
    assert normalise(text, "instruments").schema["lot_size"].dataType.simpleString() == "bigint"


def test_scan_pushes_filters(spark, tmp_path):
    market(spark)["daily_raw"].write.parquet(str(tmp_path / "t"))
    df = scan(spark.read.parquet(str(tmp_path / "t")), "trade_date", "instrument_id", start=D[1], cutoff=D[3], instruments=["A"], fields=["close"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(trade_date)" in plan and "ReadSchema: struct<trade_date:date,instrument_id:string,close:double>" in plan


def test_directory_and_chunks(spark, tmp_path):
    for name, df in market(spark).items():
        df.write.parquet(str(tmp_path / name))
    assert connectors.read_directory(spark, str(tmp_path))["daily_raw"].count() == 18
    assert connectors.month_chunks("d", "2024-11", "2025-01", "w")[1] == "d >= '2024-12-01' AND d < '2025-01-01' AND UPDATE_TIME <= 'w'"
    assert connectors.id_chunks("p", [3, 1, 2, 1], 2) == ["p IN (1, 2)", "p IN (3)"]
    data = [{"id": k} for k in range(12)]
    assert [r["id"] for r in connectors.pages(lambda last, n: [r for r in data if r["id"] > last][:n], 5)] == list(range(12))
    with pytest.raises(ContractError):
        list(connectors.pages(lambda last, n: [{"id": 1}] * n, 5))
    assert json.load(open(os.path.join(publish(spark, market(spark), str(tmp_path / "s"), "x").path, "manifest.json")))["tables"]["daily_raw"]["rows"] == 18
