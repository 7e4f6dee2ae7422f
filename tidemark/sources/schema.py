"""Contracts of the canonical tables: types, keys, visibility, ranges and allowed values, kept as column metadata."""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "long": T.LongType(), "bool": T.BooleanType()}
EXCHANGES = ("XSHG", "XSHE", "XBEI")
ACTION_KINDS = ("cash_dividend", "bonus", "split", "merge", "rights_issue")
BASES = ("instant", "ytd", "single_quarter", "ttm")


def field(name: str, kind: str, null: bool = False, unit: str = "", enum: tuple = (), minimum: float | None = None, required: bool = True) -> T.StructField:
    meta: dict = {"required": required}
    if unit:
        meta["unit"] = unit
    if enum:
        meta["enum"] = list(enum)
    if minimum is not None:
        meta["minimum"] = minimum
    return T.StructField(name, KINDS[kind], null, meta)


def _fields(text: str) -> list[T.StructField]:
    """Fields from ``name kind`` pairs; ``?`` after the kind allows nulls, ``*`` makes the column optional."""
    out = []
    for part in text.split(","):
        name, kind = part.split()
        out.append(field(name, kind.rstrip("?*"), "?" in kind, required="*" not in kind))
    return out


#: Columns that any table but the adjusted prices may carry.
LINEAGE = _fields("source_record_id string?*, source_batch_id string?*, source_updated_at timestamp?*")

_FLOWS = [f"{side}_{size}_{what}" for what in ("value", "volume") for size in ("small", "medium", "large", "extra") for side in ("in", "out")] + ["in_total", "out_total", "net_total", "net_main"]

TABLES: dict[str, list[T.StructField]] = {
    "instruments": [
        *_fields("instrument_id string, symbol string"),
        field("exchange", "string", enum=EXCHANGES),
        field("asset_type", "string", enum=("stock", "etf")),
        *_fields("list_date date, delist_date date?"),
        field("lot_size", "long", minimum=1),
        field("sell_delay_days", "long", minimum=0),
        *_fields("name string?*, currency string?*"),
    ],
    "trade_calendar": [*_fields("trade_date date"), field("exchange", "string", enum=EXCHANGES)],
    "daily_raw": [
        *_fields("trade_date date, instrument_id string"),
        *[field(c, "double", unit="CNY", minimum=0) for c in ("open", "high", "low", "close", "pre_close")],
        field("volume", "long", unit="share", minimum=0),
        field("amount", "double", unit="CNY", minimum=0),
        *_fields("paused bool, limit_up double?, limit_down double?"),
    ],
    "daily_post_adjusted": _fields("trade_date date, instrument_id string, open_post double, high_post double, low_post double, close_post double, pre_close_post double, adjustment_factor double, factor_source string, adjustment_version string"),
    "corporate_actions": [
        *_fields("event_id string, instrument_id string"),
        field("event_type", "string", enum=ACTION_KINDS),
        *_fields("record_date date?, ex_date date, pay_date date?"),
        field("cash_per_share", "double", minimum=0),
        field("share_ratio", "double", minimum=0),
        *_fields("subscription_price double?*"),
        field("status", "string", enum=("active", "cancelled")),
        *_fields("announced_at date"),
    ],
    "universe_membership": _fields("universe_id string, instrument_id string, effective_from date, effective_to date?, known_at date"),
    "industry_membership": _fields("classification string, industry_id string, instrument_id string, effective_from date, effective_to date?, known_at date"),
    "special_treatment": _fields("instrument_id string, name string, state_code string?*, reason_code string?*, known_at date, effective_from date, effective_to date?"),
    "daily_money_flow": [*_fields("trade_date date, instrument_id string"), *[field(c, "double", True, "CNY", required=False) for c in _FLOWS], *_fields("available_at date")],
    "market_rules": _fields("rule_id string, exchange string, asset_type string, effective_from date, effective_to date?, commission_bps double?, minimum_commission double?, sell_tax_bps double?, buy_tax_bps double?, transfer_fee_bps double?, currency string, source string?*, rule_version string?*, scenario string?*"),
    "financial_reports": [*_fields("report_id string, instrument_id string, statement_type string, fiscal_period_start date, fiscal_period_end date, filing_period_end date, record_kind string, published_at date, available_at date"), field("revision_sequence", "long", minimum=1)],
    "financial_facts": _fields("report_id string, instrument_id string, statement_type string, fiscal_period_start date, fiscal_period_end date, item_code string, value double?, unit string, value_basis string, source_field string, available_at date"),
    "fundamental_metrics": [*_fields("metric_id string, instrument_id string, metric_code string, fiscal_period_end date"), field("basis", "string", enum=BASES), *_fields("value double?, unit string, available_at date, calculation_version string, source_report_ids string, quality_status string")],
    "daily_valuation": _fields("trade_date date, instrument_id string, pe_ttm double?, pe_lyr double?, pb double?, ps_ttm double?, pcf_ttm double?, pcf_operating_ttm double?, dividend_yield double?, turnover_rate double?, total_shares double?, market_cap double?, circulating_shares double?, circulating_market_cap double?, free_float_shares double?, free_float_market_cap double?, a_shares double?, a_market_cap double?, available_at date"),
    "share_capital": _fields("capital_event_id string, instrument_id string, effective_from date, announced_at date, available_at date, total_shares double?, nontradable_shares double?, restricted_shares double?, tradable_shares double?, a_shares double?, b_shares double?, h_shares double?"),
}
KEYS = {
    "instruments": ["instrument_id"],
    "trade_calendar": ["exchange", "trade_date"],
    "daily_raw": ["trade_date", "instrument_id"],
    "daily_post_adjusted": ["trade_date", "instrument_id"],
    "corporate_actions": ["event_id"],
    "universe_membership": ["universe_id", "instrument_id", "effective_from"],
    "industry_membership": ["classification", "instrument_id", "effective_from"],
    "special_treatment": ["instrument_id", "effective_from"],
    "daily_money_flow": ["trade_date", "instrument_id"],
    "market_rules": ["rule_id"],
    "financial_reports": ["report_id"],
    "financial_facts": ["report_id", "item_code"],
    "fundamental_metrics": ["metric_id"],
    "daily_valuation": ["trade_date", "instrument_id"],
    "share_capital": ["capital_event_id"],
}
VISIBLE = {
    "corporate_actions": "announced_at",
    "universe_membership": "known_at",
    "industry_membership": "known_at",
    "special_treatment": "known_at",
    "daily_money_flow": "available_at",
    "financial_reports": "available_at",
    "financial_facts": "available_at",
    "fundamental_metrics": "available_at",
    "daily_valuation": "available_at",
    "share_capital": "available_at",
}
#: Tables that cannot be read without a cutoff.
DYNAMIC = {*VISIBLE, "daily_raw", "daily_post_adjusted"}
#: Tables a snapshot must have; the others are optional.
REQUIRED = ("instruments", "trade_calendar", "daily_raw", "corporate_actions", "universe_membership", "industry_membership", "market_rules")
for _name, _columns in TABLES.items():
    if _name != "daily_post_adjusted":
        _columns.extend(LINEAGE)


def struct(name: str) -> T.StructType:
    return T.StructType(TABLES[name])


def schema_hash(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()
