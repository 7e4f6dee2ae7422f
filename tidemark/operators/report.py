"""Run folders: every ledger, metrics, and a short page, all or nothing."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import BacktestError
from tidemark.operators.backtest import LEDGERS, account, ledger
from tidemark.sources.files import Files, join


def page(metrics: dict[str, float], nav: DataFrame, rows: int = 100) -> str:
    """An HTML page with the metrics and the last ``rows`` account values."""
    last = nav.orderBy(F.desc("d")).limit(rows).collect()
    line = lambda cells: "<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in cells) + "</tr>"
    table = lambda rs: "<table>" + "".join(map(line, rs)) + "</table>"
    return f"<!doctype html><meta charset='utf-8'><title>Run</title><h1>Metrics</h1>{table(sorted(metrics.items()))}<h1>Account</h1>{table([nav.columns, *map(list, last)])}"


def write_run(rows: DataFrame, metrics: dict[str, float], config: dict, folder: str) -> str:
    """Writes the ledgers of one run to ``folder``, which must not exist."""
    files = Files(rows.sparkSession)
    if files.exists(folder):
        raise BacktestError(f"{folder} exists")
    staging = f"{folder}.{uuid.uuid4().hex}"
    try:
        for name in LEDGERS:
            ledger(rows, name).write.parquet(join(staging, name))
        for name, data in (("metrics.json", metrics), ("config.json", config)):
            files.write(join(staging, name), json.dumps(data, sort_keys=True))
        files.write(join(staging, "report.html"), page(metrics, account(rows).select("d", "nav", "cash", "market_value")))
        files.move(staging, folder)
    except BaseException:
        files.remove(staging)
        raise
    return folder
