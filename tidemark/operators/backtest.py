"""The account simulation: a fold over sessions whose cash couples all instruments.

Spark builds one compact panel of events per run (sessions, bars, targets and actions of the instruments in scope),
sorted by day; a run's sessions stream through one task, so runs and parameter sets go in parallel and only the
sessions of one run are sequential. All ledgers leave as one tagged long table (run, sleeve, ledger, d, i, a, b, c, note) that
:func:`ledger` splits by filter.

An account has sleeves, one per strategy, each with its share of the capital, its lots and its claims. A session goes:
dividends paid and ex-date events, orders of the last decisions, marking to the close, entitlements at the record date,
delistings, new decisions. Orders of all sleeves meet first: a buy and a sell of one instrument cross inside the
account, without costs; what is left goes to the market as one order per instrument and side, whose fill is dealt out
in whole lots and whose costs are split in proportion. Lots are sold first in, first out, of those already sellable.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date
from functools import reduce
from itertools import groupby
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.errors import AccountingError, BacktestError
from tidemark.operators.execution import Impact, costs_of, fees, fill_order
from tidemark.operators.wide import Wide, number, over, parts, plus, ratio, share, times, total
from tidemark.workers import ship_package

LEDGER = "run long, sleeve string, ledger string, d date, i long, a double, b double, c double, note string"
#: Beyond the range of doubles a, b or c is infinite (or 0); then ``wide`` has all three as m * 2**e, else it is null.
WIDE = "wide array<struct<m: double, e: int>>"
#: Meaning of the columns a, b, c of each ledger.
LEDGERS = {
    "nav": ("nav", "cash", "market_value"),
    "fill": ("quantity", "price", "cost"),
    "cross": ("quantity", "price", ""),
    "position": ("quantity", "price", "value"),
    "cashflow": ("amount", "balance", ""),
    "residual": ("quantity", "", ""),
    "action": ("quantity_before", "quantity_after", "cash"),
    "turnover": ("traded", "nav", ""),
}
SHARES = ("split", "merge", "bonus")


@dataclass(frozen=True)
class Rules:
    """Capital, timing, lots and costs of a run; ``sleeves`` share the capital."""

    cash: float = 1_000_000.0
    timing: str = "next_open"
    lot: int = 100
    sell_delay: int = 1
    costs: Mapping[str, float] = field(default_factory=dict)
    impact: Impact = Impact(per_root=0.0)
    delisting: str = "cash"
    recovery: float = 1.0
    sleeves: Mapping[str, float] = field(default_factory=lambda: {"main": 1.0})

    def __post_init__(self):
        if self.timing not in ("next_open", "next_close", "same_close"):
            raise BacktestError(f"unknown timing {self.timing}")
        if self.delisting not in ("cash", "write_off", "carry"):
            raise BacktestError(f"unknown delisting policy {self.delisting}")
        if not self.sleeves or any(not v > 0 for v in self.sleeves.values()) or abs(sum(self.sleeves.values()) - 1) > 1e-12:
            raise BacktestError("sleeves need positive shares of 1 together")

    def fingerprint(self, data: str = "") -> str:
        """Names a run: its rules, with the initial cash, and what it read."""
        return hashlib.sha256(json.dumps([asdict(self), data], sort_keys=True).encode()).hexdigest()


class Sleeve:
    """Cash, lots and claims; every change goes through a method that writes its ledger row."""

    def __init__(self, name: str, cash: float, rows: list[tuple]):
        self.name, self.cash, self.rows = name, cash, rows
        self.lots: dict[Any, list[list]] = defaultdict(list)  # [sellable from, acquired, quantity]
        self.entitled: dict[Any, int] = {}
        self.claims: dict[Any, tuple[Any, float]] = {}  # event -> (instrument, cash)
        self.owed_sum: Any = 0

    def quantity(self, i) -> int:
        return sum(x[2] for x in self.lots[i]) if i in self.lots else 0

    def sellable(self, i, day: int) -> int:
        return sum(x[2] for x in self.lots[i] if x[0] <= day) if i in self.lots else 0

    def tell(self, ledger: str, d, i=None, a=0.0, b=0.0, c=0.0, note="") -> None:
        self.rows.append((self.name, ledger, d, i, number(a), number(b), number(c), note))

    def pay(self, d, amount: float, note: str) -> None:
        self.cash = plus(self.cash, amount)
        self.tell("cashflow", d, None, amount, self.cash, note=note)

    def add(self, i, quantity: int, day: int, delay: int) -> None:
        self.lots[i].append([day + delay, day, quantity])

    def remove(self, i, quantity: int, day: int) -> None:
        left = quantity
        for lot in sorted(self.lots[i], key=lambda x: (x[0], x[1])):
            if lot[0] <= day and left:
                used = min(left, lot[2])
                lot[2] -= used
                left -= used
        if left:
            raise AccountingError(f"{self.name} sold {quantity} of {i}, {left} too many")
        self.lots[i] = [x for x in self.lots[i] if x[2]]

    def scale(self, i, delta: int) -> None:
        """Adds or takes shares in proportion to the lots; the last lot takes what rounding leaves."""
        lots = [x for x in self.lots[i] if x[2]]
        held, left = sum(x[2] for x in lots), delta
        for k, lot in enumerate(lots):
            part = left if k == len(lots) - 1 else ratio(delta, lot[2], held)
            part = max(part, -lot[2])
            lot[2] += part
            left -= part
        self.lots[i] = [x for x in lots if x[2]]

    def claim(self, event, i, amount) -> None:
        same = isinstance(self.owed_sum, Wide) and event not in self.claims
        self.claims[event] = (i, amount)
        self.owed_sum = plus(self.owed_sum, amount) if same else None

    def settle(self, event) -> tuple[Any, float]:
        self.owed_sum = None
        return self.claims.pop(event)

    def owed(self):
        """The sum of all claims, counted again when they have changed."""
        if self.owed_sum is None:
            self.owed_sum = total(x for _, x in self.claims.values())
        return self.owed_sum

    def worth(self, prices: Mapping) -> float:
        return plus(plus(self.cash, total(times(self.quantity(i), prices.get(i, 0.0)) for i in sorted(self.lots, key=str))), self.owed())


class Session:
    """The orders of one session and phase, over all sleeves."""

    def __init__(self, d, day: int, bars: Mapping, at: str, marks: Mapping, assets: Mapping, rules: Rules):
        self.d, self.day, self.bars, self.rules = d, day, bars, rules
        self.price = {i: b[at] for i, b in bars.items() if b[at] is not None and b[at] > 0}
        self.value = {**marks, **self.price}
        self.costs = {i: costs_of(assets.get(i, "stock"), rules.costs) for i in bars}
        self.traded = 0.0

    def demands(self, sleeve: Sleeve, weights: Mapping) -> dict[Any, int]:
        """Shares wanted: positive to buy, negative to sell; sells in whole lots unless a holding is given up."""
        lot, worth, out = self.rules.lot, sleeve.worth(self.value), {}
        spare = sleeve.cash
        for i in sorted(set(weights) | set(sleeve.lots), key=str):
            held, price = sleeve.quantity(i), self.price.get(i)
            if price is None:
                if held or weights.get(i):
                    sleeve.tell("residual", self.d, i, held, note="no_price")
                continue
            goal = math.floor(over(over(times(worth, weights.get(i, 0.0)), price), lot)) * lot
            need = goal - held
            if need < 0:
                can = min(-need, sleeve.sellable(i, self.day))
                can = can if goal == 0 else can // lot * lot
                if can < -need:
                    sleeve.tell("residual", self.d, i, need + can, note="not_sellable")
                need = -can
                spare = plus(spare, times(can, price))
            if need:
                out[i] = need
        for i in sorted((i for i, q in out.items() if q > 0), key=str):  # sells fund buys
            can = min(out[i], max(0, math.floor(over(over(spare, self.price[i]), lot))) * lot)
            if can < out[i]:
                sleeve.tell("residual", self.d, i, out[i] - can, note="no_cash")
            spare = plus(spare, -times(can, self.price[i]))
            out[i] = can
        return {i: q for i, q in out.items() if q}

    def cross(self, sleeves: list[Sleeve], wanted: dict[str, dict[Any, int]]) -> None:
        """Matches buys and sells in the order of sleeves; buyers that could not pay step back, all of theirs."""
        met: list[tuple[Any, Sleeve, Sleeve, int]] = []
        for i in sorted({i for w in wanted.values() for i in w}, key=str):
            sellers = [[s, -wanted[s.name].get(i, 0)] for s in sleeves if wanted[s.name].get(i, 0) < 0]
            for buyer in sleeves:
                need = wanted[buyer.name].get(i, 0)
                for pair in sellers:
                    n = min(need, pair[1])
                    if n > 0:
                        met.append((i, buyer, pair[0], n))
                        pair[1] -= n
                        need -= n
        while met:
            change: dict[str, float] = defaultdict(float)
            for i, buyer, seller, n in met:
                value = times(n, self.price[i])
                change[buyer.name] = plus(change[buyer.name], -value)
                change[seller.name] = plus(change[seller.name], value)
            poor = {s.name for s in sleeves if plus(s.cash, change[s.name]) < -1e-7}
            if not poor:
                break
            met = [x for x in met if x[1].name not in poor]
        for i, buyer, seller, n in met:
            seller.remove(i, n, self.day)
            buyer.add(i, n, self.day, self.rules.sell_delay)
            buyer.tell("cross", self.d, i, n, self.price[i], note=f"from {seller.name}")
            seller.tell("cross", self.d, i, -n, self.price[i], note=f"to {buyer.name}")
            seller.pay(self.d, times(n, self.price[i]), "cross")
            buyer.pay(self.d, -times(n, self.price[i]), "cross")
            wanted[buyer.name][i] -= n
            wanted[seller.name][i] += n

    def market(self, side: int, i, asked: list[tuple[Sleeve, int]]) -> None:
        """One order for all sleeves; its fill in whole lots by largest remainder, its costs in proportion."""
        lot, total = self.rules.lot, sum(q for _, q in asked)
        odd = total % lot if side < 0 else 0  # a holding given up is sold with its odd shares
        filled, price, commission, tax, reason = fill_order(side, total, self.price.get(i), lot, self.bars.get(i), self.costs.get(i, {}), self.rules.impact)
        if odd and (filled == total - odd or reason == "below_one_lot" and 0 < total < lot):
            price, filled = price or self.price[i], total
            commission, tax = fees(side, filled * price, self.costs[i])
        shares = allocate(filled, [q for _, q in asked], lot)
        if side > 0:
            shares = [self._affordable(s, n, price, i) for (s, _), n in zip(asked, shares, strict=True)]
            commission, tax = fees(side, sum(shares) * price, self.costs[i]) if sum(shares) else (0.0, 0.0)
        cost, left, whole = commission + tax, commission + tax, sum(shares)
        for k, ((sleeve, q), n) in enumerate(zip(asked, shares, strict=True)):
            if n:
                last = not any(shares[k + 1 :])
                own = left if last else round(cost * n / whole, 2)
                left -= own
                if side > 0:
                    sleeve.add(i, n, self.day, self.rules.sell_delay)
                else:
                    sleeve.remove(i, n, self.day)
                sleeve.tell("fill", self.d, i, side * n, price, own)
                sleeve.pay(self.d, -side * n * price - own, "buy" if side > 0 else "sell")
                self.traded += n * price
            if n < q:
                sleeve.tell("residual", self.d, i, side * (q - n), note=reason or ("no_capacity" if filled < total else "no_cash"))

    def _affordable(self, sleeve: Sleeve, n: int, price: float, i) -> int:
        """Whole lots that the sleeve can pay, with the costs of an order of its own."""
        lot = self.rules.lot
        while n > 0 and (over := n * price + sum(fees(1, n * price, self.costs[i])) - sleeve.cash) > 1e-9:
            n -= max(1, math.ceil(over / (price * lot) - 1e-9)) * lot
        return max(0, n)

    def run(self, sleeves: list[Sleeve], goals: Mapping[str, Mapping]) -> None:
        wanted = {s.name: self.demands(s, goals[s.name]) if s.name in goals else {} for s in sleeves}
        if len(sleeves) > 1:
            self.cross(sleeves, wanted)
        for side in (-1, 1):
            for i in sorted({i for w in wanted.values() for i, q in w.items() if q * side > 0}, key=str):
                self.market(side, i, [(s, abs(wanted[s.name][i])) for s in sleeves if wanted[s.name].get(i, 0) * side > 0])


def allocate(filled: int, asked: list[int], lot: int) -> list[int]:
    """A fill in whole lots by demand, largest remainders first, none above its demand; odd shares go where they fit."""
    total = sum(asked)
    if filled >= total:
        return list(asked)
    raw = [filled * q / total / lot for q in asked]
    out = [math.floor(x) * lot for x in raw]
    for k in sorted(range(len(asked)), key=lambda k: (-(raw[k] - math.floor(raw[k])), k)):
        if filled - sum(out) >= lot and out[k] + lot <= asked[k]:
            out[k] += lot
    return out


def _events(d, day: int, events: Sequence[tuple], sleeves: list[Sleeve], marks: dict) -> None:
    """What is due on a session: claims paid, then ex-date events on the quantities entitled at the record date."""
    for when, event in events:
        if when == "pay":
            for s in sleeves:
                if event["id"] in s.claims:
                    i, amount = s.settle(event["id"])
                    s.pay(d, amount, f"dividend {i}")
    for when, event in events:
        if when != "ex":
            continue
        i, kind = event["i"], event["kind"]
        by = 1 + event["share"] if kind == "bonus" else event["share"]
        if kind in SHARES and i in marks and by > 0:
            marks[i] = over(marks[i], by)
        for s in sleeves:
            n = s.entitled.pop(event["id"], 0)
            if not n:
                continue
            before = s.quantity(i)
            if kind == "cash_dividend" and event["cash"]:
                s.claim(event["id"], i, times(n, event["cash"]))
                s.tell("action", d, i, before, before, times(n, event["cash"]), kind)
            elif kind in SHARES and by > 0:
                delta = share(n, by - 1)
                if delta >= 0 and not before:
                    s.add(i, delta, day, 0)
                else:
                    s.scale(i, max(delta, -before))
                s.tell("action", d, i, before, s.quantity(i), note=kind)


def simulate(days: list, bars: Mapping, targets: Mapping, actions: Mapping, delisted: Mapping, rules: Rules, assets: Mapping | None = None) -> list[tuple]:
    """Ledger rows (sleeve, ledger, d, i, a, b, c, note) of one run over all sessions ``days``.

    ``bars``: day -> instrument -> bar; ``targets``: day -> sleeve -> instrument -> weight; ``actions``: day -> (when,
    event) with ``when`` one of record, ex, pay; ``delisted``: instrument -> first day without it.
    """
    account = Account(rules, delisted, assets or {})
    for d in days:
        account.session(d, bars.get(d, {}), targets.get(d, {}), actions.get(d, ()))
    return account.rows


class Account:
    """The state of a run between sessions; :meth:`session` adds what a day did to ``rows``, which a caller may empty."""

    def __init__(self, rules: Rules, delisted: Mapping, assets: Mapping):
        self.rules, self.delisted, self.assets = rules, delisted, assets
        self.rows: list[tuple] = []
        self.sleeves = [Sleeve(name, rules.cash * share, self.rows) for name, share in rules.sleeves.items()]
        self.marks: dict = {}
        self.pending: Mapping[str, Mapping] = {}
        self.day = 0
        self.at = "open" if rules.timing == "next_open" else "close"

    def session(self, d, today: Mapping, targets: Mapping[str, Mapping], events: Sequence[tuple]) -> None:
        rules, sleeves, marks = self.rules, self.sleeves, self.marks
        _events(d, self.day, events, sleeves, marks)
        traded = 0.0
        if rules.timing == "same_close":
            self.pending = targets
        if self.pending:
            session = Session(d, self.day, today, self.at, marks, self.assets, rules)
            session.run(sleeves, self.pending)
            traded, self.pending = session.traded, {}
        marks |= {i: b["close"] for i, b in today.items() if b["close"] is not None}
        recorded = [event for when, event in events if when == "record"]
        for s in sleeves:
            owned = {i: s.quantity(i) for i in {event["i"] for event in recorded}}
            s.entitled.update((event["id"], owned[event["i"]]) for event in recorded if owned[event["i"]])
        for s in sleeves:
            for i in sorted(s.lots, key=str):
                n = s.quantity(i)
                if n and i in self.delisted and d >= self.delisted[i] and rules.delisting != "carry":
                    back = times(times(n, marks.get(i, 0.0)), rules.recovery if rules.delisting == "cash" else 0.0)
                    s.lots[i] = []
                    s.tell("action", d, i, n, 0, back, "delisted")
                    if back:
                        s.pay(d, back, f"delisted {i}")
            value = 0.0
            for i in sorted(s.lots, key=str):
                if n := s.quantity(i):
                    held = times(n, marks[i])
                    s.tell("position", d, i, n, marks[i], held)
                    value = plus(value, held)
            nav = s.worth(marks)
            s.tell("nav", d, None, nav, s.cash, value)
        self.rows.append(("", "turnover", d, None, float(traded), number(total(s.worth(marks) for s in sleeves)), 0.0, ""))
        if rules.timing != "same_close":
            self.pending = targets
        self.day += 1


def _dated(actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Events as rows (day, when, ...): record (the session before ex where unknown), ex, and pay (ex where unknown).

    What falls on no session happens on the next one; a record day on the one before.
    """
    names = set(actions.columns)
    get = lambda c: F.col(c) if c in names else F.lit(None).cast("date")
    rows = actions.where("active").withColumns({"__record": F.coalesce(get("record"), F.date_sub("ex", 1)), "__pay": F.coalesce(get("pay"), F.col("ex"))})
    # One row, as long as the history: for each day from the first session to the last, the session on or after and on or before it.
    ends = calendar.agg(F.min("d").alias("first"), F.max("d").alias("last"))
    every = ends.select(F.explode(F.sequence("first", "last")).alias("day")).join(calendar.select(F.col("d").alias("s")).distinct(), F.col("day") == F.col("s"), "left")
    near = every.select("day", F.min("s").over(W.orderBy(F.desc("day"))).alias("after"), F.max("s").over(W.orderBy("day")).alias("before"))
    near = near.agg(F.array_sort(F.collect_list(F.struct("day", "after", "before"))).alias("near"))
    near = near.select(F.get("near", F.lit(0))["day"].alias("__first"), F.size("near").alias("__n"), F.col("near.after").alias("__after"), F.col("near.before").alias("__before"))
    rows = rows.join(F.broadcast(near))
    place = lambda day: F.datediff(F.col(day), "__first")
    on_or_after = lambda day: F.get("__after", F.greatest(place(day), F.lit(0)))
    on_or_before = F.get("__before", F.least(place("__record"), F.col("__n") - 1))
    rows = rows.select("id", "i", "kind", "cash", "share", on_or_before.alias("record"), on_or_after("ex").alias("ex"), on_or_after("__pay").alias("pay"))
    when = F.explode(F.array(*[F.struct(F.lit(x).alias("when"), F.col(x).alias("d")) for x in ("record", "ex", "pay")]))
    return rows.withColumn("__w", when).select("id", "i", "kind", "cash", "share", F.col("__w.when").alias("when"), F.col("__w.d").alias("d")).where("d is not null")


def run_backtests(bars: DataFrame, targets: DataFrame, actions: DataFrame, instruments: DataFrame, runs: dict[int, Rules], calendar: DataFrame | None = None) -> DataFrame:
    """The tagged ledgers of all ``runs``; ``targets`` (run, d, i, weight, and a sleeve unless there is one) name the
    instruments in scope of each run.

    Sessions are those of the calendar, or of all bars. Panel rows carry a kind: bars and actions are sent only for
    instruments that a run ever targets. Spark sorts a run's rows by day, on disk where it must; the fold reads them as
    they come and holds the rows of one session at a time.
    """
    calendar = bars.select("d").distinct() if calendar is None else calendar.select("d")
    if "sleeve" not in targets.columns:
        targets = targets.withColumn("sleeve", F.lit("main"))
    for name in ("limit_up", "limit_down"):
        if name not in bars.columns:
            bars = bars.withColumn(name, F.lit(None).cast("double"))
    scope, run_ids = targets.select("run", "i").distinct(), targets.select("run").distinct()

    def panel(df: DataFrame, kind: str, **values) -> DataFrame:
        """Rows of one shape: numbers x0 to x7, a flag and two names."""
        numbers = [values.get(f"x{k}", F.lit(None)).cast("double").alias(f"x{k}") for k in range(8)]
        flag, what, who, i = (values.get(k, F.lit(None)) for k in ("flag", "what", "who", "i"))
        return df.select("run", F.lit(kind).alias("kind"), values.get("d", F.col("d")).alias("d"), i.cast("long").alias("i"), *numbers, flag.cast("boolean").alias("flag"), what.cast("string").alias("what"), who.cast("string").alias("who"))

    c = F.col
    rows = panel(run_ids.join(calendar), "session")  # runs x sessions
    rows = rows.unionByName(panel(scope.join(bars, "i"), "bar", i=c("i"), flag=c("paused"), **{f"x{k}": c(name) for k, name in enumerate(FIELDS)}))
    rows = rows.unionByName(panel(scope.join(_dated(actions, calendar), "i"), "action", i=c("i"), x0=c("cash"), x1=c("share"), what=c("kind"), who=F.concat_ws("|", "when", c("id").cast("string"))))
    rows = rows.unionByName(panel(targets, "target", i=c("i"), x0=c("weight"), who=c("sleeve")))
    asset = c("asset_type") if "asset_type" in instruments.columns else F.lit("stock")
    rows = rows.unionByName(panel(scope.join(instruments, "i"), "instrument", d=F.lit(None).cast("date"), i=c("i"), what=asset, who=c("delisted").cast("date")))

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("run", pa.int64()), ("sleeve", pa.string()), ("ledger", pa.string()), ("d", pa.date32()), ("i", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("note", pa.string()), ("wide", pa.list_(pa.struct([("m", pa.float64()), ("e", pa.int32())])))])
        lines = (line for b in batches for line in zip(*[x.to_pylist() for x in b.columns], strict=True))
        for run, own in groupby(lines, key=itemgetter(0)):
            for told in _played(own, runs[run]):
                columns = [[run] * len(told), *zip(*told, strict=True)]
                columns[5:8] = [list(map(float, x)) for x in columns[5:8]]
                wide = [[dict(zip("me", parts(x), strict=True)) for x in r[4:7]] if any(isinstance(x, Wide) for x in r[4:7]) else None for r in told]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*columns, wide], schema, strict=True)], schema=schema)

    ship_package(bars.sparkSession)
    order = ["run", "d", "kind", "i", "who"]  # instruments first, as they have no day
    return rows.repartition("run").sortWithinPartitions(*order).mapInArrow(fold, f"{LEDGER}, {WIDE}")


#: Columns of the panel that hold a bar, in order.
FIELDS = ("open", "close", "high", "low", "volume", "amount", "limit_up", "limit_down")


def _played(lines: Iterable[tuple], rules: Rules, most: int = 10_000) -> Iterator[list[tuple]]:
    """Ledger rows, about ``most`` at a time, of one run whose panel rows come by day; instruments come first."""
    known = lambda x: None if x is None or x != x else float(x)
    ends, assets = {}, {}
    account = Account(rules, ends, assets)
    for d, own in groupby(lines, key=itemgetter(2)):
        open_, today, events = False, {}, []
        goals: dict = defaultdict(dict)
        for _, kind, _, i, *numbers, flag, what, who in own:
            if kind == "session":
                open_ = True
            elif kind == "bar":
                today[i] = dict(zip(FIELDS, map(known, numbers), strict=True)) | {"paused": bool(flag)}
            elif kind == "target":
                goals[who][i] = numbers[0]
            elif kind == "action":
                when, key = who.split("|", 1)
                events.append((when, {"id": key, "i": i, "kind": what, "cash": known(numbers[0]) or 0.0, "share": known(numbers[1]) or 0.0}))
            elif kind == "instrument":
                assets[i] = what
                if who is not None:
                    ends[i] = date.fromisoformat(who)
        if open_:
            account.session(d, today, goals, events)
            if len(account.rows) >= most:
                yield list(account.rows)
                account.rows.clear()
    if account.rows:
        yield list(account.rows)


def ledger(rows: DataFrame, name: str) -> DataFrame:
    """One ledger with its own column names; ``wide`` too if there is one."""
    return rows.where(F.col("ledger") == name).select("run", "sleeve", "d", "i", *[F.col(c).alias(n) for c, n in zip("abc", LEDGERS[name], strict=True) if n], "note", *[c for c in rows.columns if c == "wide"])


def account(rows: DataFrame) -> DataFrame:
    """(run, d, nav, cash, market_value): the sum over sleeves, infinite beyond the range of doubles."""
    return ledger(rows, "nav").groupBy("run", "d").agg(*[F.sum(c).alias(c) for c in ("nav", "cash", "market_value")])


def reconcile(rows: DataFrame, runs: dict[int, Rules], tolerance: float = 1e-4) -> DataFrame:
    """(run, sleeve, d, wrong): sessions on which, from the session before (or the start), ``cash`` does not follow from
    the flows, the market ``value`` is not that of the positions, or the ``shares`` of an instrument do not follow from
    what was bought, crossed and given.

    Each is a sum that must be 0 but for ``tolerance``, or a billionth of its largest part. It is summed by powers of two,
    of which numbers beyond the range of doubles have one.
    """
    keys = ["run", "sleeve"]
    if "wide" not in rows.columns:
        rows = rows.withColumn("wide", F.lit(None).cast(WIDE.split(" ", 1)[1]))

    def of(name: str, k: int):
        """Column ``k`` of a row as (m, e); large doubles are scaled, so that their sums stay finite."""
        x = F.col("abc"[k])
        plain = F.when(F.abs(x) > 1e300, F.struct((x * 2.0**-64).alias("m"), F.lit(64).alias("e"))).otherwise(F.struct(x.alias("m"), F.lit(0).alias("e")))
        return F.coalesce(F.get("wide", F.lit(k)), plain).alias(name)

    def terms(df: DataFrame, what: str, sign: int, value: str = "x") -> DataFrame:
        i = F.col("i") if what == "shares" else F.lit(None).cast("long")
        return df.select(*keys, "d", F.lit(what).alias("what"), i.alias("i"), (F.lit(float(sign)) * F.col(f"{value}.m")).alias("m"), F.col(f"{value}.e").alias("e"))

    only = lambda name, *columns: rows.where(F.col("ledger") == name).select(*keys, "d", "i", *columns)
    line = W.partitionBy(*keys).orderBy("d")
    start = F.coalesce(*[F.when((F.col("run") == k) & (F.col("sleeve") == s), F.lit(float(r.cash * share))) for k, r in runs.items() for s, share in r.sleeves.items()])
    nav = only("nav", of("cash", 1), of("value", 2)).withColumns({"next": F.lead("d").over(line), "before": F.coalesce(F.lag("cash").over(line), F.struct(start.alias("m"), F.lit(0).alias("e")))})
    held = only("position", of("shares", 0), of("value", 2))
    later = held.join(nav.select(*keys, "d", "next"), [*keys, "d"]).where("next is not null").drop("d").withColumnRenamed("next", "d")
    action = only("action", of("before", 0), of("after", 1))
    sums = [terms(nav, "cash", 1, "before"), terms(only("cashflow", of("x", 0)), "cash", 1), terms(nav, "cash", -1, "cash")]
    sums += [terms(held, "value", 1, "value"), terms(nav, "value", -1, "value")]
    sums += [terms(later, "shares", 1, "shares"), terms(held, "shares", -1, "shares"), terms(action, "shares", 1, "after"), terms(action, "shares", -1, "before")]
    sums += [terms(only(name, of("x", 0)), "shares", 1) for name in ("fill", "cross")]
    each = [*keys, "d", "what", "i"]
    summed = reduce(DataFrame.unionByName, sums).groupBy(*each, "e").agg(F.sum("m").alias("m"), F.max(F.abs("m")).alias("most"))
    summed = summed.withColumn("top", F.greatest(F.max("e").over(W.partitionBy(*each)), F.lit(0)))
    down = F.pow(F.lit(2.0), F.col("e") - F.col("top"))
    found = summed.groupBy(*each, "top").agg(F.abs(F.sum(F.col("m") * down)).alias("apart"), F.max(F.col("most") * down).alias("most"))
    wrong = found.where(F.col("apart") > F.lit(tolerance) * F.pow(F.lit(2.0), -F.col("top")) + 1e-9 * F.col("most"))
    return wrong.groupBy(*keys, "d").agg(F.sort_array(F.collect_set("what")).alias("wrong"))
