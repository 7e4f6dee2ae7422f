"""Parameter search and the store of runs."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import sqlite3
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from tidemark.errors import ExperimentError


def key_of(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def grid(space: dict[str, list]) -> Iterator[dict]:
    """All combinations, in the order of sorted names."""
    names = sorted(space)
    for values in itertools.product(*(space[n] for n in names)):
        yield dict(zip(names, values, strict=True))


def sample(space: dict[str, dict], n: int, seed: int) -> Iterator[dict]:
    """``n`` different random points; a dimension is {choices}, or {low, high, log?, int?}."""
    r, seen = random.Random(seed), set()
    for _ in range(100 * n):
        point = {}
        for name in sorted(space):
            d = space[name]
            if "choices" in d:
                point[name] = r.choice(d["choices"])
                continue
            low, high = (math.log(d["low"]), math.log(d["high"])) if d.get("log") else (d["low"], d["high"])
            x = r.uniform(low, high)
            x = math.exp(x) if d.get("log") else x
            point[name] = round(x) if d.get("int") else x
        if (k := key_of(point)) not in seen:
            seen.add(k)
            yield point
            if len(seen) == n:
                return


class Store:
    """Runs, parameters, metrics and trials in SQLite on the driver."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.lock = threading.RLock()  # one connection serves all trial threads
        self.db.executescript(
            """create table if not exists runs (id text primary key, kind text, fingerprint text, status text, note text);
            create table if not exists params (run text, name text, value text, primary key (run, name));
            create table if not exists metrics (run text, name text, value real, primary key (run, name));
            create table if not exists artifacts (run text, name text, path text, primary key (run, name));
            create table if not exists trials (search text, key text, params text, metrics text, status text, primary key (search, key));"""
        )

    def start(self, run: str, kind: str, fingerprint: str, params: dict) -> None:
        with self.db:
            if self.db.execute("select 1 from runs where id = ?", (run,)).fetchone():
                raise ExperimentError(f"run {run} exists")
            self.db.execute("insert into runs values (?, ?, ?, 'running', '')", (run, kind, fingerprint))
            self.db.executemany("insert into params values (?, ?, ?)", [(run, k, json.dumps(v, sort_keys=True)) for k, v in params.items()])

    def finish(self, run: str, metrics: dict[str, float], artifacts: dict[str, str] | None = None, status: str = "succeeded", note: str = "") -> None:
        with self.db:
            self.db.execute("update runs set status = ?, note = ? where id = ?", (status, note, run))
            self.db.executemany("insert or replace into metrics values (?, ?, ?)", [(run, k, v) for k, v in metrics.items()])
            self.db.executemany("insert or replace into artifacts values (?, ?, ?)", [(run, k, v) for k, v in (artifacts or {}).items()])

    def succeeded(self, fingerprint: str) -> str | None:
        row = self.db.execute("select id from runs where fingerprint = ? and status = 'succeeded' order by id limit 1", (fingerprint,)).fetchone()
        return row and row[0]

    def compare(self, runs: list[str]) -> dict[str, dict[str, float]]:
        marks = ",".join("?" * len(runs))
        out: dict[str, dict[str, float]] = {}
        for name, run, value in self.db.execute(f"select name, run, value from metrics where run in ({marks}) order by name, run", runs):
            out.setdefault(name, {})[run] = value
        return out

    def trial(self, search: str, key: str) -> dict | None:
        with self.lock:
            row = self.db.execute("select metrics from trials where search = ? and key = ? and status = 'done'", (search, key)).fetchone()
        return row and json.loads(row[0])

    def save_trial(self, search: str, key: str, params: dict, metrics: dict | None, status: str) -> None:
        with self.lock, self.db:
            self.db.execute("insert or replace into trials values (?, ?, ?, ?, ?)", (search, key, json.dumps(params, sort_keys=True), json.dumps(metrics), status))


def search(points: list[dict], run: Callable[[dict], dict], objective: str, store: Store, name: str, workers: int = 4, tries: int = 2, feasible: Callable[[dict], bool] = lambda m: True) -> list[dict]:
    """Trials with their metrics, best objective first; known trials are not run again, failed ones are tried again."""

    def one(params: dict) -> dict:
        key = key_of(params)
        metrics = store.trial(name, key)
        for attempt in range(tries):
            if metrics is not None:
                break
            try:
                metrics = run(params)
            except Exception as e:  # a trial may fail; the search goes on
                if attempt == tries - 1:
                    store.save_trial(name, key, params, {"error": str(e)}, "failed")
        if metrics is not None:
            store.save_trial(name, key, params, metrics, "done")
        return {"key": key, "params": params, "metrics": metrics}

    with ThreadPoolExecutor(workers) as pool:
        found = list(pool.map(one, points))
    good = [t for t in found if t["metrics"] is not None and feasible(t["metrics"]) and math.isfinite(t["metrics"].get(objective, math.nan))]
    return sorted(good, key=lambda t: (-t["metrics"][objective], t["key"]))
