"""Secrets in text: fixed patterns, and formats learned by grammar inference.

Base kinds are patterns (``assign``, ``access``, ``hex``), leftmost and non-overlapping per kind. The kind ``format``
adds candidates (runs of 12 or more of ``[A-Za-z0-9+/_.=-]`` with a digit and a letter, without full stops and hyphens
at their ends, outside all base spans) that look like credentials: from labelled credentials and labelled other
strings, one probabilistic automaton each is inferred by merging the states of a prefix tree whose outgoing
frequencies are statistically compatible (Hoeffding bound, the red-blue order of ALERGIA) over classes of characters;
a candidate is a secret if its log-likelihood per character under the first exceeds that under the second by a margin.
The values of base spans are scored the same way, but stay whatever their score.

Credentials are strings of published formats and values that the base patterns find in the corpus; other strings are
versions, dates, paths and names, and runs of the corpus outside base spans (both from ``sample`` rows at most, those
with the smallest hashes). Two in five of the other strings do not train: the margin is such that at most ``false`` of
them would be called secrets, and at least ``least``.

Defined results: null and empty texts have no spans; matches that fail a length rule are dropped but still use up
their characters; spans are code points, end exclusive; candidates whose score equals the margin are not secrets; very
long texts are read whole; rows may repeat; empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, ship_package

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Any row that may hold a match of one of the patterns; wider than needed, never narrower.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{32}|[A-Za-z+/_.=-][0-9]|[0-9][A-Za-z+/_.=-]"
KINDS = ("assign", "access", "hex", "format")


def _base(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base kinds, by start, then kind as listed."""
    out = [(m.start(), m.end(), "assign", m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access", m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m.group()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind as listed."""
    return [x[:3] for x in _base(text)]


def candidates(text: str, taken: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, end, run) of the candidates that touch none of the spans ``taken``."""
    out = []
    for m in CANDIDATE.finditer(text):
        word = m.group().rstrip(".-")
        a = m.start() + len(word) - len(word.lstrip(".-"))
        z = m.start() + len(word)
        word = text[a:z]
        if z - a >= 12 and DIGIT.search(word) and LETTER.search(word) and not any(x[0] < z and a < x[1] for x in taken):
            out.append((a, z, word))
    return out


# --- grammar inference -------------------------------------------------------------------------------------------


def _class_of(c: str) -> str:
    return "0" if c.isdigit() else "X" if c.isupper() else c if not c.islower() else "e" if c in "aeiouy" else "x"


#: Classes: digits, capitals, vowels and consonants; other characters as they are.
CLASS = {chr(k): _class_of(chr(k)) for k in range(33, 127)}


def symbols(text: str) -> list[str]:
    return [CLASS.get(c, "?") for c in text]


class Automaton:
    """A probabilistic automaton with counts: per state the strings that pass, those that end, and the arcs."""

    def __init__(self):
        self.passing, self.ending, self.arcs = [0], [0], [{}]

    def add(self, string: list[str]) -> None:
        at = 0
        self.passing[0] += 1
        for s in string:
            to = self.arcs[at].get(s)
            if to is None:
                to = self.arcs[at][s] = len(self.passing)
                self.passing.append(0)
                self.ending.append(0)
                self.arcs.append({})
            at = to
            self.passing[at] += 1
        self.ending[at] += 1

    def merge_states(self, alpha: float = 0.05) -> Automaton:
        """Red-blue merging: each blue state joins the first compatible red one or turns red."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
            return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                if differ(self.ending[a], self.passing[a], self.ending[b], self.passing[b]):
                    return False
                for s in self.arcs[a].keys() | self.arcs[b].keys():
                    x, y = self.arcs[a].get(s), self.arcs[b].get(s)
                    if differ(self.passing[x] if x is not None else 0, self.passing[a], self.passing[y] if y is not None else 0, self.passing[b]):
                        return False
                    if x is not None and y is not None and x != y:
                        todo.append((x, y))
            return True

        def fold(a: int, b: int) -> None:
            """Adds the tree below ``b`` to ``a``."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                self.passing[a] += self.passing[b]
                self.ending[a] += self.ending[b]
                for s, y in self.arcs[b].items():
                    x = self.arcs[a].get(s)
                    if x is None:
                        self.arcs[a][s] = y
                    else:
                        todo.append((x, y))

        red, order = {0}, [0]
        while True:
            blue = [(r, s, to) for r in order for s, to in sorted(self.arcs[r].items()) if to not in red]
            if not blue:
                return self
            parent, symbol, state = max(blue, key=lambda x: self.passing[x[2]])
            for r in order:
                if compatible(r, state):
                    self.arcs[parent][symbol] = r
                    fold(r, state)
                    break
            else:
                red.add(state)
                order.append(state)

    def score(self, string: list[str], alphabet: int = 12, back: float = 4.0) -> float:
        """Log-likelihood per symbol.

        A state's frequencies are smoothed by ``back`` observations of the automaton's overall ones; symbols that no
        arc reads keep the state.
        """
        at, total = 0, 0.0
        for s in string:
            overall = (self.overall.get(s, 0) + 1 / alphabet) / (self.symbols + 1)
            total += math.log((self.used[at].get(s, 0) + back * overall) / (self.passing[at] + back))
            at = self.arcs[at].get(s, at)
        total += math.log((self.ending[at] + back * self.ending_share) / (self.passing[at] + back))
        return total / (len(string) + 1)

    def freeze(self, strings: list[list[str]]) -> Automaton:
        """Counts each arc's use by the training strings, for arcs into merged states share their targets' counts."""
        self.used = [dict.fromkeys(a, 0) for a in self.arcs]
        self.passing, self.ending = [0] * len(self.arcs), [0] * len(self.arcs)
        for x in strings:
            at = 0
            self.passing[0] += 1
            for s in x:
                self.used[at][s] += 1
                at = self.arcs[at][s]
                self.passing[at] += 1
            self.ending[at] += 1
        self.overall = Counter(s for x in strings for s in x)
        self.symbols = sum(self.overall.values()) + len(strings)
        self.ending_share = (len(strings) + 1) / (self.symbols + 1)
        return self


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    cut = [symbols(x) for x in strings]
    tree = Automaton()
    for x in cut:
        tree.add(x)
    return tree.merge_states(alpha).freeze(cut)


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ANY, SIX = UPPER + LOWER + DIGITS, DIGITS + "abcdef"

#: Published credential formats, as literal text and (letters, length) pairs.
FORMATS: dict[str, tuple] = {
    "github": ("ghp_", (ANY, 36)),
    "gitlab": ("glpat-", (ANY, 20)),
    "slack": ("xoxb-", (DIGITS, 11), "-", (DIGITS, 11), "-", (ANY, 24)),
    "google": ("AIza", (ANY + "-_", 35)),
    "stripe": ("sk_live_", (ANY, 24)),
    "session": ("ASIA", (UPPER + "234567", 16)),
    "jwt": ("eyJ", (ANY, 30), ".eyJ", (ANY, 60), ".", (ANY + "-_", 43)),
    "base64": ((ANY + "+/", 40),),
    "plain": ((ANY, 32),),
    "hex16": ((SIX, 16),),
    "hex24": ((SIX, 24),),
    "lower": ((LOWER + DIGITS, 20),),
    "uuid": ((SIX, 8), "-", (SIX, 4), "-", (SIX, 4), "-", (SIX, 4), "-", (SIX, 12)),
}


def labelled_strings(seed: int = 11, each: int = 40, formats: dict[str, tuple] | None = None) -> tuple[list[str], list[str]]:
    """Labelled strings made from credential formats, and from what else looks like candidates."""
    r = random.Random(seed)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    syllable = lambda: of("bcdfghlmnprstvw", 1) + of("aeiou", 1) + r.choice(["", "", "n", "r", "s", "t"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 5)))
    secrets, others = [], []
    for _ in range(each):
        secrets += ["".join(x if isinstance(x, str) else of(*x) for x in parts) for parts in (FORMATS if formats is None else formats).values()]
        others += [
            f"{word()}{of(DIGITS, r.randint(1, 4))}.{word()}.{r.choice(['com', 'org', 'net', 'io'])}",
            f"{word()}-{word()}-{r.randint(1, 999)}",
            f"{word()}_{word()}_{r.randint(1, 99)}.{r.choice(['txt', 'html', 'py', 'csv'])}",
            f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{of(DIGITS, 2)}",
            of(DIGITS, r.randint(12, 18)) + r.choice(["th", "px", "kg"]),
            f"{word()}{word().title()}{word().title()}{r.randint(1, 9)}",
            f"/{word()}/{word()}{r.randint(1, 9)}/{word()}/{word()}",
            "=" * r.randint(10, 30) + word() + of(DIGITS, 1),
            f"v{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{word()}.{r.randint(1, 9)}",
            f"{word().upper()}_{word().upper()}_{r.randint(1, 2030)}",
            f"{word()}.{r.randint(1, 99)}",
            f"{word()}.{word()}={r.randint(1, 9999)}",
        ]
    return secrets, [x for x in others if len(x) >= 12]


class Scanner:
    """Both automata; ``spans`` gives the base spans and the ones they add."""

    def __init__(self, secrets: list[str] | None = None, others: list[str] | None = None, least: float = 0.3, false: float = 0.005):
        made = labelled_strings()
        secrets, others = [*made[0], *(secrets or [])], [*made[1], *(others or [])]
        self.secret, self.other = infer(secrets), infer([x for k, x in enumerate(others) if k % 5 < 3])
        held = sorted(self.score(x) for k, x in enumerate(others) if k % 5 >= 3)
        self.margin = max(least, held[-1 - int(false * len(held))]) if held else least

    def score(self, candidate: str) -> float:
        """How much likelier a character of the candidate is in a credential, as a logarithm."""
        x = symbols(candidate)
        return self.secret.score(x) - self.other.score(x)

    def likely(self, candidate: str) -> bool:
        return self.score(candidate) > self.margin

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int, int]:
        """(base spans, all spans, base spans whose values look like credentials, candidates scored)."""
        base = _base(text)
        found = candidates(text, base)
        added = [(a, z, "format") for a, z, word in found if self.likely(word)]
        plain = [x[:3] for x in base]
        whole = sorted(plain + added, key=lambda x: (x[0], KINDS.index(x[2])))
        return plain, whole, sum(self.likely(x[3]) for x in base), len(found) + len(base)

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        return self.scan(text)[:2]


def fit_scanner(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400, per_text: int = 20) -> Scanner:
    """Both automata, from made strings, and from base spans and other runs of at most ``sample`` rows of either sort."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    strong = F.col("text").rlike("(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    weak = F.col("text").rlike("(?=[A-Za-z0-9+/_.=-]{0,40}[0-9])(?=[0-9+/_.=-]{0,40}[A-Za-z])[A-Za-z0-9+/_.=-]{12}")
    secrets, others = set(), set()
    for kind in (strong, weak & ~strong):
        for r in hash_sample(rows.where(kind), sample, "id", "h").collect():
            base = _base(r.text)
            secrets.update([x[3] for x in base][:per_text])
            others.update([w for *_, w in candidates(r.text, base)][:per_text])
    return Scanner(sorted(secrets), sorted(others - secrets))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


REPORT = [T.StructField(f"n_{k}", T.LongType()) for k in ("assign", "access", "hex")] + [T.StructField(k, T.StringType()) for k in ("base_sha256", "spans")] + [T.StructField(k, T.LongType()) for k in ("n_format", "n_base_likely", "n_scored")]


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_base_likely, n_scored) per row."""
    ship_package(docs.sparkSession)
    scanner = scanner or fit_scanner(docs, id_col, text_col)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    nothing = ([], [], 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = pc.match_substring_regex(b.column(1), MAYBE).to_pylist()
            found = [scanner.scan(b.column(1)[i].as_py()) if x else nothing for i, x in enumerate(maybe)]
            counts = [[sum(k == kind for *_, k in x[1]) for x in found] for kind in KINDS]
            told = [_told(x[0]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *[pa.array(c, pa.int64()) for c in counts[:3]],
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told], pa.string()),
                    pa.array([_told(x[1]) for x in found], pa.string()),
                    *[pa.array(c, pa.int64()) for c in (counts[3], [x[2] for x in found], [x[3] for x in found])],
                ],
                [id_col, *[f.name for f in REPORT]],
            )

    return base.mapInArrow(run, T.StructType([base.schema[0], *REPORT]))
