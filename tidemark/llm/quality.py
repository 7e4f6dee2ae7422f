"""Document quality by weak supervision, in DataFrame operations only.

Rules look at one document each and vote good, bad or abstain. Their accuracies are not set by hand: expectation
maximisation over all documents that pass the base rule estimates what each rule says of good and of bad documents,
together with the share of good ones, from the votes alone. It starts from a count of votes in which a bad vote weighs
``weigh`` good ones, which only fixes what is called bad; rules that say the same of both kinds end up with no weight.
Rules that see one cause (symbols, letters) agree more often than independent voters would; each rule's weight is
divided by 1 plus its correlations with the others within the kinds. A document stays if its posterior probability of
being good reaches a threshold. Only the counts of vote patterns enter the estimation, at most 3 to the power of the
number of rules, so the driver never sees documents.

Base measures follow fixed definitions (words are ``[^\\x20\\x09-\\x0D]+``). Repeated 8-word windows are found in two
steps: hashes of all windows first, and only where two of those agree the windows themselves are compared.

Defined results: null text has no words and fails the base rule; a posterior equal to the threshold keeps the
document; documents with equal votes, copies among them, have equal posteriors; where no document passes the base rule
there is nothing to estimate; very long texts are measured whole; rows may repeat; empty tables give empty results;
other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, words_of

WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, starts: Column) -> Column:
    """Exact: sort (window, place), keep the places with an equal neighbour, and add up what they cover."""
    keyed = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))

    def places(k: Column) -> Column:
        same = F.zip_with(k, F.slice(k, 2, F.size(k)), lambda x, y: x["w"] == y["w"])
        near = F.zip_with(F.concat(F.array(F.lit(False)), same), F.transform(same, lambda x: x), lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))
        pairs = F.zip_with(k, near, lambda x, y: F.when(y, x["i"]))
        return F.sort_array(F.filter(pairs, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    return F.aggregate(_let(keyed, places), start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).cast("int").alias("n"), i.cast("int").alias("at")), lambda a: a["n"])


def _repeated(words: Column) -> Column:
    """Words that lie in windows which occur twice or more."""

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        some = _let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW))), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) <= WINDOW, 0).when(some, _covered(w, starts)).otherwise(0)

    return _let(words, count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...) per row, from whole texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    letters = F.length(F.regexp_replace("text", "[^\\p{L}]++", ""))
    wordless = F.regexp_count("text", F.lit(f"(?<![^{SPACE}])[^{SPACE}\\p{{L}}]++(?![^{SPACE}])"))
    endings = F.filter("lines", lambda x: x.rlike(f"[.!?\u2026\u3002][\"')\u00bb\u201d]?[{SPACE}]*$"))
    return base.withColumn("lines", lines).select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]++", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        letters.cast("long").alias("n_letters"),
        wordless.cast("long").alias("n_wordless"),
        F.size(endings).cast("long").alias("n_endings"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def votes(m: DataFrame) -> dict[str, Column]:
    """1 good, -1 bad, 0 abstain for each rule, from the columns of :func:`measures`."""
    n, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")

    def rule(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    lines = F.greatest("n_lines", F.lit(1)).cast("double")
    symbols, letters, wordless = F.col("n_symbols") / chars, F.col("n_letters") / chars, F.col("n_wordless") / n
    repeats, dups, endings, rich = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_endings") / lines, F.col("n_distinct") / n
    return {
        "symbols": rule(symbols < 0.01, symbols > 0.05),
        "letters": rule(letters > 0.93, letters < 0.85),
        "wordless": rule(wordless < 0.03, wordless > 0.2),
        "repeats": rule(repeats < 0.02, repeats > 0.15),
        "lines": rule(dups < 0.05, dups > 0.2),
        "endings": rule(endings > 0.9, endings < 0.6),
        "variety": rule(rich > 0.6, (rich < 0.3) & (F.col("n_words") < 2000)),
        "size": rule(F.col("n_words") >= 100, F.col("n_words") < 40),
    }


KINDS = (1, -1)


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, weigh: int = 3, n_rules: int | None = None) -> dict:
    """EM for voters from (votes, count) of all patterns: the share of good ones, P(vote | kind) per rule, and each
    rule's discount for correlation with other rules."""
    n_rules = len(patterns[0][0]) if patterns else n_rules or 0
    total = sum(c for _, c in patterns)
    p = [(v.count(1) + 1) / (v.count(1) + weigh * v.count(-1) + 2) for v, _ in patterns]
    model: dict = {}
    for _ in range(rounds):
        say = [{y: dict.fromkeys((-1, 0, 1), 1.0) for y in KINDS} for _ in range(n_rules)]
        for (v, c), good in zip(patterns, p, strict=True):
            for k, x in enumerate(v):
                say[k][1][x] += good * c
                say[k][-1][x] += (1 - good) * c
        say = [{y: {v: n / sum(row[y].values()) for v, n in row[y].items()} for y in KINDS} for row in say]
        share = (sum(good * c for good, (_, c) in zip(p, patterns, strict=True)) + 1) / (total + 2)
        model = {"share": share, "say": say, "trust": [1.0] * n_rules}
        new = [posterior(model, v) for v, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(p, new, strict=True)), default=0.0)
        p = new
        if moved < 1e-9:
            break
    return model | {"trust": _trust(patterns, p, n_rules)}


def _trust(patterns: list[tuple[tuple[int, ...], int]], p: list[float], n_rules: int) -> list[float]:
    """1 / (1 + the sum of a rule's correlations with the others within the kinds)."""
    joint = [[0.0] * n_rules for _ in range(n_rules)]
    for kind in KINDS:
        weights = [c * (good if kind == 1 else 1 - good) for good, (_, c) in zip(p, patterns, strict=True)]
        mass = sum(weights)
        if mass <= 0:
            continue
        mean = [sum(w * v[k] for w, (v, _) in zip(weights, patterns, strict=True)) / mass for k in range(n_rules)]
        for a in range(n_rules):
            for b in range(n_rules):
                joint[a][b] += sum(w * (v[a] - mean[a]) * (v[b] - mean[b]) for w, (v, _) in zip(weights, patterns, strict=True))
    wide = [math.sqrt(joint[k][k]) for k in range(n_rules)]
    alike = [[abs(joint[a][b]) / (wide[a] * wide[b]) if wide[a] * wide[b] > 0 else 0.0 for b in range(n_rules)] for a in range(n_rules)]
    return [1 / (1 + sum(x for b, x in enumerate(alike[a]) if b != a)) for a in range(n_rules)]


def _weight(model: dict, k: int, vote: int) -> float:
    say = model["say"][k]
    return model["trust"][k] * (math.log(say[1][vote]) - math.log(say[-1][vote]))


def posterior(model: dict, v: tuple[int, ...]) -> float:
    odds = math.log(model["share"]) - math.log(1 - model["share"]) + sum(_weight(model, k, x) for k, x in enumerate(v))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, cache=None) -> DataFrame:
    """Per row: id, base measures, base_failed, quality (posterior probability of good), kept.

    ``cache`` materialises the measures between estimation and scoring (default: a written table of the numbers only).
    """
    from tidemark.llm.common import cut

    m = (cache or cut)(measures(docs, id_col, text_col))
    rules = votes(m)
    cast = m.select("*", *[v.alias(f"vote_{k}") for k, v in rules.items()])
    names = [f"vote_{k}" for k in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    patterns = [(tuple(r[x] for x in names), r["count"]) for r in cast.where(~failed).groupBy(*names).count().orderBy(*names).collect()]
    model = fit_label_model(patterns, n_rules=len(names))
    odds = F.lit(math.log(model["share"]) - math.log(1 - model["share"]))
    for k, name in enumerate(names):
        odds = odds + F.when(F.col(name) == 1, _weight(model, k, 1)).when(F.col(name) == -1, _weight(model, k, -1)).otherwise(_weight(model, k, 0))
    quality = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))
    out = cast.withColumn("quality", quality).withColumn("base_failed", failed)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), F.round("quality", 6).alias("quality"))
