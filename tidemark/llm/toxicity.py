"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded, stratified sample of labelled rows (``per_class`` of each label, those with the smallest
hashes; rows that repeat text and label count once). Terms are all words of the examples (runs of letters, lower case);
none is left out. A vector holds ``(1 + ln tf) * idf * relevance`` of unit length; words that no example has count in
a text's length. ``relevance`` is the supervised factor of term weighting: ``floor`` for words whose
log odds between the labels lie within ``sure`` standard errors of 0, and more by what exceeds that. So words of a
topic or a language still find neighbours, but do not drown the few that tell the labels apart.

The inverted index keeps, per term, its postings in blocks of ``block`` examples with the largest weight of each block;
examples that share their heaviest term lie side by side. A query adds up the block maxima of its terms, scores the
blocks of the highest bounds, and then all blocks whose bound is not below the k-th best cosine so far; the k nearest
are therefore exact. Their labels vote with their cosines as weights;
isotonic regression on left-out votes of the examples, reweighted to the true share of labels, calibrates the vote.
The nearest examples and their cosines are returned as evidence.

Defined results: texts that share no word with an example (null and empty ones too) get the calibrated share of such
examples, or the share of label 1 if there are none; ties in cosine (to 12 digits) go to the example with the smaller
number; without labelled rows every score is 0; very long texts are scored whole; rows may repeat; empty tables give
empty results; other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, ship_package
from tidemark.llm.langid import remainder

WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> Counter[str]:
    """Counts of the words of the whole text."""
    return Counter(WORD.findall(text.lower()))


class Index:
    """Block-max inverted index over unit vectors, given as (term, example, weight) postings in order of term, example."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int, n_terms: int, block: int = 64):
        self.block, self.n, self.docs, self.weights = block, n, docs, weights
        self.n_blocks = -(-n // block)
        cell = terms.astype(np.int64) * self.n_blocks + docs // block
        self.top = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(self.top, cell, weights)
        self.top = self.top.reshape(n_terms, self.n_blocks)
        size = np.bincount(cell, minlength=n_terms * self.n_blocks)
        self.starts = np.concatenate(([0], np.cumsum(size))).astype(np.int32)

    def scores(self, terms: np.ndarray, query: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of the examples of some blocks; 0 elsewhere."""
        cells = (terms[:, None] * self.n_blocks + blocks).ravel()
        a = self.starts[cells]
        size = self.starts[cells + 1] - a
        some = size > 0
        a, size = a[some], size[some]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(a) else np.zeros(0, np.int64)
        return np.bincount(self.docs[at], self.weights[at] * np.repeat(np.repeat(query, len(blocks))[some], size), minlength=self.n)

    def search(self, terms: np.ndarray, query: np.ndarray, k: int, skip: int = -1) -> list[tuple[int, float]]:
        """The k examples with the largest positive cosine, without example ``skip``."""
        if not len(terms) or not self.n:
            return []
        bound = query @ self.top[terms]
        order = np.argsort(-bound, kind="stable")
        some = order[: max(1, -(-2 * k // self.block) + 1)]
        score = self.scores(terms, query, some)
        if skip >= 0:
            score[skip] = 0
        least = np.partition(score, -k)[-k] if self.n > k else 0.0
        rest = order[len(some) :]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= least - 1e-9)]
        if len(rest):
            score = score + self.scores(terms, query, rest)
            if skip >= 0:
                score[skip] = 0
            least = np.partition(score, -k)[-k] if self.n > k else 0.0
        near = np.flatnonzero((score >= least - 1e-12) & (score > 0))
        near = near[np.lexsort((near, -np.round(score[near], 12)))][:k]
        return [(int(i), float(score[i])) for i in near]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: ascending knots and their values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b * c
            pools[-1][1] += c
        else:
            pools.append([b * c, c, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    knots = np.array([p for s, c, a, z in pools for p in (a, z)])
    return knots, np.array([v for s, c, _, _ in pools for v in (s / c, s / c)])


class Model:
    def __init__(self, examples: list[tuple[object, str, int]], shares: dict[int, float] | None = None, k: int = 10, floor: float = 0.05, sure: float = 2.0, block: int = 64):
        self.k = k
        once = {(x, y): i for i, x, y in reversed(examples)}
        kept = [(i, x, y) for (x, y), i in once.items()][::-1]
        counts = [terms_of(x) for _, x, _ in kept]
        df, toxic = Counter(), Counter()
        for c, (_, _, y) in zip(counts, kept, strict=True):
            df.update(c.keys())
            if y:
                toxic.update(c.keys())
        words = sorted(df)
        n, pos = len(kept), sum(y for _, _, y in kept)
        self.terms = {t: i for i, t in enumerate(words)}
        d, a = np.array([df[t] for t in words], float), np.array([toxic[t] for t in words], float)
        cells = np.array([a, pos - a, d - a, n - pos - d + a]) + 0.5  # with and without the term, label 1 and label 0
        odds = np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3])
        far = np.maximum(0, np.abs(odds) / np.sqrt((1 / cells).sum(axis=0)) - sure)
        self.worth = (np.log((1 + n) / (1 + d)) + 1) * (floor + far)
        self.unknown = (np.log(1 + n) + 1) * floor
        # Examples side by side that share their heaviest term among those that several have.
        shared = np.where(d >= 8, self.worth, 0)
        heavy = [max((self.terms[t] for t in c), key=lambda t: (shared[t], t), default=-1) for c in counts]
        order = sorted(range(n), key=lambda i: (heavy[i], i))
        counts = [counts[i] for i in order]
        self.ids = [kept[i][0] for i in order]
        self.labels = np.array([kept[i][2] for i in order], np.float64)
        vectors = [self.vector(c) for c in counts]
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([*(t for t, _ in vectors), np.zeros(0, np.int64)])
        docs = np.repeat(np.arange(n, dtype=np.int32), sizes)
        weights = np.concatenate([*(w for _, w in vectors), np.zeros(0)])
        by_term = np.argsort(terms, kind="stable")
        self.index = Index(terms[by_term], docs[by_term], weights[by_term], n, len(words), block)
        weight = np.ones(n)
        for y, share in (shares or {}).items():
            own = self.labels == y
            if own.any():
                weight[own] = share * n / own.sum()
        votes = [self.vote(self.index.search(*v, k, i)) if len(v[0]) else None for i, v in enumerate(vectors)]
        seen = np.array([v is not None for v in votes], bool)
        every = (self.labels * weight).sum() / weight.sum() if n else 0.0
        self.blank = float((self.labels * weight)[~seen].sum() / weight[~seen].sum() if (~seen).any() else every)
        self.knots = self.values = None
        if seen.any():
            self.knots, self.values = isotonic(np.array([v for v in votes if v is not None]), self.labels[seen], weight[seen])

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights; the length is that of all its terms."""
        found = [self.terms.get(t, -1) for t in counts]
        terms = np.array(found, np.int64)
        raw = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        known = terms >= 0
        raw[known] *= self.worth[terms[known]]
        raw[~known] *= self.unknown
        length = float(np.sqrt(raw @ raw)) or 1.0
        order = np.argsort(terms[known], kind="stable")
        return terms[known][order], (raw[known] / length)[order]

    def vote(self, near: list[tuple[int, float]]) -> float:
        total = sum(s for _, s in near)
        return round(float(sum(s * self.labels[i] for i, s in near) / total), 9) if total else 0.0

    def score(self, text: str) -> tuple[float, list, list[float]]:
        """(score, nearest example ids, their cosines)."""
        near = self.index.search(*self.vector(terms_of(text)), self.k)
        if not near:
            return self.blank, [], []
        return float(np.interp(self.vote(near), self.knots, self.values)), [self.ids[i] for i, _ in near], [s for _, s in near]


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000, **how) -> Model:
    """Builds the model from at most ``per_class`` rows of each label that are not held out."""
    marked = labels.where(remainder(id_col) != 0).where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    n = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    few = hash_sample(marked.where("y = 0"), per_class, "id").unionByName(hash_sample(marked.where("y = 1"), per_class, "id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(few), "id").orderBy("id", "y", "text").collect()  # at most 2 * per_class rows
    total = sum(n.values()) or 1
    return Model([(r.id, r.text, r.y) for r in rows], {y: c / total for y, c in n.items()}, **how)


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """(id, held_out, score, predicted, evidence, cosines) per row of ``docs``."""
    model = model or fit_toxicity(docs, labels, id_col, text_col, label_col)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), (remainder(id_col) == 0).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class
    out = [base.schema[0], base.schema[1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType())), T.StructField("cosines", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.score(x) for x in b.column(2).to_pylist()]
            scores = [s for s, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([i for _, i, _ in found], pa.list_(pa.int64())), pa.array([c for _, _, c in found], pa.list_(pa.float64()))],
                [f.name for f in out],
            )

    return base.mapInArrow(run, T.StructType(out))
