"""Language identification with averaged hashed subword embeddings and a linear softmax.

The subwords of a text are its byte 3- and 4-grams (lower case, white space as one space), hashed into ``buckets``
rows of an embedding table; their average goes through a linear layer and a softmax, as in fastText. Embeddings and
layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows (``sample``
rows, those with the smallest hashes). Since averaging and the layer are both linear, prediction uses their product,
one score row per bucket.

Probabilities are calibrated by a temperature fitted on a part of the sample that training did not see. A text is
rejected if its calibrated score is below the level that ``lose`` of the correctly labelled texts of that part stay
under, at most 0.5, or if it has no letters.

Defined results: null texts and texts without letters get ``und`` with score 0 and are rejected; ties go to the
first language in code-point order; without labelled rows every text gets ``und``; rows may repeat; empty tables give
empty results; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_sample, map_batches, ship_package, text_slices

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; rows with 0 are held out."""
    return F.crc32(F.encode(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "utf-8")) % 5


def hashes(text: str, bits: int) -> np.ndarray:
    """Buckets of all byte 3- and 4-grams of the whole text."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    three = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    four = three[:-1] * np.uint32(31) + b[3:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    both = np.concatenate((three, four))
    return ((both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


class Model:
    """``table``: buckets x languages, the product of embeddings and layer."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, bits: int, heat: float = 1.0, least: float = 0.0):
        self.languages, self.table, self.bias, self.bits, self.heat, self.least = languages, table, bias, bits, heat, least

    def logits(self, text: str) -> np.ndarray:
        return self.table[hashes(text, self.bits)].mean(axis=0) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        tags, scores, rejected = [], [], []
        for x in texts:
            if not x or not self.languages or not LETTER.search(x):
                tags.append(UNKNOWN)
                scores.append(0.0)
                rejected.append(True)
                continue
            p = softmax(self.logits(x)[None] / self.heat)[0]
            k = int(p.argmax())
            tags.append(self.languages[k])
            scores.append(float(p[k]))
            rejected.append(bool(p[k] < self.least))
        return tags, scores, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], bits: int = 16, width: int = 16, epochs: int = 4, rate: float = 0.5, lose: float = 0.001, seed: int = 3) -> Model:
    """A model from (text, language) pairs; every fifth pair only calibrates."""
    rows = [(x, y) for x, y in rows if x and LETTER.search(x)]
    languages = sorted({y for _, y in rows})
    r = np.random.default_rng(seed)
    n_lang = len(languages)
    if n_lang == 0:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), bits)
    order = r.permutation(len(rows))
    held, fit = order[::5], np.array([i for k, i in enumerate(order) if k % 5], dtype=int)
    if not len(fit):
        fit = held
    place = {y: k for k, y in enumerate(languages)}
    embed = r.normal(0, 1, (1 << bits, width)).astype(np.float32)
    layer, bias = np.zeros((width, n_lang), np.float32), np.zeros(n_lang, np.float32)
    inputs = {}
    for i in fit:
        u, c = np.unique(hashes(rows[i][0], bits), return_counts=True)
        inputs[i] = (u, (c / c.sum()).astype(np.float32))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in r.permutation(fit):
            u, share = inputs[i]
            x = share @ embed[u]
            p = softmax((x @ layer + bias)[None])[0]
            p[place[rows[i][1]]] -= 1
            back = layer @ p
            layer -= step * np.outer(x, p)
            bias -= step * 0.1 * p
            # A bucket's gradient carries its share; scaled so that frequent subwords move by the step itself.
            embed[u] -= (step * share / share.max())[:, None] * back[None]
    model = Model(languages, (embed @ layer).astype(np.float32), bias, bits)
    if len(held):
        z = np.array([model.logits(rows[i][0]) for i in held])
        y = np.array([place[rows[i][1]] for i in held])
        grid = [0.05 * 1.15**k for k in range(60)]
        model.heat = float(min(grid, key=lambda h: -np.log(softmax(z / h)[np.arange(len(y)), y] + 1e-12).mean()))
        p = softmax(z / model.heat)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.least = float(min(0.5, np.quantile(right, lose))) if len(right) else 0.0
    return model


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500, **how) -> Model:
    """Trains on at most ``sample`` labelled rows that are not held out."""
    rows = docs.where((remainder(id_col) != 0) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    few = hash_sample(rows, sample, "id").collect()
    return train([(r.text, r.lang) for r in few], **how)


OUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def predict_languages(rows: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``rows`` with the language, its calibrated probability and whether it is rejected; columns of those ``names`` are replaced."""
    rows = rows.drop(*names)
    at = rows.columns.index(text_col)
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at):
            found = sent.value.predict(b.column(at).to_pylist())
            made = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [f"c{k}" for k in range(b.num_columns + 3)])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, OUT, strict=True)]
    return map_batches(rows, run, T.StructType([*rows.schema.fields, *fields]))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) per row."""
    model = model or fit_language_model(docs, id_col, text_col, lang_col)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), (remainder(id_col) == 0).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict_languages(base, model).drop("text").select(id_col, "held_out", "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, text_col: str = "text", model: Model | None = None, **how) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with their columns unchanged."""
    model = model or fit_language_model(docs, text_col=text_col, **how)
    at = docs.columns.index(text_col)
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at):
            _, _, rejected = sent.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([not x for x in rejected], pa.bool_()))

    return map_batches(docs, run, docs.schema)
