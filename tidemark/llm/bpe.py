"""Byte-level BPE encoding and decoding with a memory-mapped lexicon of frequent words.

A chunk is an optional space followed by non-space characters, or a run of white space as the pre-tokeniser cuts it;
no merge crosses its ends, so a chunk always has the same ids. The words that are most frequent over all documents
(at most ``size``, counted before the shuffle) and their ids are compiled into a minimal acyclic transducer: states with equal suffixes
are shared (built incrementally from sorted words), and the outputs along a path add up to the word's number, which
indexes its ids. The arrays are one file, sent to executors with the job's files and memory-mapped there, so the
workers of a machine share its pages. Chunks outside the lexicon are merged exactly, by rank.

Texts that hold a special token's string, or control characters on which white-space rules differ, go to the library
as a whole. A worker's memory of chunks is bounded in bytes (``remember``), and so are the pieces in which texts are
coded; results depend on neither, nor on the lexicon.

Defined results: null text is encoded as empty (no ids); decoding gives the text back; rows may repeat; empty tables
give empty results; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_arrow, map_batches, ship_package, text_slices

CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Python counts these as white space, Unicode and the library do not.
ODD = re.compile("[\x1c-\x1f]")


class Transducer:
    """A minimal acyclic automaton over byte strings whose outputs number its words in sorted order."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.to, self.add, self.final = (arrays[k] for k in ("keys", "to", "add", "final"))

    @staticmethod
    def build(words: list[bytes]) -> dict[str, np.ndarray]:
        """Arrays of the automaton of ``words`` (distinct, not empty)."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            found = register.get(key)
            if found is None:
                found = register[key] = len(states)
                states.append(key)
            return found

        path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, state)]]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))

        for word in sorted(words):
            same = len(os.path.commonprefix([last, word]))
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        root = settle(path[0])
        count = []
        for final, arcs in states:  # targets come before sources
            count.append(final + sum(count[to] for _, to in arcs))
        rows = []
        for state, (final, arcs) in enumerate(states):
            ahead = int(final)
            for byte, to in arcs:
                rows.append((state << 8 | byte, to, ahead))
                ahead += count[to]
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        return {"keys": table[:, 0].copy(), "to": table[:, 1].astype(np.int32), "add": table[:, 2].astype(np.int32), "final": np.array([f for f, _ in states] + [bool(root < 0)], dtype=bool), "root": np.array([root])}

    def numbers(self, words: list[bytes], root: int) -> np.ndarray:
        """Each word's number, or -1; all words advance together, one byte a step."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if n else size
        data = np.frombuffer(b"".join(words), np.uint8)
        state, number, out = np.full(n, root, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        alive = np.arange(n)
        step = 0
        while len(alive):
            done = size[alive] == step
            ends = alive[done & self.final[state[alive]]]
            out[ends] = number[ends]
            alive = alive[~done]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[start[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            state[alive] = self.to[at]
            number[alive] += self.add[at]
            step += 1
        return out


def write_lexicon(path: str, words: list[str], ids: list[list[int]]) -> None:
    """One file: a header of (name, type, offset, length), then the arrays, each at a multiple of 8."""
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    arrays = Transducer.build([words[i].encode() for i in order])
    arrays["offsets"] = np.cumsum([0, *[len(ids[i]) for i in order]]).astype(np.int64)
    arrays["ids"] = np.array([x for i in order for x in ids[i]], dtype="<u4")
    head, body = [], b""
    for name, a in arrays.items():
        body += bytes(-len(body) % 8)
        head.append(f"{name} {a.dtype.str} {len(body)} {len(a)}")
        body += a.tobytes()
    top = "\n".join(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(top)) + top + bytes(-len(top) % 8) + body)


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        (n,) = struct.unpack("<Q", raw[:8].tobytes())
        base = 8 + n + -n % 8
        arrays = {}
        for line in raw[8 : 8 + n].tobytes().decode().split("\n"):
            name, kind, at, size = line.split(" ")
            arrays[name] = raw[base + int(at) : base + int(at) + int(size) * np.dtype(kind).itemsize].view(kind)
        self.automaton, self.offsets, self.ids, self.root = Transducer(arrays), arrays["offsets"], arrays["ids"], int(arrays["root"][0])

    def find(self, words: list[str]) -> list[bytes | None]:
        """Ids of each word as little-endian unsigned 32-bit integers, None for words outside."""
        numbers = self.automaton.numbers([w.encode() for w in words], self.root)
        low, high = self.offsets[numbers], self.offsets[np.minimum(numbers + 1, len(self.offsets) - 1)]
        return [self.ids[a:b].tobytes() if k >= 0 else None for k, a, b in zip(numbers.tolist(), low.tolist(), high.tolist(), strict=True)]


class Merger:
    """Exact ids of any chunk, by the merges of a byte-level vocabulary file of the tokenizers library.

    Merging by rank over bytes (tiktoken) gives the same ids and takes half the time; it serves letters below U+0250
    where merge order and ids agree, the library all else.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        back = {c: b for b, c in _byte_letters().items()}
        special = set(self.specials)
        ranks = {}
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(back[c] for c in token)
            if token not in special:
                ranks[self.bytes_of[i]] = i
        with open(vocabulary) as f:
            merges = json.load(f)["model"]["merges"]
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        order = [vocab[x] for x in pairs]
        self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary if order == sorted(order) else None

    def ids(self, chunks: list[str]) -> list[bytes]:
        if not self.by_rank:
            return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        fast = self.by_rank
        return [array("I", fast(x)).tobytes() if max(x) < "\u0250" else self.whole(x) for x in chunks]

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Encodes and decodes texts; keeps chunks with their ids in about ``remember`` bytes."""

    #: What Python needs for an entry of the memory beside the characters and ids.
    ENTRY = 200

    def __init__(self, vocabulary: str, lexicon: str | None = None, remember: int = 48 << 20):
        self.merger, self.lexicon, self.remember = Merger(vocabulary), Lexicon(lexicon) if lexicon else None, remember
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.special = re.compile("|".join(map(re.escape, self.merger.specials)) or "(?!)")

    def learn(self, chunks: set[str]) -> None:
        """Makes the ids of ``chunks`` known: all new ones are asked of the automaton at once, the rest is merged."""
        if self.held > self.remember:
            self.known.clear()
            self.held = 0
        new = list(chunks - self.known.keys())
        if self.lexicon and new:
            hits = self.lexicon.find(new)
            self._keep([c for c, x in zip(new, hits, strict=True) if x is not None], [x for x in hits if x is not None])
            new = [c for c, x in zip(new, hits, strict=True) if x is None]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self._keep(part, self.merger.ids(part))

    def _keep(self, chunks: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(chunks, ids, strict=True))
        self.held += self.ENTRY * len(chunks) + sum(map(len, chunks)) + sum(map(len, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        odd = [bool(self.special.search(x) or ODD.search(x)) for x in texts]
        cuts = [[] if o else CHUNK.findall(x) for x, o in zip(texts, odd, strict=True)]
        self.learn(set().union(*cuts))
        known = self.known.__getitem__
        return [self.merger.whole(x) if o else b"".join(map(known, chunks)) for x, o, chunks in zip(texts, odd, cuts, strict=True)]

    def decode(self, ids: bytes) -> str:
        token = self.merger.bytes_of.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_chunks(docs: DataFrame, text_col: str, size: int, longest: int = 64) -> list[str]:
    """At most ``size`` of the most frequent words of all documents, each with the space before it.

    Words of one class of counts (a sixteenth of a power of two) come in together or not at all, so only the numbers
    of words per class and the chosen words reach the driver. Words seen once, or longer than ``longest`` bytes, are
    left to the merger.
    """
    text = F.translate(F.col(f"`{text_col}`"), "\t\n\x0b\f\r", "     ")
    words = docs.select(F.explode(F.split(text, " ")).alias("w")).where(F.octet_length("w").between(1, longest))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = cut(counted.select("w", F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int").alias("grade")))
    taken, least = 0, None
    for r in sorted(counted.groupBy("grade").count().collect(), reverse=True):  # a few hundred grades
        taken += r["count"]
        if taken > size:
            break
        least = r.grade
    if least is None:
        return []
    return sorted(" " + r.w for r in counted.where(F.col("grade") >= least).collect() if "\x00" not in r.w)


def ship_lexicon(docs: DataFrame, text_col: str, vocabulary: str, size: int = 30_000) -> str:
    """Builds the lexicon on the driver and adds its file to the job; the file's name."""
    words = frequent_chunks(docs, text_col, size)
    ids = [np.frombuffer(x, "<u4").tolist() for x in Merger(vocabulary).ids(words)] if words else []
    fd, path = tempfile.mkstemp(suffix=".lexicon")
    os.close(fd)
    write_lexicon(path, words, ids)
    with open(path, "rb") as f:
        name = f"{hashlib.sha256(f.read()).hexdigest()[:16]}.lexicon"
    named = os.path.join(os.path.dirname(path), name)
    os.replace(path, named)
    docs.sparkSession.sparkContext.addFile(named)
    ship_package(docs.sparkSession)
    return name


_codecs: dict[tuple, Codec] = {}


def codec(vocabulary: str, lexicon: str | None) -> Codec:
    """The worker's codec, kept between tasks."""
    if (vocabulary, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[vocabulary, lexicon] = Codec(vocabulary, lexicon and SparkFiles.get(lexicon))
    return _codecs[vocabulary, lexicon]


REPORT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_column(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", size: int = 30_000) -> DataFrame:
    """``docs`` with the ids of each text as binary (little-endian unsigned 32-bit) in ``ids_col``, which replaces any
    column of that name."""
    docs = docs.drop(ids_col)
    at = docs.columns.index(text_col)
    name = ship_lexicon(docs, text_col, vocabulary, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, name)
        for b in text_slices(batches, at, 512):
            ids = pa.array(coder.encode([x or "" for x in b.column(at).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [f"c{k}" for k in range(b.num_columns + 1)])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())]))


def decode_column(rows: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``text_col``; null ids decode to null."""
    rows = rows.drop(text_col)
    at = rows.columns.index(ids_col)
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, None)
        for b in batches:
            text = pa.array([None if x is None else coder.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [f"c{k}" for k in range(b.num_columns + 1)])

    return map_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def bpe_report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 30_000) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what the codec encodes and decodes, one row per row."""
    name = ship_lexicon(docs, text_col, vocabulary, size)
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, name)
        for part in text_slices(batches, 1, 512):
            ids = coder.encode(part.column(1).to_pylist())
            told = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told]),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(base, run, T.StructType([base.schema[0], *REPORT.fields]))
