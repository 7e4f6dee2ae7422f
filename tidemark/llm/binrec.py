"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A data file is a row of records. A record is
``length (8 bytes) | masked checksum of the length (4) | payload (length) | masked checksum of the payload (4)``,
all little-endian; a checksum is CRC-32, masked as ``((c >> 15 | c << 17) + 0xa282ead8) mod 2^32`` so that checksums
of data that hold checksums stay useful. The payload is
``doc_id (8) | bytes per id (1) | ids``, with ids as unsigned 16-bit integers where the vocabulary allows and 32-bit
otherwise. Next to each data file lies its index: one unsigned 64-bit offset per record and the end of the file, so any
record can be read on its own, in any order.

Rows are dealt out by ranges of the id and sorted within, so files and records are in ascending order of the id. A
task writes files under names of its own attempt and reports them; readers only read reported files, so tasks that
are run again leave no double records. Files lie in the shared folder (any file system pyarrow knows).

Defined results: null text has the end id only; rows with one id lie next to each other in any order; null ids come
first and are written as the smallest 64-bit integer; empty tables write no record; other columns may have any names.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import ODD, _byte_letters
from tidemark.llm.common import ship_package

NO_ID = -(2**63)


class WordCodec:
    """Exact ids of texts under a vocabulary file with word ends (``</w>``), white-space word by word.

    Words of letters below U+0250 are merged by rank over bytes, with a byte that UTF-8 never uses for the word's
    end; other words, and texts with special tokens' strings, go to the library.
    """

    def __init__(self, vocabulary: str, remember: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        with open(vocabulary) as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern).findall
        back = {c: bytes([b]) for b, c in _byte_letters().items()}
        end = "</w>"

        def raw(token: str) -> bytes:
            last = token.endswith(end)
            return b"".join(back[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        for m in merges:
            x, y = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault(raw(x + y), 512 + len(ranks))
        self.to_id = np.zeros(max(ranks.values()) + 1, np.uint32)
        letters = _byte_letters()
        for b in range(256):
            self.to_id[b], self.to_id[256 + b] = vocab.get(letters[b], 0), vocab.get(letters[b] + end, 0)
        for m in merges:
            x, y = m if isinstance(m, list) else m.split(" ")
            self.to_id[ranks[raw(x + y)]] = vocab[x + y]
        self.table = self.to_id.tolist()
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.wide = self.library.get_vocab_size(with_added_tokens=True) > 65536
        self.code = "I" if self.wide else "H"
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def _word(self, word: str) -> bytes:
        if max(word) >= "ɐ" or "İ" in word:
            return self._library(word)
        table, out = self.table, []
        for piece in self.cut(word.lower()):
            out += [table[r] for r in self.merge(piece.encode() + b"\xff")]
        return array(self.code, out).tobytes()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 2 bytes an id (4 for vocabularies above 65536)."""
        odd = [bool(self.special.search(x) or ODD.search(x)) for x in texts]
        words = [[] if o else x.split() for x, o in zip(texts, odd, strict=True)]
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = set().union(*words)
        self.known.update((w, self._word(w)) for w in new)
        known = self.known.__getitem__
        return [self._library(x) if o else b"".join(map(known, w)) for x, o, w in zip(texts, odd, words, strict=True)]


_codecs: dict[str, WordCodec] = {}


def word_codec(vocabulary: str) -> WordCodec:
    if vocabulary not in _codecs:
        _codecs.clear()
        _codecs[vocabulary] = WordCodec(vocabulary)
    return _codecs[vocabulary]


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload of a file; None at its end; ValueError if it is damaged."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    (n,) = struct.unpack("<Q", head[:8])
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def read_record(stream, offset: int) -> tuple[int, np.ndarray]:
    """The record (doc id, ids) that starts at ``offset`` of a seekable file."""
    stream.seek(offset)
    return unpack(read_frame(stream))


def read_index(stream) -> np.ndarray:
    return np.frombuffer(stream.read(), "<u8")


def unpack(payload: bytes) -> tuple[int, np.ndarray]:
    doc, width = struct.unpack("<qB", payload[:9])
    return doc, np.frombuffer(payload[9:], "<u2" if width == 2 else "<u4")


FILES = "path string, first long, n_docs long, n_tokens long"


def write_ids(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, partitions: int | None = None) -> list:
    """Writes data and index files under ``folder``; rows (path, first, n_docs, n_tokens) of the files in order.

    There is one row per file, so the list grows with the number of files and not with documents.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(n, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_codec(vocabulary)
        width = 4 if coder.wide else 2
        end = array(coder.code, [end_id]).tobytes()
        out, offsets, tokens, first = None, [0], 0, None
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        name = f"{root}/part-{uuid.uuid4().hex}"
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                ids = part.column(0).to_pylist()
                if out is None and ids:
                    first = ids[0]
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name + ".bin")
                for doc, x in zip(ids, coder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    record = frame(struct.pack("<qB", doc, width) + x + end)
                    out.write(record)
                    offsets.append(offsets[-1] + len(record))
                    tokens += len(x) // width + 1
        if out is not None:
            out.close()
            with store.open_output_stream(name + ".idx") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"path": [name], "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return sorted(ranged.mapInArrow(run, FILES).collect(), key=lambda r: (r.first, r.path))


def read_ids(spark: SparkSession, files: list, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the records of ``files``; every checksum is verified."""
    ship_package(spark)
    ahead, rows = 0, []
    for r in files:
        rows.append((r.path, ahead))
        ahead += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, ahead long").repartition(len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path + ".bin", buffer_size=1 << 20) as f:
                    docs, starts, sizes, sums = [], [], [], []
                    while (payload := read_frame(f)) is not None:
                        doc, ids = unpack(payload)
                        docs.append(None if doc == NO_ID else doc)
                        starts.append(at)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, schema)


def read_shuffled(spark: SparkSession, files: list, folder: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(place, doc_id, ids) of all records of ``files`` in a random order that ``seed`` fixes.

    ``place`` is the sort key of that order, ``ids`` little-endian unsigned 32-bit integers. Every task gets records of
    many files: it reads their places from the offset indexes and fetches each record by one seek.
    """
    ship_package(spark)
    schema = "place long, doc_id long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(r.path, r.n_docs) for r in files], "path string, n long").where("n > 0")
    picks = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    picks = picks.withColumn("place", F.xxhash64("path", "k", F.lit(seed)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = picks.repartitionByRange(n, "place").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                paths, spots = part.column(0).to_pylist(), part.column(1).to_pylist()
                found: list[tuple] = [(None, b"")] * len(paths)
                # Within a slice the records of one file are fetched together, in their order on disk.
                order = sorted(range(len(paths)), key=lambda i: (paths[i], spots[i]))
                for path, group in itertools.groupby(order, key=lambda i: paths[i]):
                    with store.open_input_file(path + ".idx") as index, store.open_input_file(path + ".bin") as data:
                        for i in group:
                            index.seek(8 * spots[i])
                            doc, ids = read_record(data, int(np.frombuffer(index.read(8), "<u8")[0]))
                            found[i] = (None if doc == NO_ID else doc, ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["place", "doc_id", "ids"])

    return dealt.mapInArrow(run, schema)
