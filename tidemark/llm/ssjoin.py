"""Similarity join of word-shingle sets by Jaccard, with PartEnum signatures, and the groups that its links form.

Sets of ``x`` and ``y`` elements whose Jaccard similarity is at least ``s`` differ in at most
``(1 - s) / (1 + s) * (x + y)`` elements. Sizes fall into bands that grow by ``1 / s``, so linked sets lie in one band
or in neighbours; each set signs for its own band and for the next. For a band whose pairs differ in at most ``k``
elements, the feature domain (hashes of shingles) is cut into ``n1`` parts, and each part into ``n2`` sub-parts. With
``n1 * (k2 + 1) > k``, linked sets differ in at most ``k2`` elements of some part, and so agree on ``n2 - k2`` of its
sub-parts; every subset of that many sub-parts is a signature. :data:`LEVELS` fixes ``k2`` and ``n2`` per size.

A subset may be empty, and empty signatures tell nothing apart. ``n1`` has ``spare`` parts more than needed, so linked
sets agree in ``spare + 1`` parts at least; only a set with more than ``spare`` parts that have an empty subset, a rare
one, signs those subsets too. Hence no link is lost.

The work after signing is linear in rows:

1. Sets with one content form a class; one id stands for it.
2. Within a batch of a task, and then within a signature, each set is paired with the smallest id that shares it.
3. Each set meets the smallest of these pivots, first with a parity sketch, which bounds the difference from below,
   then, if that allows a link, with the set itself. The links give groups.
4. Signatures that still span several groups are blocks. A task gets each member of a block once, with its sketch,
   compares all of them in memory and returns, of the pairs that may link, those that connect the members. Clusters so
   connected are blocks again, to which each member sends its set once; the task returns links that join groups, fewer
   than there are groups. Blocks of too many members are cut, and pairs of pieces are checked, but not pieces of one
   group with each other.

Elements are 64-bit hashes of shingles.

Defined results: texts with fewer words than a shingle have their whole word sequence as the only element; null texts
and texts without words have the empty set, which links with nothing; ids must be unique (rows that repeat an id are
taken as one document with the first of its texts in code-point order); rows without an id link with nothing and have
no component; a similarity equal to the bound links; empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, join_hot, map_arrow, n_partitions, ship_package, text_slices

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

#: (largest set, k2, n2). Sets of up to 1,000 elements, where a passage of 60 words is a good part of a text, sign pairs
#: of three sub-parts, which hold a third more elements than a part with k2 = 0 and cost half as many signatures again.
#: On 47,000 texts at five words and 0.8 that leaves 84,000 pairs to look at instead of 142,000. Larger sets rarely
#: collide by a shared passage and sign single parts.
LEVELS = ((1000, 1, 3), (1 << 62, 0, 1))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each whole text (A-Z lower-cased)."""
    words = [(x or "").encode().lower().split() for x in texts]
    flat = [w for ws in words for w in ws]
    codes = pd.util.hash_array(np.array([*flat, None], dtype=object)[:-1], categorize=False) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for ws in words:
        c = codes[at : at + len(ws)]
        at += len(ws)
        if len(c) >= n:
            h = c[: len(c) - n + 1].copy()
            for k in range(1, n):
                h = mix64(h) + c[k : len(c) - n + 1 + k] * M1
            out.append(np.unique(mix64(h)))
        elif len(c):
            h = np.uint64(len(c))
            h = np.array([h])
            for x in c:
                h = mix64(h) * M2 + x
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands for a similarity of ``percent`` in 100, in integers so that no link is lost to rounding."""

    def __init__(self, percent: int, longest: int = 1 << 40):
        self.percent, self.low = percent, [1]
        while self.low[-1] < longest:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 100 // percent + 1))
        self.plans = np.array([self.plan(b) for b in range(len(self.low) - 1)], np.int64)

    def of(self, size) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """(n1, k2, n2, spare) for the pairs of which one lies in ``band`` and the other in it or in the band below.

        n1 is 0 where no two different sets can link.
        """
        most = self.low[band + 1] - 1
        k = 2 * most * (100 - self.percent) // (100 + self.percent)
        k2, n2 = next((a, b) for top, a, b in LEVELS if most <= top)
        need = k // (k2 + 1) + 1
        spare = 1 + need // 24
        return (need + spare if k else 0), k2, n2, spare


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, 64-bit signature) of all signatures of sorted sets; empty sets have none."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets), dtype=np.int64), size)
    own = bands.of(size)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    spread, value = mix64(flat ^ M3), mix64(flat + M2)
    for band in (own, own + 1):
        plan = bands.plans[np.maximum(band, 0)]
        for k2, n2 in sorted({(int(a), int(b)) for a, b in plan[(size > 0) & (plan[:, 0] > 0)][:, 1:3]}):
            here = ((plan[:, 1] == k2) & (plan[:, 2] == n2) & (plan[:, 0] > 0))[doc]
            d, x = doc[here], spread[here]
            part = ((x >> np.uint64(32)) * plan[d, 0].astype(np.uint64)) >> np.uint64(32)
            sub = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(n2)) >> np.uint64(32)
            # One row per part that holds elements; its sub-parts are sums of element hashes.
            key = (d.astype(np.uint64) << np.uint64(44)) | (part << np.uint64(4)) | sub
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            sums = np.add.reduceat(value[here][order], first) if len(first) else np.zeros(0, np.uint64)
            key = key[first]
            row_key = key >> np.uint64(4)
            new = np.concatenate(([True], row_key[1:] != row_key[:-1])) if len(key) else np.zeros(0, bool)
            row = np.cumsum(new) - 1
            table = np.zeros((int(new.sum()), n2), np.uint64)
            full = np.zeros(table.shape, bool)
            at = (key & np.uint64(15)).astype(np.int64)
            table[row, at], full[row, at] = sums, True
            row_doc, row_part = (row_key[new] >> np.uint64(40)).astype(np.int64), row_key[new] & np.uint64((1 << 40) - 1)
            # Sets with too many hollow parts sign empty subsets too: their missing parts become rows.
            solid = np.bincount(row_doc[full.sum(axis=1) > k2], minlength=len(sets))
            hollow = np.zeros(len(sets), bool)
            hollow[np.unique(d)] = True
            hollow &= plan[:, 0] - solid > plan[:, 3]
            for i in np.flatnonzero(hollow).tolist():
                gone = np.setdiff1d(np.arange(plan[i, 0], dtype=np.uint64), row_part[row_doc == i])
                row_doc, row_part = np.concatenate((row_doc, np.full(len(gone), i))), np.concatenate((row_part, gone))
                table, full = np.concatenate((table, np.zeros((len(gone), n2), np.uint64))), np.concatenate((full, np.zeros((len(gone), n2), bool)))
            for c, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
                tag = mix64(row_part * np.uint64(64) + np.uint64(c) + (band[row_doc] + 1).astype(np.uint64) * M1)
                keep = full[:, subset].any(axis=1) | hollow[row_doc]
                # Sub-parts keep their places in the sum, so that contents cannot trade them.
                mixed = sum((mix64(table[:, j] + np.uint64(j)) for j in subset), np.zeros(len(tag), np.uint64))
                owners.append(row_doc[keep])
                found.append(mix64(mixed + tag)[keep])
    return np.concatenate(owners), np.concatenate(found)


def sketch(s: np.ndarray) -> np.ndarray:
    """The size, then parities of the numbers of elements in buckets, as 64-bit words.

    Two to four buckets an element, 256 at least.
    """
    bits = max(256, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 256
    odd = np.bincount((mix64(s + M1) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.concatenate((np.array([len(s)], "<u8"), np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")))


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch at a smaller width."""
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(x: np.ndarray, size: np.ndarray, table: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether size and parities allow a link of one set with each of a table of others."""
    differ = np.bitwise_count(table ^ x).sum(axis=1, dtype=np.int64)
    fits = 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)
    return fits & (differ * (100 + percent) <= (sizes + size) * (100 - percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def sketch_pairs(sketches: list[np.ndarray], group: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members of other groups that it may link to."""
    width = min(map(len, sketches), default=1) - 1
    size = np.array([s[0] for s in sketches], np.int64)
    table = np.array([folded(s[1:], width) for s in sketches])
    for i in range(len(sketches) - 1):
        near = np.flatnonzero((group[i + 1 :] != group[i]) & may_link(table[i], size[i], table[i + 1 :], size[i + 1 :], percent)) + i + 1
        if len(near):
            yield i, near


def _runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows with equal values of a sorted column, one batch per group."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(column).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [b.num_rows]))
        for a, z in itertools.pairwise(starts.tolist()):
            if held and keys[a] != last:
                yield pa.concat_batches(held)
                held = []
            last = keys[a]
            held.append(b.slice(a, z - a))
    if held:
        yield pa.concat_batches(held)


def set_facts(base: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, digest, sketch) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            digests = pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary())
            sketches = pa.array([sketch(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), digests, sketches], ["id", "n_shingles", "digest", "sketch"])

    return map_arrow(base, run, T.StructType([base.schema[0], *T.StructType.fromDDL("n_shingles long, digest binary, sketch binary")]))


#: Low bits of a key that tell batches apart; the rest is the signature.
SALT = 12


def signed(base: DataFrame, n: int, percent: int, skip: dict[bytes, int], most: int = 1 << 20) -> DataFrame:
    """(key, id) of rows (id, text); of a set whose digest is in ``skip`` only the row with that id signs.

    Up to about ``most`` signatures of a task are combined at a time: the smallest id with a signature has it as its
    key, with a salt of 0. If others follow, they and it have it as a key with the batch's salt. So a signature that a
    third of all documents share reaches one key only once for each such batch.
    """

    def combined(ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        sigs &= ~np.uint64((1 << SALT) - 1)
        order = np.lexsort((ids, sigs))
        ids, sigs = ids[order], sigs[order]
        lead = np.concatenate(([True], sigs[1:] != sigs[:-1]))
        again = ~lead & (ids == np.concatenate(([0], ids[:-1])))  # one set, one signature twice
        ids, sigs, lead = ids[~again], sigs[~again], lead[~again]
        met = ~lead | ~np.concatenate((lead[1:], [True]))  # in groups of two or more
        salt = np.uint64(1 + int(mix64(sigs[:1] + ids[:1].view(np.uint64))[0]) % ((1 << SALT) - 1))
        key = np.concatenate((sigs[lead], sigs[met] | salt)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate((ids[lead], ids[met])))], ["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        ids, sigs, held = [], [], 0
        for b in text_slices(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            docs = b.column(0).to_numpy()
            if skip:
                sets = [s if skip.get(hashlib.sha256(s.tobytes()).digest(), doc) == doc else s[:0] for doc, s in zip(docs.tolist(), sets, strict=True)]
            at, found = signatures(sets, bands)
            ids.append(docs[at])
            sigs.append(found)
            held += len(at)
            if held >= most:
                yield combined(np.concatenate(ids), np.concatenate(sigs))
                ids, sigs, held = [], [], 0
        if held:
            yield combined(np.concatenate(ids), np.concatenate(sigs))

    return map_arrow(base, run, "key long, id long")


def _among(rows: DataFrame, wanted: DataFrame, most_mb: float = 4.0) -> DataFrame:
    """Join on ``id`` of many rows with a written list of wanted ids and numbers, which is broadcast up to ``most_mb``."""
    mb = wanted.count() * 8 * (len(wanted.columns) + 1) / 1e6
    return rows.join(F.broadcast(wanted) if mb <= most_mb else wanted, "id")


def with_sets(wanted: DataFrame, base: DataFrame, n: int) -> DataFrame:
    """``wanted`` (id and other columns) with ``elements``, the set of the document's text as bytes."""
    names = [c for c in wanted.columns if c != "id"]
    rows = _among(base, wanted).select("id", *names, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, len(names) + 1):
            found = shingle_sets(b.column(len(names) + 1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([s.tobytes() for s in found], pa.binary())], ["id", *names, "elements"])

    return map_arrow(rows, sets, T.StructType([*rows.schema.fields[:-1], T.StructField("elements", T.BinaryType())]))


def at_pivots(pairs: DataFrame, tell: Callable[[DataFrame], DataFrame], payload: str, test: Callable[[np.ndarray, np.ndarray], bool], kind: str, share: int = 64) -> DataFrame:
    """The pairs (a, b) that pass ``test``; ``a`` is the pivot that several ``b`` share.

    ``tell`` adds ``payload`` to rows with ids. It travels once for each ``b`` and once for each ``share`` partners of
    a pivot: those meet in a place of their own.
    """
    met = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("places"))
    met = met.withColumn("places", F.greatest("places", F.lit(1)))
    partners = pairs.join(met, "a").select(F.col("b").alias("id"), F.col("a").alias("at"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("side"))
    pivots = met.select(F.col("a").alias("id"), F.col("a").alias("at"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("side"))
    told = tell(cut(partners.unionByName(pivots))).select(F.xxhash64("at", "place").alias("spot"), "side", "at", "id", F.col(payload))
    dealt = told.repartition(n_partitions(pairs.sparkSession), "spot").sortWithinPartitions("spot", "at", "side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, x = None, None
        for b in batches:
            left, right = [], []
            for side, at, doc, e in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), b.column(4), strict=True):
                y = np.frombuffer(e.as_buffer(), kind)
                if side == 0:
                    pivot, x = at, y.copy()
                elif pivot == at and test(x, y):
                    left.append(at)
                    right.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return map_arrow(dealt, check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``edges`` (a, b); the component is its smallest id.

    Every round, each id takes the smallest label among its own and its neighbours', and then the label of that label,
    so chains shorten by more than half a round.
    """
    both = cut(edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        # The own label's id is told too (hooking), so that a whole group follows its smallest neighbour.
        told = labels.join(near, labels.id == near.u).select("id", "component", F.least("component", "c").alias("new"))
        hooked = told.groupBy("component").agg(F.min("new").alias("root")).select(F.col("component").alias("old"), "root")
        moved = cut(told.join(hooked, told.component == hooked.old).select("id", "component", F.least("new", "root").alias("new")))
        jump = moved.select(F.col("id").alias("at"), F.col("new").alias("further"))
        labels = moved.join(jump, moved.new == jump["at"], "left").select("id", "component", F.least("new", F.coalesce("further", "new")).alias("now"))
        labels = cut(labels)
        done = labels.where("now <> component").isEmpty()
        labels = labels.select("id", F.col("now").alias("component"))
        if done:
            return labels


def blocks(members: DataFrame, most: int) -> DataFrame:
    """(block, id, group) from (sig, id, group, weight): one block per signature, or, beyond a weight of ``most``, per
    pair of pieces.

    Pieces weigh about ``most / 2``. A group that fills pieces has pieces of its own, which are not paired with each
    other; pieces of all other groups are.
    """
    large = cut(members.groupBy("sig").agg(F.sum("weight").alias("m")).where(F.col("m") > most))
    if large.isEmpty():
        return members.select(F.col("sig").alias("block"), "id", "group")
    half = max(1, most // 2)
    small = members.join(large.select("sig"), "sig", "left_anti").select(F.col("sig").alias("block"), "id", "group")
    rows = members.join(large, "sig")
    owners = rows.groupBy("sig", "group").agg(F.sum("weight").alias("c")).where(F.col("c") > half)
    rows = rows.join(owners, ["sig", "group"], "left")
    owner = F.when(F.col("c").isNotNull(), F.col("group"))
    own, mixed = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / half)), F.pmod(F.xxhash64("group"), F.ceil(F.col("m") / half))
    rows = rows.select("sig", "id", "group", owner.alias("owner"), F.xxhash64("sig", owner, F.coalesce(own, mixed)).alias("piece"))
    rows = cut(rows)
    pieces = rows.select("sig", "piece", "owner").distinct()
    x, y = pieces.select("sig", F.col("piece").alias("p"), F.col("owner").alias("po")), pieces.select(F.col("sig").alias("s2"), F.col("piece").alias("q"), F.col("owner").alias("qo"))
    met = x.join(y, (F.col("sig") == F.col("s2")) & (F.col("p") <= F.col("q"))).where("po is null or qo is null or po <> qo")
    met = met.select("sig", F.xxhash64("sig", "p", "q").alias("block"), F.explode(F.array_distinct(F.array("p", "q"))).alias("piece"))
    return small.unionByName(rows.join(met, ["sig", "piece"]).select("block", "id", "group"))


class Roots:
    """Groups that merge, named by their smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, g: int) -> int:
        up = self.up
        while (h := up.get(g, g)) != g:
            up[g] = up.get(h, h)
            g = h
        return g

    def merge(self, g: int, h: int) -> bool:
        """Whether they were apart."""
        g, h = self.of(g), self.of(h)
        self.up[max(g, h)] = min(g, h)
        return g != h


def between_groups(members: DataFrame, facts: DataFrame, base: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """Links (a, b) that join all groups of (sig, id, group, weight) with a link between members of one signature.

    First the sketches: a task returns, of the pairs in a block that may link, those that connect its members. Members
    so connected form a cluster, of which every member sends its set once, to the cluster's block; there all pairs that
    may link and whose groups are still apart are verified.
    """
    spark = members.sparkSession
    pair = "a long, b long"

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_partitions(spark), "block").sortWithinPartitions("block", "id")

    def tell(left: list[int], right: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            ids, found, roots = b.column(1).to_pylist(), ([], []), Roots()
            for i, others in sketch_pairs([np.frombuffer(x.as_buffer(), "<u8") for x in b.column(3)], b.column(2).to_numpy(), percent):
                for j in others.tolist():
                    if roots.merge(i, j):
                        found[0].append(ids[i])
                        found[1].append(ids[j])
            if found[0]:
                yield tell(*found)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            ids, group, found, roots = b.column(1).to_pylist(), b.column(2).to_numpy(), ([], []), Roots()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(3)]
            for i, others in sketch_pairs([sketch(s) for s in sets], group, percent):
                for j in others.tolist():
                    x, y = int(group[i]), int(group[j])
                    if roots.of(x) != roots.of(y) and linked(sets[i], sets[j], percent):
                        roots.merge(x, y)
                        found[0].append(ids[i])
                        found[1].append(ids[j])
            if found[0]:
                yield tell(*found)

    told = blocks(members, most).join(facts.select("id", "sketch"), "id").select("block", "id", "group", "sketch")
    maybe = cut(map_arrow(dealt(told), near, pair).distinct())
    if maybe.isEmpty():
        return maybe
    clusters = components(maybe).withColumnRenamed("component", "sig")
    clusters = cut(clusters.join(members.select("id", "group", "weight").distinct(), "id").select("sig", "id", "group", "weight"))
    return map_arrow(dealt(with_sets(cut(blocks(clusters, most)), base, n).select("block", "id", "group", "elements")), check, pair)


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, most: int = 2048) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for every document.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links. ``most``
    bounds the members of a block that one task compares.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    base = rows.where("id is not null")
    if not base.groupBy("id").count().where("count > 1").isEmpty():
        base = cut(base.groupBy("id").agg(F.min("text").alias("text")))
    facts = cut(set_facts(base, shingle))
    total = facts.count()
    classes = cut(facts.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    hot = max(1000, 4 * n_partitions(spark))
    # Classes with at least total / 1000 members: at most 1000 rows.
    large = {bytes(r.digest): r.class_id for r in classes.where((F.col("n") > 1) & (F.col("n") * 1000 >= total)).collect()}
    placed = cut(join_hot(facts.where("n_shingles > 0").select("id", "digest"), classes, "digest", "n", total, hot).select("id", "class_id"))

    by_key = W.partitionBy("key").orderBy("id")
    first, more = F.min("id").over(by_key.rowsBetween(W.unboundedPreceding, 0)), F.lead("id").over(by_key).isNotNull()
    marks = signed(base, shingle, percent, large).select(F.shiftright("key", SALT).alias("sig"), "id", first.alias("first"), more.alias("more"))
    # (sig, id, first): who shares a signature, and the smallest id there or in the batch. One id stands for a class.
    copies = placed.where("id <> class_id")
    shared = marks.where("id <> first or more").select("sig", "id", "first").join(copies, "id", "left")
    shared = cut(shared.select("sig", F.coalesce("class_id", "id").alias("id"), "first"))

    # One pivot per set settles most groups.
    tried = shared.where("id <> first").groupBy("id").agg(F.min("first").alias("first"))
    tried = tried.join(copies.withColumnRenamed("id", "first"), "first", "left").select(F.coalesce("class_id", "first").alias("a"), F.col("id").alias("b")).where("a <> b")
    sketches = facts.select("id", "sketch")
    near = at_pivots(cut(tried), lambda ids: _among(sketches, ids), "sketch", lambda x, y: bool(may_link(*_level(x, y), percent)[0]), "<u8")
    links = cut(at_pivots(cut(near), lambda ids: with_sets(ids, base, shingle), "elements", lambda x, y: linked(x, y, percent), "<u8"))

    def grouped(links: DataFrame) -> DataFrame:
        """(id, class_id, group) of all documents with a set."""
        found = components(links).withColumnRenamed("id", "class_id")
        return cut(placed.join(found, "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("group")))

    named = grouped(links)
    # Signatures that still span several groups; of those with the same members, one.
    size = facts.select("id", (1 + F.floor(F.col("n_shingles") / 1000)).alias("weight"))
    spread = shared.select("sig", "id").join(named.where("id = class_id").select("id", "group"), "id").distinct()
    told = spread.groupBy("sig").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
    open_sigs = told.where("lo <> hi").groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    members = cut(spread.join(open_sigs, "sig", "left_semi").join(size, "id").select("sig", "id", "group", "weight"))
    extra = cut(between_groups(members, facts, base, shingle, percent, most))
    if not extra.isEmpty():
        named = grouped(links.unionByName(extra))
    out = facts.select("id", "n_shingles").join(named, "id", "left")
    # Rows without an id have no class and no component; each is a document of its own.
    out = out.unionByName(set_facts(rows.where("id is null"), shingle).select("id", "n_shingles"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("group", "id").alias("component_id"))


def _level(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arguments of :func:`may_link` for two sketches."""
    width = min(len(x), len(y)) - 1
    return folded(x[1:], width), x[:1].astype(np.int64), folded(y[1:], width)[None], y[:1].astype(np.int64)


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with their columns unchanged."""
    groups = similarity_groups(docs, id_col, text_col, shingle, percent)
    gone = cut(groups.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")))
    # The list is broadcast up to 4 MB of ids.
    gone = F.broadcast(gone) if gone.count() * 16 <= 4e6 else gone
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
