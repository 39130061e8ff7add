"""Similarity join of documents on word shingles, exact, and its components.

A document's set are the distinct hashes (64 bits) of its shingles of five
words; two documents link when the Jaccard similarity of their sets reaches the
threshold. Only components are computed: every link counts for them, but links
within what is already one component are not looked for, so neither pairs nor
the number of links can be had. Links are found in these steps:

1. *Order.* Any order of shingles will do for prefix filtering, as long as all
   documents share it: here frequent ones last, then by hash. Frequent are
   those that a task meets three times among its documents; they are marked in
   a bitmap of fixed size. A false mark costs time, never a link.
2. *Postings.* Linked sets share one of the first n - ceil(t * n) + 1 shingles
   of each, so only those are posted. A key's postings, sorted by size, form
   tiles by size band.
3. *Leaders.* The first of a tile leads its postings, and each document is
   paired with the leader it shares most keys with: a pair for a document, also
   where thousands of near copies share every shingle. Verified pairs give first
   components. Only keys whose postings lie in several components can hide a
   link that matters; in these the document that shares most shingles with
   others leads next (the original among edited copies), again one for each.
   A key with several components has a posting in another one than its first:
   such keys are marked in a bitmap of fixed size, the other postings stay where
   they are. A false mark costs time, never a link. Of keys with the same
   postings (a passage has many) only the first in the order goes on: it comes
   first in each of these documents, and a pair counts at its first common key.
4. *The rest.* What is still open is compared across components, sizes
   permitting. Two sets have no common shingle before their first, so its places
   in both bound the overlap from above; a pair that this key cannot prove open
   is left to the key of its first common shingle. Keys of few postings pair
   them at once; postings of the others carry hashed bitmap signatures, bound the
   overlap by bit counts too and are compared tile by tile.
5. *Verification.* Sizes and the bit counts of small signatures, kept with the
   sets, leave few pairs; only their texts are read again and sent, and their
   sorted arrays are intersected.

Copies of a set within a task are posted once; all copies get the class of
their set. Null texts, and texts without words, have an empty set and link with
nothing. Rows without an id link with nothing and get a null component; rows
that share an id count as one document. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, mix, slices, text_bytes
from orderflow.llm.components import components

WORDS = 5
THRESHOLD = (75, 100)
#: Bits of the bitmaps of frequent shingles and of candidate documents: 8 MB each.
BITMAP_BITS = 26
#: Occurrences in a task that make a shingle frequent, and hashes looked at together.
FREQUENT, WINDOW = 3, 2_000_000
#: Bytes of text hashed together.
SLICE = 1 << 20
#: Documents compared with their leader by one task, about.
FAN = 2_000
#: Rows of a key held at a time, and rows of a tile's side.
HELD, TILE = 500_000, 1024
#: Postings of a key up to which they are paired without signatures.
FEW = 32

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = -(-n // (1 << 18)) << 18
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def drop_power_tables() -> None:
    """Forget the tables, which have the size of the largest slice; they are made anew when needed."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and where each text's begin."""
    data, at = text_bytes(texts)
    inside = ~_SPACE[data]
    edges = at[1:-1][(at[1:-1] < len(data)) & (at[1:-1] > 0)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.searchsorted(start, at)


def _combine(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(first), n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[first + k])
    return h


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    h = _combine(words, np.arange(max(0, len(words) - size + 1)), size)
    out = []
    for i, (a, count) in enumerate(zip(at.tolist(), n.tolist(), strict=False)):
        if count >= size:
            s = np.sort(h[a : a + count - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(_combine(words, np.array([a]), count) if count else words[:0])
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mix(s * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(s))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signature(s: np.ndarray, spread: int = 2) -> np.ndarray:
    """A bitmap of ``spread`` times the set's size or more, bits from the low bits of the hashes."""
    bits = 64
    while bits < spread * len(s):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out)


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(sig.reshape(-1, size), axis=0) if len(sig) > size else sig


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """At most so many elements are common: a bit that only one side has costs it one."""
    size = min(len(a), len(b))
    a, b = _fold(a, size), _fold(b, size)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def bitmap(df: DataFrame, hashes: str) -> np.ndarray:
    """Bitmap (packed, BITMAP_BITS) over the upper bits of a column of 64-bit hashes."""
    place = F.shiftrightunsigned(F.col(hashes), 64 - BITMAP_BITS)
    rows = df.groupBy(F.expr(f"bitmap_bucket_number(shiftrightunsigned({hashes}, {64 - BITMAP_BITS}))").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    # Positions are 0-based; bucket k (from 1) holds positions (k - 1) * 32768 + 1 ... k * 32768, bucket 0 position 0 and below.
    out = np.zeros((1 << BITMAP_BITS) // 8 + 4096, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["k"] - 1) * 4096 if r["k"] else len(out) - 4096
        out[at : at + 4096] |= part
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has these hashes (uint64)."""
    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) - 1
    place[place < 0] = 8 * (len(bits) - 4096)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def prefix(s: np.ndarray, frequent: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    """The first n - ceil(t * n) + 1 shingles in the common order: frequent ones last."""
    n, (num, den) = len(s), threshold
    if n == 0:
        return s
    size = n - -(-num * n // den) + 1
    late = marked(frequent, s)
    return np.concatenate([s[~late], s[late]])[:size]


def _compatible(a: np.ndarray, b: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    num, den = threshold
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)  # products of int32 sizes pass 32 bits
    return den * np.minimum(a, b) >= num * np.maximum(a, b)


def _bands(n: np.ndarray, threshold=THRESHOLD) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(threshold[1] / threshold[0])).astype(np.int64)


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, size: int, threshold: tuple[int, int]):
        self.spark, self.size, self.threshold = docs.sparkSession, size, threshold
        self.texts = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
        self.scratch = Scratch(self.spark, "jaccard")

    def sets(self) -> tuple[DataFrame, np.ndarray]:
        """Size and digest of every document's set; the bitmap of frequent shingles."""
        size = self.size

        def run(batches):
            seen, held, n = set(), [], 0
            names = ["id", "n", "d1", "d2", "sig", "frequent"]

            def frequent():
                h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
                k = FREQUENT - 1
                again = h[k:][h[k:] == h[:-k]] if len(h) > k else h[:0]
                again = np.unique(again).view(np.int64)
                for a in range(0, len(again), 100_000):
                    part = pa.array(again[a : a + 100_000])
                    empty = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(len(part), pa.binary()), part], names)

            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    sets = shingle_sets(part.column("text"), size)
                    digests = [set_digest(s) for s in sets]
                    for s, d in zip(sets, digests, strict=True):
                        if d not in seen:
                            seen.add(d)
                            held.append(s)
                            n += len(s)
                    columns = [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*digests, strict=True))]
                    sigs = pa.array([signature(s).tobytes() for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns, sigs, pa.nulls(part.num_rows, pa.int64())], names)
                    if n > WINDOW:
                        yield from frequent()
                        seen, held, n = set(), [], 0
            yield from frequent()

        both = self.scratch.keep(self.texts.mapInArrow(run, "id long, n long, d1 long, d2 long, sig binary, frequent long"), "sets")
        self.signatures = self.scratch.keep(both.filter("n > 0 AND id IS NOT NULL").select("id", "n", "sig").distinct(), "signatures")
        return both.filter("n IS NOT NULL").drop("frequent", "sig"), bitmap(both.filter("frequent IS NOT NULL"), "frequent")

    def postings(self, frequent: np.ndarray) -> DataFrame:
        size, threshold, bits = self.size, self.threshold, self.spark.sparkContext.broadcast(frequent)

        def run(batches):
            seen: set = set()
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, sets = part.column("id").to_numpy(), shingle_sets(part.column("text"), size)
                    keys, docs, sizes, places = [], [], [], []
                    if len(seen) > WINDOW:
                        seen = set()
                    for i, s in zip(ids, sets, strict=True):
                        if len(s) == 0 or (d := set_digest(s)) in seen:
                            continue
                        seen.add(d)
                        p = prefix(s, bits.value, threshold)
                        keys.append(p)
                        docs.append(np.full(len(p), i))
                        sizes.append(np.full(len(p), len(s), np.int32))
                        places.append(np.arange(len(p), dtype=np.int32))
                    if keys:
                        arrays = [np.concatenate(keys).view(np.int64), *(np.concatenate(x) for x in (docs, sizes, places))]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "id", "n", "place"])

        return self.texts.filter("id IS NOT NULL").mapInArrow(run, "key long, id long, n int, place int")

    def led(self, postings: DataFrame, several=None) -> DataFrame:
        """Postings of keys with several, with the leader (first) of their tile and the first of their key.

        The first posting of a key has a digest of all its key's. Of documents
        that ``several`` marks, which have other texts too, no two lists count as equal.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = postings.repartition(n, "key").sortWithinPartitions("key", "n", "id")
        threshold = self.threshold

        def rows(key, ids, n, place, state, more):
            band = _bands(n, threshold)
            new = np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])]
            lead = ids[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if state and state[0] == key[0] and state[1] == band[0]:
                same = np.cumsum(new) == 1
                lead[same] = state[2]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.repeat(np.diff(np.r_[starts, len(key)]), np.diff(np.r_[starts, len(key)]))
            first = np.repeat(ids[starts], np.diff(np.r_[starts, len(key)]))
            own = mix(mix(ids.view(np.uint64)) + n.astype(np.uint64))
            digest = np.add.reduceat(own, starts)
            whole = np.add.reduceat(marked(several.value, mix(ids.view(np.uint64))), starts) == 0 if several else np.ones(len(starts), bool)
            whole[-1] &= not more  # a key that goes on is like no other
            if state and state[0] == key[0]:
                whole[0] = False
            digest = np.where(whole, digest, mix(key[starts].view(np.uint64)))
            some = count > 1
            if state and state[0] == key[0]:
                some |= key == key[0]
                first[key == key[0]] = state[3]
            lists = pa.array(np.repeat(digest, np.diff(np.r_[starts, len(key)])).view(np.int64), mask=~np.isin(np.arange(len(key)), starts))
            arrays = [pa.array(x[some]) for x in (key, ids, n, place, lead, first, count)] + [lists.filter(pa.array(some))]
            return pa.RecordBatch.from_arrays(arrays, ["key", "id", "n", "place", "lead", "first", "m", "list"]), (key[-1], band[-1], lead[-1], first[-1])

        def run(batches):
            held, state = None, None
            for batch in batches:
                now = [batch.column(c).to_numpy() for c in ("key", "id", "n", "place")]
                if not len(now[0]):
                    continue
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                if more := len(held[0]) - cut > HELD:
                    cut = len(held[0])
                if cut:
                    out, state = rows(*(x[:cut] for x in held), state, more)
                    yield out
                    held = [x[cut:] for x in held] if cut < len(held[0]) else None
            if held is not None and len(held[0]):
                yield rows(*held, state, False)[0]

        return self.scratch.keep(dealt.mapInArrow(run, "key long, id long, n int, place int, lead long, first long, m long, list long"), "led")

    def listed(self, led: DataFrame) -> DataFrame:
        """Of keys with equal lists of postings only the first in the common order, and some others.

        It is the first of these keys in every document of the list, so no pair
        meets first at another of them.
        """
        keys = led.filter("list IS NOT NULL").groupBy("first", "list", "m").agg(F.min(F.struct("place", "key")).alias("top"))
        shared = self.marks(keys.select(F.col("top.key").alias("id")))

        def run(batches):
            for batch in batches:
                yield _marked_rows(batch, shared.value, ["key", "id", "n", "place", "first", "m"])

        kind = "key long, id long, n int, place int, first long, m long"
        rows = led.select("key", "id", "n", "place", "first", "m", F.xxhash64("key").alias("h"))
        return self.scratch.keep(rows.mapInArrow(run, kind), "listed")

    def marks(self, ids: DataFrame):
        """A bitmap of fixed size of these ids, for the tasks."""
        return self.spark.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("h")), "h"))

    @property
    def hashed(self) -> DataFrame:
        return self.texts.filter("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("h"))

    def wanted(self, ids: DataFrame) -> DataFrame:
        """id and text of documents with these ids, and of some others (where the bitmap errs)."""
        shared = self.marks(ids)

        def run(batches):
            for batch in batches:
                yield _marked_rows(batch, shared.value)

        return self.hashed.mapInArrow(run, "id long, text string")

    def signed(self, ids: DataFrame) -> DataFrame:
        """id, size and signature of each set of these documents, and of some others."""
        shared = self.marks(ids)

        def run(batches):
            for batch in batches:
                yield _marked_rows(batch, shared.value, ["id", "n", "sig"])

        rows = self.signatures.select("id", "n", "sig", F.xxhash64("id").alias("h"))
        return rows.mapInArrow(run, "id long, n long, sig binary")

    def dealt(self, pairs: DataFrame, side: DataFrame) -> DataFrame:
        """What the side table has of the documents of pairs, those of a leader after its own."""
        fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
        # A leader of very many goes to several tasks, each with a part of them.
        led = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("part"), F.col("b").alias("id"))
        leads = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.col("a").alias("id"))
        rows = led.union(leads).join(side, "id").withColumn("member", F.col("id") != F.col("a"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", "member", "id")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those pairs that sizes and bit counts permit: signatures travel, not texts."""
        threshold = self.threshold

        def run(batches):
            lead, own = None, []
            for batch in batches:
                out = []
                for a, i, n, sig in zip(*(batch.column(c).to_pylist() for c in ("a", "id", "n", "sig")), strict=True):
                    bits = np.frombuffer(sig, np.uint8)
                    if a == i:
                        own = own if lead == a else []
                        lead = a
                        own.append((bits, n))
                    elif lead == a and any(_may_link(x, bits, m, n, threshold) for x, m in own):
                        out.append((a, i))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        return self.dealt(pairs, self.signed(ids)).mapInArrow(run, "a long, b long").distinct()

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs (a, b) whose documents link; a leads, and its set is met before those of all its b."""
        asked = self.scratch.keep(pairs.select("a", "b").filter("a <> b").distinct(), f"{name}-asked")
        pairs = self.scratch.keep(self.near(asked), f"{name}-pairs")
        self.scratch.drop(f"{name}-asked")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        dealt = self.dealt(pairs, self.wanted(ids))
        size, threshold = self.size, self.threshold

        def run(batches):
            lead, own = None, []  # the leader and the set and signature of each of its texts
            for batch in batches:
                for piece in slices(batch, "text", SLICE):
                    out = []
                    columns = [piece.column(c).to_pylist() for c in ("a", "id")]
                    for a, i, s in zip(*columns, shingle_sets(piece.column("text"), size), strict=True):
                        if a == i:
                            own = own if lead == a else []
                            lead = a
                            if len(s):
                                own.append((s, signature(s)))
                        elif lead == a and len(s) and any(_linked(x, bits, s, threshold) for x, bits in own):
                            out.append((a, i))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

        found = self.scratch.keep(dealt.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")
        self.scratch.drop(f"{name}-pairs")
        return found

    def parted(self, led: DataFrame, labels: DataFrame) -> DataFrame:
        """Postings of keys that may lie in several components: all that do, and some others."""
        pairs = self.scratch.keep(led.select("first", "id").filter("first <> id").distinct(), "firsts")
        one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("first", "id"))
        apart = pairs.join(one, "first", "left").join(two, "id", "left")
        apart = apart.filter(F.coalesce("first_label", "first") != F.coalesce("id_label", "id"))
        context = self.spark.sparkContext
        shared = context.broadcast(bitmap(apart.select(F.xxhash64("first", "id").alias("h")), "h"))

        def only(bits):
            def run(batches):
                for batch in batches:
                    h = batch.column("h").to_numpy().view(np.uint64)
                    yield batch.drop_columns(["h"]).filter(pa.array(marked(bits.value, h)))

            return run

        found = led.select("key", F.xxhash64("first", "id").alias("h")).mapInArrow(only(shared), "key long")
        keys = context.broadcast(bitmap(found.select(F.xxhash64("key").alias("h")), "h"))
        rows = led.select("key", "id", "n", "place", "m", F.xxhash64("key").alias("h"))
        return rows.mapInArrow(only(keys), "key long, id long, n int, place int, m long")

    def opened(self, rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """Postings of keys that lie in several components, with the component."""
        label = F.coalesce(F.col("label"), F.col("id"))
        columns = ["key", "id", "n", "place", "m"]
        own = rows.select(columns).join(labels, rows.id == labels.node, "left").select(*columns, label.alias("label"))
        own = self.scratch.keep(own, f"{name}-all")
        keys = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        found = self.scratch.keep(own.join(keys, "key"), name)
        self.scratch.drop(f"{name}-all")
        return found

    def under(self, rows: DataFrame, weight: Column) -> DataFrame:
        """Pairs of each posting with the document of most weight of its key, across components."""
        weights = rows.groupBy("id").agg(weight.alias("w"))
        top = rows.join(weights, "id").groupBy("key").agg(F.max(F.struct("w", "id", "n", "label")).alias("top"))
        num, den = self.threshold
        small, large = F.least("n", "top.n"), F.greatest("n", "top.n")
        pairs = rows.join(top, "key").filter((F.col("label") != F.col("top.label")) & (den * small >= num * large))
        return best_led(pairs.select(F.col("top.id").alias("a"), F.col("id").alias("b")))

    def across(self, rows: DataFrame) -> DataFrame:
        """Pairs of open postings in different components that sizes, places and bit counts permit."""
        threshold = self.threshold
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = ["key", "id", "n", "place", "label"]
        many = self.scratch.keep(rows.groupBy("key").count().filter(F.col("count") > FEW).select("key"), "many")
        few = rows.join(many, "key", "left_anti").select(columns).repartition(n, "key").sortWithinPartitions("key", "n", "id")
        large = rows.join(many, "key").select(columns)
        # Of an id with several texts, a posting meets the signatures of all that have its size, its own among them.
        sigs = self.signed(large.select("id").distinct())
        tiled = large.join(sigs, ["id", "n"]).select(*columns, "sig").repartition(n, "key").sortWithinPartitions("key", "n", "id")

        def run(names, compare):
            def pairs(batches):
                out, count = [], 0
                for group in _whole_keys(batches, names):
                    for found in compare(group, threshold):
                        out.append(found)
                        count += len(found)
                        if count > HELD:
                            yield _pairs(out)
                            out, count = [], 0
                if out:
                    yield _pairs(out)

            return pairs

        kind = "a long, b long"
        return few.mapInArrow(run(columns, _paired), kind).union(tiled.mapInArrow(run([*columns, "sig"], _groups), kind))

    def several(self, sets: DataFrame):
        """A bitmap of the documents that have more than one set, if there are any."""
        known = sets.filter("id IS NOT NULL").groupBy("id").agg(*[f(c) for c in ("d1", "d2") for f in (F.min, F.max)])
        ids = known.filter("`min(d1)` <> `max(d1)` OR `min(d2)` <> `max(d2)`").select("id")

        def mixed(batches):
            for batch in batches:
                h = mix(batch.column("id").to_numpy().view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

        bits = bitmap(ids.mapInArrow(mixed, "h long"), "h")
        return self.spark.sparkContext.broadcast(bits) if bits.any() else None

    def result(self) -> DataFrame:
        sets, frequent = self.sets()
        led = self.led(self.postings(frequent), self.several(sets))
        first = self.verified(best_led(led.select(F.col("lead").alias("a"), F.col("id").alias("b"))), "first")
        labels = components(first, self.scratch, "early-first", rounds=2)
        lists = self.listed(led)
        self.scratch.drop("led")
        rows = self.opened(self.parted(lists, labels), labels, "shared")
        self.scratch.drop("listed")
        links = self.scratch.keep(first.union(self.verified(self.under(rows, F.sum("m")), "by-shared")), "links")
        labels = components(links, self.scratch, "early-shared", rounds=2)
        rows = self.opened(rows, labels, "open")
        self.scratch.drop("shared")
        links = links.union(self.verified(self.across(rows), "rest"))
        # Documents of one set form a class; its smallest id stands for it.
        known = sets.filter("id IS NOT NULL AND n > 0")
        classes = known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
        member = self.scratch.keep(known.join(classes, ["d1", "d2", "n"]).select("id", "rep"), "member")
        same = member.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        final = components(links.union(same), self.scratch, "final")
        return sets.join(final, sets.id == final.node, "left").select("id", "n", F.coalesce("label", "id").alias("component_id"))


def best_led(pairs: DataFrame) -> DataFrame:
    """For each b the leader a it is paired with most often, the smallest of several."""
    counts = pairs.filter("a <> b").groupBy("a", "b").count()
    top = counts.groupBy("b").agg(F.min(F.struct(-F.col("count"), "a")).alias("top"))
    return top.select("top.a", "b")


def _reaches(common: np.ndarray, sizes: np.ndarray, threshold) -> np.ndarray:
    num, den = threshold
    return den * common >= num * (sizes - common)


def _linked(a: np.ndarray, bits: np.ndarray, b: np.ndarray, threshold) -> bool:
    """Sizes, then bit counts, then the intersection itself."""
    if not _may_link(bits, signature(b), len(a), len(b), threshold):
        return False
    return bool(_reaches(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b), threshold))


def _may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold) -> bool:
    """Whether sizes and signatures permit a link."""
    return bool(_compatible(n_a, n_b, threshold)) and bool(_reaches(overlap_bound(a, b, n_a, n_b), n_a + n_b, threshold))


def _marked_rows(batch: pa.RecordBatch, bits: np.ndarray, columns=("id", "text")) -> pa.RecordBatch:
    h = batch.column("h").to_numpy().view(np.uint64)
    return batch.select(list(columns)).filter(pa.array(marked(bits, h)))


def _words(sigs: list[bytes], size: int) -> np.ndarray:
    """Signatures folded to ``size`` bytes, a row for each."""
    return np.stack([_fold(np.frombuffer(x, np.uint8), size) for x in sigs]).view(np.uint64)


def _whole_keys(batches, names):
    """Columns of batches sorted by their first, so that no key goes on in the next."""
    held: list = []  # rows of one key
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if held and (cut or held[0][0][0] != now[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)]
            held = []
        elif cut:
            yield [x[:cut] for x in now]
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _placed(n_a, place_a, n_b, place_b, threshold) -> np.ndarray:
    """Whether sets can reach the threshold if their first common shingle has these places."""
    n_a, n_b = np.asarray(n_a, np.int64), np.asarray(n_b, np.int64)
    return _reaches(np.minimum(n_a - place_a, n_b - place_b), n_a + n_b, threshold)


def _paired(columns, threshold):
    """All pairs of each key that sizes and places permit."""
    key, ids, n, place, label = columns
    for far in range(1, len(key)):
        x = np.flatnonzero(key[far:] == key[:-far])
        if not len(x):
            break
        y = x + far
        fits = _compatible(n[x], n[y], threshold) & (label[x] != label[y]) & _placed(n[x], place[x], n[y], place[y], threshold)
        yield np.c_[ids[x[fits]], ids[y[fits]]]


def _tiles(ids, n, place, label, sig, threshold):
    """Each tile of a key against itself and those after it, while sizes permit."""
    width = np.array([len(x) for x in sig])
    for i in range(0, len(ids), TILE):
        a = slice(i, i + TILE)
        for j in range(i, len(ids), TILE):
            if not _compatible(n[a][-1], n[j], threshold):
                break
            b = slice(j, j + TILE)
            fits = _compatible(n[a][:, None], n[b][None, :], threshold) & (label[a][:, None] != label[b][None, :])
            fits &= _placed(n[a][:, None], place[a][:, None], n[b][None, :], place[b][None, :], threshold)
            if i == j:
                fits = np.triu(fits, 1)
            x, y = np.nonzero(fits)
            size = int(min(width[a].min(), width[b].min()))
            first, second = _words(sig[a], size), _words(sig[b], size)
            for c in range(0, len(x), HELD):
                p, q = x[c : c + HELD], y[c : c + HELD]
                only_a = np.bitwise_count(first[p] & ~second[q]).sum(1, dtype=np.int64)
                only_b = np.bitwise_count(second[q] & ~first[p]).sum(1, dtype=np.int64)
                most = np.minimum(n[a][p] - only_a, n[b][q] - only_b)
                may = _reaches(most, n[a][p].astype(np.int64) + n[b][q], threshold)
                yield np.c_[ids[a][p[may]], ids[b][q[may]]]


def _groups(columns, threshold):
    key, *rest = columns
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            yield from _tiles(*(x[a:b] for x in rest), threshold)


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.sort(np.concatenate(out), axis=1)
    ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
    ab = ab[np.r_[True, (ab[1:] != ab[:-1]).any(1)]] if len(ab) else ab
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """key, n_shingles and component_id (smallest id reachable by links) of each row."""
    found = _Join(docs, key, text, size, threshold).result()
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def first_of_component(found: DataFrame, key: str = "doc_id") -> Column:
    """Whether a row of ``jaccard_components`` is the one that stays."""
    return found[key].isNull() | (found[key] == found["component_id"])


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
