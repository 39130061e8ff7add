"""Removal of byte strings that occur twice, by blockwise suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also begins at any
other place of the corpus, overlaps included.

1. *Anchors.* In every stretch of a text the k-gram of least hash is an anchor,
   so equal strings have equal anchors. Anchors are counted over the corpus;
   those met twice or more are marked in a bitmap of fixed size (a false mark
   costs time, nothing else). A string with an anchor of its own is not
   repeated: that leaves few candidates.
2. *Buckets.* Suffixes (candidate strings, by where they begin) fall into the
   bucket of the least k-gram of the whole string; neighbours of a bucket travel
   as one span of bytes. Spans equal as a whole are known to be repeated and
   their bytes are sent once by a task.
3. *Blocks.* A task sorts one block of buckets at a time. Strings are sorted by
   their first and last ``PERIOD`` bytes; a string alone with these is done.
   Long ties are resolved by ranks of a difference-cover sample: for any two
   places some shift below the period takes both to sample places, whose ranks
   (over length - PERIOD bytes, by doubling) were computed before. Only the
   sample, a seventh of the block, is ever ranked.

Matches never cross documents. Null texts are empty; texts shorter than the
string are kept whole; equal rows are each other's repeats and go. Names of
``PERIOD`` bytes are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, mix, slices, spread, text_bytes
from orderflow.llm.jaccard_join import _power_tables, bitmap, marked

LENGTH = 400
GRAM = 32
#: K-grams in the stretch that has an anchor.
STRETCH = 128
PERIOD = 80
SLICE = 4 << 20
BLOCK = 4 << 20
#: Distinct hashes a task remembers.
SEEN = 2_000_000


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place (places too near the end are left out)."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = max(0, len(data) - size + 1)
    return mix((total[size:] - total[:n]) * down[:n]) if n else total[:0]


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    m, done = h, 1
    while 2 * done <= width:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


def _stretches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchor's hash of the stretch from each place; 0 where a text ends before."""
    m = least(h, STRETCH) if len(h) >= STRETCH else h[:0]
    n = np.diff(at) - (STRETCH + GRAM - 2)
    inside = np.zeros(len(m) + 1, np.int32)
    np.add.at(inside, at[:-1][n > 0], 1)
    np.add.at(inside, (at[:-1] + n)[n > 0], -1)
    return np.where(np.cumsum(inside[:-1]) > 0, m, np.uint64(0))


def anchor_hashes(texts: pa.Array) -> np.ndarray:
    """Hashes of all anchors, one for each place that is an anchor."""
    data, at = text_bytes(texts)
    h = gram_hashes(data, GRAM)
    m = _stretches(h, at)
    if not len(m):
        return m
    pad = np.zeros(STRETCH - 1, np.uint64)
    # A place is an anchor if it is the least of a stretch, that is, of the one with the largest least.
    most = ~least(~np.r_[pad, m, pad], STRETCH)
    return h[(most == h) & (most > 0)]


def candidate_spans(data: np.ndarray, at: np.ndarray, repeated: np.ndarray, length: int):
    """(text, first string, strings, bucket) of runs of candidate strings with one bucket."""
    h = gram_hashes(data, GRAM)
    m = _stretches(h, at)
    width, bytes_seen = length - GRAM + 1, STRETCH + GRAM - 1  # k-grams of a string; bytes of a stretch
    size = np.diff(at)
    start = _runs(m)
    stop = np.r_[start[1:], len(m)]
    # A string that holds a whole stretch whose anchor is met once is not repeated.
    alone = (m[start] > 0) & ~marked(repeated, m[start])
    start, stop = start[alone], stop[alone]
    begin = at[np.searchsorted(at, start, side="right") - 1]
    fits = np.zeros(len(data) + 1, np.int32)
    long = size >= length
    np.add.at(fits, at[:-1][long], 1)
    np.add.at(fits, (at[1:] - length + 1)[long], -1)
    shut = np.zeros(len(data) + 1, np.int32)
    np.add.at(shut, np.maximum(start - (length - bytes_seen), begin), 1)
    np.add.at(shut, stop, -1)
    may = (np.cumsum(fits) > 0) & (np.cumsum(shut) == 0)
    edge = np.diff(np.r_[0, may.astype(np.int8), 0])
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
        m = least(h[lo : hi + width], width)
        first = _runs(m)
        # A run of one text again and again may be long; its bucket stays the same.
        sizes = np.diff(np.r_[first, len(m)])
        parts = -(-sizes // length)
        first = np.repeat(first, parts) + length * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.diff(np.r_[first, len(m)])
        out.append((np.full(len(first), np.searchsorted(at, lo, side="right") - 1), lo + first, n, m[first]))
    if not out:
        return None
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def difference_cover(period: int) -> np.ndarray:
    """Residues such that every difference modulo the period occurs; built greedily."""
    cover, have = [0], {0}
    while len(have) < period:
        best = max(range(period), key=lambda r: len({(r - c) % period for c in cover} | {(c - r) % period for c in cover} | have))
        have |= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return np.array(sorted(cover), np.int64)


def _shifts(period: int, cover: np.ndarray) -> np.ndarray:
    """For residues i, j a shift d with i + d and j + d both in the cover."""
    has = np.zeros(period, bool)
    has[cover] = True
    table = np.zeros((period, period), np.int64)
    both = has[(np.arange(period)[:, None] + np.arange(period)[None, :]) % period]  # [residue, shift]
    for i in range(period):
        table[i] = (both[i][None, :] & both).argmax(1)
    return table


COVER = difference_cover(PERIOD)
SHIFT = _shifts(PERIOD, COVER)


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def repeated_strings(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the string from each start is equal to that from another start.

    ``length`` must be a multiple of the period, (length - period) / period a
    power of two; else, and for ties too many for rounds, names of all periods
    of a string are compared instead.
    """
    again = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return again
    name = gram_hashes(text, PERIOD)
    key = mix(name[starts] + np.uint64(0x632BE59BD9B4E019)) ^ name[starts + length - PERIOD]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    edge = np.r_[True, ordered[1:] != ordered[:-1], True]
    tied = ~(edge[:-1] & edge[1:])
    if not tied.any():
        return again
    left = order[tied]  # indices of starts, group by group
    group = (np.cumsum(edge[:-1]) - 1)[tied]
    doublings = ((length - PERIOD) // PERIOD).bit_length() - 1
    if length % PERIOD == 0 and (PERIOD << doublings) == length - PERIOD:
        # Ranks of the cover sample over PERIOD, 2 * PERIOD ... bytes.
        base = np.arange(0, len(text), PERIOD)
        sample = (base[:, None] + COVER[None, :]).ravel()
        sample = sample[sample < len(name)]
        at = np.full(len(text) + PERIOD, -1, np.int64)
        at[sample] = np.arange(len(sample))
        rank, reach = _ranks(name[sample]), PERIOD
        for _ in range(doublings):
            nxt = at[np.minimum(sample + reach, len(text))]
            after = np.where(nxt >= 0, rank[nxt], np.uint64(len(sample)))
            rank, reach = _ranks(rank * np.uint64(len(sample) + 1) + after), 2 * reach
        for _ in range(16):
            first = np.r_[True, group[1:] != group[:-1]]
            lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            p, q = starts[left], starts[lead]
            d = SHIFT[p % PERIOD, q % PERIOD]
            same = rank[at[p + d]] == rank[at[q + d]]
            hit = same & ~first
            again[left[hit]] = True
            again[lead[hit]] = True
            left, group = left[~same], group[~same]
            if len(left):
                size = np.bincount(group - group[0])[group - group[0]]
                left, group = left[size > 1], group[size > 1]
            if not len(left):
                return again
    whole = group.astype(np.uint64)
    for d in [*range(0, length - PERIOD, PERIOD), length - PERIOD]:
        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + name[starts[left] + d])
    _, inverse, count = np.unique(whole, return_inverse=True, return_counts=True)
    # Strings already known to be repeated left with their class, so classes are whole here.
    again[left[count[inverse] > 1]] = True
    return again


def _intervals(rows: dict, length: int):
    """Covered intervals of a block's spans: (row, start, end)."""
    span, have = rows["span"], rows["bytes"]
    order = np.argsort(span, kind="stable")
    new = _runs(span[order])
    which = np.empty(len(span), np.int64)
    which[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(span)]))
    count = np.bincount(which)
    body: list = [None] * len(new)
    for w, b in zip(which.tolist(), have, strict=True):
        if b is not None and body[w] is None:
            body[w] = b
    text = np.frombuffer(b"".join(body), np.uint8)
    size = np.array([len(b) for b in body], np.int64)
    offset, strings = np.cumsum(size) - size, size - length + 1
    starts = spread(offset, strings)
    again = repeated_strings(text, starts, length) if (count == 1).any() else np.zeros(len(starts), bool)
    again |= np.repeat(count > 1, strings)
    edge = np.diff(np.r_[0, again.astype(np.int8), 0])
    # Runs of repeated strings; spans are apart in ``starts``, so cut there too.
    first_of_span = np.zeros(len(starts) + 1, bool)
    first_of_span[np.cumsum(strings) - strings] = True
    inner = np.flatnonzero(first_of_span[1:-1] & again[:-1] & again[1:]) + 1
    lo = np.sort(np.r_[np.flatnonzero(edge == 1), inner])
    hi = np.sort(np.r_[np.flatnonzero(edge == -1), inner])
    owner = np.searchsorted(np.cumsum(strings), lo, side="right")
    lo, hi = lo - (np.cumsum(strings) - strings)[owner], hi - (np.cumsum(strings) - strings)[owner]
    by_span = np.searchsorted(owner, np.arange(len(new) + 1))
    n = np.diff(by_span)[which]
    pick = spread(by_span[which], n)
    row = np.repeat(np.arange(len(span)), n)
    return row, rows["start"][row] + lo[pick], rows["start"][row] + hi[pick] + length - 1


class _Dedup:
    def __init__(self, docs: DataFrame, key: str, text: str, length: int, carry: tuple[str, ...] = ()):
        self.spark, self.length = docs.sparkSession, length
        self.scratch = Scratch(self.spark, "suffixes")
        value = F.coalesce(docs[text].cast("string"), F.lit(""))
        # A row is known by its id and a hash of its text: rows equal in both fare alike.
        more = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
        self.texts = docs.select(docs[key].cast("long").alias("id"), value.alias("text"), F.xxhash64(value).alias("hash"), *more)
        self.carry = [f"_c{i}" for i in range(len(carry))]
        self.long = self.texts.filter(F.octet_length("text") >= length)

    def repeated(self) -> np.ndarray:
        """The bitmap of anchors that the corpus has twice or more."""

        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    value, n = np.unique(anchor_hashes(part.column("text")), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

        counts = self.long.select("text").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))
        return bitmap(counts.filter("n > 1"), "anchor")

    def spans(self, repeated: np.ndarray) -> DataFrame:
        length, shared = self.length, self.spark.sparkContext.broadcast(repeated)
        names = ["bucket", "span", "id", "hash", "start", "bytes"]

        def run(batches):
            sent: set = set()
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    data, at = text_bytes(part.column("text"))
                    found = candidate_spans(data, at, shared.value, length)
                    if found is None:
                        continue
                    doc, first, n, bucket = found
                    stop = first + n + length - 1
                    up, down = _power_tables(len(data) + 1)
                    total = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
                    span = mix(mix((total[stop] - total[first]) * down[first]) + n.astype(np.uint64) + bucket)
                    raw, bodies = data.tobytes(), []
                    if len(sent) > SEEN:
                        sent = set()
                    for s, a, b in zip(span.tolist(), first.tolist(), stop.tolist(), strict=True):
                        bodies.append(None if s in sent else raw[a:b])
                        sent.add(s)
                    take = pa.array(doc)
                    for a in range(0, len(doc), 8192):
                        c = slice(a, a + 8192)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(bucket[c].view(np.int64)), pa.array(span[c].view(np.int64)), part.column("id").take(take[c]), part.column("hash").take(take[c]),
                             pa.array(first[c] - at[doc[c]]), pa.array(bodies[c], pa.binary())],
                            names,
                        )

        return self.long.select("id", "text", "hash").mapInArrow(run, "bucket long, span long, id long, hash long, start long, bytes binary")

    def covered(self, spans: DataFrame) -> DataFrame:
        length = self.length
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = spans.repartition(n, "bucket").sortWithinPartitions("bucket")

        def done(batches):
            table = pa.Table.from_batches(batches).combine_chunks()
            rows = {c: table.column(c).to_numpy() for c in ("span", "start")} | {"bytes": table.column("bytes").to_pylist()}
            row, start, end = _intervals(rows, length)
            take = pa.array(row)
            out = pa.Table.from_arrays([table.column("id").take(take), table.column("hash").take(take), pa.array(start), pa.array(end)], ["id", "hash", "start", "end"])
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

        def run(batches):
            held, size = [], 0
            for batch in batches:
                bucket = batch.column("bucket").to_numpy()
                weights = np.cumsum(pc.fill_null(pc.binary_length(batch.column("bytes")), 64).to_numpy(zero_copy_only=False))
                cuts = np.r_[_runs(bucket), len(bucket)]
                last = 0
                # Blocks end where a bucket does; what a batch ends with may go on.
                for a in cuts[:-1].tolist():
                    if held and a == 0 and held[-1].column("bucket")[-1].as_py() == bucket[0]:
                        continue
                    here = size + (int(weights[a - 1]) if a else 0) - (int(weights[last - 1]) if last else 0)
                    if here > BLOCK and (a > last or held):
                        yield from done([*held, batch.slice(last, a - last)])
                        held, size, last = [], 0, a
                held.append(batch.slice(last))
                size += int(weights[-1]) - (int(weights[last - 1]) if last else 0) if len(weights) else 0
            if held:
                yield from done(held)

        return dealt.mapInArrow(run, "id long, hash long, start long, end long")

    def result(self, with_text: bool) -> DataFrame:
        covered = self.covered(self.spans(self.repeated()))
        lists = covered.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("cut")).withColumnsRenamed({"id": "cut_id", "hash": "cut_hash"})
        rows = self.texts.join(lists, self.texts.id.eqNullSafe(F.col("cut_id")) & (F.col("hash") == F.col("cut_hash")), "left").select("id", "text", "cut", *self.carry)
        last, carry = ("kept" if with_text else "kept_sha256"), self.carry
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

        def run(batches):
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    data, at = text_bytes(part.column("text"))
                    raw = data.tobytes()
                    cuts = part.column("cut").to_pylist()
                    columns: list[list] = [[], [], [], []]
                    for a, b, cut in zip(at.tolist(), at[1:].tolist(), cuts, strict=False):
                        own = raw[a:b]
                        keep, removed, n = own, 0, 0
                        if cut:
                            parts, done = [], 0
                            for s, e in _merged(cut):
                                parts.append(own[done:s])
                                removed, n, done = removed + e - s, n + 1, e
                            keep = b"".join([*parts, own[done:]])
                        value = keep.decode("utf-8", "ignore") if with_text else hashlib.sha256(keep).hexdigest()
                        for c, v in zip(columns, (b - a, removed, n, value), strict=True):
                            c.append(v)
                    arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
                    extra = [part.column(c) for c in carry]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *arrays, *extra], ["id", "n_bytes", "n_removed", "n_spans", last, *carry])

        more = "".join(f", {c} {kinds[c]}" for c in carry)
        return rows.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, {last} string{more}")


def _merged(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((c["start"], c["end"]) for c in cut):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_text: bool = True, carry: tuple[str, ...] = ()
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, the kept text (or its SHA-256) and the columns in ``carry``.

    A kept text drops the halves of characters that a removed string cuts; the
    SHA-256 is over the remaining bytes as they are.
    """
    found = _Dedup(docs, key, text, length, carry).result(with_text)
    return found.withColumnsRenamed({"id": key} | {f"_c{i}": c for i, c in enumerate(carry)})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)
