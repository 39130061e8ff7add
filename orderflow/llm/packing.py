"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best fit. Documents are taken by falling length, gaps by
rising size. A sweep gives every document of a length its successor among the
gaps, the smallest that holds it; documents that want the same gaps are told
apart by rank, one to a gap; the gaps shrink, and the sweep repeats until the
length is placed.

Lengths and gaps are whole numbers of at most ``seq_len``, so both sorted lists
are kept as counts by length: what one length's documents do in a sweep is one
step over a run of equal gaps, whatever the size of the corpus. The steps (at
most 2 * seq_len**2, commonly a few for each length) go to the tasks, where
every document finds its own by its length and rank. Ranks come from counts by
task and length and their prefix sums; no length is ever gathered.

A document longer than a sequence is cut into pieces of ``seq_len`` tokens of
which the first may be shorter; others are never cut. Null texts are empty
(a document then holds the end id alone). Repeated rows are packed each for
itself.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, slices
from orderflow.llm.pieces import encoder

_ROW = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long"


def plan(counts: dict[int, int], seq_len: int) -> tuple[np.ndarray, int]:
    """Steps (length, first rank, first sequence, offset, documents) and the sequences used."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, number)
    sizes: list[int] = []  # the sizes above, rising
    steps, used = [], 0

    def add(size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):  # no gap holds it: as many new sequences as these documents need
                n = -(-left // (seq_len // length))
                add(seq_len, used, n)
                used += n
                continue
            size = sizes[i]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(i)
            take = min(n, left)
            steps.append((length, rank, first, seq_len - size, take))
            add(size, first + take, n - take)
            add(size - length, first, take)
            rank, left = rank + take, left - take
    return np.array(steps, np.int64).reshape(-1, 5), used


def _cut(ids: np.ndarray, at: np.ndarray, seq_len: int):
    """Pieces of the documents that lie in ``ids``: document, piece, start, length."""
    size = np.diff(at)
    n = -(-size // seq_len)
    doc = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    short = size - (n - 1) * seq_len  # of the first piece
    start = np.where(piece == 0, 0, short[doc] + (piece - 1) * seq_len)
    return doc, piece, start, np.where(piece == 0, short[doc], seq_len)


def pieces_of(docs: DataFrame, tokenizer_file: str, end_id: int, seq_len: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its place among its task's pieces of that length."""
    narrow = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        encode, task = encoder(tokenizer_file), TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                at, ids = encode.encode(part.column("text"))
                ids, at = np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
                doc, piece, start, length = _cut(ids, at, seq_len)
                first = at[doc] + start
                raw, ends = ids.tobytes(), (first + length).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends, strict=True)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                place = np.empty(len(length), np.int64)
                place[order] = np.arange(len(length)) - np.repeat(new, np.diff(np.r_[new, len(length)])) + seen[ordered]
                seen += np.bincount(length, minlength=seq_len + 1)
                columns = [part.column("key").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(first.tolist(), ends, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(run, _ROW + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, seq_len: int) -> DataFrame:
    """Add sequence_id and offset to stored rows of ``pieces_of``."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    steps, _ = plan(totals, seq_len)
    shared = spark.sparkContext.broadcast(steps)
    columns = [c for c in pieces.columns if c not in ("task", "place")]
    ranked = pieces.join(ranks, ["length", "task"]).select(*columns, (F.col("before") + F.col("place")).alias("rank"))

    def run(batches):
        s = shared.value
        order = np.lexsort((s[:, 1], s[:, 0]))
        s = s[order]
        firsts = np.searchsorted(s[:, 0], np.arange(seq_len + 2))
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            step = _search(s[:, 1], firsts[length], firsts[length + 1], rank)
            sequence, offset = s[step, 2] + rank - s[step, 1], s[step, 3]
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def _search(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Last index in [low, high) whose value is at most the wanted one; bisection for all rows at once."""
    low, high = low.copy(), high.copy()
    while np.any(high - low > 1):
        mid = (low + high) // 2
        up = (high - low > 1) & (values[mid] <= wanted)
        down = (high - low > 1) & ~up
        low, high = np.where(up, mid, low), np.where(down, mid, high)
    return low


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int, seq_len: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence each is packed into and its place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep(pieces_of(docs, tokenizer_file, end_id, seq_len, key, text, with_ids), "pieces"), seq_len)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)
