"""Removal of word windows that a document with a smaller id has too.

Level-wise doubling. A window can only be repeated if the windows of half its
length that it begins and ends with are repeated, so windows are counted at a
short length first, and only those that other documents have as well are
extended to twice that length (one word less where the target asks for it),
until the target is reached or no candidates survive.

1. *Levels.* Each slice of texts sends the windows that survive so far, once,
   in packed rows (``packed``); a bucket's task marks those that two documents
   have, in a bitmap of fixed size. A false mark costs time at the next level,
   never a result.
2. *Last level.* Slices send the full hashes of their surviving windows and the
   smallest id that has each. The answer is one bit for each: whether another
   slice has it in a document of a smaller id. Within a slice ids are compared
   directly. So a window that a third of all documents share is sent once by a
   slice, and no task sees its occurrences.
3. *Removal.* Texts without a surviving window are finished at once; others are
   kept in the shared folder, and meet the answers by slice.

Windows never cross documents. Null texts have no words. Rows with equal ids
don't remove each other's words; rows without an id lose nothing and take
nothing. Empty tables give empty results. A text of any length is one slice at
most; columns besides key and text, whatever their names, are not read. Windows
are known by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, mix, slices, spread
from orderflow.llm.packed import binary, bucket_bits, bucket_cuts, gathered, is_marked, marks, runs, unpacked, words_of

LENGTH = 13
#: Windows are counted first at a length of at most this.
BASE = 7
#: Bytes of text handled together.
SLICE = 2 << 20
_FAR = np.int64((1 << 63) - 1)


def lengths(length: int, base: int = BASE) -> list[int]:
    """Lengths of the levels: each at most twice the one before, the last the target."""
    out = [length]
    while out[0] > max(1, base):
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, from those of half the length."""
    if length == 1:
        return words
    half = (length + 1) // 2
    h, n = window_hashes(words, half), max(0, len(words) - length + 1)
    return mix((h[:n] + np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93) + h[length - half : length - half + n])


def inside(first: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Whether the window from each word ends in the same text."""
    out = np.zeros(max(0, n_words - length + 1), bool)
    a, b = first[:-1], first[1:] - length + 1
    out[spread(a[b > a], (b - a)[b > a])] = True
    return out


def surviving(words: np.ndarray, first: np.ndarray, levels: list[int], maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the level after the maps' (the last, if all have one): hash, and whether it survives."""
    h, alive = words[:0], None
    for k, length in enumerate(levels[: len(maps) + 1]):
        h, fits = window_hashes(words, length), inside(first, len(words), length)
        if alive is not None:
            shift = length - levels[k - 1]
            fits &= alive[: len(fits)] & alive[shift : shift + len(fits)]
        alive = fits
        if k < len(maps):
            alive[alive] = is_marked(maps[k], h[alive])
    return h, alive


def _document_of(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, places, side="right") - 1


class _Levels:
    def __init__(self, docs: DataFrame, length: int, base: int, key: str, text: str):
        self.spark, self.levels = docs.sparkSession, lengths(length, base)
        self.docs = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
        self.bits = bucket_bits(docs)
        self.scratch = Scratch(self.spark, "substrings")
        self.shared: list = []

    def mark(self) -> bool:
        """Count one level; whether any candidate survives it."""
        levels, shared, bits = self.levels, list(self.shared), self.bits

        def send(batches):
            maps = [b.value for b in shared]
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    *_, words, first = words_of(part.column("text"))
                    h, alive = surviving(words, first, levels, maps)
                    at = np.flatnonzero(alive)
                    order = np.argsort(h[at], kind="stable")  # ties stay in the order of documents
                    h, doc = h[at][order], _document_of(first, at[order])
                    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                    # Once, and once more at the first other document.
                    other = ~new
                    other[1:] &= doc[1:] != doc[:-1]
                    nth = np.cumsum(other) - np.repeat((np.cumsum(other) - other)[new], np.diff(np.r_[np.flatnonzero(new), len(h)]))
                    h = h[new | (other & (nth == 1))]
                    if len(h):
                        bucket, cuts = bucket_cuts(h, bits)
                        short = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), binary(short, cuts)], ["bucket", "hashes"])

        def merge(table: pa.Table) -> pa.Table:
            h = np.sort(unpacked(table.column("hashes"), np.uint32))
            again = np.unique(h[1:][h[1:] == h[:-1]]).astype(np.uint64) << np.uint64(32 - bits)
            got = [marks(again, bits)] if len(again) else []
            return pa.table({"bucket": table.column("bucket")[: len(got)], "marks": pa.array(got, pa.binary())})

        sent = self.docs.mapInArrow(send, "bucket int, hashes binary")
        found = gathered(sent.groupBy("bucket").applyInArrow(merge, "bucket int, marks binary"), bits)
        self.shared.append(self.spark.sparkContext.broadcast(found))
        return bool(found.any())

    def split(self) -> DataFrame:
        """All rows; those with surviving windows have a slice and their text, others their result."""
        levels, shared = self.levels, list(self.shared)

        def run(batches):
            maps, task, n = [b.value for b in shared], TaskContext.get().partitionId(), 0
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    data, start, stop, words, first = words_of(part.column("text"))
                    _, alive = surviving(words, first, levels, maps)
                    open_ = np.zeros(part.num_rows, bool)
                    open_[_document_of(first, np.flatnonzero(alive))] = True
                    open_ &= part.column("id").is_valid().to_numpy(zero_copy_only=False)
                    digest = [None if o else s for o, s in zip(open_.tolist(), digests(data, start, stop, first, ~open_), strict=True)]
                    size = len(open_)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(size, (task << 32) + n), mask=~open_), part.column("id"), part.column("text").filter(pa.array(open_)).take(
                                pa.array(np.cumsum(open_) - 1, mask=~open_)),
                            pa.array(np.diff(first).astype(np.int64)), pa.array(digest, pa.string()),
                        ],
                        ["slice", "id", "text", "n_words", "kept_sha256"],
                    )
                    n += 1

        kinds = "slice long, id long, text string, n_words long, kept_sha256 string"
        return self.scratch.keep(self.docs.mapInArrow(run, kinds), "split", "zstd")

    def asked(self, texts: pa.Array, ids: np.ndarray, maps: list[np.ndarray]):
        """Surviving windows of a slice: distinct hashes, their smallest id, and for each window its place, hash number and document."""
        *rest, words, first = words_of(texts)
        h, alive = surviving(words, first, self.levels, maps)
        at = np.flatnonzero(alive)
        value, number = np.unique(h[at], return_inverse=True)
        doc = _document_of(first, at)
        owner = np.full(len(value), _FAR)
        np.minimum.at(owner, number, ids[doc])
        return value, owner, at, number, doc, (*rest, first)

    def removed(self) -> DataFrame:
        rows, shared, bits, me = self.split(), self.shared[: len(self.levels) - 1], self.bits, _Asker(self.levels)
        todo = rows.filter("slice IS NOT NULL").select("slice", "id", "text")
        done = rows.filter("slice IS NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")

        def ask(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            value, owner, *_ = me.asked(_flat(table, "text"), table.column("id").to_numpy(), [b.value for b in shared])
            bucket, cuts = bucket_cuts(value, bits)
            return pa.table([pa.array(bucket), table.column("slice")[:1].take(pa.array(np.zeros(len(bucket), np.int64))), binary(value, cuts), binary(owner, cuts)], ["bucket", "slice", "hashes", "owners"])

        def answer(table: pa.Table) -> pa.Table:
            h, owner = unpacked(table.column("hashes"), np.uint64), unpacked(table.column("owners"), np.int64)
            order = np.argsort(h, kind="stable")
            first = runs(h[order])
            least = np.minimum.reduceat(owner[order], first) if len(h) else owner
            smaller = np.empty(len(h), bool)
            smaller[order] = np.repeat(least, np.diff(np.r_[first, len(h)])) < owner[order]
            ends = np.cumsum([len(x) // 8 for x in table.column("hashes").to_pylist()])
            bits_of = [np.packbits(smaller[a:b]).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            return pa.table([table.column("slice"), table.column("bucket"), pa.array(bits_of, pa.binary())], ["slice", "bucket", "smaller"])

        def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
            texts = texts.combine_chunks()
            ids = texts.column("id").to_numpy()
            value, owner, at, number, doc, (data, start, stop, first) = me.asked(_flat(texts, "text"), ids, [b.value for b in shared])
            bucket, cuts = bucket_cuts(value, bits)
            got = dict(zip(answers.column("bucket").to_pylist(), answers.column("smaller").to_pylist(), strict=True))
            parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=n) for b, n in zip(bucket.tolist(), np.diff(cuts).tolist(), strict=True)]
            smaller = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
            gone = at[smaller[number] | (owner[number] < ids[doc])]
            edge = np.zeros(len(start) + 1, np.int32)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + me.levels[-1], -1)
            out = np.cumsum(edge[:-1]) > 0
            sums = np.r_[0, np.cumsum(out)]
            return pa.table(
                [pa.array(ids), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(digests(data, start, stop, first, None, ~out), pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

        requests = todo.groupBy("slice").applyInArrow(ask, "bucket int, slice long, hashes binary, owners binary")
        answers = requests.groupBy("bucket").applyInArrow(answer, "slice long, bucket int, smaller binary")
        cuts = todo.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string")
        return done.union(cuts)


class _Asker:
    """What tasks need of the levels."""

    def __init__(self, levels: list[int]):
        self.levels = levels

    asked = _Levels.asked


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, wanted: np.ndarray | None = None, keep: np.ndarray | None = None) -> list[str]:
    """SHA-256 of each text's kept words, joined by one space; empty for texts not wanted."""
    size = stop - start
    use = np.ones(len(size), bool) if keep is None else keep
    if wanted is not None:
        use = use & np.repeat(wanted, np.diff(first))
    # Every word with the byte after it, which becomes the space; the last space of a text is left out.
    length = np.where(use, size + 1, 0)
    ends = np.r_[0, np.cumsum(length)]
    joined = np.append(data, np.uint8(32))[spread(start[use], length[use])]
    joined[ends[1:][use] - 1] = 32
    raw = memoryview(joined)
    out = []
    for a, b, w in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist(), [True] * (len(first) - 1) if wanted is None else wanted.tolist(), strict=True):
        out.append(hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() if w else "")
    return out


def remove_substrings(docs: DataFrame, length: int = LENGTH, base: int = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and the SHA-256 of the kept words for each row."""
    work = _Levels(docs, length, base, key, text)
    for _ in work.levels[:-1]:
        if not work.mark():
            break
    return work.removed().withColumnRenamed("id", key)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
         unnest([md5(array_to_string(w[i : i + 12], ' ')) FOR i IN range(1, len(w) - 11)]) AS g
  FROM d WHERE len(w) >= 13
), least AS (
  SELECT g, min(doc_id) AS least FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN least USING (g) WHERE least < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
