"""Collocations of two to four words by Toivonen's sampling method, exact.

Texts are lower-cased (A-Z) and split at punctuation and line ends into pieces,
those at spaces and tabs into words; a phrase is a run of words of one piece.
Everything is counted for each language.

1. *Sample.* One document in ``RATE`` (by a hash of id and text) is mined at a
   lowered count; what it proposes is marked in a bitmap of fixed size.
2. *Full pass.* All words, all proposed phrases and their negative border are
   counted over the whole corpus: every phrase whose two phrases of one word
   less (without its last, without its first word) are proposed. Only phrases
   that occur are ever looked at, so the border is never listed.
3. *Expansion.* Where a phrase of the border proves frequent, its own extensions
   may be frequent as well and were not counted: another pass counts the phrases
   whose parts are frequent and that no earlier pass counted, and so on until a
   pass finds none. Phrases have four words at most, so the passes are few.
4. *Names.* The counts know phrases as 64-bit hashes only. Documents of the sample
   name nearly all frequent ones; one more pass names those that the sample has
   not. Cuts, scores, phrases inside longer ones and ranks are joins and
   aggregations.

False marks of the bitmaps are counted too, and dropped by their count. Slices
of texts send a hash once, with its count (``packed``), so frequent words are
no hot keys. Null texts are empty, a null language is ``und``; repeated rows
count each; empty tables give no rows; texts may have any length; columns besides
id, text and language are not read. Ties are ranked by phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, mix, slices, spread
from orderflow.llm.jaccard_join import bitmap, marked
from orderflow.llm.packed import binary, bucket_bits, bucket_cuts, gathered, is_marked, marks, unpacked, words_of

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000
#: A candidate with this share (in percent) of its occurrences inside a longer one is dropped.
INSIDE = 80
#: One document in so many is in the sample.
RATE = 8
#: Bytes of text handled together.
SLICE = 2 << 20
#: Bits of a bitmap: 8 MB, as up to six of them are shared.
MAP_BITS = 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
#: The same, as a pattern of words.
_WORD = r"[^ \t.,;:!?\n\x0B\f\r]+"


class _Grams:
    """All phrases of a slice: ``hashes[k - 1]`` and ``valid[k - 1]`` by first word, for k words."""

    def __init__(self, texts: pa.Array, lang: np.ndarray):
        data, start, stop, words, first = words_of(texts, _LOWER, _BLANK, _BREAK)
        self.data, self.start, self.stop, self.first = data, start, stop, first
        n = len(words)
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        words = mix(words + mix(lang)[self.doc])
        seen = np.r_[0, np.cumsum(_BREAK[data], dtype=np.int32)]
        linked = (seen[start[1:]] == seen[stop[:-1]]) & (self.doc[1:] == self.doc[:-1]) if n else np.zeros(0, bool)
        self.hashes, self.valid = [words], [np.ones(n, bool)]
        for k in range(2, MOST_WORDS + 1):
            size = max(0, n - k + 1)
            before = self.hashes[-1][:size]
            self.hashes.append(mix((before + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) + words[k - 1 :][:size]))
            self.valid.append(self.valid[-1][:size] & linked[k - 2 :][:size])

    def extends(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Whether both phrases of one word less are marked."""
        shorter, size = self.hashes[k - 2], len(self.hashes[k - 1])
        has = is_marked(bits, shorter)
        return has[:size] & has[1 : size + 1]

    def strings(self, k: int, places: np.ndarray) -> pa.Array:
        """The phrases of k words from these places, space-joined."""
        word = (places[:, None] + np.arange(k)).ravel()
        size = self.stop[word] - self.start[word] + 1
        joined = np.append(self.data, np.uint8(32))[spread(self.start[word], size)]
        ends = np.cumsum(size)
        joined[ends - 1] = 32  # the byte after a word
        keep = np.ones(len(joined), bool)
        keep[ends[k - 1 :: k] - 1] = False
        offsets = np.r_[0, ends[k - 1 :: k] - 1 - np.arange(len(places))].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(joined[keep])])


def _grams(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield part, _Grams(part.column("text"), part.column("code").to_numpy(zero_copy_only=False).view(np.uint64))


class _Miner:
    def __init__(self, docs: DataFrame, min_count: int, rate: int, key: str, text: str, lang: str):
        self.spark, self.min_count, self.rate = docs.sparkSession, min_count, rate
        self.lowered = max(2, min_count // rate // 2 + 1)
        language = F.coalesce(docs[lang].cast("string"), F.lit("und"))
        self.docs = docs.select(
            docs[key].cast("string").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"), language.alias("lang"), F.xxhash64(language).alias("code")
        )
        self.bits = bucket_bits(docs)
        self.scratch = Scratch(self.spark, "phrases")
        self.maps: list = []  # bitmaps whose extensions have been counted

    def sample(self) -> DataFrame:
        return self.docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(self.rate)) == 0)

    def propose(self) -> None:
        """Mine the sample: all phrases in one go, at the lowered count."""
        bits, least = self.bits, self.lowered

        def send(batches):
            for _, grams in _grams(batches):
                h = np.sort(np.concatenate([x[v] for x, v in zip(grams.hashes, grams.valid, strict=True)]))
                # A hash is sent as often as it is met, but no oftener than it takes to be proposed.
                again = np.zeros(len(h), bool)
                again[least:] = h[least:] == h[:-least]
                h = h[~again]
                if len(h):
                    bucket, cuts = bucket_cuts(h, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), binary(((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), cuts)], ["bucket", "hashes"])

        def merge(table: pa.Table) -> pa.Table:
            h = np.sort(unpacked(table.column("hashes"), np.uint32))
            often = np.unique(h[least - 1 :][h[least - 1 :] == h[: max(0, len(h) - least + 1)]]).astype(np.uint64) << np.uint64(32 - bits)
            got = [marks(often, bits, MAP_BITS)] if len(often) else []
            return pa.table({"bucket": table.column("bucket")[: len(got)], "marks": pa.array(got, pa.binary())})

        sent = self.sample().select("text", "code").mapInArrow(send, "bucket int, hashes binary")
        self._share(gathered(sent.groupBy("bucket").applyInArrow(merge, "bucket int, marks binary"), bits, MAP_BITS))

    def _share(self, bits: np.ndarray) -> None:
        self.maps.append(self.spark.sparkContext.broadcast(bits))

    def count(self) -> DataFrame:
        """One full pass: (bucket, marks, hashes, counts, unmarked) of what it finds frequent.

        It counts what the last bitmap extends to and no earlier one did, in the
        first pass all words too; ``unmarked`` are those not in the last bitmap.
        """
        bits, shared, least, pass_ = self.bits, list(self.maps), self.min_count, len(self.maps)

        def send(batches):
            *earlier, last = [b.value for b in shared]
            for _, grams in _grams(batches):
                found = [grams.hashes[0]] if pass_ == 1 else []
                for k in range(2, MOST_WORDS + 1):
                    wanted = grams.valid[k - 1] & grams.extends(k, last)
                    for old in earlier:
                        if wanted.any():
                            wanted &= ~grams.extends(k, old)
                    found.append(grams.hashes[k - 1][wanted])
                h, n = np.unique(np.concatenate(found), return_counts=True)
                if len(h):
                    bucket, cuts = bucket_cuts(h, bits)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), binary(h, cuts), binary(n.astype(np.uint32), cuts)], ["bucket", "hashes", "counts"])

        def merge(table: pa.Table) -> pa.Table:
            h, n = unpacked(table.column("hashes"), np.uint64), unpacked(table.column("counts"), np.uint32)
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            h, n = h[first], np.add.reduceat(n, first)
            h, n = h[n >= least], n[n >= least]
            bucket = table.column("bucket")[: min(1, len(h))]
            row = [[marks(h, bits, MAP_BITS)], [h.tobytes()], [n.tobytes()]] if len(h) else [[], [], []]
            new = [int((~is_marked(shared[-1].value, h)).sum())][: len(bucket)]
            return pa.table([bucket, *(pa.array(x, pa.binary()) for x in row), pa.array(new, pa.int64())], ["bucket", "marks", "hashes", "counts", "unmarked"])

        sent = self.docs.select("text", "code").mapInArrow(send, "bucket int, hashes binary, counts binary")
        kinds = "bucket int, marks binary, hashes binary, counts binary, unmarked long"
        return self.scratch.keep(sent.groupBy("bucket").applyInArrow(merge, kinds), f"found-{pass_}")

    def frequent(self) -> DataFrame:
        """bucket, hashes and counts of all frequent words and phrases, when no border is left."""
        self.propose()
        found, new = self.count(), None
        while True:
            new = found if new is None else new
            open_ = new.agg(F.sum("unmarked")).first()[0]
            # What the n-th pass finds anew has n words at least: after the last length nothing is open.
            if not open_ or len(self.maps) == MOST_WORDS:
                break
            self._share(gathered(found.select("bucket", "marks"), self.bits, MAP_BITS))
            new = self.count()
            found = found.union(new)
        self.all = self.spark.sparkContext.broadcast(gathered(found.select("bucket", "marks"), self.bits, MAP_BITS))
        return found.select("bucket", "hashes", "counts")

    def _names(self, docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
        """Words, language and string of frequent phrases of these documents, in packed rows."""
        bits, shared = self.bits, self.all
        wanted = None if only is None else self.spark.sparkContext.broadcast(only)

        def run(batches):
            for part, grams in _grams(batches):
                found = []
                for k in range(1, MOST_WORDS + 1):
                    at = np.flatnonzero(grams.valid[k - 1])
                    h = grams.hashes[k - 1][at]
                    has = is_marked(shared.value, h)
                    if wanted is not None:
                        has[has] = marked(wanted.value, h[has])
                    h, one = np.unique(h[has], return_index=True)
                    at = at[has][one]
                    found.append((h, np.full(len(h), k, np.uint8), part.column("lang").take(pa.array(grams.doc[at])), grams.strings(k, at)))
                hashes, size, *strings = zip(*found, strict=True)
                order = np.argsort(np.concatenate(hashes), kind="stable")
                h = np.concatenate(hashes)[order]
                if len(h):
                    bucket, cuts = bucket_cuts(h, bits)
                    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays(x).take(pa.array(order))) for x in strings]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), binary(h, cuts), binary(np.concatenate(size)[order], cuts), *lists], ["bucket", "hashes", "sizes", "langs", "phrases"])

        kinds = "bucket int, hashes binary, sizes binary, langs array<string>, phrases array<string>"
        return docs.select("text", "lang", "code").mapInArrow(run, kinds)

    def named(self, frequent: DataFrame) -> DataFrame:
        """lang, k, phrase and f of all frequent words and phrases."""

        def join(names: pa.Table, counts: pa.Table) -> pa.Table:
            h, n = unpacked(counts.column("hashes"), np.uint64), unpacked(counts.column("counts"), np.int64)
            known, one = np.unique(unpacked(names.column("hashes"), np.uint64), return_index=True)
            place = np.searchsorted(known, h)
            has = known[np.minimum(place, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            at = pa.array(one[np.where(has, place, 0)] if len(one) else np.zeros(len(h), np.int64), mask=~has)
            size = unpacked(names.column("sizes"), np.uint8).astype(np.int32)
            strings = [names.column(c).combine_chunks().flatten().take(at) for c in ("langs", "phrases")]
            return pa.table([pa.array(h.view(np.int64)), pa.array(n), pa.array(size).take(at), *strings], ["hash", "f", "k", "lang", "phrase"])

        def met(names: DataFrame) -> DataFrame:
            return names.groupBy("bucket").cogroup(frequent.groupBy("bucket")).applyInArrow(join, "hash long, f long, k int, lang string, phrase string")

        first = self.scratch.keep(met(self._names(self.sample())), "named")
        left, columns = first.filter("phrase IS NULL").select("hash"), ["lang", "k", "phrase", "f"]
        first = first.filter("phrase IS NOT NULL").select(*columns)
        if left.isEmpty():
            return first
        rest = met(self._names(self.docs, bitmap(left, "hash"))).filter("phrase IS NOT NULL")
        return self.scratch.keep(first.union(rest.join(left, "hash", "left_semi").select(*columns)), "counts")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, rate: int = RATE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of words and phrases with f >= min_count, and (lang, n) of all words."""
    miner = _Miner(docs, min_count, rate, key, text, lang)
    counts = miner.named(miner.frequent())
    return counts, miner.docs.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(_WORD))).cast("long").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates of two words or more: the cut of the lowest score."""
    cuts = counts.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    known = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        one = known.withColumnsRenamed({"f": name, "part": f"{name}_part", "of": f"{name}_of"})
        parts = parts.join(one, (F.col("lang") == F.col(f"{name}_of")) & (F.col(side) == F.col(f"{name}_part")))
    # Decimals: the product may pass 64 bits, the quotient is a million at most.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE, rate: int = RATE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` candidates."""
    counts, totals = phrase_counts(docs, min_count, rate, key, text, lang)
    within = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = counts.filter("k > 2").select(F.col("lang").alias("of"), F.explode(within).alias("inner"), "f").groupBy("of", "inner").agg(F.max("f").alias("longest"))
    left = scored(counts).join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")), "left")
    left = left.filter(f"longest IS NULL OR cast(longest as decimal(25, 0)) * 100 < cast(a as decimal(25, 0)) * {int(inside)}")
    # Spark keeps the first ``top`` of every task before they meet.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = ranked.join(totals.withColumnRenamed("lang", "of_lang"), F.col("lang") == F.col("of_lang"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = """
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), sides AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
         ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1 : c.k], ' ')
), best AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, unnest(flatten([[array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') FOR i IN range(1, k - m + 2)] FOR m IN range(2, k)])) AS phrase, f
  FROM f WHERE k > 2
), longest AS (
  SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longest o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 80 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
