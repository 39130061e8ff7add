"""Quality rules: log-likelihood ratio of hashed n-grams, with base rules before it.

Words and pairs of words are hashed into ``BUCKETS`` buckets. Counts over the
whole corpus and over trusted documents give two smoothed multinomials; a
document's score is the mean log-ratio (trusted to raw) of its n-grams, and
every document at or above the threshold is kept. Ratios are whole numbers of
micro-units, so sums do not depend on the order of addition and the verdict of
a document is the same on every run.

Trusted documents are all those labelled of good quality; raw counts cover
every document.

DataFrame functions only, no Python on the executors. Passes keep no group:
counts and sums are combined before the shuffle, and texts are not shuffled to
find the trusted ones (see ``log_ratios``). Null texts have no words, fail the
base rule and are not kept; null ids are never trusted; repeated rows are judged
each for itself. A text without n-grams scores 0; texts may have any length.
Empty tables give empty results. Columns besides the key and the text are not
read, so clashing names are of no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents

BUCKETS = 1 << 16
#: Bits of the bitmaps of ids: 8 MB in all. When one fills up, more texts meet the ids, nothing is lost.
ID_BITS = 26
#: Mean log-ratio, in nats, from which a document is kept.
THRESHOLD = -0.15
MICRO = 1_000_000
#: Windows of a text are told apart by their hash's upper bits and numbered in
#: the lower ones; longer texts take a slower way.
_NUMBER_BITS = 20
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words in a window of three that the text has twice or more.

    Windows are sorted by hash, equal neighbours are compared word by word, and
    the windows found, by place, each add the words not counted before.
    """
    n = F.size(words)
    last = F.sequence(F.lit(0), n - 3)
    window_hash = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    same = lambda a, b: (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])
    mask = (1 << _NUMBER_BITS) - 1
    number = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    packed = F.sort_array(F.transform(last, lambda i: window_hash(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(last, lambda i: F.struct(window_hash(i).alias("h"), i.alias("i"))))
    return n, last, packed, pairs, number, same


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _words and the base columns n_words ... base_failed to all columns."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = docs.withColumn("_text", t).withColumn("_words", words_of(F.col("_text")))
    words = F.col("_words")
    n, last, packed, pairs, number, same = _repeat_words(words)
    small = (n >= 4) & (n - 3 < (1 << _NUMBER_BITS))
    df = df.withColumn("_packed", F.when(small, packed)).withColumn("_pairs", F.when((n >= 4) & ~small, pairs))

    def twins(sorted_windows: Column, place, near):
        """Places of windows equal to a neighbour in sorted order."""
        at = F.sequence(F.lit(0), F.size(sorted_windows) - 1)
        equal = lambda a, b: near(sorted_windows[a], sorted_windows[b]) & same(place(sorted_windows[a]), place(sorted_windows[b]))
        hit = F.filter(at, lambda k: ((k > 0) & equal(k - 1, k)) | ((k < F.size(sorted_windows) - 1) & equal(k, k + 1)))
        return F.sort_array(F.transform(hit, lambda k: place(sorted_windows[k])))

    close = lambda a, b: a.bitwiseXOR(b).between(0, (1 << _NUMBER_BITS) - 1)
    found = F.coalesce(
        twins(F.col("_packed"), number, close), twins(F.col("_pairs"), lambda x: x["i"], lambda a, b: a["h"] == b["h"]), F.array().cast("array<int>")
    )
    df = df.withColumn("_twins", found)
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"))
    repeated = F.aggregate(F.col("_twins"), start, step, lambda a: a["n"])
    # A line of white space only has no word.
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.length(F.col("_text"))
    df = (
        df.withColumn("_lines", lines)
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(_without(F.col("_text"), _SPACES)).cast("long"))
        .withColumn("n_symbols", (bare - F.length(_without(F.col("_text"), _SYMBOLS))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated)
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_text", "_lines", "_packed", "_pairs", "_twins")


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each word and each pair of words, with its bucket (null for a text without any)."""
    words, i = F.col("_words"), F.col("_i")
    n = F.size(words)
    at = df.select(*keep, "_words", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), 2 * n - 2))).alias("_i"))
    place = F.shiftright(i, 1)
    code = F.when(i.bitwiseAND(F.lit(1)) == 0, F.xxhash64(words[place])).otherwise(F.xxhash64(words[place], words[place + 1]))
    bucket = F.when(i.isNotNull(), F.pmod(code, F.lit(BUCKETS)).cast("int"))
    return at.select(*keep, bucket.alias("bucket"))


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key.cast("string")), 64 - ID_BITS)


def _id_bitmap(ids: DataFrame, key: str) -> DataFrame:
    """Bitmap of hashed ids, 4 KB a row: 2048 rows at most, whatever the number of ids."""
    place = _place(F.col(f"`{key}`"))
    return ids.groupBy(F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def _marked(rows: DataFrame, bitmap: DataFrame, name: str) -> DataFrame:
    """Rows with whether the bitmap has their ``_key``."""
    parts = bitmap.withColumnsRenamed({"_part": f"{name}_part", "_bits": f"{name}_bits"})
    place = _place(F.col("_key"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.expr("shiftright({0}, {1})".format("_byte", "_bit")).bitwiseAND(F.lit(1)) == 1
    found = rows.join(F.broadcast(parts), F.bitmap_bucket_number(place) == F.col(f"{name}_part"), "left")
    found = found.withColumn("_byte", byte).withColumn("_bit", at.bitwiseAND(F.lit(7)).cast("int"))
    return found.withColumn(name, F.coalesce(has & F.col("_key").isNotNull(), F.lit(False))).drop("_byte", "_bit", f"{name}_part", f"{name}_bits")


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, counts of raw and of good n-grams; ``trusted`` holds ids.

    Texts stay where they are: a bitmap of the trusted ids marks their rows. Ids
    marked by chance are found by joining ids alone, and a second bitmap marks
    these; only the few texts that both mark meet the trusted ids themselves.
    """
    scratch = Scratch(docs.sparkSession, "trusted")
    ids = trusted.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    first = scratch.keep(_id_bitmap(ids, "_id"), "first")
    keys = docs.select(F.col(f"`{key}`").alias("_key"))
    chance = _marked(keys, first, "_first").filter("_first").join(ids, F.col("_key") == F.col("_id"), "left_anti")
    second = scratch.keep(_id_bitmap(chance, "_key"), "second")
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    texts = _marked(_marked(texts, first, "_first"), second, "_second")
    words = words_of(F.coalesce("_text", F.lit(""))).alias("_words")
    sure = F.when(F.col("_first") & ~F.col("_second"), 1).otherwise(0).cast("long").alias("_mark")
    counts = _grams(texts.select(sure, words), "_mark").filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_mark").alias("sure"))
    rest = texts.filter("_first AND _second").join(ids, F.col("_key") == F.col("_id"), "left_semi").select(words)
    more = _grams(rest).filter("bucket IS NOT NULL").groupBy(F.col("bucket").alias("_more")).agg(F.count("*").alias("few"))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    full = full.join(more, F.col("bucket") == F.col("_more"), "left")
    good = F.coalesce("sure", F.lit(0)) + F.coalesce("few", F.lit(0))
    return full.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), good.alias("good"))


def score_documents(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, base columns, llr (mean log-ratio) and kept for each row."""
    # Kept, so that texts are counted (and shuffled) once.
    counts = Scratch(docs.sparkSession, "quality").keep(log_ratios(docs, trusted, key, text), "counts")
    totals = counts.agg(F.sum("raw").alias("r"), F.sum("good").alias("g")).first()
    ratio = F.log((F.col("good") + 1) / F.lit(float(totals["g"] + BUCKETS))) - F.log((F.col("raw") + 1) / F.lit(float(totals["r"] + BUCKETS)))
    table = counts.select(F.col("bucket").alias("_b"), F.round(ratio * MICRO).cast("long").alias("_ratio"))
    base = with_base(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = base.withColumn("_row", F.monotonically_increasing_id())
    grams = _grams(rows, "_row", "_key", *columns)
    # BUCKETS rows: a bounded broadcast.
    scored = grams.join(F.broadcast(table), F.col("bucket") == F.col("_b"), "left")
    sums = scored.groupBy("_row").agg(
        F.first("_key").alias(key), *[F.first(c).alias(c) for c in columns], F.coalesce(F.sum("_ratio"), F.lit(0)).alias("_sum"), F.count("bucket").alias("_n")
    )
    llr = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / MICRO).otherwise(0.0)
    verdict = F.col("_sum") >= F.lit(round(threshold * MICRO)) * F.col("_n")
    return sums.select(key, *columns, llr.alias("llr"), (~F.col("base_failed") & verdict).alias("kept"))


def trusted_ids(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Ids labelled good."""
    return labels.filter((F.col(label) == 1) & F.col(key).isNotNull()).select(key)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(documents(spark, sf_dir), trusted_ids(labels))
