"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other text is unlabelled. A linear
model over hashed words and word beginnings minimises the class-prior-corrected
risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss; where
the second part turns negative, the step undoes it instead (the non-negative
correction), so a flexible model cannot fit the positives out of the unlabelled.

The fit takes at most about ``MAX_POSITIVE`` positive and ``MAX_UNLABELLED``
unlabelled rows, chosen by a hash of their id; the prior is counted over all
labelled rows that may be learnt from. Rows whose crc32(id as text) mod 5 is 0
are held out: neither their labels nor their texts are used. Every document is
scored by its whole text and nothing else.

Null and empty texts get the score of a text without words. Without a positive
row to learn from, every score is 0. Repeated rows are scored each for itself;
of repeated labels the largest counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import documents, slices, text_bytes

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
BITS = 20
#: Characters of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: A feature counts if that many positives of the fit have it, and by so many
#: standard deviations more than unlabelled texts do.
MIN_POSITIVES, MIN_DEVIATIONS = 5, 4.0
#: Bytes of text handled together.
SLICE = 2 << 20
STEPS, RATE, DECAY = 150, 0.05, 2e-3

_ASCII_WORDS = np.arange(256, dtype=np.uint8)
_ASCII_WORDS[[b for b in range(128) if not chr(b).isalnum()]] = 32
_ASCII_WORDS[65:91] += 32


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words; text and word of each distinct pair, by text."""
    data, at = text_bytes(texts)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(_ASCII_WORDS[data].tobytes()))
    lists = pc.ascii_split_whitespace(plain)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index_in("", words).as_py()  # white space at an end gives an empty word
    pair = np.repeat(np.arange(len(texts)), size) * max(1, len(words)) + word
    if empty is not None:
        pair = pair[word != empty]
    pair = np.unique(pair)
    return words, pair // max(1, len(words)), pair % max(1, len(words))


def _hash(strings: pa.Array, kind: int) -> np.ndarray:
    coded = pc.dictionary_encode(strings)
    codes = np.fromiter((zlib.crc32(s.encode(), kind) for s in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return codes[coded.indices.to_numpy(zero_copy_only=False)] & ((1 << BITS) - 1)


def word_features(words: pa.Array) -> np.ndarray:
    """Hashed features of each word, a column for each kind."""
    columns = [_hash(words, 0)] + [_hash(pc.utf8_slice_codeunits(words, 0, k), k) for k in BEGINNINGS]
    return np.stack(columns, 1) if len(words) else np.zeros((0, 1 + len(BEGINNINGS)), np.int64)


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of features and the bias, by the non-negative risk estimator."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive.any():
        return weights, -np.inf
    lengths = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    n_p, n_u = positive.sum(), max(1, (~positive).sum())
    have_p = np.bincount(flat[positive[doc]], minlength=1 << BITS)
    share_u = (np.bincount(flat[~positive[doc]], minlength=1 << BITS) + 0.5) / (n_u + 1)
    more = (have_p / n_p - share_u) / np.sqrt(share_u * (1 - share_u) / n_p)
    use = ((have_p >= MIN_POSITIVES) & (more >= MIN_DEVIATIONS))[flat]
    doc = doc[use]
    kept, column = np.unique(flat[use], return_inverse=True)
    w, b = np.zeros(len(kept)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, w[column], len(rows)) + b
        up = 1 / (1 + np.exp(-z))  # derivative of the loss against label -, and 1 - up against label +
        against = np.logaddexp(0, z)
        rest = against[~positive].sum() / n_u - prior * against[positive].sum() / n_p
        g_rest = np.where(positive, -prior * up / n_p, up / n_u)
        g = g_rest + np.where(positive, -prior * (1 - up) / n_p, 0) if rest >= 0 else -g_rest
        full = np.concatenate([np.bincount(column, g[doc], len(kept)) + (DECAY * w if rest >= 0 else 0), [g.sum()]])
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[kept] = w
    return weights, float(b)


def score(texts: pa.Array, model) -> np.ndarray:
    weights, b = model
    if not np.isfinite(b):  # nothing was learnt
        return np.zeros(len(texts))
    words, doc, word = distinct_words(texts)
    by_word = weights[word_features(words)].sum(1, dtype=np.float64)
    z = np.bincount(doc, by_word[word], len(texts)) + b
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _below(key: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The fitted model. Labelled ids reach the texts by a bounded broadcast."""
    marks = labels.filter(~held_out(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("mark"))
    n_marked, n_positive = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("mark") > 0).cast("long")), F.lit(0))).first()
    if not n_positive:
        return fit([], np.zeros(0, bool), 0.5)
    texts = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).filter(F.col("key").isNotNull() & ~held_out(F.col("key")))
    n_texts = texts.count()
    chosen = marks.filter((F.col("mark") > 0) & _below(F.col("key"), min(1.0, MAX_POSITIVE / n_positive))).select("key")
    known = texts.join(F.broadcast(chosen), "key").select("text", F.lit(True).alias("positive"))
    others = texts.filter(_below(F.col("key"), min(1.0, MAX_UNLABELLED / max(1, n_texts)))).select("text", F.lit(False).alias("positive"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, doc, word = distinct_words(part.column("text"))
                features = word_features(words)[word]
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [np.unique(features[a:b]).astype(np.int32) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), part.column("positive")], ["features", "positive"])

    sample = known.unionAll(others).mapInArrow(run, "features array<int>, positive boolean").toArrow()
    column = sample.column("features").combine_chunks()
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    prior = min(max(n_positive / n_marked, 1e-4), 1 - 1e-4)
    return fit(rows, sample.column("positive").to_numpy(), prior)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, held_out, score and predicted of each row, and the columns in ``carry``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label))
    # The text itself is not sent twice.
    names = ["_text" if c == text else f"_c{i}" for i, c in enumerate(carry)]
    more = [F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True) if n != "_text"]
    narrow = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"), held_out(docs[key]).alias("held_out"), *more)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                s = score(part.column("_text"), model.value)
                own = [part.column("_key"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                extra = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *extra], ["_key", "held_out", "score", "predicted", *names])

    kinds = [f"_key {docs.schema[key].dataType.simpleString()}", "held_out boolean", "score double", "predicted int"]
    kinds += [f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names]
    found = narrow.mapInArrow(run, ", ".join(kinds))
    return found.withColumnsRenamed({"_key": key} | dict(zip(names, carry, strict=True)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
