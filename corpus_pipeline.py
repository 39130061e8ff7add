"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. The last returns the pieces of documents with their sequences; all others
return the columns of ``documents``; other columns are left behind.

Null texts count as empty: they pass the first two stages (an empty text links
with nothing) and come out of the third as empty texts, one end token each. Rows
without an id stay, as nothing can be said of them by id; repeated rows are scored
and packed each for itself, but rows that share an id share the verdict of the
second stage, and equal texts of 400 bytes or more are repeats to the third. Texts
may have any length. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, reachable
from orderflow.llm.jaccard_join import jaccard_components
from orderflow.llm.mixing import in_order, mix
from orderflow.llm.packing import pack_documents
from orderflow.llm.suffix_dedup import remove_repeats
from orderflow.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SEQUENCE_TOKENS, END_ID = 1024, 2


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5."""
    labels = reachable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(toxicity(docs, labels, carry=tuple(COLUMNS[1:])).filter("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity of 0.75 or more the one with the smallest id.

    Rows without an id stay; rows that share an id share its verdict.
    """
    reachable(spark)
    found = jaccard_components(docs).filter("doc_id IS NOT NULL AND doc_id <> component_id")
    others = found.select(F.col("doc_id").alias("other")).distinct()
    return _columns(docs.join(others, docs.doc_id == others.other, "left_anti"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that occur again; n_chars of cut texts is counted anew.

    A document of which nothing is left goes; a null text becomes empty.
    """
    reachable(spark)
    found = remove_repeats(docs, carry=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.filter("n_removed = 0 OR kept <> ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: parts, and rows in them, by position."""
    return _columns(in_order(mix(_columns(docs)), docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence each is packed into."""
    import public_tokenizers

    reachable(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("pfair_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: No SQL expresses a fitted classifier, components or a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared folder."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
