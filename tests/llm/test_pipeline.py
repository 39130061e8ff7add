"""The pipeline's stages on a small folder, each against brute force over its own input."""

import sys
from pathlib import Path

import public_tokenizers
from test_documents import components_of, kept_of
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from orderflow.llm.common import Scratch, documents  # noqa: E402
from orderflow.llm.toxicity import op3_toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, scratch = documents(spark, FOLDER), Scratch(spark, "test-pipeline")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == P.COLUMNS
        docs = scratch.keep(out, name)
        seen.append({r.doc_id: r.text for r in docs.collect()})
    raw, clean, single, cut, mixed = seen
    toxic = {r.doc_id for r in op3_toxicity(spark, FOLDER).filter("predicted = 1").collect()}
    assert clean == {i: t for i, t in raw.items() if i not in toxic}
    ids = sorted(clean)
    top = components_of([clean[i] for i in ids])[1]
    assert single == {i: clean[i] for k, i in enumerate(ids) if top[k] == k}
    ids = sorted(single)
    for i, (size, gone, _, _) in zip(ids, kept_of([single[i].encode() for i in ids], 400)):
        assert (i in cut) == (gone < size or size == 0)
        assert gone or cut[i] == single[i]
        assert i not in cut or abs(len(cut[i].encode()) - (size - gone)) <= 6
    assert mixed == cut
    packed = P.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    lengths = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in mixed.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeats, a long text, clashing columns; and a table without rows."""
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    extra = [(None, "no id here", None, None, None), (None, None, None, None, None), (900_001, None, "en", "src0", 0), (900_002, "", None, "src1", 0), (900_003, "tail word " * 40_000, "en", "src0", 400_000)]
    extra += [(900_004, "same row twice", "en", "src9", 14)] * 2
    docs = base.unionByName(spark.createDataFrame(extra, base.schema)).selectExpr("*", "1 AS label", "'x' AS id", "2L AS position", "'y' AS slot", "3L AS piece")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(900_004) == 2 and {900_001, 900_002} <= set(ids) and ids.count(None) == 2
    assert all(r.offset + r.length <= 1024 for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 900_001) == 1
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, str(empty)).collect() == []
