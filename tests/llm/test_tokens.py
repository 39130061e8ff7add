"""Token counts, token files and packing against the library itself."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orderflow.llm import packing, token_counts, token_files
from orderflow.llm.common import Scratch, reachable
from orderflow.llm.pieces import PieceEncoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", "  ", " a", "a ", "a  b", "a\n\nb", " \n", "don't 's", "x<|endoftext|>y  <|endoftext|> z", "é H̱ ̱x", "a b  c", "12 34.5",
    "日本 語 x", "\x1ca \x1c b", "a ​ b", "é'é ..a", "É'S It'S", "a\r\nb", "ab'\ncd", "ǅ ß ẞ İ", None,
]
ALPHABET = [" ", "  ", "\n", "a", "B", "'", "s", ".", "é", "́", " ", "1", "<|endoftext|>", "日", "\x1f", "\t", "ß", "İ", "$%"]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 14))) for _ in range(3000)]


def ids_of(file, values):
    found = Tokenizer.from_file(public_tokenizers.path(file)).encode_batch([x or "" for x in values], add_special_tokens=False)
    return [x.ids for x in found]


@pytest.mark.parametrize("file", FILES)
def test_pieces_are_the_librarys_ids(file):
    values = texts()
    encoder = PieceEncoder(public_tokenizers.path(file))
    assert encoder.kind != "whole"
    for part in (values[:1500], values[1500:], []):
        at, ids = encoder.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == ids_of(file, part)


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 16), (31, 30)])
def test_chunks_splice_to_the_whole(file, chunk, overlap):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    rng = random.Random(chunk)
    words = ["alpha", "Beta,", "don't", "x", "  ", "\n\n", "naïve", "1234", "<|endoftext|>", "日本語", "q" * 90, "é.\nÉ"]
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        got = [i for part in token_counts.encode_huge(tokenizer, text, chunk, overlap) for i in part]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_counts(spark, monkeypatch):
    reachable(spark)
    values = [*ODD, "word " * 40_000, "z" * 70_000]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(values)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, public_tokenizers.path(FILES[0])).collect()}
    for i, (x, ids) in enumerate(zip(values, ids_of(FILES[0], values))):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((x or "").encode()), len(ids) > 512)
    assert token_counts.token_counts(docs.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_token_files_round_trip(spark):
    reachable(spark)
    rows = [(7, "b b"), (None, "null id"), (3, None), (3, "again"), (3, "again"), (1, ""), (9, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, public_tokenizers.path(FILES[1]), 1, Scratch(spark, "t"))
    got = token_files.read_token_files(manifest, digest=False).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 3, 3, 7, 9]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert sorted(r.ids for r in got) == sorted([*x, 1] for x in ids_of(FILES[1], [t for _, t in rows]))
    for r, d in zip(got, sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)):
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    empty = token_files.write_token_files(docs.limit(0), public_tokenizers.path(FILES[1]), 1, Scratch(spark, "t"))
    assert token_files.read_token_files(empty).count() == 0


def test_plan_is_gapless_and_near_the_bound():
    rng = random.Random(3)
    counts = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(40)}
    steps, used = packing.plan(counts, 64)
    filled = np.zeros(used, np.int64)
    for length, rank, first, offset, n in sorted(steps.tolist(), key=lambda s: s[3]):
        assert (filled[first : first + n] == offset).all()
        filled[first : first + n] += length
    assert filled.max() <= 64 and filled.sum() == sum(k * n for k, n in counts.items())
    # One document at a time, each into the smallest gap that holds it.
    gaps, one_by_one = [], 0
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            i = bisect.bisect_left(gaps, k)
            if i == len(gaps):
                gaps.append(64)
                one_by_one += 1
            bisect.insort(gaps, gaps.pop(i) - k)
    assert used <= one_by_one * 1.01 + 1


def test_packing(spark):
    reachable(spark)
    rows = [(i, "w" + " w" * (i * 7 % 40)) for i in range(300)] + [(5, None), (5, None), (None, "x"), (900, "long " * 500)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(docs, public_tokenizers.path(FILES[0]), 2, 32, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")
    assert (got.offset == by.length.cumsum() - got.length).all() and by.length.sum().max() <= 32
    assert len(by) <= -(-got.length.sum() // 32) * 1.1 + 1
    pieces = got[got.doc_id == 900].sort_values("piece")
    assert [i for x in pieces.ids for i in x] == [*ids_of(FILES[0], ["long " * 500])[0], 2]
    assert set(pieces.length[1:]) == {32} and (pieces.start.values == np.cumsum(pieces.length.values) - pieces.length.values).all()
    assert got.length.sum() == sum(len(x) + 1 for x in ids_of(FILES[0], [t for _, t in rows]))
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path(FILES[0]), 2, 32).count() == 0
