"""Token alignment against a plain one of every pair of byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orderflow.llm import alignment

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KINDS = "doc_id long, text string, part string, id string, pairs string, n_a string"


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def plain(rows):
    a_kind, b_kind = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a_kind.encode_special_tokens = True
    letter = byte_letters()

    def b_token(i):
        p = b_kind.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_kind.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for key, text in rows:
        a, b, ranges = [], [], []
        if text:
            a, b = a_kind.encode(" " + text, add_special_tokens=False).ids, b_kind.encode(text)
            tokens = [[bytes(letter[c] for c in a_kind.id_to_token(i)) for i in a], [b_token(i) for i in b]]
            if any(b"".join(t) != (" " + text).encode() for t in tokens):
                a, b, tokens = [], [], [[], []]
            for t in tokens:
                at, out = 0, []
                for x in t:
                    out.append((at, at + len(x)))
                    at += len(x)
                ranges.append(out)
        links, groups, ga, gb = [], [], [], []
        if a:
            j = 0
            for i, (s, e) in enumerate(ranges[0]):
                while ranges[1][j][1] <= s:
                    j += 1
                m = j
                while m < len(b) and ranges[1][m][0] < e:
                    links.append((a[i], b[m]))
                    m += 1
            ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
            last = 0
            for end in ends:
                ga = [x for x, (s, e) in zip(a, ranges[0], strict=True) if last <= s < end]
                gb = [x for x, (s, e) in zip(b, ranges[1], strict=True) if last <= s < end]
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                last = end
        docs.append((key, a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        (
            (k, len(a), len(b), len(g), len(li), sum(count[p] == best[p[0]] for p in li), sum(count[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
            for k, a, b, g, li in docs
        ),
        key=str,
    )


def found(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "q") for i, t in rows], KINDS)


ODD = [
    "", None, " ", "a", "  two  spaces", "tab\there", "line\nbreak\n\n", " leads", "trails ", "naïve café über straße", "▁mark ▁", "日本語の文章です。", "emoji 👩‍👩‍👧 ok 🎉",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "x" * 300, "don't we'll I'd", "1234567890 12.5%", "\x00nul \x01", "é combining", "a b c", "ﬁ ligature Ⅳ", "http://a.b/c?d=e&f=g#h", "שלום עולם", "﻿bom",
]


@pytest.mark.parametrize("part", [1, alignment.PART])
def test_plain(spark, monkeypatch, part):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows = [(r["doc_id"], r["text"]) for r in texts] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "again and again"), (None, None)]
    monkeypatch.setattr(alignment, "PART", part)
    got = found(alignment.align_tokens(table(spark, rows).repartition(6), A_FILE, B_FILE))
    want = plain(rows)
    assert got == want
    assert sum(r[1] == 0 for r in want) < len(want) / 2


def test_words_apart_are_words_together():
    """Ids of words encoded apart are those of whole texts, for odd texts and many spaces too."""
    rng = np.random.default_rng(2)
    parts = ["the", "Zürich", "▁", " ", "  ", "\n", "don't", "日本", "x1.5", "<s>", "\t", "é", "👩‍👩‍👧", "AAAA", "...", "\x00"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(parts, 12)) for _ in range(500)] + [" ".join(rng.choice(parts, 12)) for _ in range(500)]
    pieces = alignment._Pieces(B_FILE)
    assert pieces.apart
    at, ids = pieces.encode(pa.array(texts))
    want = pieces.model.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want


def test_windows_are_remembered(monkeypatch):
    work = alignment.Aligner(A_FILE, B_FILE)
    texts = pa.array(["the cat sat on the mat", "the cat sat"])
    first = work.batch(texts)
    kept = dict(work.windows)
    monkeypatch.setattr(alignment, "align", None)  # nothing is aligned again
    again = work.batch(texts)
    assert 0 < len(kept) == len(work.windows) < 9 and first[1] == again[1]
    monkeypatch.undo()
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1)
    assert work.batch(texts)[1] == first[1] and work.batch(pa.array(["z" * 5000]))[0][2][0] >= 1
    assert len(work.windows) == 1


def test_empty_table_and_no_tokens(spark):
    assert alignment.align_tokens(table(spark, []), A_FILE, B_FILE).collect() == []
    assert found(alignment.align_tokens(table(spark, [(1, ""), (2, None)]), A_FILE, B_FILE)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_long_text(spark):
    rows = [(1, "many words again " * 100_000 + "end"), (2, "many words"), (3, "y" * 200_000)]
    got = {r[0]: r for r in found(alignment.align_tokens(table(spark, rows), A_FILE, B_FILE))}
    small = plain([(2, "many words")])[0]
    assert got[2][1:5] == small[1:5] and got[2][5] == got[2][4]
    assert got[1][4] >= 300_000 and got[3][3] >= 1
