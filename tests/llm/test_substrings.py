"""Word windows that a smaller document has too, against a plain count."""

import hashlib
import re

import numpy as np
import pytest

from orderflow.llm import substrings

KINDS = "doc_id long, text string, n_words string, slice string, id string"


def plain(rows, length):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - length + 1):
            if i is not None:
                g = tuple(w[j : j + length])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if i is not None and least[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], KINDS)


def odd_rows():
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(word, n))
    shared, other = text(40), text(25)
    rows = [(i, f"{text(6)} {shared}\t{text(5)}\n{other if i % 3 else ''} éß{i} x") for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (53, "one"), (None, shared), (None, None), (1, shared), (1, shared), (1, other)]
    rows += [(60, "a " * 3000), (61, "a " * 12), (62, "a " * 13), (63, "b " * 30), (64, shared), (65, shared), (-7, shared[: len(shared) // 2])]
    return rows


@pytest.mark.parametrize(("length", "base"), [(13, 7), (13, 4), (13, 13), (5, 1), (1, 1), (16, 2)])
def test_plain(spark, length, base):
    rows = odd_rows()
    assert found(substrings.remove_substrings(table(spark, rows).repartition(5), length, base)) == plain(rows, length)


def test_levels():
    assert substrings.lengths(13) == [7, 13]
    assert substrings.lengths(13, 2) == [2, 4, 7, 13]
    assert all(b <= 2 * a for a, b in zip(substrings.lengths(100, 3), substrings.lengths(100, 3)[1:], strict=False))


def test_nothing_survives(spark):
    rows = [(i, " ".join(f"{i}-{j}" for j in range(40))) for i in range(20)]
    work = substrings._Levels(table(spark, rows), 13, 2, "doc_id", "text")
    assert not work.mark()
    assert found(substrings.remove_substrings(table(spark, rows))) == plain(rows, 13)


def test_empty_table(spark):
    assert substrings.remove_substrings(table(spark, [])).collect() == []


def test_long_texts(spark):
    """A text much longer than a slice, and its copy."""
    rng = np.random.default_rng(1)
    long = " ".join(map(str, rng.integers(0, 1 << 40, 250_000)))
    assert len(long) > substrings.SLICE
    rows = [(1, long), (2, "x " + long), (3, long[: len(long) // 2])]
    got = {r["doc_id"]: r for r in substrings.remove_substrings(table(spark, rows)).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_words"]) == (0, 250_000, 250_001)
    assert got[2]["kept_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert got[3]["n_words"] - got[3]["n_removed"] <= 1
