"""Phrases, their scores and ranks against a plain count of everything."""

import re
from collections import Counter

import numpy as np
import pytest

from orderflow.llm import phrases

KINDS = "doc_id long, text string, lang string, n string, f string, phrase string, score string"


def plain(rows, least, top, inside=80):
    count, total = {}, Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            c = count.setdefault(lang or "und", Counter())
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        often = {p: a for p, a in c.items() if a >= least}
        kept = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * often[q] >= inside * a for q in longer):
                continue
            score, cut = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows], KINDS)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def odd_rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "gamma", "délta", "ε", "zeta", "eta", "ΘETA", "iota", "k"]
    weights = np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 1]) / 46

    def text():
        out = []
        for _ in range(60):
            out.append(rng.choice(words, p=weights))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", " ; ", "\xa0"]))
        return "".join(out) + " new york city hall." * int(rng.integers(0, 3))

    rows = [(i, text(), ["en", "de", None, "und"][i % 4]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, ". , \t", "fr"), (None, text(), "en"), (None, None, None)]
    return rows + [rows[4]] * 3 + [(5, "new york city hall", "en")]


@pytest.mark.parametrize(("least", "rate", "top"), [(12, 8, 2000), (12, 1000, 2000), (5, 1, 7), (30, 4, 3)])
def test_plain(spark, least, rate, top):
    """At a rate of 1000 the sample is empty, and expansion passes find all."""
    rows = odd_rows()
    got = found(phrases.collocations(table(spark, rows).repartition(4), least, top, rate=rate))
    want = plain(rows, least, top)
    assert want and got == want


def test_passes_until_closed(spark):
    """The sample proposes nothing: words, then pairs, then longer phrases prove frequent."""
    rows = [(i, "one two three four five", "en") for i in range(40)]
    miner = phrases._Miner(table(spark, rows), 30, 10**6, "doc_id", "text", "lang")
    counts = [r["f"] for r in miner.named(miner.frequent()).collect()]
    assert counts == [40] * (5 + 4 + 3 + 2) and len(miner.maps) == 4


def test_empty_table(spark):
    assert phrases.collocations(table(spark, [])).collect() == []


def test_long_text_and_ties(spark):
    rows = [(1, "tick tock " * 300_000, "en"), (2, "b a. c d. " * 50, "xx")]
    got = found(phrases.collocations(table(spark, rows)))
    assert [r[2] for r in got if r[0] == "xx"] == ["b a", "c d"]
    en = [r for r in got if r[0] == "en"]
    assert {r[2] for r in en} == {"tick tock tick tock", "tock tick tock tick"} and en[0][6] == 600_000
