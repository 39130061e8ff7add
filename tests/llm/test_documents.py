"""Toxicity, quality, similarity join, repeats, mixing and licences against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from orderflow.llm import jaccard_join, licenses, mixing, quality, suffix_dedup, toxicity
from orderflow.llm.common import Scratch, reachable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


@pytest.fixture(scope="module")
def rng():
    return random.Random(11)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_toxicity_learns_and_holds_out(spark, rng):
    reachable(spark)
    rows = [(i, prose(rng, 60) + (" vile" * rng.randint(1, 2) if i % 6 == 0 else ""), "c") for i in range(900)]
    rows += [(None, "vile words", "c"), (5000, None, "c"), (5001, "", "c"), (5002, "vile " * 5000, "c"), (6, rows[6][1], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    held = got[got.held_out & (got.doc_id < 900)]
    assert len(got) == len(rows) and got.score.between(0, 1).all() and 100 < len(held) < 250
    assert ((held.doc_id % 6 == 0).astype(int) == held.predicted).mean() > 0.97
    assert got[got.doc_id == 5002].predicted.item() == 1 and got[got.doc_id.isin([5000, 5001])].predicted.sum() == 0
    none = toxicity.toxicity(docs, labels.filter("toxic = 7")).toPandas()
    assert (none.score == 0).all()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def base_of(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_and_verdict(spark, rng, monkeypatch):
    good = [prose(rng, 80) for _ in range(150)]
    junk = [" ".join(f"{w}%%%" for w in prose(rng, 80).split()) for _ in range(40)]
    odd = [None, "", " \t\n", "a a a a a a", "x\nx\n \n \nx", "é#|<é\x0bb", "to be or not to be or not", "a b a b a b " * 200, "one", "one two", "one two three"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(good + junk + odd)] + [(0, good[0], True)], "doc_id long, text string, kept boolean")
    trusted = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    for bits in (20, 1):  # the second sends all windows the slower way
        monkeypatch.setattr(quality, "_NUMBER_BITS", bits)
        got = quality.score_documents(docs, trusted).toPandas().sort_values("doc_id", kind="stable")
        assert len(got) == len(good + junk + odd) + 1
        for r in got.itertuples():
            n = base_of((good + junk + odd)[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert got[got.doc_id < 150].kept.all() and not got[got.doc_id.between(150, 189)].kept.any()
    assert quality.score_documents(docs.limit(0), trusted).count() == 0


def test_all_good_labels_count(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 1, 0) AS quality").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 1 AS quality"))
    trusted = quality.trusted_ids(labels)
    assert trusted.count() == 25_000
    docs = spark.range(50_000).selectExpr("id AS doc_id", "'one two' AS text")
    assert quality.log_ratios(docs, trusted).agg({"raw": "sum", "good": "sum"}).first()[:] == (150_000, 75_000)


def ratios_of(texts, trusted):
    """Micro-unit log-ratios by bucket, n-grams of each text: in plain Python, with the hash's own library."""

    def code(words, seed=42):
        for w in words:
            seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
        return (seed - (1 << 64) if seed >> 63 else seed) % quality.BUCKETS

    grams = [[code(g) for g in [(w,) for w in ws] + list(zip(ws, ws[1:], strict=False))] for ws in (WORD.findall(t or "") for _, t in texts)]
    raw = collections.Counter(b for g in grams for b in g)
    good = collections.Counter(b for (i, _), g in zip(texts, grams, strict=True) if i in trusted for b in g)
    r, g = raw.total() + quality.BUCKETS, good.total() + quality.BUCKETS
    return grams, lambda b: round((math.log((good[b] + 1) / g) - math.log((raw[b] + 1) / r)) * 1e6)


@pytest.mark.parametrize("bits", [26, 5])
def test_quality_verdict_by_hand(spark, rng, monkeypatch, bits):
    """With few bits of ids nearly all documents are marked by chance, and the counts stay right."""
    monkeypatch.setattr(quality, "ID_BITS", bits)
    texts = [(i, prose(rng, rng.randint(40, 120))) for i in range(60)] + [(100, "long " * 60_000 + "tail"), (101, None), (None, prose(rng, 60)), (3, prose(rng, 70))]
    trusted = {i for i in range(0, 60, 4)} | {777}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, _first string")
    got = quality.score_documents(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
    grams, ratio = ratios_of(texts, trusted)
    want = []
    for (i, t), g in zip(texts, grams, strict=True):
        total, failed = sum(map(ratio, g)), base_of(t)[0] < 50 or 100 * base_of(t)[4] > 50 * base_of(t)[0]
        want.append((i, round(total / len(g) / 1e6, 4) if g else 0.0, not failed and total >= round(quality.THRESHOLD * 1e6) * len(g)))
    assert sorted(((r.doc_id, round(r.llr, 4), r.kept) for r in got), key=str) == sorted(want, key=str)
    assert {k for *_, k in want} == {True, False}


def components_of(texts):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    top = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = top[a], top[b]
            top = [min(x, y) if v in (x, y) else v for v in top]
    return sets, top


def test_jaccard_components(spark, rng, monkeypatch):
    reachable(spark)
    passage = prose(rng, 40, 5000)
    texts = ["", None, "one", "ONE", "one two", "a b c d e", "A B c d e", " \n "]
    for _ in range(25):
        words = prose(rng, rng.randint(30, 120), 5000).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):  # a chain of copies with more and more edits
            words = words.copy()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    texts += [passage + " " + prose(rng, 60, 5000) for _ in range(30)]
    texts += [prose(random.Random(1), 200, 5000) + f" end{i % 40}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[8], 1)], "doc_id long, text string, n int")
    sets, top = components_of(texts)
    for window in (2_000_000, 500):  # the second flushes often and marks frequent shingles
        monkeypatch.setattr(jaccard_join, "WINDOW", window)
        got = jaccard_join.jaccard_components(docs).toPandas()
        assert len(got) == len(texts) + 1 and got.doc_id.isna().sum() == 1
        for r in got.dropna(subset="doc_id").itertuples():
            assert (r.n_shingles, r.component_id) == (len(sets[int(r.doc_id)]), top[int(r.doc_id)]), texts[int(r.doc_id)]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_rows_of_one_id(spark, rng):
    """Rows that share an id count as one document: each of their texts may link."""
    reachable(spark)
    one, two = prose(rng, 60, 9000), prose(rng, 60, 9000)
    rows = [(1, one), (1, two), (5, two + " x"), (6, one + " y"), (7, prose(rng, 60, 9000)), (7, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1}


def test_few_pairs_are_verified(spark, rng):
    """One leader for a document, no text for pairs that signatures rule out, no posting of settled keys."""
    reachable(spark)
    pairs = spark.createDataFrame([(1, 9), (1, 9), (2, 9), (2, 8), (1, 8), (8, 8)], "a long, b long")
    assert sorted(map(tuple, jaccard_join.best_led(pairs).collect())) == [(1, 8), (1, 9)]
    one = prose(rng, 80, 9000)
    docs = spark.createDataFrame([(1, one), (2, one + " x"), (3, prose(rng, 80, 9000)), (4, None)], "doc_id long, text string")
    join = jaccard_join._Join(docs, "doc_id", "text", jaccard_join.WORDS, jaccard_join.THRESHOLD)
    join.sets()
    asked = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (1, 4)], "a long, b long")
    assert list(map(tuple, join.near(asked).collect())) == [(1, 2)]
    led = [(10, 1, 1), (10, 2, 1), (11, 1, 1), (11, 2, 1), (11, 3, 1), (12, 5, 5), (12, 6, 5)]  # key, id, first
    rows = spark.createDataFrame(led, "key long, id long, first long").selectExpr("*", "cast(9 as int) n", "cast(0 as int) place", "id lead", "2L m")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, label long")
    assert {r.key for r in join.parted(rows, labels).collect()} == {11, 12}


def test_equal_lists_count_once(spark, rng):
    """Of keys with the same postings the first goes on; ids of several texts keep theirs; only signatures asked for travel."""
    reachable(spark)
    passage = prose(rng, 40, 9000)
    texts = [passage + " " + prose(rng, 10, 9000) for _ in range(6)]
    rows = [*enumerate(texts), (9, prose(rng, 40, 9000)), (9, prose(rng, 50, 9000)), (10, "")]
    rows += [(11, rows[6][1] + " x"), (12, rows[6][1] + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard_join._Join(docs, "doc_id", "text", jaccard_join.WORDS, jaccard_join.THRESHOLD)
    sets, frequent = join.sets()
    led = join.led(join.postings(frequent), join.several(sets))
    lists = collections.defaultdict(list)
    for r in led.collect():
        lists[r.key].append((r.id, r.place))
    kept = {r.key for r in join.listed(led).collect()}
    alike = collections.defaultdict(set)
    for key, found in lists.items():
        alike[tuple(sorted(i for i, _ in found))].add(key)
    assert any(len(keys) > 1 for ids, keys in alike.items() if 9 not in ids)
    for ids, keys in alike.items():
        if 9 in ids:
            assert keys <= kept
        else:
            assert keys & kept == {min(keys, key=lambda k: min(lists[k])[1])}
    asked = spark.createDataFrame([(2,), (9,), (10,)], "id long")
    assert sorted(r.id for r in join.signed(asked).collect()) == [2, 9, 9]


def test_open_postings_of_one_id(spark, rng):
    """Without leaders: bit counts never prune a link of any text of an id."""
    reachable(spark)
    one, two, three = (prose(rng, 60, 9000) for _ in range(3))
    rows = [(1, "a few words of no use"), (1, two), (2, one), (2, three), (5, two + " x"), (6, one + " y"), (8, three + " z")]
    join = jaccard_join._Join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", jaccard_join.WORDS, jaccard_join.THRESHOLD)
    postings = join.postings(join.sets()[1])
    pairs = {tuple(r) for r in join.across(postings.withColumn("label", postings.id)).collect()}
    assert pairs == {(1, 5), (2, 6), (2, 8)}


def test_open_postings_of_few_and_many(spark, rng, monkeypatch):
    """Pairs made at once and pairs from tiles hold every link, whatever the number of postings of a key."""
    reachable(spark)
    texts = []
    for _ in range(6):
        words = prose(rng, 80, 9000).split()
        for i in range(8):
            texts.append(" ".join(words))
            words = words.copy()
            words[rng.randrange(len(words))] = f"edit{i}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, _ = components_of(texts)
    links = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    join = jaccard_join._Join(docs, "doc_id", "text", jaccard_join.WORDS, jaccard_join.THRESHOLD)
    postings = join.postings(join.sets()[1])
    rows = postings.withColumn("label", postings.id)
    for few in (32, 4, 1):
        monkeypatch.setattr(jaccard_join, "FEW", few)
        join.scratch = Scratch(spark, "jaccard")
        pairs = {tuple(sorted(r)) for r in join.across(rows).collect()}
        assert links <= pairs
        assert all(a // 8 == b // 8 for a, b in pairs)


def test_first_places_bound_the_overlap():
    """A pair that meets late in both prefixes cannot link; sizes beyond 32 bits of a product still can."""
    one = np.ones(2, np.int64)
    columns = [one, np.array([1, 2]), np.full(2, 100, np.int32), np.array([3, 20], np.int32), np.array([1, 2])]
    assert [x.tolist() for x in jaccard_join._paired(columns, (75, 100))] == [[]]  # 80 of 120 at most
    columns[3] = np.array([3, 14], np.int32)
    assert [x.tolist() for x in jaccard_join._paired(columns, (75, 100))] == [[[1, 2]]]  # 86 of 114
    large = np.array([22_000_000], np.int32), np.array([28_000_000], np.int32)
    assert jaccard_join._compatible(*large).all()


def test_whole_keys():
    """No key is cut, however batches cut it."""
    key = np.repeat([1, 2, 3, 4, 5], [3, 1, 9, 1, 2])
    for step in (1, 2, 3, 5, 20):
        batches = [pa.record_batch({"key": key[i : i + step], "id": np.arange(len(key))[i : i + step]}) for i in range(0, len(key), step)]
        groups = list(jaccard_join._whole_keys(batches, ["key", "id"]))
        assert np.concatenate([g[1] for g in groups]).tolist() == list(range(len(key)))
        seen = [set(g[0].tolist()) for g in groups]
        assert sum(map(len, seen)) == 5


def kept_of(values, length):
    seen = collections.Counter(v[i : i + length] for v in values for i in range(len(v) - length + 1))
    out = []
    for v in values:
        gone = np.zeros(len(v) + 1, bool)
        for i in range(len(v) - length + 1):
            if seen[v[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(v), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(v, gone) if not g)).hexdigest()))
    return out


def test_repeats(spark, rng):
    reachable(spark)
    shared = [prose(rng, 200, 10**6) for _ in range(3)]
    texts = [None, "", "short", "ab" * 700, "q" * 1500, "q" * 399, "é" * 500]
    for _ in range(30):
        parts = [prose(rng, rng.randint(1, 120), 10**6)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 300)
            parts += [s[a : a + rng.randint(300, 900)], prose(rng, rng.randint(0, 50), 10**6)]
        texts.append(" ".join(parts))
    texts += [texts[8], texts[9]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, shared[0], 0)], "doc_id long, text string, hash int")
    want = kept_of([(t or "").encode() for t in [*texts, shared[0]]], 400)
    got = suffix_dedup.remove_repeats(docs, with_text=False).toPandas()
    got = got.assign(doc_id=got.doc_id.fillna(len(texts)).astype(int)).sort_values("doc_id")
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want
    full = suffix_dedup.remove_repeats(docs, carry=("hash", "text")).filter("n_removed = 0").toPandas()
    assert (full.kept == full.text.fillna("")).all()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_strings_of_a_block(rng):
    data = bytes(rng.choices(b"ab", k=300)) * 2 + b"x" * 900 + bytes(rng.choices(b"abc", k=500))
    text = np.frombuffer(data, np.uint8)
    for length in (400, 200):  # ranks of the sample; names of all periods
        starts = np.arange(len(text) - length + 1)
        seen = collections.Counter(data[i : i + length] for i in starts)
        assert suffix_dedup.repeated_strings(text, starts, length).tolist() == [seen[data[i : i + length]] > 1 for i in starts]


def test_difference_cover():
    cover = set(suffix_dedup.COVER.tolist())
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


def lag(slots, weights):
    """Largest deviation of any source from its share over a list of sources by slot."""
    done, total, worst = collections.Counter(), sum(weights.values()), 0
    for t, s in enumerate(slots, 1):
        done[s] += 1
        worst = max(worst, *(abs(done[x] - weights[x] / total * t) for x in weights))
    return worst


def test_schedule_deviates_by_less_than_a_block(rng):
    for _ in range(30):
        weights = {f"s{i}": rng.random() + 0.01 for i in range(rng.randint(1, 12))}
        shares = mixing.whole_shares(weights, 200)
        slots = mixing.one_period(shares)
        by_slot = [s for _, s in sorted((t, s) for s, ts in slots.items() for t in ts)]
        assert sum(shares.values()) == len(by_slot) == 200 and lag(by_slot, shares) < 1


def test_mixing(spark, rng):
    rows = [(i, "big") for i in range(500)] + [(1000 + i, "mid") for i in range(90)] + [(2000 + i, None) for i in range(37)]
    rows += [(7, "twin"), (7, "twin"), (None, "twin"), (3000, "untargeted")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, slot string")
    weights = {"big": 3.0, "mid": 2.0, None: 1.0, "twin": 0.5}
    got = mixing.mix(docs, weights, block_rows=5, period=40).toPandas().sort_values("position")
    assert list(got.position) == list(range(len(rows))) and "_slot" in got
    assert got.groupby("_slot").source.nunique(dropna=False).max() == 1
    assert sorted(got.doc_id.fillna(-1).astype(int)) == sorted(-1 if r[0] is None else r[0] for r in rows)
    blocks = got.drop_duplicates("_slot").source.tolist()
    first_out = next(i for i in range(len(blocks)) if blocks[: i + 1].count("twin") == 1 and i >= 0)
    shares = mixing.whole_shares(weights, 40)
    assert lag([None if s != s or s is None else s for s in blocks[:first_out]], shares) < 1
    assert got.source.iloc[-1] == "untargeted"
    again = mixing.mix(docs.repartition(7), weights, block_rows=5, period=40).toPandas().sort_values("position")
    assert again.source.fillna("").tolist() == got.source.fillna("").tolist()
    assert mixing.mix(docs.limit(0)).count() == 0


def target_lag(slots, weights):
    """The most that any source is ever off its target, in blocks."""
    total, worst, done = sum(map(Fraction, weights.values())), 0, dict.fromkeys(weights, 0)
    for t, s in enumerate(slots, 1):
        done[s] += 1
        worst = max(worst, *(abs(done[x] - t * Fraction(w) / total) for x, w in weights.items()))
    return worst


def test_mixture_keeps_to_the_target_weights():
    # Far longer than a period of 1000 slots, and weights that no 1000 slots can hold.
    for weights in ({"a": 0.7123, "b": 0.2001, "c": 0.0876}, {"hot": 157.8, **{f"m{i}": 40.0 for i in range(20)}, **{f"t{i}": 0.9 for i in range(30)}}):
        slots = itertools.islice(mixing.schedule(dict.fromkeys(weights, 10**6), weights), 8000)
        assert target_lag([s for s, _ in slots], weights) < 1


def test_mixing_of_many_sources(spark, monkeypatch):
    counts = {f"s{i}": 17 + i % 3 for i in range(1200)} | {"hot": 4000}
    docs = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string")
    monkeypatch.setattr(mixing, "SLOTS", 700)  # several tables of places
    got = mixing.mix(docs).toPandas().sort_values("position")
    assert list(got.position) == list(range(sum(counts.values()))) and got.groupby("source").size().to_dict() == counts
    blocks = got.drop_duplicates("slot")
    assert list(blocks.slot) == list(range(len(blocks))) and got.groupby("slot").source.nunique().max() == 1
    left, order = {s: -(-n // 16) for s, n in counts.items()}, blocks.source.tolist()
    first_out = next(i for i, s in enumerate(order) if left.update({s: left[s] - 1}) or not left[s])
    assert target_lag(order[:first_out], {s: math.sqrt(n) for s, n in counts.items()}) < 1


def test_expressions():
    parse, evaluate = licenses.parse, licenses.evaluate
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse("(MIT OR GPL-2.0+) AND isc */") == ["mit", "gpl-2.0+", "or", "isc", "and"]
    assert parse("GPL-2.0 WITH Classpath-exception-2.0 or MIT") == ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]
    assert parse("(mit or") is None and parse("") is None and parse("and mit") is None and parse("MIT or") == ["mit"]
    assert parse("see the file LICENSE") is None and parse("NONE") is None and parse("mitigated") is None
    assert parse("LicenseRef-Own AND MIT, see LICENSE") == ["licenseref-own", "mit", "and"]
    assert evaluate(parse("GPL-2.0 WITH Some-exception"), {"mit"}) == (False, {"gpl"})
    assert len(parse("(" * 5000 + "mit" + ")" * 5000)) == 1
    assert evaluate(parse("GPL-3.0 OR MIT"), {"mit"}) == (True, {"gpl", "mit"})
    assert evaluate(parse("GPL-3.0 AND MIT"), {"mit"}) == (False, {"gpl", "mit"})


def test_licenses(spark, rng):
    reachable(spark)
    pieces = ["MIT", "license", "License,", "apache", "general", "public", "GENERAL-PUBLIC", "x", "é", "\n", "mit  license", "# SPDX-License-Identifier: MIT OR GPL-2.0\n", "2"]
    texts = [None, "", "mit license", "mit license", "SPDX-License-Identifier: see the file LICENSE", "a mit license mit license b", "é mit\tlicense", "bad\n// SPDX-License-Identifier: AND\n", "x" * 100_000 + " apache license"]
    texts += [" ".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in licenses.scan_licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r.doc_id] or ""))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        own = set(filter(None, r.labels.split(",")))
        assert labels <= own and 0 <= r.score <= 1 and ("spdx" not in lower(texts[r.doc_id] or "") or r.score > 0)
        assert "see" not in own
        if "MIT OR GPL-2.0" in (texts[r.doc_id] or ""):
            assert {"mit", "gpl"} <= own
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
