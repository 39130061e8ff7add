"""Alignment of the tokens of two tokenizers on the same text.

Both see the text with a space before it: a byte-level BPE (A) and a
sentencepiece model (B). After both have encoded a whole text, the places where
both have a token end, and where both next tokens carry a space, are anchors:
ends shared by both, verified by the bytes of the tokens. They split the text
into short windows of token ids. A window's alignment follows from its ids
alone, so each worker keeps it by the two tuples of ids and most windows are
only looked up.

How often two tokens are linked is counted in documents, over all of them:

1. A part (about ``PART`` bytes of texts of one task) sends its distinct pairs
   with the number of its documents that hold them, in packed rows by buckets of
   pairs; buckets add them up. A frequent pair is sent once by a part.
2. The pairs of each A id are compared, and every part is answered with the
   count of its pairs and whether it is the highest of its A id.
3. Documents, kept with their pairs in the shared folder, meet their part's answer.

Null and empty texts, and texts whose tokens don't give back the text (white
space that a tokenizer drops, say), have no tokens: zeros and an empty hash. Rows
with equal ids are documents of their own; a null id stays null. A long text
without spaces is one window. Empty tables give empty results; columns besides key and text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, mix, slices, spread, text_bytes
from orderflow.llm.packed import binary, bucket_bits, bucket_cuts, runs, unpacked
from orderflow.llm.pieces import _byte_letters, encoder

#: Bytes of text aligned together, and of a part, about.
SLICE, PART = 2 << 20, 8 << 20
#: Bytes of windows a worker remembers before it starts anew, and of an entry besides its ids and text, about.
KEPT_BYTES, _ENTRY = 64 << 20, 220
_B_BITS = 20

_aligners: dict[tuple[str, str], "Aligner"] = {}


class _Bytes:
    """The bytes of every token id."""

    def __init__(self, tokens: list[bytes], spaced: list[bool]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array(spaced, bool)

    def same(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Whether each text's tokens (ids[at[i]:at[i + 1]]) join to its bytes."""
        total = np.r_[0, np.cumsum(self.length[ids])]
        fits = np.diff(total[at]) == np.diff(text_at)
        keep = np.repeat(fits, np.diff(at))
        joined = self.data[spread(self.start[ids[keep]], self.length[ids[keep]])]
        own = data[np.repeat(fits, np.diff(text_at))]
        wrong = np.r_[0, np.cumsum(joined != own)]
        ends = np.cumsum(np.where(fits, np.diff(text_at), 0))
        return fits & (np.diff(np.r_[0, wrong[ends]]) == 0)


def _find(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which ends are among the others, too."""
    return others[np.minimum(np.searchsorted(others, ends), len(others) - 1)] == ends


def align(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, decimal: _Bytes):
    """Of windows one after another, each with as many bytes of A as of B tokens: groups and
    links of each, all links (A id, B id in one number), and the text of each window's groups."""
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    ends = np.union1d(a_end, b_end)
    links = a[np.searchsorted(a_end, ends)] << _B_BITS | b[np.searchsorted(b_end, ends)]
    a_last, b_last = _find(a_end, b_end), _find(b_end, a_end)  # the last token of a group
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    stop = a_end[a_stop - 1]
    n_groups = np.diff(np.r_[0, np.cumsum(a_last)[a_stop - 1]])
    n_links = np.diff(np.r_[0, np.searchsorted(ends, stop, side="right")])
    # Group by group: the A tokens, then the B tokens.
    a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group, side="left")
    b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[a_place], ids[b_place] = a, b
    mark[a_place], mark[b_place] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
    size = decimal.length[ids]
    text, at = decimal.data[spread(decimal.start[ids], size)], np.cumsum(size)
    text[at - 1] = mark  # each number ends with a place for its mark
    raw, cuts = text.tobytes(), at[a_stop + b_stop - 1].tolist()
    return n_groups, n_links, links, [raw[i : j - 1] for i, j in zip([0, *cuts], cuts, strict=False)]


class _Pieces:
    """Ids of texts by a sentencepiece model that takes white space as part of the next piece.

    No piece of such a model goes on behind a space, so the words of a text, parted
    by single spaces, are encoded apart, each distinct one once. Texts with other
    spaces, or with the model's own mark, go to the library whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any("▁" in n.lstrip("▁") for n in names)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.length, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.kept = 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts, num_threads=1) if texts else []
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return length, np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum()))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and all ids."""
        if self.kept > KEPT_BYTES:
            self._clear()
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.at]
        if new:
            length, ids = self._whole(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
            self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids])
            self.kept += sum(map(len, new)) + 8 * len(ids) + _ENTRY * len(new)
        number = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        word = number[coded.indices.to_numpy(zero_copy_only=False)]
        sums = np.r_[0, np.cumsum(self.length[word])]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return np.diff(sums[np.r_[0, ends]]), self.ids[spread(self.start[word], self.length[word])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin, with the end, and all ids; no text may be null."""
        odd = pc.match_substring_regex(texts, "^ |  | $|▁|^$") if self.apart else pa.array([True] * len(texts))
        odd = odd.to_numpy(zero_copy_only=False)
        count = np.zeros(len(texts), np.int64)
        parts = []
        for mask, way in ((~odd, self._words), (odd, lambda x: self._whole(x.to_pylist()))):
            if mask.any():
                count[mask], ids = way(texts.filter(pa.array(mask)))
                parts.append((mask, ids))
        at = np.r_[0, np.cumsum(count)]
        out = np.zeros(int(at[-1]), np.int64)
        for mask, ids in parts:
            out[np.repeat(mask, count)] = ids
        return at, out


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = encoder(a_file, plain=True), _Pieces(b_file)
        letter = {c: b for b, c in _byte_letters().items()}
        known = self.a.tokenizer.get_vocab(True)
        tokens = [b""] * (max(known.values(), default=-1) + 1)
        for t, i in known.items():
            tokens[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        self.a_bytes = _Bytes(tokens, [t[:1] == b" " for t in tokens])
        model = self.b.model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = _Bytes(tokens, [p[:1] == "▁" for p in pieces])
        size = max(len(self.a_bytes.length), len(self.b_bytes.length))
        self.decimal = _Bytes([b"%d," % i for i in range(size)], [])
        self._clear()

    def _clear(self) -> None:
        self.windows: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.kept = 0
        self.numbers = [np.zeros(0, np.int64) for _ in range(3)]  # groups and links of a window, where its links begin
        self.links = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array):
        """Tokens of both, without those of texts that have none: ids and where each text's begin, twice."""
        texts = pc.fill_null(texts, "")
        filled = pc.not_equal(texts, "")
        spaced = pc.if_else(filled, pc.binary_join_element_wise(" ", texts, ""), "")
        data, text_at = text_bytes(spaced)
        a_at, a = self.a.encode(spaced)
        b_at, b = self.b.encode(texts)
        a = a.astype(np.int64)
        good = filled.to_numpy(zero_copy_only=False) & self.a_bytes.same(a, a_at, data, text_at) & self.b_bytes.same(b, b_at, data, text_at)
        out = []
        for ids, at in ((a, a_at), (b, b_at)):
            n = np.where(good, np.diff(at), 0)
            out += [ids[np.repeat(good, np.diff(at))], np.r_[0, np.cumsum(n)]]
        return out

    def known(self, a: np.ndarray, b: np.ndarray, a_from, a_stop, b_from, b_stop) -> np.ndarray:
        """Numbers of these windows; those not met before are aligned, all together."""
        if self.kept > KEPT_BYTES:
            self._clear()
        la, lb = a_stop - a_from, b_stop - b_from
        end = np.cumsum(la + lb + 1)
        at = end - (la + lb + 1)
        ids = np.full(int(end[-1]), -1, np.int32)
        ids[spread(at, la)] = a[spread(a_from, la)]
        ids[spread(at + la + 1, lb)] = b[spread(b_from, lb)]
        raw = ids.tobytes()
        keys = [raw[i:j] for i, j in zip((4 * at).tolist(), (4 * end).tolist(), strict=True)]
        number = np.array([self.windows.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            own_a, own_b = a[spread(a_from[new], la[new])], b[spread(b_from[new], lb[new])]
            found = align(own_a, own_b, self.a_bytes.length[own_a], self.b_bytes.length[own_b], np.cumsum(la[new]), np.cumsum(lb[new]), self.decimal)
            n_groups, n_links, links, texts = found
            number[new] = len(self.texts) + np.arange(len(new))
            self.windows.update(zip([keys[i] for i in new.tolist()], number[new].tolist(), strict=True))
            first = len(self.links) + np.cumsum(n_links) - n_links
            self.numbers = [np.concatenate(x) for x in zip(self.numbers, (n_groups, n_links, first), strict=True)]
            self.links = np.concatenate([self.links, links])
            self.texts += texts
            self.kept += 4 * int((la + lb)[new].sum()) + sum(map(len, texts)) + 8 * len(links) + _ENTRY * len(new)
        return number

    def batch(self, texts: pa.Array):
        """For each text n_a, n_b, n_groups, n_links and hash; and (text, pair, times) of its distinct pairs."""
        a, a_at, b, b_at = self.encode(texts)
        n = len(texts)
        if not len(a):
            none = np.zeros(n, np.int64)
            return [none] * 4, [""] * n, [none[:0]] * 3
        a_end, b_end = np.cumsum(self.a_bytes.length[a]), np.cumsum(self.b_bytes.length[b])
        # Anchors: an end of both, before tokens that both carry a space, or the end of a text.
        place = np.minimum(np.searchsorted(b_end, a_end), len(b) - 1)
        shared = b_end[place] == a_end
        before_space = np.r_[self.a_bytes.spaced[a[1:]], True] & np.r_[self.b_bytes.spaced[b[1:]], True][place]
        before_space[a_at[1:][np.diff(a_at) > 0] - 1] = True
        cut = np.flatnonzero(shared & before_space)
        a_stop, b_stop = cut + 1, place[cut] + 1
        a_from, b_from = np.r_[0, a_stop[:-1]], np.r_[0, b_stop[:-1]]
        seed = np.uint64(0x9E3779B97F4A7C15)
        name = np.zeros(len(cut), np.uint64)
        for ids, begin, stop in ((a, a_from, a_stop), (b, b_from, b_stop)):
            nth = (np.arange(len(ids)) - np.repeat(begin, stop - begin)).astype(np.uint64)
            name = mix(name + np.add.reduceat(mix(ids.astype(np.uint64) + (nth + np.uint64(1)) * seed), begin) + (stop - begin).astype(np.uint64))
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        number = self.known(a, b, a_from[one], a_stop[one], b_from[one], b_stop[one])
        groups, n_of, first = (x[number] for x in self.numbers)
        groups, links = groups[which], n_of[which]
        window_at = np.searchsorted(a_stop, a_at, side="right")  # windows that end by there
        sums = [np.r_[0, np.cumsum(x)] for x in (groups, links)]
        columns = [np.diff(a_at), np.diff(b_at), *(np.diff(s[window_at]) for s in sums)]
        words, at = list(map(self.texts.__getitem__, number[which].tolist())), window_at.tolist()
        digest = [hashlib.sha256(b";".join(words[i:j])).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]
        code, place = np.unique(self.links[spread(first, n_of)], return_inverse=True)
        own = place[spread((np.cumsum(n_of) - n_of)[which], links)]
        text = np.repeat(np.repeat(np.arange(n), np.diff(window_at)), links)
        both, times = np.unique(text * len(code) + own, return_counts=True)
        return columns, digest, [both // len(code), code[both % len(code)], times]


def aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _aligners:
        _aligners.clear()
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


_OUT = ["n_a", "n_b", "n_groups", "n_links"]
_SPLIT = "part long, bucket int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _part_rows(part: int, bits: int, ids: list[pa.Array], found: list) -> pa.RecordBatch:
    """Rows of a part: its pairs by bucket, and its documents with the places of their pairs."""
    columns = [np.concatenate([f[0][k] for f in found]) for k in range(4)]
    shift = np.r_[0, np.cumsum([len(f[1]) for f in found])]
    text = np.concatenate([f[2][0] + s for f, s in zip(found, shift.tolist(), strict=False)])
    code, times = (np.concatenate([f[2][k] for f in found]) for k in (1, 2))
    value, number = np.unique(mix(code.astype(np.uint64)), return_inverse=True)
    pair = np.empty(len(value), np.int64)
    pair[number] = code
    docs = np.bincount(number, minlength=len(value)).astype(np.uint32)  # a document has a pair once here
    bucket, cuts = bucket_cuts(value, bits)
    n, m = len(bucket), int(shift[-1])
    text_at = np.searchsorted(text, np.arange(m + 1))
    none = [pa.array([None] * n, pa.int64())]
    arrays = [
        pa.array(np.full(n + m, part)),
        pa.concat_arrays([pa.array(bucket), pa.array([None] * m, pa.int32())]),
        pa.concat_arrays(none + ids),
        *(pa.concat_arrays([*none, pa.array(c)]) for c in columns),
        pa.array([None] * n + [d for f in found for d in f[1]], pa.string()),
        pa.concat_arrays([binary(pair, cuts), binary(number.astype(np.uint32), text_at)]),
        pa.concat_arrays([binary(docs, cuts), binary(times.astype(np.uint32), text_at)]),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["part", "bucket", "id", *_OUT, "groups_sha256", "pairs", "times"])


def align_tokens(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    spark, bits = docs.sparkSession, bucket_bits(docs)
    scratch = Scratch(spark, "alignment")
    narrow = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))

    def run(batches):
        work, task, nth = aligner(a_file, b_file), TaskContext.get().partitionId(), 0
        ids, found, size = [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                ids.append(piece.column("id"))
                found.append(work.batch(piece.column("text")))
                size += piece.column("text").nbytes
                if size >= PART:
                    yield _part_rows((task << 32) + nth, bits, ids, found)
                    ids, found, size, nth = [], [], 0, nth + 1
        if ids:
            yield _part_rows((task << 32) + nth, bits, ids, found)

    split = scratch.keep(narrow.mapInArrow(run, _SPLIT), "split", "zstd")
    asked = split.filter("bucket IS NOT NULL").select("bucket", "part", "pairs", "times")

    def add(table: pa.Table) -> pa.Table:
        pair, n = unpacked(table.column("pairs"), np.int64), unpacked(table.column("times"), np.uint32)
        order = np.argsort(pair, kind="stable")
        first = runs(pair[order])
        sums = np.add.reduceat(n[order].astype(np.int64), first)
        return pa.table([table.column("bucket")[:1].take(pa.array(np.zeros(len(first), np.int64))), pa.array(pair[order][first]), pa.array(sums)], ["bucket", "pair", "n"])

    counts = scratch.keep(asked.groupBy("bucket").applyInArrow(add, "bucket int, pair long, n long"), "counts")
    of = F.shiftright("pair", _B_BITS)
    highest = counts.groupBy(of.alias("a")).agg(F.max("n").alias("highest"))
    known = counts.join(highest, of == F.col("a")).select("bucket", "pair", "n", (F.col("n") == F.col("highest")).alias("best"))

    def answer(asks: pa.Table, table: pa.Table) -> pa.Table:
        pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order]
        rows = []
        for raw in asks.column("pairs").to_pylist():
            place = np.searchsorted(pair, np.frombuffer(raw, np.int64))
            rows.append((n[place].tobytes(), np.packbits(best[place]).tobytes()))
        return pa.table([asks.column("part"), asks.column("bucket"), *(pa.array(list(x), pa.binary()) for x in zip(*rows, strict=True))], ["part", "bucket", "counts", "best"])

    answers = asked.select("bucket", "part", "pairs").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "part long, bucket int, counts binary, best binary")

    def finish(rows: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("bucket")
        n = unpacked(got.column("counts"), np.int64)
        best = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(c) // 8) for b, c in zip(got.column("best").to_pylist(), got.column("counts").to_pylist(), strict=True)]
        best = np.concatenate(best).astype(np.int64) if best else n
        sums = []
        for pairs, times in zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist(), strict=True):
            p, t = np.frombuffer(pairs, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
            sums.append((int(best[p] @ t), int(n[p] @ t)))
        added = zip(*sums, strict=True) if sums else ((), ())
        return pa.table([rows.column("id"), *(rows.column(c) for c in _OUT), *(pa.array(list(x), pa.int64()) for x in added), rows.column("groups_sha256")], ["id", *_OUT, "n_best", "count_sum", "groups_sha256"])

    rows = split.filter("bucket IS NULL").drop("bucket")
    kinds = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, kinds).withColumnRenamed("id", key)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
