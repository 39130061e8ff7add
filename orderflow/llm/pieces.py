"""Token ids of many texts, each distinct piece of text encoded once.

The library's encoders split a text before any merge, so a text may be cut
wherever that split surely has a boundary, and the parts encoded apart:

* before a space that follows a character which is no white space: no pattern
  of the two supported kinds matches across, and none looks back;
* around a newline between two such characters;
* after a run of letters, before an ASCII symbol: letters match as one run.

Texts repeat most of their pieces, so the encoder keeps what it has seen, up to
``PIECE_BYTES``. Texts are split in slices of ``SLICE`` bytes, as the arrays of a
split take many times the bytes of its text. Runs of Latin letters are a single unit of the split; they go to the
library's merge model directly, all other pieces through its whole encoder. Any
tokenizer of another kind is applied to whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orderflow.llm.common import release, spread
from orderflow.llm.jaccard_join import drop_power_tables

#: Latin letters of one or two bytes: letters by any version of Unicode.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"( ?[{_LETTERS}]+)([!-/:-@\[-`{{-~].*)?", re.S)
_LETTER_RUN = re.compile(rf" ?[{_LETTERS}]+")
#: A word that ends with no white space by any definition; letters, then a symbol.
_CLOSED = r"[\pL\pM\pN\pP\pS]\z"
_LETTERS_FIRST = rf"\A(?P<head>[{_LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~](?s:.*))\z"
#: The split of the supported byte-level and word-end kinds (fixed values).
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of pieces and ids remembered by a worker before it starts anew, about,
#: and bytes of text split at a time.
PIECE_BYTES, SLICE = 112 << 20, 3 << 20
#: What a remembered piece takes besides its letters and ids, about.
_ENTRY = 150

_encoders: dict[tuple, "PieceEncoder"] = {}


def encoder(path: str, plain: bool = False) -> "PieceEncoder":
    """The encoder of a tokenizer file; a Python worker holds one at a time.

    With ``plain`` special strings inside texts are ordinary text. A worker that
    other stages used before gives back first what they left.
    """
    if (path, plain) not in _encoders:
        _encoders.clear()
        drop_power_tables()
        release()
        _encoders[path, plain] = PieceEncoder(path, plain)
    return _encoders[path, plain]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _closed(word: str) -> bool:
    """Whether it ends with a character that is white space by no definition."""
    return bool(word) and unicodedata.category(word[-1])[0] not in "ZC"


def _opened(word: str) -> bool:
    return bool(word) and unicodedata.category(word[0])[0] not in "ZCM"


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre, norm, model = conf["pre_tokenizer"] or {}, conf["normalizer"], conf["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and conf["post_processor"] is None
    plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"])
    plain &= not any(re.search(r"\s", t["content"]) for t in conf["added_tokens"])
    # An added token must begin with a symbol, so that no run of letters hides one's start.
    plain &= all(re.match(r"[!-/:-@\[-`{-~]", t["content"]) for t in conf["added_tokens"])
    if not plain:
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "bytes"
    if norm and pre.get("type") == "Sequence":
        names = [n["type"] for n in norm.get("normalizers", [])]
        first, *rest = pre["pretokenizers"]
        if (
            names == ["NFC", "Replace", "Lowercase"]
            and first["type"] == "Split"
            and first["pattern"] == {"Regex": _WORD_SPLIT}
            and [(r["type"], r.get("use_regex"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False, False)]
        ):
            return "words"
    return "whole"


class PieceEncoder:
    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kind = _kind(path)
        self._letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._start = np.zeros(1024, np.int64)
        self._length = np.zeros(1024, np.int64)
        self._ids = np.zeros(8192, np.uint32)
        self._end = self._bytes = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one entry more than texts), and all ids.

        Null is empty. Special strings inside texts are taken as the library
        takes them by default, unless the encoder is a plain one.
        """
        texts = pc.fill_null(texts, "")
        block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        found = [self._encode(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if not found:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        lengths = np.concatenate([np.diff(at) for at, _ in found])
        return np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([ids for _, ids in found])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            lengths = np.array([len(x.ids) for x in found], np.int64)
            ids = np.fromiter((i for x in found for i in x.ids), np.uint32, int(lengths.sum()))
            return np.concatenate([[0], np.cumsum(lengths)]), ids
        if self._bytes > PIECE_BYTES:
            self._clear()
        lists = pc.split_pattern(texts, " ")
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(n_words)
        first = np.zeros(len(word), bool)
        first[ends - n_words] = True
        # A piece begins with a text or after a closed word; other words join it.
        closed = pc.match_substring_regex(words, _CLOSED).to_numpy(zero_copy_only=False)[word]
        begins = first.copy()
        begins[1:] |= closed[:-1]
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(word)))
        # Two parts a piece: its letters, with the space before, and what follows them.
        cut = pc.extract_regex(words, _LETTERS_FIRST)
        heads = pc.dictionary_encode(pc.if_else(cut.is_valid(), pc.struct_field(cut, "head"), words))
        tails = pc.dictionary_encode(pc.if_else(cut.is_valid(), pc.struct_field(cut, "tail"), ""))
        h, t = heads.dictionary.to_pylist(), tails.dictionary.to_pylist()
        head = heads.indices.to_numpy(zero_copy_only=False)[word[starts]]
        tail = tails.indices.to_numpy(zero_copy_only=False)[word[starts]]
        codes = np.empty(2 * len(starts), np.int32)
        codes[0::2] = 2 * head + first[starts]
        codes[1::2] = 2 * len(h) + tail
        n, extra = 2 * len(h) + len(t), {"": 0}
        for k in np.flatnonzero(sizes > 1).tolist():
            a = starts[k]
            text = " ".join(words.take(word[a : a + sizes[k]]).to_pylist())
            text = text if first[a] else " " + text
            codes[2 * k] = n + extra.setdefault(text, len(extra))
            codes[2 * k + 1] = n
        used = np.zeros(n + len(extra), bool)
        used[codes] = True
        alone = np.flatnonzero(used[1 : 2 * len(h) : 2]).tolist()
        spaced = np.flatnonzero(used[0 : 2 * len(h) : 2]).tolist()
        place = np.zeros(len(used), np.int64)
        for at, parts in (
            (2 * np.array(spaced, np.int64), [" " + h[i] for i in spaced]),
            (2 * np.array(alone, np.int64) + 1, [h[i] for i in alone]),
            (2 * len(h) + np.arange(len(t) + len(extra)), [*t, *extra]),
        ):
            place[at] = self._places(parts)
        at = place[codes]
        lengths = self._length[at]
        ids = self._ids[spread(self._start[at], lengths)]
        piece_ends = np.concatenate([[0], np.cumsum(lengths)])
        text_start = 2 * np.searchsorted(starts, np.concatenate([[0], ends]))
        return piece_ends[text_start], ids

    def _places(self, parts: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in parts if p not in self._at))
        if new:
            self._learn(new)
        return np.fromiter(map(self._at.__getitem__, parts), np.int64, len(parts))

    def _learn(self, new: list[str]) -> None:
        runs = {p for p in new if _LETTER_RUN.fullmatch(p)}
        found = {p: self._merge(p) for p in runs}
        cut = {p: self._cut(p) for p in new if p not in runs}
        whole = list({q for qs in cut.values() for q in qs if q not in found})
        for q, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            found[q] = e.ids
        ids = [found[p] if p in runs else [i for q in cut[p] for i in found[q]] for p in new]
        n, first = len(self._at), self._end
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        self._start = _room(self._start, n + len(new))
        self._length = _room(self._length, n + len(new))
        self._ids = _room(self._ids, first + total)
        self._ids[first : first + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self._length[n : n + len(new)] = lengths
        self._start[n : n + len(new)] = first + np.cumsum(lengths) - lengths
        self._end = first + total
        self._bytes += sum(map(len, new)) + 4 * total + _ENTRY * len(new)
        self._at.update(zip(new, range(n, n + len(new)), strict=True))

    def _cut(self, piece: str) -> list[str]:
        """Parts whose ids, one after another, are those of the piece."""
        lines = piece.split("\n")
        if len(lines) == 1:
            return _letters_first(piece)
        if all(map(_closed, lines)) and all(map(_opened, lines[1:])):
            out = _letters_first(lines[0])
            for line in lines[1:]:
                out += ["\n", *_letters_first(line)]
            return out
        return [piece]

    def _merge(self, run: str) -> list[int]:
        if self.kind == "words":
            run = run.lstrip(" ").lower()
        unit = run.encode().decode("latin-1").translate(self._letters)
        return [t.id for t in self.tokenizer.model.tokenize(unit)]


def _letters_first(piece: str) -> list[str]:
    m = _WORD.fullmatch(piece)
    return [g for g in m.groups() if g] if m else [piece]


def _room(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out

