"""Licence scans: identifier tags and notice phrases, and licence expressions.

Texts are lower-cased (A-Z) and cut into words; an Aho-Corasick automaton over
the words, joined by one space, finds all phrases in one pass, however many
there are. Expressions after an identifier tag are read by a shunting-yard
parser (``with`` binds closest, then ``and``, then ``or``) and evaluated
against a set of permissive licences.

A tag counts with the known identifiers of its expression (``FAMILIES``) and with
references of one's own (``LicenseRef-...``); a tag before other words is a bad
one, and gives no label.

Null and empty texts have no words and no labels (empty strings, score 0);
rows, repeated ones too, are scanned each for itself; empty tables give no rows;
texts may have any length; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orderflow.llm.common import documents, slices, text_bytes

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
    "all rights reserved": "proprietary",
}
#: Words of the tag that an expression follows.
TAGS = ("spdx license identifier", "license expression")
PERMISSIVE = {"mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "bsl"}
#: Identifiers to labels, by their beginning; the first that fits.
FAMILIES = (
    ("mit", "mit"), ("x11", "mit"), ("apache", "apache"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("mpl", "mpl"), ("epl", "epl"),
    ("bsd", "bsd"), ("0bsd", "bsd"), ("isc", "isc"), ("bsl", "bsl"), ("cc0", "cc0"), ("cc-by", "cc-by"), ("unlicense", "unlicense"), ("zlib", "zlib"),
)
#: How much each kind of evidence says by itself.
_WEIGHT = {"base": 0.5, "notice": 0.6, "tag": 0.9, "bad tag": 0.3}

_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_WORDS = bytes(b if _WORD_BYTES[b] else 32 for b in _LOWER)
_TAG_LINE = re.compile(r"(?:spdx-license-identifier|license-expression)[ \t]*[:=][ \t]*([^\n\r]*)")


def family(identifier: str) -> str | None:
    """Label of an identifier; references of one's own stand for themselves, other words are none."""
    for start, label in FAMILIES:
        if identifier.startswith(start) and identifier[len(start) : len(start) + 1] in ("", *"-.+v0123456789"):
            return label
    return identifier.rstrip("+") if re.fullmatch(r"licenseref-.+", identifier) else None


def parse(expression: str) -> list[str] | None:
    """The longest leading part of a text that is an expression, in postfix order; None if none is.

    Operands are known identifiers, or what follows ``with``; trailing words that
    do not continue the expression (the rest of a comment) are ignored. Expressions nest to any depth; the parser does not recurse.
    """
    tokens = [m.group() for m in _TOKEN.finditer(expression.lower())]
    best, out, stack, want, depth, exception = None, [], [], True, 0, False
    for t in tokens:
        if want:
            if t == "(":
                stack.append(t)
                depth += 1
            elif t in _RANK or t == ")" or not (exception or family(t)):
                break
            else:
                out.append(t)
                want = False
        elif t in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            want, exception = True, t == "with"
        elif t == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
        if not want and not depth:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str], allowed: set[str]) -> tuple[bool, set[str]]:
    """Whether the allowed labels satisfy an expression, and all labels in it."""
    stack: list[tuple[bool, set[str], str]] = []
    for t in postfix:
        if t in _RANK:
            b, a = stack.pop(), stack.pop()
            if t == "with":  # an exception only adds permissions
                stack.append(a)
            else:
                stack.append((a[0] and b[0] if t == "and" else a[0] or b[0], a[1] | b[1], ""))
        else:
            stack.append((family(t) in allowed, {family(t)}, t))
    return stack[0][:2]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrases, what in ((NOTICES.items(), "notice"), (BASE.items(), "base"), (((t, "") for t in TAGS), "tag")):
        for phrase, label in phrases:
            at = f" {phrase} "
            found.add_word(at, [*found.get(at, []), (what, label, len(phrase))])
    found.make_automaton()
    return found


def scan(words: str, text, machine) -> tuple:
    """n_base, first_word, last_word, base_labels, labels, score, permissive of one text.

    ``words``: its words with a space before, between and after them; ``text``:
    a function that gives the lower-cased text, asked only where a tag is found.
    """
    base, notices, starts, tag = set(), set(), [], False
    for end, hits in machine.iter(words):
        for what, label, size in hits:
            if what == "base":
                base.add(label)
                starts.append(end - size)  # of the phrase's first character
            elif what == "notice":
                notices.add(label)
            else:
                tag = True
    evidence, tagged, permissive = set(), set(), []
    if tag:
        for m in _TAG_LINE.finditer(text()):
            postfix = parse(m.group(1))
            if postfix is None:
                evidence.add("bad tag")
                continue
            good, labels = evaluate(postfix, PERMISSIVE)
            evidence.add("tag")
            tagged |= labels
            permissive.append(good)
    evidence |= ({"base"} if base else set()) | ({"notice"} if notices else set())
    labels = base | notices | tagged
    rest = 1.0
    for e in sorted(evidence):
        rest *= 1 - _WEIGHT[e]
    allowed = None
    if labels:
        allowed = all(permissive) and (base | notices) <= PERMISSIVE
    if starts:
        # Word numbers from the spaces before them.
        spaces = np.flatnonzero(np.frombuffer(words.encode("latin-1"), np.uint8) == 32)
        first, last = (int(np.searchsorted(spaces, x)) - 1 for x in (min(starts), max(starts)))
    else:
        first = last = None
    return len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - rest, allowed


def count_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each lower-cased text in an array of all their bytes."""
    inside = _WORD_BYTES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = inside[edges]
    return np.diff(np.r_[0, np.cumsum(begins, dtype=np.int64)][at])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``scan`` and n_words for each row. A map; no shuffle."""
    narrow = docs.select(docs[key], docs[text].cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    columns = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permissive": pa.bool_()}

    def run(batches):
        machine = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                lower = np.frombuffer(_LOWER, np.uint8)[data]
                raw, places = lower.tobytes(), at.tolist()
                rows = []
                for a, b in zip(places, places[1:], strict=False):
                    own = raw[a:b]
                    words = b" %s " % b" ".join(own.translate(_TO_WORDS).split())
                    rows.append(scan(words.decode("latin-1"), lambda own=own: own.decode("latin-1"), machine))
                found = list(zip(*rows, strict=True))
                arrays = [pa.array(x, t) for x, t in zip(found, columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_words(lower, at)), *arrays], [key, "n_words", *columns])

    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
    return narrow.mapInArrow(run, f"`{key}` {kind}, {kinds}")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
