"""Token counts of texts of any length.

Ordinary texts are encoded piece by piece (``pieces``). A huge text is encoded
in overlapping chunks with offsets, so the library never holds the encoding of
more than one chunk; two chunks are spliced at a boundary that both encodings
have inside their overlap and that is proven stable. If they have none there,
the overlap is widened until they do, or until the chunk is the whole rest.

Null texts count as empty. Empty tables give empty results, repeated rows are
counted each for itself, and columns besides the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from orderflow.llm.common import documents, slices
from orderflow.llm.pieces import encoder

#: Characters in a chunk, and in the first overlap that is tried.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10

#: Before a space or newline that follows an ASCII graphic character. The split
#: before merging has a boundary there in any context: its pieces hold white
#: space only at their start, and its patterns look at nothing before them.
_STABLE = re.compile(r"(?<=[!-~])[ \n]")


def stable_boundaries(text: str, start: int, stop: int) -> list[int]:
    return [m.start() for m in _STABLE.finditer(text, max(start, 1), stop)]


def _boundaries(encoding) -> np.ndarray:
    """Character offsets at which a token begins, and the index of that token."""
    return np.array([a for a, _ in encoding.offsets], np.int64)


def encode_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """Ids of a text, a list for each chunk; one after another they are its ids."""
    at, skip = 0, 0  # text before ``at`` is done; the chunk's first ``skip`` tokens are its left neighbour's
    size, wide = chunk, overlap
    left = tokenizer.encode(text[at : at + size], add_special_tokens=False)
    while at + size < len(text):
        stop = at + size
        start = max(at + 1, stop - wide)
        # Stable places in the overlap; the end of a chunk may cut a piece, so
        # the last of them serves as the place to begin the right chunk.
        places = stable_boundaries(text, start, stop)
        right = None
        if places:
            begin = places[0]
            right = tokenizer.encode(text[begin : begin + chunk], add_special_tokens=False)
            common = np.intersect1d(_boundaries(left) + at, _boundaries(right) + begin)
            # Where white space belongs to no token, a token begins after it.
            cuts = [p for p in places if p in common or (p + 1) in common]
            cut = next((p if p in common else p + 1 for p in cuts), None)
            if cut is not None:
                mine, yours = _boundaries(left) + at, _boundaries(right) + begin
                yield left.ids[skip : int(np.searchsorted(mine, cut))]
                skip = int(np.searchsorted(yours, cut))
                at, size, left, wide = begin, chunk, right, overlap
                continue
        if start > at + 1:
            wide *= 2
        else:  # no boundary in the whole chunk: a longer chunk
            size *= 2
            left = tokenizer.encode(text[at : at + size], add_special_tokens=False)
    yield left.ids[skip:]


def count_batch(batch: pa.RecordBatch, column: str, tokenizer_file: str) -> np.ndarray:
    """Tokens of each text of a batch."""
    pieces, out = encoder(tokenizer_file), []
    for part in slices(batch, column):
        texts = pc.fill_null(part.column(column), "")
        huge = np.flatnonzero(pc.utf8_length(texts).to_numpy(zero_copy_only=False) > CHUNK_CHARS)
        if pieces.kind == "whole":
            huge = huge[:0]  # nothing is known of its boundaries
        short = texts
        if len(huge):
            mask = np.zeros(len(texts), bool)
            mask[huge] = True
            short = pc.if_else(pa.array(mask), "", texts)
        counts = np.diff(pieces.encode(short)[0])
        for i in huge.tolist():
            counts[i] = sum(map(len, encode_huge(pieces.tokenizer, texts[i].as_py())))
        out.append(counts)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row. A map; no shuffle."""
    narrow = docs.select(docs[key], docs[text].cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = count_batch(batch, "text", tokenizer_file)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
