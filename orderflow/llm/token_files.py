"""Token ids in flat binary files with 64-bit document offsets.

A corpus is a folder of parts, each of two files that can be mapped:

* ``<part>.ids``: unsigned little-endian integers, 2 bytes each if the vocabulary
  allows, else 4;
* ``<part>.idx``: for each document two signed 64-bit integers, its id and the
  place of its first token in the part, then one closing pair.

The manifest has a row for each part: path, width, documents, tokens and, as
a prefix sum over the parts before it, the base to which its offsets are
relative. Texts are dealt out by ranges of document ids and sorted, so parts
and documents in them are in ascending order of id (null ids first).

Every attempt of a task writes files of its own name, and only those of the
attempt whose manifest row Spark committed are ever read. Null texts are
empty; repeated ids and rows are written each for itself; an empty table gives
an empty manifest.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, documents, slices
from orderflow.llm.pieces import encoder
from orderflow.session import input_bytes

PART_BYTES = 64 << 20
#: Stands for a null document id in the index.
NULL_ID = -(1 << 63)
#: Tokens looked at in one step when a part is read.
READ_TOKENS = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int | None, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the corpus below the scratch folder; returns the manifest."""
    spark, folder = docs.sparkSession, f"{scratch.folder}/parts"
    narrow = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    size = input_bytes(docs) or 0
    known = size if size < 1 << 60 else 0  # Spark gives tables of unknown size a huge one
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / PART_BYTES))
    dealt = narrow.repartitionByRange(n, "key").sortWithinPartitions("key")

    def run(batches):
        pieces = encoder(tokenizer_file)
        wide = max(pieces.tokenizer.get_vocab_size(True) - 1, end_id or 0) >= 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        store, top, ids_file = None, "", None
        keys, places, total = [], [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                at, ids = pieces.encode(piece.column("text"))
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                if ids_file is None:
                    store, top = _open(folder)
                    store.create_dir(top)
                    ids_file = store.open_output_stream(f"{top}/{name}.ids")
                ids_file.write(ids.astype(kind).tobytes())
                keys.append(pc.fill_null(piece.column("key"), NULL_ID).to_numpy(zero_copy_only=False))
                places.append(at[:-1] + total)
                total += int(at[-1])
        if ids_file is None:
            return
        ids_file.close()
        index = np.array([np.append(np.concatenate(keys), 0), np.append(np.concatenate(places), total)], "<i8").T
        with store.open_output_stream(f"{top}/{name}.idx") as f:
            f.write(np.ascontiguousarray(index).tobytes())
        row = [[part], [f"{folder}/{name}"], [kind.itemsize], [len(index) - 1], [total]]
        yield pa.RecordBatch.from_pydict(dict(zip(("part", "path", "width", "n_docs", "n_tokens"), row, strict=True)))

    written = scratch.keep(dealt.mapInArrow(run, "part long, path string, width long, n_docs long, n_tokens long"), "manifest")
    # One row for each file: small enough for one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def map_part(path: str, width: int):
    """Index (documents + 1 pairs) and ids of a part; local files are mapped, others read."""
    from pyarrow import fs

    store, top = _open(path)
    kind = "<u2" if width == 2 else "<u4"
    if isinstance(store, fs.LocalFileSystem):
        empty = store.get_file_info(f"{top}.ids").size == 0
        ids = np.zeros(0, kind) if empty else np.memmap(f"{top}.ids", kind, "r")
        return np.memmap(f"{top}.idx", "<i8", "r").reshape(-1, 2), ids
    with store.open_input_file(f"{top}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
    return index, _Remote(store.open_input_file(f"{top}.ids"), kind)


class _Remote:
    """Slices of a file in a store that cannot be mapped."""

    def __init__(self, file, kind):
        self.file, self.kind = file, np.dtype(kind)

    def __getitem__(self, s: slice) -> np.ndarray:
        self.file.seek(s.start * self.kind.itemsize)
        return np.frombuffer(self.file.read((s.stop - s.start) * self.kind.itemsize), self.kind)


def ids_crc32(ids, start: int, stop: int) -> int:
    """CRC of the ids as little-endian 32-bit integers, read in bounded steps."""
    crc = 0
    for a in range(start, stop, READ_TOKENS):
        crc = zlib.crc32(np.asarray(ids[a : min(stop, a + READ_TOKENS)]).astype("<u4").tobytes(), crc)
    return crc


def read_token_files(manifest: DataFrame, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, as asked, ids_crc32 or the ids of every document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index, ids = map_part(row["path"], row["width"])
                for a in range(0, len(index) - 1, 4096):
                    rows = np.asarray(index[a : a + 4097])
                    keys, at = rows[:-1, 0], rows[:, 1]
                    if digest:
                        last = pa.array([ids_crc32(ids, i, j) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.int64())
                    else:
                        last = pa.array([np.asarray(ids[i:j]).astype(np.int64) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=keys == NULL_ID), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), last],
                        ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    last = "ids_crc32 long" if digest else "ids array<long>"
    # A task for each part: the round robin over so few rows costs nothing.
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "width", "base").repartition(n, "path").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1, scratch)
    return read_token_files(manifest)
