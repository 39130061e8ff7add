"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes nearest point once vectors are scaled by the
largest norm M and get one more coordinate sqrt(1 - |x|^2): a query, scaled to
length 1 with 0 there, is nearest to what has the largest product with it.
Vectors are put in ranges of norm (a factor of two), each with its own M and
cells, so a long vector does not crowd the others; a query visits all ranges. A
range of at most ``WHOLE`` vectors is one cell that every query visits.

Each of ``TABLES`` tables hashes points by ``FUNCTIONS`` p-stable (Gaussian)
functions floor((a.x + b) / WIDTH) to a cell. A query visits its own cell and
those that differ by one step in any functions, in the order of estimated
success (the summed squares of its distances to the borders crossed), the first
``PROBES`` of each table. Candidates of all tables are reranked by the exact
product in double precision and merged; there is no cap on them. A query that
found fewer than k although there are more is compared with all vectors.

Cells are dealt to tiles; a salt from the vector's id spreads a crowded cell
over ``SALTS`` tiles. A query goes once to each tile, with the cells it probes
there; queries go in blocks of about ``QUERY_BLOCK``, and vectors stream past a
block, so a task holds one block and its best so far.

Null, empty and zero vectors, vectors with null or non-finite components or
with another dimension than the most frequent one, and rows without an id take
no part. Of repeated rows of an id each is a candidate, but the result holds an
id once for a query. A query with fewer than k candidates gets them all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import Scratch, mix, reachable

TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 4, 6, 2.0, 96, 11
SALTS = 8
#: Bins of norm for a factor of two.
BINS = 8
QUERY_BLOCK = 10_000
#: Points hashed into a tile, about, over all tables.
TILE_ROWS = 16_384
#: Candidates gathered before they are reranked.
BUFFER = 500_000
#: Vectors of a norm range that are not worth hashing, at most.
WHOLE = 1000
#: Numbers in the vectors of the pairs compared at once, about.
PAIR_NUMBERS = 1 << 24
#: How far a product from a matrix product may be off (vectors of length 1).
SLACK = 1e-9


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, v and norm of the vectors that take part (dimension not yet compared)."""
    v = F.col("v")
    df = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    df = df.filter(F.col("id").isNotNull() & (F.size(v) > 0))
    df = df.filter(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    df = df.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
    return df.filter("norm > 0").withColumn("bin", F.floor(F.log2("norm") * BINS))


def norm_ranges(bins: list[tuple]) -> list[tuple]:
    """(highest bin, largest norm, whether one cell) of ranges of ``BINS`` bins, longest first, from (bin, largest norm, vectors)."""
    out: list[tuple] = []
    for b, norm, n in sorted(bins, reverse=True):
        if out and out[-1][0] - b < BINS:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((b, norm, n))
    return [(b, norm, n <= WHOLE) for b, norm, n in out]


class Hashes:
    """The tables' functions for vectors of a dimension (the extra coordinate not counted)."""

    def __init__(self, dim: int, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES):
        rng = np.random.default_rng(SEED)
        self.tables, self.functions, self.probes = tables, functions, probes
        self.a = rng.normal(size=(tables, dim + 1, functions)) / width
        self.b = rng.uniform(size=(tables, functions))
        steps = itertools.product((0, -1, 1), repeat=functions)
        self.steps = np.array(list(steps), np.int8)

    def cells(self, table: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = points @ self.a[table] + self.b[table]
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def code(self, table: int, cells: np.ndarray, part: np.ndarray | int = 0) -> np.ndarray:
        """Codes of cells of norm ranges."""
        h = np.full(cells.shape[:-1], table + 1, np.uint64) + np.asarray(part, np.uint64) * np.uint64(self.tables)
        for k in range(self.functions):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64))
        return h

    def of_points(self, table: int, v: np.ndarray, bins: np.ndarray, ranges: list[tuple]) -> np.ndarray:
        """Codes of the cells that vectors lie in."""
        part = np.searchsorted([-r[0] for r in ranges], -bins, side="right") - 1
        scaled = v / np.array([r[1] for r in ranges])[part, None]
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        cells = self.cells(table, np.c_[scaled, rest])[0]
        cells[np.array([r[2] for r in ranges])[part]] = 0
        return self.code(table, cells, part)

    def probed(self, table: int, points: np.ndarray, ranges: list[tuple]) -> np.ndarray:
        """Codes of the cells each query visits: of each range, in order of estimated success."""
        low, past = self.cells(table, points)
        cost = past**2 @ (self.steps == -1).T + (1 - past) ** 2 @ (self.steps == 1).T
        n = min(self.probes, len(self.steps))
        first = np.argpartition(cost, n - 1, axis=1)[:, :n]
        first = np.take_along_axis(first, np.argsort(np.take_along_axis(cost, first, 1), axis=1, kind="stable"), 1)
        cells, one = low[:, None, :] + self.steps[first], np.zeros((len(points), 1, self.functions), np.int64)
        return np.concatenate([self.code(table, one if r[2] else cells, part) for part, r in enumerate(ranges)], 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _tile(code: np.ndarray, salt, tiles: int) -> np.ndarray:
    return (mix(code + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(tiles)).astype(np.int32)


class _Best:
    """The best candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.least = np.full(len(ids), -np.inf)
        self.slack = SLACK * np.linalg.norm(vectors, axis=1)
        self.held: list[tuple] = []
        self.size = 0
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, largest: float) -> None:
        near = self.vectors[queries] @ vectors.T >= (self.least - self.slack * largest)[queries, None]
        near &= self.ids[queries, None] != ids
        q, c = np.nonzero(near)
        if len(q):
            q = queries[q]
            # The exact measure, one pair at a time in a fixed order.
            self.held.append((q, ids[c], (self.vectors[q] * vectors[c]).sum(1)))
            self.size += len(q)
            if self.size > BUFFER:
                self.keep()

    def keep(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(self.rows, *self.held, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, bool)
        q, i, s = q[new], i[new], s[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        full = place == self.k - 1
        self.least[q[full]] = s[full]
        self.rows, self.held, self.size = (q[kept], i[kept], s[kept]), [], 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", hashes: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found to each query.

    ``hashes``: other values of ``Hashes`` parameters. A vector is no candidate
    of a query with its own id.
    """
    spark = reachable(vectors.sparkSession)
    points, asked = usable(vectors, key, column), usable(queries, key, column)
    kinds = "query_id long, rank int, vec_id long, score double"
    groups = points.groupBy(F.size("v").alias("dim"), "bin").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    if not groups:
        return spark.createDataFrame([], kinds)
    of_dim: dict[int, int] = {}
    for r in groups:
        of_dim[r["dim"]] = of_dim.get(r["dim"], 0) + r["n"]
    dim = min(of_dim, key=lambda d: (-of_dim[d], d))
    ranges, n_points = norm_ranges([(r["bin"], r["norm"], r["n"]) for r in groups if r["dim"] == dim]), of_dim[dim]
    largest = ranges[0][1]
    points, asked = points.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    options = hashes or {}
    # Each tile returns k rows for a query, so tiles follow the rows, not the cluster.
    tiles = -(-n_points * options.get("tables", TABLES) // TILE_ROWS)

    def hash_points(batches):
        h = Hashes(dim, **options)
        for batch in batches:
            ids, v, bins = batch.column("id").to_numpy(), _matrix(batch.column("v"), dim), batch.column("bin").to_numpy()
            salt = mix(ids.astype(np.uint64)) % np.uint64(SALTS)
            for t in range(h.tables):
                code = h.of_points(t, v, bins, ranges)
                one = pa.array([None] * len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_tile(code, salt, tiles)), pa.array(code.view(np.int64)), one, batch.column("id"), batch.column("v")], ["tile", "cell", "cells", "id", "v"]
                )

    def hash_queries(batches):
        h = Hashes(dim, **options)
        for batch in batches:
            step = max(1, 256 // len(ranges))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                v = _matrix(part.column("v"), dim)
                v = np.c_[v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))]
                codes = np.concatenate([h.probed(t, v, ranges) for t in range(h.tables)], 1)
                # Once to each tile, with what it visits there.
                all_tiles = np.stack([_tile(codes, s, tiles) for s in range(SALTS)], 2).reshape(len(v), -1)
                row = np.repeat(np.arange(len(v)), all_tiles.shape[1])
                triple = np.unique(np.c_[row, all_tiles.ravel(), np.repeat(codes.ravel(), SALTS).view(np.int64)], axis=0)
                starts = np.flatnonzero(np.r_[True, (triple[1:, :2] != triple[:-1, :2]).any(1)])
                cells = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(triple)], pa.int32()), pa.array(triple[:, 2]))
                at = pa.array(triple[starts, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(triple[starts, 1].astype(np.int32)), pa.nulls(len(starts), pa.int64()), cells, part.column("id").take(at), part.column("v").take(at)],
                    ["tile", "cell", "cells", "id", "v"],
                )

    columns = "tile int, cell long, cells array<long>, id long, v array<double>"
    def search(batches):
        at, best, visits, held = None, None, {}, []

        def start():
            """The queries of the tile are complete: who visits which cell."""
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            v = np.concatenate([_matrix(b.column("v"), dim) for b in held])
            who = np.repeat(np.arange(len(ids)), np.concatenate([b.column("cells").value_lengths().to_numpy() for b in held]))
            cell = np.concatenate([b.column("cells").flatten().to_numpy() for b in held])
            order = np.argsort(cell, kind="stable")
            cell, who = cell[order], who[order]
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            return _Best(ids, v, k), {int(cell[a]): who[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}

        def end():
            best.keep()
            q, i, s = best.rows
            for a in range(0, len(q), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[q[a : a + 10_000]]), pa.array(i[a : a + 10_000]), pa.array(s[a : a + 10_000])], ["query_id", "vec_id", "score"])

        for batch in batches:
            tile, block = batch.column("tile").to_numpy(), batch.column("block").to_numpy()
            query = batch.column("cell").is_null().to_numpy(zero_copy_only=False)
            cell = batch.column("cell").fill_null(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1]) | (cell[1:] != cell[:-1]), True])
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = (int(tile[a]), int(block[a]))
                if here != at:
                    if best is not None:
                        yield from end()
                    at, best, visits, held = here, None, {}, []
                part = batch.slice(a, b - a)
                if query[a]:
                    held.append(part)
                    continue
                if best is None:
                    if not held:
                        continue  # nobody visits this tile
                    best, visits = start()
                    held = []
                if (who := visits.get(int(cell[a]))) is not None:
                    rows = max(1, PAIR_NUMBERS // (dim * len(who)))
                    for c in range(0, b - a, rows):
                        few = part.slice(c, rows)
                        best.add(who, few.column("id").to_numpy(), _matrix(few.column("v"), dim), largest)
        if best is not None:
            yield from end()

    def best_of(probes: DataFrame, hashed: DataFrame, tiles: int, blocks: int) -> DataFrame:
        hashed = hashed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        probes = probes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        dealt = probes.unionByName(hashed).repartition(tiles, "tile", "block").sortWithinPartitions("tile", "block", F.col("cell").asc_nulls_first(), "id")
        ranked = dealt.mapInArrow(search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return ranked.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    hashed = points.select("id", "v", "bin").mapInArrow(hash_points, columns)
    probes = asked.select("id", "v").mapInArrow(hash_queries, columns)
    found = Scratch(spark, "nearest").keep(best_of(probes, hashed, tiles, blocks), "found")
    # Queries short of what there is are compared with all vectors, dealt by hash.
    known = [r["id"] for r in points.select("id").distinct().limit(k + 1).collect()]
    due = F.lit(k) if len(known) > k else F.lit(len(known)) - F.col("id").isin(known).cast("int")
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    short = asked.select("id").distinct().join(counts, "id", "left").filter(F.coalesce("n", F.lit(0)) < due).select("id")
    late = asked.join(short, "id", "left_semi")
    n_late = late.count()
    if not n_late:
        return found
    tiles = -(-n_points // TILE_ROWS)
    one, none = F.lit(0).cast("long"), F.lit(None)
    probes = late.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), none.cast("long").alias("cell"), F.array(one).alias("cells"), "id", "v")
    dealt = F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int").alias("tile")
    all_points = points.select(dealt, one.alias("cell"), none.cast("array<long>").alias("cells"), "id", "v")
    whole = best_of(probes, all_points, tiles, -(-n_late // QUERY_BLOCK))
    return found.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(whole)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
