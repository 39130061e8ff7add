import numpy as np

from orderflow.llm import nearest
from orderflow.llm.common import reachable


def brute(ids, x, query, k):
    s = (x * x[np.flatnonzero(ids == query)[0]]).sum(1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != query]
    return [(int(ids[i]), float(s[i])) for i in order[:k]]


def test_nearest(spark):
    reachable(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 600)] + 0.4 * rng.normal(size=(600, 16))
    x[100:140] = x[100]  # one very common vector
    ids = np.arange(600)
    rows = [(int(i), v.tolist(), "c") for i, v in zip(ids, x)]
    rows += [(1000, None, "c"), (1020, [0.0] * 16, "c"), (1040, [1.0, None] + [0.0] * 14, "c"), (1060, [float("nan")] * 16, "c"), (1080, [float("inf")] * 16, "c"),
             (1100, [1.0] * 3, "c"), (None, [1.0] * 16, "c"), (1120, [], "c")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20).toPandas()
    assert set(got.query_id) == set(range(0, 600, 20))
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        want = brute(ids, x, q, 20)
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) == 20
        assert np.allclose(g.score, (x[g.vec_id] * x[q]).sum(1)) and g.vec_id.is_unique and q not in set(g.vec_id)
        hits += len({v for v, _ in want} & set(g.vec_id))
    assert hits >= 0.9 * 20 * 30
    # With every cell probed the result is exact, ties included.
    full = nearest.nearest(vectors, vectors.filter("vec_id in (100, 120, 300)"), k=20, hashes={"probes": 3**6, "width": 20.0}).toPandas()
    for q, g in full.sort_values("rank").groupby("query_id"):
        assert g.vec_id.tolist() == [v for v, _ in brute(ids, x, q, 20)]
    few = nearest.nearest(vectors.filter("vec_id < 5"), vectors.filter("vec_id = 0"), k=20).count()
    assert few <= 4
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def exact(got, ids, x, k):
    for q, g in got.sort_values("rank").groupby("query_id"):
        want = brute(ids, x, q, k)
        assert g["rank"].tolist() == list(range(1, len(want) + 1)) and g.vec_id.tolist() == [v for v, _ in want]


def test_every_query_gets_all_that_is_due(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WHOLE", 0)  # small tables are hashed too
    reachable(spark)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(15, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())]  # one row twice
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for n in (1, 5, 15):
        table = vectors.filter(f"vec_id < {n}")
        got = nearest.nearest(table, table).toPandas()
        assert got.groupby("query_id").size().to_dict() == ({i: n - 1 for i in range(n)} if n > 1 else {})
        exact(got, np.arange(n), x[:n], 20)
    # Queries that are no candidates themselves; more candidates than k, of which hashing finds too few.
    got = nearest.nearest(vectors.filter("vec_id < 5"), vectors.filter("vec_id >= 5")).groupBy("query_id").count().collect()
    assert {tuple(r) for r in got} == {(i, 5) for i in range(5, 15)}
    far = nearest.nearest(vectors, vectors, k=10, hashes={"tables": 1, "probes": 1, "width": 0.2}).toPandas()
    assert far.groupby("query_id").size().tolist() == [10] * 15
    exact(far, np.arange(15), x, 10)


def test_a_long_vector_does_not_crowd_the_cells(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 100
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    bins = nearest.usable(vectors, "vec_id", "embedding").select("id", "bin", "norm").toPandas().sort_values("id")
    ranges = nearest.norm_ranges(list(bins.groupby("bin").norm.agg(["max", "size"]).itertuples(name=None)))
    assert [r[2] for r in ranges] == [True, False]
    h = nearest.Hashes(64)
    crowded = np.unique(h.of_points(0, x, bins.bin.to_numpy(), ranges), return_counts=True)[1].max()
    together = np.unique(h.code(0, h.cells(0, np.c_[x, np.sqrt(np.maximum(0, 100**2 - (x * x).sum(1)))] / 100)[0]), return_counts=True)[1].max()
    assert crowded < 300 and together > 1500
    # Every query meets the long one, whatever its direction.
    got = nearest.nearest(vectors, vectors.filter("vec_id in (0, 20, 40, 60)")).toPandas()
    for q, g in got.groupby("query_id"):
        assert len(g) == 20 and (7 in set(g.vec_id)) == (7 in [v for v, _ in brute(np.arange(3000), x, q, 20)])
