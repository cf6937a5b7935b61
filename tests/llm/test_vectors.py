"""Near-duplicate vectors, neighbours and components against brute force, empty tables included."""

import numpy as np

from tessera.llm import ann, embed_dedup
from tessera.llm.components import components
from tessera.llm.vectors import sample

KIND = "vec_id bigint, embedding array<float>"


def vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    near = base[r.integers(0, 12, 60)] + r.normal(size=(60, 16)) * 0.12
    return np.concatenate([base, near, base[:5]]).astype(np.float32)


def cosines(x):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return unit @ unit.T


def smallest(n, pairs):
    out = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            out[a] = out[b] = min(out[a], out[b])
    return out


def test_embedding_near_dedup(spark):
    x = vectors()
    c = cosines(x)
    assert abs(c - 0.95).min() > 1e-6
    links = [(a, b) for a in range(len(x)) for b in range(len(x)) if a != b and c[a, b] >= 0.95]
    names = smallest(len(x), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND), threshold=0.95).collect()}
    assert got == {i: (sum(a == i for a, _ in links), names[i]) for i in range(len(x))}
    assert embed_dedup.dedup(spark.createDataFrame([], KIND)).count() == 0


def test_permutation_ann(spark):
    x = vectors()
    c = cosines(x)
    got = {}
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND), every=10, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: set(sorted((i for i in range(len(x)) if i != q), key=lambda i: (-c[q, i], i))[:5]) for q in range(0, len(x), 10)}
    assert got.keys() == want.keys() and sum(len(got[q] & want[q]) for q in want) >= 0.9 * 5 * len(want)
    assert ann.search(spark.createDataFrame([], KIND)).count() == 0


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 9), (20, 21), (22, 21), (1, 22), (None, 3), (5, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 1: 1, 20: 1, 21: 1, 22: 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shuffled(spark):
    """Bytes that executors have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_embedding_near_dedup_moves_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 16)
    monkeypatch.setattr(embed_dedup, "ROUND_BYTES", 100_000, raising=False)
    r = np.random.default_rng(9)
    x = r.normal(size=(1000, 64))
    x[900:] = x[:100] + r.normal(size=(100, 64)) * 0.05
    x = x.astype(np.float32)
    links = np.argwhere(np.triu(cosines(x) >= 0.95, 1)).tolist()
    names = smallest(len(x), links)
    embed_dedup.prepare(spark)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND).repartition(2).checkpoint()
    before = shuffled(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.dedup(df, threshold=0.95).collect()}
    assert shuffled(spark) - before < 4 * x.nbytes
    assert got == {i: (sum(i in k for k in links), names[i]) for i in range(len(x))}


def test_sample_is_that_of_all_rows(spark):
    df = spark.range(40_000, numPartitions=20).selectExpr("id", "array(cast(id + 1 as float), 1f) AS vec")
    got, every = sample(df, 200, 40_000), sample(df, 200, 200)
    assert len(got[2]) == 200 and np.array_equal(got[2], every[2])


def test_permutation_ann_moves_results_only(spark, monkeypatch):
    for name, value in (("INDEX_ROWS", 64), ("QUERY_ROWS", 8), ("ROUND_BYTES", 20_000)):
        monkeypatch.setattr(ann, name, value, raising=False)
    x = np.random.default_rng(2).normal(size=(2000, 64)).astype(np.float32)
    x[1000:1012] = x[1000]
    ann.prepare(spark)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], KIND).repartition(2).checkpoint()
    before = shuffled(spark)
    got = {}
    for r in ann.search(df, every=10, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert shuffled(spark) - before < x.nbytes
    c = cosines(x)
    want = {q: sorted((i for i in range(len(x)) if i != q), key=lambda i: (-c[q, i], i))[:5] for q in range(0, len(x), 10)}
    assert got.keys() == want.keys() and all(len(g) == 5 for g in got.values())
    assert sum(len({v for v, _ in got[q].values()} & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert [got[1000][k][0] for k in range(1, 6)] == [1001, 1002, 1003, 1004, 1005]
    assert all(abs(s - c[q, v]) < 1e-12 for q in got for v, s in got[q].values())
