import numpy as np
import pytest

from tarn.llm import knn


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_no long, embedding array<float>").repartition(4)


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {i: sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))}, s


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 16)
    monkeypatch.setattr(knn, "MIN_SHARDS", 4)


@pytest.mark.parametrize("points, searches", [(65_536, 262_144), (30, 50), (10**6, 40), (20, 10**6)])
def test_factor_one_is_exact(spark, small, monkeypatch, points, searches):
    monkeypatch.setattr(knn, "TASK_POINTS", points)
    monkeypatch.setattr(knn, "TASK_SEARCHES", searches)
    rng = np.random.default_rng(1)
    x = np.float32(rng.normal(size=(400, 8)))
    x[50:60] = x[40:50] + np.float32(0.001)
    want, s = brute(x.astype(float), 5)
    got = knn.nearest(table(spark, x), "chunk_no", "embedding", factor=1.0, dim=8).orderBy("query", "rank").collect()
    found = {i: [] for i in want}
    for r in got:
        found[r["query"]].append(r["neighbour"])
    for i in want:  # ties within float32 aside
        assert np.allclose(sorted(s[i, found[i]]), sorted(s[i, want[i]]), atol=2e-6)
    pairs = {(r["a"], r["b"]) for r in knn.similar_pairs(table(spark, x), "chunk_no", "embedding", min_cosine=0.9, factor=1.0, dim=8).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i in want for j in want[i] if s[i, j] >= 0.9}


def test_factor_one_is_exact_about_dense_groups(spark, small):
    """Rows far from a dense group must meet rows of it that have their neighbours already and come from another shard."""
    rng = np.random.default_rng(1)
    away = rng.normal(size=(1000, 8))
    away[:, 0] = 0
    away *= rng.uniform(0.25, 0.6, size=(1000, 1)) / np.linalg.norm(away, axis=1, keepdims=True)
    x = np.float32(np.eye(8)[0] + np.concatenate([rng.normal(size=(8000, 8)) * 0.05, away]))
    got = {(r["a"], r["b"]) for r in knn.similar_pairs(table(spark, x), "chunk_no", "embedding", min_cosine=0.9, factor=1.0, dim=8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    fifth = -np.partition(-s, 4, axis=1)[:, 4]
    i, j = np.nonzero((s >= fifth[:, None] + 2e-6) & (s >= 0.9 + 2e-6))  # ties within float32 aside
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} <= got
    assert all(s[a, b] >= min(fifth[a], fifth[b]) - 2e-6 for a, b in got)


def test_every_search_meets_every_point_once():
    rng = np.random.default_rng(5)
    shard, at_home = rng.integers(0, 3, 400), rng.random(400) < 0.6
    divided = np.array([[3, 2], [1, 1], [1, 4]])
    offsets = np.cumsum([0, *(divided[:, 0] * divided[:, 1])])
    task, role, asks, row = knn._deal(shard, at_home, knn._shares(rng.integers(0, 10**12, 400)), np.ones(400, bool), divided, offsets)
    met = {}
    for t in np.unique(task):
        own = task == t
        for a in row[own & asks]:
            for b in row[own & (role == knn.POINT)]:
                met[a, b] = met.get((a, b), 0) + 1
    assert met == {(a, b): 1 for a in range(400) for b in range(400) if at_home[b] and shard[a] == shard[b]}


def test_rounds_hold_their_bound():
    sizes = [(0, 100, 900), (1, 50, 0), (3, 400, 2000)]
    divided = np.array([[3, 2], [1, 1], [1, 1], [2, 4]])
    offsets = np.cumsum([0, *(divided[:, 0] * divided[:, 1])])
    for most in (1, 700, 2000, 10**9):
        rounds = knn._rounds(sizes, divided, offsets, most)
        assert [t for low, high in rounds for t in range(low, high)] == list(range(int(offsets[-1])))
    rows = [100 / 2 + 1000 / 3] * 6 + [50, 0] + [400 / 4 + 2400 / 2] * 8
    assert all(sum(rows[low:high]) <= 2000 for low, high in knn._rounds(sizes, divided, offsets, 2000)) and len(knn._rounds(sizes, divided, offsets, 10**9)) == 1


@pytest.mark.parametrize("min_cosine", [-1.0, 0.9])
def test_rounds_lose_nothing(spark, small, monkeypatch, min_cosine):
    """The same rows come out however few vectors are sent at a time, and what was sent in a round is gone at its end."""
    x = np.float32(np.random.default_rng(2).normal(size=(600, 6)))
    df = table(spark, x)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    written, sent = knn.materialize, []

    def watch(part, label):
        held = blocks.getAllBlocks().mkString(" ").count("shuffle_")
        out = written(part, label)
        sent.append((label, blocks.getAllBlocks().mkString(" ").count("shuffle_") - held))
        return out

    rows = lambda: sorted(map(tuple, knn.nearest(df, "chunk_no", "embedding", 5, min_cosine, 1.0, dim=6).collect()))
    whole = rows()
    monkeypatch.setattr(knn, "materialize", watch)
    monkeypatch.setattr(knn, "ROUND_BYTES", 1)
    monkeypatch.setattr(knn, "ROUND_COPIES", 1)
    assert rows() == whole and len(whole) > 600
    assert [label for label, _ in sent].count("neighbours") > 1 and all(left <= 0 for _, left in sent)


def test_copies_ties_and_unusable_rows(spark, small):
    base = np.float32([[1, 0, 0, 0], [0, 1, 0, 0], [0.6, 0.8, 0, 0]])
    rows = [(i, [float(v) * (1 + i) for v in base[0]]) for i in range(20)] + [(100 + i, [float(v) for v in base[1]]) for i in range(3)] + [(200, [0.6, 0.8, 0.0, 0.0])]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0]), (303, [float("nan"), 0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_no long, embedding array<float>")
    got = {}
    for r in knn.nearest(df, "chunk_no", "embedding", 5, factor=1.0, dim=4).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[19] == [0, 1, 2, 3, 4]
    assert got[100] == [101, 102, 200, 0, 1] and got[200] == [100, 101, 102, 0, 1]
    assert set(got) == set(range(20)) | {100, 101, 102, 200}
    few = knn.nearest(df, "chunk_no", "embedding", 5, factor=1.0, queries=lambda key: key == 200, dim=4)
    assert [r["neighbour"] for r in few.orderBy("rank").collect()] == [100, 101, 102, 0, 1]
    assert knn.nearest(df.limit(0), "chunk_no", "embedding", dim=4).count() == 0
    assert knn.similar_pairs(df.filter("chunk_no = 200"), "chunk_no", "embedding", dim=4).count() == 0


def test_recall_with_production_factors(spark, testdata):
    df = spark.read.parquet(f"{testdata}/chunks.parquet")
    rows = [(r["chunk_no"], r["embedding"]) for r in df.select("chunk_no", "embedding").collect() if r["embedding"] and len(r["embedding"]) == 64 and any(r["embedding"])]
    rows.sort()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    want, s = brute(x, 5)
    pairs = {(ids[min(i, j)], ids[max(i, j)]) for i in want for j in want[i] if s[i, j] >= 0.9}
    got = {(r["a"], r["b"]) for r in knn.similar_pairs(df, "chunk_no", "embedding").collect()}
    assert len(got & pairs) >= 0.98 * len(pairs) and got <= pairs
    near = {(r["query"], r["neighbour"]) for r in knn.nearest(df, "chunk_no", "embedding", factor=knn.FAR_FACTOR, queries=lambda key: key % 20 == 0).collect()}
    truth = {(ids[i], ids[j]) for i in want for j in want[i] if ids[i] % 20 == 0}
    assert len(near & truth) >= 0.9 * len(truth)


def test_tree_parts_equal_distances():
    x = np.eye(64, dtype=np.float32).repeat(20, axis=0)
    best = knn.Best(len(x), 3, np.full(len(x), -1.0))
    knn.search(x, np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), bool), best, 1.0)
    best.settle()
    assert (best.similarity == 1.0).all() and (best.neighbour[5] == [0, 1, 2]).all()
