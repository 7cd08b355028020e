import numpy as np
import pytest

from acervo.llm import knn


def make(spark, x, extra=()):
    rows = [(f"v{i:04d}", 1, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "place_id string, indexed_at int, embeddings array<float>")


@pytest.mark.parametrize("block", [64, 4096])
def test_exact_with_ties(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[100:118] = x[100]  # more equal vectors than places
    x[200:205] = x[200] + rng.normal(size=(5, 12)).astype(np.float32) * 0.05
    bad = [("n", 1, None), ("e", 1, []), ("z", 1, [0.0] * 12), ("s", 1, [1.0] * 11), ("nan", 1, [float("nan")] * 12), ("inf", 1, [float("inf")] + [1.0] * 11), ("nul", 1, [None] + [1.0] * 11), (None, 1, [1.0] * 12)]
    bad += [("v0003", 0, [1.0] * 12), ("old", 1, [1.0] * 12), ("old", 2, [0.0] * 12)]
    lists = knn.nearest(knn.newest_vectors(make(spark, x, bad), "place_id", "indexed_at", "embeddings", 12), 10, 12)
    got = {}
    for r in lists.collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbour"], r["cosine"])
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y @ y.T
    np.fill_diagonal(s, -9)
    assert set(got) == {f"v{i:04d}" for i in range(300)}
    for i in range(300):
        order = sorted(range(300), key=lambda j: (-round(s[i, j], 6), j))[:10]
        cos = [got[f"v{i:04d}"][r][1] for r in range(1, 11)]
        assert np.allclose(cos, [s[i, j] for j in order], atol=1e-5)
        if not 100 <= i < 118:
            assert len({got[f"v{i:04d}"][r][0] for r in range(1, 11)} & {f"v{j:04d}" for j in order}) >= 9
    pairs = {tuple(r)[:2] for r in knn.mutual(lists, 0.85).collect()}
    assert all(a < b for a, b in pairs) and ("v0200", "v0201") in pairs


def test_small_and_empty(spark):
    two = knn.usable(make(spark, np.eye(2, 3, dtype=np.float32)), "place_id", "embeddings", 3)
    assert sorted(tuple(r)[:2] for r in knn.nearest(two, 10, 3).collect()) == [("v0000", "v0001"), ("v0001", "v0000")]
    assert knn.nearest(two.limit(0), 10, 3).collect() == []


def test_quantisation_bound():
    x = np.random.default_rng(0).normal(size=(200, 96))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale = knn.quantise(x)
    whole = codes.astype(np.float32) @ codes.astype(np.float32).T
    assert np.array_equal(whole.astype(np.int64), codes.astype(np.int64) @ codes.astype(np.int64).T)  # tiles are exact
    e = np.linalg.norm(x - codes * scale, axis=1)
    assert np.all(np.abs(x @ x.T - whole * scale**2) <= e[:, None] * (1 + e.max()) + e.max() + 1e-9)


def test_codes_too_long_for_exact_tiles():
    with pytest.raises(ValueError):
        knn._pack(2000)


def test_few_pairs_are_recomputed(spark, monkeypatch):
    """All pairs are seen as codes; survivors are a small part of them."""
    seen = []
    merge = knn.Heaps.merge
    monkeypatch.setattr(knn.Heaps, "merge", lambda self, rows, *a: (seen.append(len(rows)), merge(self, rows, *a))[1])
    monkeypatch.setattr(knn, "BLOCK", 256)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 96))
    x /= np.linalg.norm(x, axis=1)[:, None]
    import pyarrow as pa
    import pyarrow.parquet as pq
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        batch = pa.RecordBatch.from_arrays([pa.array([f"{i:04d}" for i in range(2000)]), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["id", "v"])
        packed = list(knn._pack(96)(iter([batch])))
        for i, b in enumerate(packed):
            pq.write_table(pa.Table.from_batches([b]), f"{folder}/part-{i}.parquet")
        out = pa.Table.from_batches(list(knn._search(f"file://{folder}", 10, 96, -2.0)(iter(packed)))).to_pylist()
    u = knn.unit(x.astype(np.float32))
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert len(out) == 20_000 and sum(seen) < 0.05 * 2000 * 1999
    for r in out[:500]:
        assert abs(r["cosine"] - np.sort(s[int(r["id"])])[-r["rank"]]) < 1e-12


def folder_of(x, turn, at):
    """Blocks of 128 vectors as four packing tasks write them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    packed = []
    for task in range(4):
        own = range(task, len(x), 4)
        batch = pa.RecordBatch.from_arrays([pa.array([f"{i:04d}" for i in own]), pa.array(list(x[task::4]), pa.list_(pa.float32()))], names=["id", "v"])
        knn.TaskContext.get = lambda n=task: type("T", (), {"partitionId": lambda self: n})()
        packed += knn._pack(x.shape[1], turn)(iter([batch]))
    for i, b in enumerate(packed):
        pq.write_table(pa.Table.from_batches([b]), f"{at}/part-{i}.parquet")
    return packed


def near_some(rng, n):
    """Vectors in all directions, every tenth near the one before it; some equal, some longer copies."""
    x = rng.normal(size=(n, 96)).astype(np.float32)
    x[1::10] = x[::10] + rng.normal(size=x[::10].shape).astype(np.float32) * 0.4
    x[300:314] = x[300]
    x[320:323] = 3 * x[20]
    return x


@pytest.mark.parametrize("once", [True, False])
def test_outlines_rule_out_no_pair_and_cost_less(monkeypatch, tmp_path, once):
    """Lists from a least cosine on, against all products; a third of the products of codes, and half of the pairs of blocks."""
    import pyarrow as pa

    monkeypatch.setattr(knn, "BLOCK", 128)
    monkeypatch.setattr(knn.TaskContext, "get", None)
    x = near_some(np.random.default_rng(6), 2000)
    turn, share = knn.fit_outline(x, 0.85)
    packed = folder_of(x, turn, tmp_path)
    done, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: (done.append(a.shape[0] * a.shape[1] * b.shape[1]), matmul(a, b, out=out))[1])
    parts = [pa.Table.from_batches(list(knn._search(f"file://{tmp_path}", 5, 96, 0.85, turn, once)(iter(packed[i::3])))) for i in range(3)]
    assert sum(done) < (0.35 if once else 0.6) * 96 * 2000**2
    u = knn.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert abs((s >= 0.85).mean() - share) < 1e-4
    got = {}
    for r in pa.concat_tables(parts).to_pylist():
        got.setdefault(int(r["id"]), []).append((-r["cosine"], r["neighbour"]))
    assert set(got) == set(np.flatnonzero((s >= 0.85).any(axis=1)))
    for i, found in got.items():
        assert len(found) == len(set(found))
        cos = [-c for c, _ in sorted(found)[:5]]
        assert np.allclose(cos, np.sort(s[i][s[i] >= 0.85])[::-1][:5], atol=1e-12)
        if 300 <= i < 314:  # ties: the smaller ids
            assert [n for _, n in sorted(found)[:5]] == [f"{j:04d}" for j in range(300, 314) if j != i][:5]


@pytest.mark.parametrize("copies", [1, 190])
def test_least_cosine_gives_the_same_pairs(spark, monkeypatch, copies):
    """Few pairs, and so many that the lists are made whole by their own tasks."""
    monkeypatch.setattr(knn, "BLOCK", 100)
    x = near_some(np.random.default_rng(8), 600)
    x[400 : 400 + copies] = x[400]
    vectors = knn.usable(make(spark, x), "place_id", "embeddings", 96)
    pairs = [sorted(tuple(r)[:2] for r in knn.mutual(knn.nearest(vectors, 10, 96, least), 0.85).collect()) for least in (-2.0, 0.85)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 50
    ranks = {}
    for r in knn.nearest(vectors, 10, 96, 0.85).collect():
        ranks.setdefault(r["id"], []).append(r["rank"])
    assert all(sorted(r) == list(range(1, len(r) + 1)) and len(r) <= 10 for r in ranks.values())
