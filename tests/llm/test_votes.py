import datetime
import inspect

import numpy as np
import pytest

from acervo.llm import paired
from acervo.llm.consensus import Salted, beta_cdf, beta_quantile, consensus, fit, krippendorff, reliability
from acervo.llm.paired import components, rank_items, spread, win_counts
from acervo.llm.votes import LABELS, systems, valid_votes

AT = datetime.datetime(2025, 1, 1)
ANN = "annotation_id long, annotator string, instance_id long, selected_model string, annotated_at timestamp_ntz, label string"
CMP = "id long, task_type string, item_a_model string, item_b_model string, model string"


def test_valid_votes(spark):
    forms = ["A es mejor", ' {"b es  MEJOR": 1} ', "{'Ambos son malos': '1'}", "A", "", None, "{}", '{"Saltar": "1"}', '{"A es mejor": 1, "B es mejor": 1}']
    rows = [(i, f"u{i}", 1, f, AT, "x") for i, f in enumerate(forms)]
    rows += [(20, "u0", 1, "b es mejor", None, "x"), (21, "u1", 1, "A es mejor", AT, "x"), (22, None, 1, "A es mejor", AT, "x"), (23, "u9", 77, "A es mejor", AT, "x"), (0, "u0", 1, "A es mejor", AT, "x")]
    compared = spark.createDataFrame([(1, "T", "a", "b", "m"), (1, "T", "a", "b", "m")], CMP)
    got = sorted(tuple(r) for r in valid_votes(spark.createDataFrame(rows, ANN), compared).collect())
    assert got == [(1, "u0", 0), (1, "u1", 0), (1, "u2", 2)]
    assert valid_votes(spark.createDataFrame([], ANN), compared).collect() == []


def test_ranking_against_newton(spark):
    rng = np.random.default_rng(5)
    k, wins = 6, np.zeros((6, 6))
    true = np.linspace(-1, 1, k)
    rows, i = [], 0
    alias = spark.createDataFrame([(f"Model {m}", f"m{m}") for m in range(k)], "alias string, model string")
    compared = []
    for a in range(k):
        for b in range(a + 1, k):
            for _ in range(rng.integers(3, 40)):
                won = rng.random() < 1 / (1 + np.exp(true[b] - true[a]))
                wins[(a, b) if won else (b, a)] += 1
                compared.append((i, " Task " if i % 2 else "task", f"MODEL {a} ", f"m{b}", "x"))
                rows.append((i, "u", i, LABELS[0 if won else 1], AT, "x"))
                i += 1
    compared += [(i, "task", "nobody", "m1", "x"), (i + 1, "task", None, "m1", "x"), (i + 2, "task", "m1", "Model 1", "x")]
    rows += [(i + j, "u", i + j, LABELS[0], AT, "x") for j in range(3)] + [(i + 5, "w", 0, LABELS[2], AT, "x")]
    c = spark.createDataFrame(compared, CMP)
    w = win_counts(valid_votes(spark.createDataFrame(rows, ANN), c), systems(c, alias))
    got = {r["model"]: r for r in rank_items(w, prior=0.5, tolerance=1e-7).collect()}
    x = np.zeros(k)
    for _ in range(4000):  # gradient ascent on the same regularised likelihood
        p = 1 / (1 + np.exp(x[None, :] - x[:, None]))
        s = 1 / (1 + np.exp(-x))
        x += 0.02 * ((wins * (1 - p)).sum(1) - (wins.T * p).sum(1) + 0.5 * (1 - s) - 0.5 * s)
    assert [got[f"m{m}"]["strength"] for m in range(k)] == pytest.approx(list(x), abs=1e-4)
    assert [r for r in sorted(got, key=lambda m: got[m]["rank"])] == [f"m{m}" for m in np.argsort(-x)]
    assert {r["component"] for r in got.values()} == {"m0"} and all(r["converged"] for r in got.values())
    n = wins + wins.T
    p = 1 / (1 + np.exp(x[None, :] - x[:, None]))
    info = -n * p * (1 - p)
    np.fill_diagonal(info, (n * p * (1 - p)).sum(1) + s * (1 - s))
    assert [got[f"m{m}"]["se"] for m in range(k)] == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(info)))), rel=1e-3)
    rough = {r["model"]: r for r in rank_items(w, small=0, dense=2).collect()}  # joined, not broadcast; errors from the diagonal
    assert all(not r["se_exact"] and r["se"] <= got[m]["se"] for m, r in rough.items())
    assert all(abs(r["strength"] - got[m]["strength"]) < 1e-4 for m, r in rough.items())
    assert not any(r["converged"] for r in rank_items(w, sweeps=1).collect())
    assert sum(r["wins"] for r in got.values()) == wins.sum()


def test_components_and_undefeated(spark):
    w = spark.createDataFrame([("t", "a", "b", 3), ("t", "b", "c", 1), ("t", "x", "y", 2)], "task string, winner string, loser string, n long")
    got = {r["model"]: r for r in rank_items(w).collect()}
    assert {m: r["component"] for m, r in got.items()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert all(np.isfinite(r["strength"]) for r in got.values())
    assert rank_items(w.limit(0)).collect() == []
    pairs = w.selectExpr("task", "winner AS item", "loser AS other").union(w.selectExpr("task", "loser", "winner"))
    assert components(pairs).count() == 5


def simulate(seed, items=300, annotators=12):
    rng = np.random.default_rng(seed)
    truth, skill = rng.integers(0, 3, items), np.r_[[0.95] * 4, [0.75] * 4, [0.4] * 3, 0.05]
    votes = []
    for i in range(items):
        for a in rng.choice(annotators, 5, replace=False):
            right = rng.random() < skill[a]
            votes.append((i, f"u{a:02d}", int(truth[i]) if right else int((truth[i] + 1 + rng.integers(0, 2)) % 3)))
    return truth, votes


def test_consensus_beats_majority(spark):
    truth, votes = simulate(8)
    df = spark.createDataFrame(votes, "instance_id long, annotator string, label int")
    got = {r["instance_id"]: r for r in consensus(df).collect()}
    right = np.mean([LABELS.index(got[i]["label"]) == truth[i] for i in range(len(truth))])
    count = np.zeros((len(truth), 3))
    for i, _, v in votes:
        count[i, v] += 1
    assert right > 0.9 and right >= np.mean(count.argmax(1) == truth)
    rel = {r["annotator"]: r for r in reliability(df).collect()}
    assert rel["u00"]["reliability"] > rel["u05"]["reliability"] > rel["u09"]["reliability"] > rel["u11"]["reliability"]
    assert all(r["low"] <= r["reliability"] <= r["high"] for r in rel.values())


def test_variational_step_against_numpy(spark):
    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("scipy_free", Path(__file__).with_name("scipy_free.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    digamma = module.digamma

    _, votes = simulate(3, 40)
    df = spark.createDataFrame(votes, "instance_id long, annotator string, label int")
    _, post, _, converged = fit(df, tolerance=0, rounds=1)
    assert not converged
    got = {r["instance_id"]: [r["q0"], r["q1"], r["q2"]] for r in post.collect()}
    names = sorted({a for _, a, _ in votes})
    q = np.full((40, 3), 0.1)
    for i, _, v in votes:
        q[i, v] += 1
    q /= q.sum(1)[:, None]
    shares = q.sum(0) + 1
    for _ in range(3):
        c = np.ones((len(names), 3, 3)) + np.eye(3)
        for i, a, v in votes:
            c[names.index(a), :, v] += q[i]
        logs = digamma(c) - digamma(c.sum(2))[:, :, None]
        e = np.tile(digamma(shares), (40, 1))
        for i, a, v in votes:
            e[i] += logs[names.index(a), :, v]
        q = np.exp(e - e.max(1)[:, None])
        q /= q.sum(1)[:, None]
    assert np.allclose([got[i] for i in range(40)], q, atol=1e-6)


def test_agreement(spark):
    schema = "instance_id long, annotator string, label int"
    same = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "a", 1), (2, "b", 1), (3, "a", 2)], schema)
    assert krippendorff(same).first()["alpha"] == pytest.approx(1.0)
    mixed = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 0)], schema)
    r = krippendorff(mixed).first()
    assert (r["items"], r["votes"]) == (2, 4) and r["alpha"] == pytest.approx(1 - 2 / (2 * 3 * 1 / 3))
    assert krippendorff(mixed.limit(0)).first()["alpha"] is None
    assert consensus(mixed.limit(0), rounds=1).collect() == []
    tie = consensus(spark.createDataFrame([(1, "a", 1), (1, "b", 0)], schema), rounds=1).first()
    assert tie["n"] == 2 and tie["agreement"] == 0


def test_hot_item_and_hot_annotator(spark):
    """A third of all votes on one item, a third by one annotator: same result, and no task holds them."""
    rng = np.random.default_rng(7)
    votes = [(0, f"u{a:03d}", int(rng.random() < 0.3)) for a in range(400)]
    votes += [(i, "u000", int(rng.integers(0, 3))) for i in range(1, 401)]
    votes += [(int(i), f"u{a:03d}", int(rng.integers(0, 3))) for i, a in {(rng.integers(1, 401), rng.integers(1, 400)) for _ in range(400)}]
    df = spark.createDataFrame(votes, "instance_id long, annotator string, label int")
    plain = {r["instance_id"]: r["confidence"] for r in consensus(df, rounds=2).collect()}
    for small in (0, 10_000):
        salted = {r["instance_id"]: r["confidence"] for r in consensus(df, rounds=2, small=small, least_hot=50).collect()}
        assert salted.keys() == plain.keys() and max(abs(salted[i] - plain[i]) for i in plain) < 1e-9
    item = Salted(df, "instance_id", "annotator", 50)
    assert item.hot == [0]
    placed = df.withColumn("_i", item.salt()).groupBy("instance_id", "_i").count()
    assert placed.agg({"count": "max"}).first()[0] < 400 / item.tasks * 2
    assert item.table(df.limit(0), "_i").columns == [*df.columns, "_i"]


def test_beta_quantiles():
    a, b = np.array([2.0, 30.0, 1.0]), np.array([5.0, 3.0, 1.0])
    grid = np.linspace(0, 1, 200_001)[1:-1]
    for i in range(3):
        density = grid ** (a[i] - 1) * (1 - grid) ** (b[i] - 1)
        total = np.cumsum(density) / density.sum()
        for p in (0.025, 0.5, 0.975):
            assert abs(beta_quantile(p, a[i : i + 1], b[i : i + 1])[0] - grid[np.searchsorted(total, p)]) < 1e-4
    assert abs(beta_cdf(0.3, 1.0, 1.0) - 0.3) < 1e-12


def test_errors_of_large_groups_are_exact(spark, monkeypatch):
    """More items than are inverted in one piece: the same errors, from blocks; a small group beside them. No size
    by itself calls for rough errors."""
    assert inspect.signature(rank_items).parameters["dense"].default is None
    monkeypatch.setattr(paired, "SIDE", 32)
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for task, k, many in (("t", 70, 200), ("v", 41, 90), ("u", 5, 9)):
        p = np.exp(rng.normal(size=k))
        info = np.diag(p / (p + 1) ** 2)
        for a, b in {tuple(sorted(x)) for x in rng.integers(0, k, (many, 2)).tolist() if x[0] != x[1]} | {(i, i + 1) for i in range(k - 1)}:
            n = float(rng.integers(1, 9))
            rows += [(task, f"m{i:04d}", f"m{j:04d}", n, float(p[i]), float(p[j])) for i, j in ((a, b), (b, a))]
            w = n * p[a] * p[b] / (p[a] + p[b]) ** 2
            info[[a, b], [a, b]] += w
            info[[a, b], [b, a]] -= w
        want |= {(task, f"m{i:04d}"): se for i, se in enumerate(np.sqrt(np.diag(np.linalg.inv(info))))}
    got = {(r["task"], r["item"]): r for r in spread(spark.createDataFrame(rows, "task string, item string, other string, n double, p double, q double"), 0.5, whole=40).collect()}
    assert got.keys() == want.keys() and all(r["se_exact"] for r in got.values())
    assert [got[i]["se"] for i in want] == pytest.approx(list(want.values()), rel=1e-9)
