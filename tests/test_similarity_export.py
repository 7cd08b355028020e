import numpy as np
import pytest

from acervo import catalogue
from acervo.plans import topics


@pytest.mark.parametrize("top", [300, 7])
def test_export_against_plain_loop(spark, tmp_path, monkeypatch, top):
    """Every document has a line: of its top neighbours those of larger id by score, without the first."""
    monkeypatch.setattr(topics, "TOP_SIMILAR", top)
    x = np.random.default_rng(1).normal(size=(330, 8)).round(3)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    w = np.exp(2 * x)
    w /= w.sum(1, keepdims=True)
    w[w < 0.003] = 0
    root = np.sqrt(w / w.sum(1, keepdims=True))
    s = np.round(root @ root.T, 12)
    got = {r["query"]: r["similar"] for r in catalogue.queries()["t19_similarity_export"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(330))
    for i in range(330):
        near = [j for j in np.lexsort((np.arange(330), -s[i]))[:top] if j > i and s[i, j] > 0][1:]
        parts = [p.split("|") for p in got[i].split()]
        assert [int(a) for a, _ in parts] == near
        assert np.allclose([float(b) for _, b in parts], s[i, near], atol=1e-9)
