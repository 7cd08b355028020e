"""Statistics of votes over every form a vote comes in."""

import datetime

import pytest

from acervo import catalogue

QUERIES = catalogue.queries()
ANN = "annotation_id long, annotator string, instance_id long, selected_model string, annotated_at timestamp_ntz"
CMP = "id long, place_id string, task_type string, item_a_model string, item_b_model string"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes annotations of (annotator, instance, vote), later ones newer, and comparisons."""

    def write(votes, comparisons=((1, "p", "T", "m", "n"), (2, "p", "T ", "m", "n"))):
        rows = [(i, u, c, v, datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=i)) for i, (u, c, v) in enumerate(votes)]
        spark.createDataFrame(rows, ANN).write.parquet(f"{tmp_path}/annotations.parquet")
        spark.createDataFrame(list(comparisons), CMP).write.parquet(f"{tmp_path}/pair_comparisons.parquet")
        spark.createDataFrame([("M", "m"), ("the n", "n")], "alias string, model string").write.parquet(f"{tmp_path}/model_alias.parquet")
        return str(tmp_path)

    return write


def rows(spark, d, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, d).collect())


def test_every_form_counts_and_the_latest_of_all_stays(spark, tables):
    d = tables([("u", 1, "B es mejor"), ("u", 1, '{"A es mejor": 1}'), ("v", 1, " a ES  mejor\t"), ("w", 1, "{'Ambos son malos': '1'}"), ("u", 2, "B es mejor"), ("v", 2, '{"Saltar": "1"}'), ("v", 2, '{"B es mejor": "true"}')])
    assert rows(spark, d, "a12_league_points") == [("t", "m", 7), ("t", "n", 7)]
    assert rows(spark, d, "a12_comparison_table") == [("t", "m", 7, 1.0, 1), ("t", "n", 7, 1.0, 1)]
    assert rows(spark, d, "e12_rank_distribution") == [("t", "m", 1), ("t", "n", 2)]
    assert rows(spark, d, "k7_annotations_wide") == [("u", 1, "1", None), ("u", 2, None, "1"), ("v", 1, "1", None), ("v", 2, None, "1")]
    assert rows(spark, d, "e13_krippendorff") == [(pytest.approx(1 - 2 / 4),)]


def test_binomial_reads_objects(spark, tables):
    d = tables([(f"u{i}", 1, '{"A es mejor": "1"}' if i < 11 else "b es mejor") for i in range(12)])
    assert [(r["n"], r["wins"]) for r in QUERIES["e7_binomial_holm"](spark, d).collect()] == [(12, 11)]


def test_agreement_over_all_pairs_of_annotators(spark, tables):
    a, b, n = "A es mejor", "B es mejor", "Ambos son malos"
    d = tables([("u", 1, a), ("v", 1, a), ("w", 1, b), ("z", 1, n), ("u", 2, b), ("z", 2, b), ("w", 3, a)])
    ((pairs, agreement, kappa),) = rows(spark, d, "e8_cohen_kappa")
    e = (6**2 + 5**2 + 3**2) / 14**2
    assert (pairs, agreement, kappa) == (7, pytest.approx(2 / 7, abs=1e-6), pytest.approx((2 / 7 - e) / (1 - e), abs=1e-6))
    assert rows(spark, d, "e9_pairwise_winners") == sorted([(a, a, 2), (a, b, 2), (a, n, 2), (b, a, 2), (b, b, 2), (b, n, 1), (n, a, 2), (n, b, 1)])


def test_kappa_by_task(spark, tables):
    votes = [(f"u{i}", c, "A es mejor" if i < 3 else "B es mejor") for c in (1, 2) for i in range(5)] + [("u0", 3, "A es mejor"), ("u1", 3, "A es mejor")]
    d = tables(votes, [(1, "p", "T", "m", "n"), (1, "p", "T", "m", "n"), (2, "p", " t", "m", "n"), (3, "p", "few", "m", "n")])
    assert rows(spark, d, "e8_kappa_by_task") == [("t", 20, 0.4, -0.25)]


def test_winner_agreement_leaves_out_neither(spark, tables):
    a, b, n = "A es mejor", "B es mejor", "Ambos son malos"
    votes = [(f"u{i}", 1, a if i < 5 else b) for i in range(7)] + [("w", 1, n), ("u0", 2, a), ("u1", 2, b), ("u2", 2, n)]
    d = tables(votes, [(1, "p", "T", "m", "n"), (2, "p", "few", "m", "n")])
    assert [tuple(r) for r in QUERIES["e9_winner_agreement"](spark, d).orderBy("task").collect()] == [(None, 22, 0.5), ("t", 21, pytest.approx(11 / 21, abs=1e-6))]


def test_ranks_by_place(spark, tables):
    d = tables([("u", 1, "A es mejor"), ("u", 2, "B es mejor"), ("u", 3, '{"A es mejor": 1}')], [(1, "p", "T", "m", "n"), (2, "q", "T", " M", "The  N"), (3, "r", "t", "m", "n")])
    assert rows(spark, d, "e12_place_ranks") == [("t", "m", 1, 2), ("t", "m", 2, 1), ("t", "n", 1, 1), ("t", "n", 2, 2)]
