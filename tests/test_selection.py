from acervo.operators.selection import greedy


def test_all_candidates_take_part(spark):
    """Two hundred chunks too large or too near after the first leave room for one ranked last."""
    rows = [(1, 0, 1.0, 10)] + [(1, i, 0.99 - i / 1e4, 95 if i > 1 else 5) for i in range(1, 201)] + [(1, 900, 0.7, 20), (2, 3, 0.5, 1)]
    nodes = spark.createDataFrame(rows, "d int, idx int, score double, size int")
    got = greedy(nodes, "d", budget=90, gap=2, drop=0.6, least=1, most=4).orderBy("d", "order").collect()
    assert [(r["d"], r["order"], r["idx"]) for r in got] == [(1, 0, 0), (1, 1, 900), (2, 0, 3)]
