from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm.mixing import mix, quotas, shares, sized
from acervo.llm.packing import closest, fill, pack
from acervo.llm.tokens import VOCABULARY, encoder, token_counts


def best_sum(counts, room):
    reach = {0}
    for s, n in counts.items():
        reach = {r + s * k for r in reach for k in range(n + 1) if r + s * k <= room}
    return max(reach)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
@settings(max_examples=100, deadline=None)
def test_closest_is_optimal(counts, room):
    chosen = closest(counts, room)
    total = sum(s * n for s, n in chosen.items())
    assert total == best_sum(counts, room) and all(n <= counts[s] for s, n in chosen.items())


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_fill_places_all(histogram):
    plan, used = fill(histogram, 50), Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 50 and times > 0
        used.update({s: n * times for s, n in pattern.items()})
    assert used == Counter(histogram)


def test_pack(spark):
    word = lambda n: " ".join(["contrato"] * n)
    count = lambda t: len(encoder(VOCABULARY).encode_ordinary(t))
    texts = [word(3), word(5), word(5), word(40), word(1), "", None, word(7), "x" * 5000]
    df = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)] + [(2, texts[2], 2, "c"), (None, word(2), 0, "c")], "doc_id long, text string, piece long, container string")
    rows = pack(df, capacity=16).collect()
    by, per = {}, Counter()
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        if r["container"] is not None:
            per[r["container"]] += r["piece_tokens"]
    assert max(per.values()) <= 16 and set(per) == set(range(len(per)))
    for i, t in enumerate(texts):
        n = count(t) if t else 0
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert sum(r["piece_tokens"] for r in pieces) == n * (2 if i == 2 else 1)
        if n > 16:
            assert len(pieces) == -(-n // 16) and all(r["piece_tokens"] == 16 for r in pieces[:-1])
        elif not n:
            assert [r["container"] for r in pieces] == [None]
    assert len(by[2]) == 2 and None in by
    assert pack(df.limit(0), capacity=16).collect() == []


def test_little_space_left(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used = [r["t"] for r in pack(df).where("container IS NOT NULL").groupBy("container").sum("piece_tokens").toDF("c", "t").collect()]
    assert sum(used) > 0.97 * 2048 * (len(used) - 1)


@pytest.mark.parametrize("text", ["", "Obra pública; precio 3,50 €\n\n", "a" * 3000, "日本 😀"])
def test_token_round_trip(text):
    e = encoder(VOCABULARY)
    assert e.decode(e.encode_ordinary(text)) == text


def test_mix(spark):
    rows = [(i, "palabra " * (1 + i % 9), f" Big-{'s' if i % 2 else 'S'}ource ") for i in range(600)] + [(1000 + i, "otra cosa", "small") for i in range(20)] + [(2000 + i, "sin fuente", s) for i, s in enumerate([None, "", "ajena"])] + [(3000, None, "small"), (3001, "", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.03, 4), ("rare", 0.4, 3), ("none", None, None)], "source string, target_share double, max_repeats int")
    sizes = sized(df)
    total = sizes.groupBy().sum("n_tokens").first()[0]
    q = quotas(sizes, targets)
    out = {r["source"]: r for r in q.collect()}
    assert (out["big_source"]["outcome"], out["rare"]["outcome"], out["none"]["outcome"]) == ("cut", "short", None)
    mixed = mix(sizes, q)
    copies = Counter((r["source"], r["doc_id"]) for r in mixed.collect())
    assert max(n for (s, _), n in copies.items() if s == "big_source") == 1
    report = {r["source"]: r for r in shares(sizes, q, mixed).collect()}
    assert report["big_source"]["used"] == pytest.approx(0.5 * total, rel=0.02)
    assert report["small"]["outcome"] == "repeated" and report["small"]["most_copies"] <= 4 and report["small"]["used"] == pytest.approx(0.03 * total, rel=0.1)
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    again = Counter((r["source"], r["doc_id"]) for r in mix(sizes, q).collect())
    assert again == copies
    empty = sized(df.limit(0))
    assert mix(empty, quotas(empty, targets)).collect() == []
    assert token_counts(df.limit(0)).collect() == []
