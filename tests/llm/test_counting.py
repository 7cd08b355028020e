import random
import unicodedata
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from acervo.llm.burst import BurstTrie, route_of, term_frequencies, terms_of


@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 5)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_trie_counts_like_a_dictionary(items):
    trie, want = BurstTrie(3), {}
    for term, n in items:
        trie.add(term, n, 1)
        cell = want.setdefault(term, [0, 0])
        cell[0] += n
        cell[1] += 1
    got = {p + s: c for p, entries in trie.containers() for s, c in entries}
    assert got == want and trie.size == len(want)


def test_route_is_prefix():
    heavy = frozenset({"a", "ab"})
    assert [route_of(t, heavy) for t in ("abc", "abcd", "ab", "a", "ac", "b")] == ["abc", "abc", "ab", "a", "ac", "b"]


def test_terms_of():
    e = "é"
    assert terms_of(f"Caf{e} café  X", None) == Counter({"café": 2, "x": 1})
    assert terms_of("  \t", "a|2 A|1 b|0 |3 c|x d e|f|2 g|-1") == Counter({"a": 3, "e|f": 2})
    assert terms_of(None, None) == terms_of("", " ") == Counter()


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(400):
        for version in range(rng.choice([1, 1, 2])):
            rows.append((f"p{i}", version, " ".join(rng.choices(words, k=rng.randint(0, 20))) + (" común" if i % 3 else ""), None, "x", 1))
    rows += [rows[0], (None, 9, "nulo nulo nulo", None, "x", 1), ("p7", None, "viejo viejo viejo", None, "x", 1), ("hot", 5, None, "zz|4 yy|1", "x", 1)] + [("hot", 4, "aa bb cc", None, "x", 1)] * 200
    df = spark.createDataFrame(rows, "place_id string, indexed_at int, lemmas string, bow string, term string, mark int")
    best = {}
    for k, at, text, bag, *_ in rows:
        if k is not None and (key := (at is not None, at or 0, text or "", bag or "")) >= best.get(k, (False, -1, "", "")):
            best[k] = key
    occ, rec, n = Counter(), Counter(), 0
    for _, _, text, bag in best.values():
        found = terms_of(text, bag)
        if found.total() >= 3:
            n += 1
            occ.update(found)
            rec.update(found.keys())
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(df, burst=4, flush=50, routes=8).collect()}
    mark = lambda r: "rare" if r < 5 else "common" if r > n / 2 else None
    assert got == {t: (occ[t], rec[t], mark(rec[t])) for t in occ}
    assert got["común"][2] == "common" and got["zz"][0] == 4
    assert unicodedata.is_normalized("NFC", "".join(got))
    assert term_frequencies(df.limit(0)).collect() == []


def test_long_common_beginnings_are_split(spark):
    """A third of the vocabulary shares 70 characters: routes go on below them."""
    from acervo.llm.burst import heavy_prefixes

    base = "https://contratos.example.org/expedientes/documentos/anexos/version/a/"
    terms = [f"{base}{i:05d}" for i in range(1500)] + [f"{chr(97 + i % 26)}{i}" for i in range(3000)]
    sizes = spark.createDataFrame([(t[:-2], 1) for t in terms], "prefix string, n long")
    heavy = heavy_prefixes(sizes, len(terms) / 64)
    assert base in heavy and max(map(len, heavy)) > len(base)
    size = Counter(route_of(t, heavy) for t in terms)
    assert max(size.values()) <= len(terms) / 64
    rows = [(f"p{i}", 1, " ".join(terms[3 * i : 3 * i + 3]), None) for i in range(1500)]
    got = {r["term"]: r["occurrences"] for r in term_frequencies(spark.createDataFrame(rows, "place_id string, indexed_at int, lemmas string, bow string"), routes=64).collect()}
    assert got == {t: 1 for t in terms}
