"""Language of documents and of their lines: rank-order profiles.

A profile is the ranking of a language's most frequent character n-grams (within words, word
ends marked). A line's n-grams are ranked the same way, and its distance to a profile is how far
out of place they are: the sum of the differences of the two ranks, with the size of the profile for
n-grams it lacks. n-grams a line has equally often share their mean rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-letter code and its three-letter codes.
CODES = {"es": ("spa",), "ca": ("cat",), "gl": ("glg",), "eu": ("eus", "baq"), "en": ("eng",), "fr": ("fra", "fre")}
#: Length of the n-grams, size of a profile, labelled documents used per language at most.
N, PROFILE, SAMPLE = 5, 6000, 400
MIN_WORDS = 6

_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=20_000)
def _grams_of(word: str) -> tuple[str, ...]:
    w = f"_{word}_"
    return tuple(w[i : i + n] for n in range(1, N + 1) for i in range(len(w) - n + 1))


def grams(text: str) -> Counter:
    found: Counter = Counter()
    for word in _WORD.findall(text.lower()):
        found.update(_grams_of(word))
    return found


def code(label: Column) -> Column:
    """Two-letter code of an ISO 639-1 or 639-3 code in any case, with or without country; else null."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_][a-z]{2})?$", 1)
    names = F.create_map(*[F.lit(x) for two, threes in CODES.items() for name in (two, *threes) for x in (name, two)])
    return F.try_element_at(names, bare)


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, dict[str, int]]:
    """{language: {n-gram: rank from 0}} of at most `sample` labelled texts per language, chosen by
    hash. Null texts and unknown labels are left out; a language without texts has no profile."""
    rows = labelled.select(code(F.col(f"`{lang}`")).alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    some = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, Counter()).update(grams(t))
        for name, found in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = some.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram")))).where(F.col("rank") <= size)
    profiles: dict[str, dict[str, int]] = {}
    for r in ranked.select("lang", "gram", "rank").collect():  # size rows per language of CODES
        profiles.setdefault(r[0], {})[r[1]] = r[2] - 1
    return profiles


@lru_cache(maxsize=50_000)
def _ids_of(word: str) -> np.ndarray:
    """Hashes of a word's n-grams: lines are ranked on numbers, not strings."""
    return np.array([xxhash.xxh64_intdigest(g) for g in _grams_of(word)], dtype=np.uint64)


class Judge:
    def __init__(self, profiles: dict[str, dict[str, int]], size: int) -> None:
        self.langs = sorted(profiles)
        ids = {g: xxhash.xxh64_intdigest(g) for p in profiles.values() for g in p}
        self.known = np.array(sorted(set(ids.values())), dtype=np.uint64)
        self.missing = float(size)
        self.ranks = np.full((len(self.known), len(self.langs)), np.nan)
        for j, name in enumerate(self.langs):
            for g, rank in profiles[name].items():
                self.ranks[np.searchsorted(self.known, np.uint64(ids[g])), j] = rank

    def __call__(self, line: str) -> tuple[str, float]:
        """The nearest language and the confidence: how much nearer it is than the next, from 0 to 1."""
        words = _WORD.findall(line.lower())
        found, counts = np.unique(np.concatenate([_ids_of(w) for w in words]) if words else np.empty(0, np.uint64), return_counts=True)
        _, group, size = np.unique(-counts, return_inverse=True, return_counts=True)
        ranks = (np.cumsum(size) - (size + 1) / 2)[group]
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hit = self.known[at] == found
        gap = np.abs(ranks[hit][:, None] - self.ranks[at[hit]])
        far = self.missing * (~hit).sum() + np.where(np.isnan(gap), self.missing, gap).sum(axis=0)
        order = np.argsort(far, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], float(1 - far[order[0]] / far[order[1]]) if far[order[1]] else 0.0


def languages(df: DataFrame, profiles: dict[str, dict[str, int]], key: str = "place_id", text: str = "raw_text", label: str = "lang", min_words: int = MIN_WORDS, size: int = PROFILE) -> DataFrame:
    """(key, label, line_no, lang, confidence, n_chars, main): a row per judged line, line_no from 0
    counting all lines between newlines, and one with line_no -1 per document for its main language,
    the one with most characters in judged lines (ties: the earlier code), its confidence weighted
    by characters. label is the two-letter code delivered, null if missing or unknown.

    Lines of fewer than min_words words with a letter aren't judged; documents without a judged line,
    null keys, null texts and failed downloads (`[ERROR:`) have no rows. Repeated rows give their
    rows once; texts aren't shuffled. Without profiles there are no rows.
    """
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), code(F.col(f"`{label}`")).alias("label"), F.col(f"`{text}`").alias("text")).where("key IS NOT NULL AND text IS NOT NULL AND NOT startswith(ltrim(text), '[ERROR:')")
    kinds = pa.schema([("key", pa.string()), ("label", pa.string()), ("line_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_chars", pa.int64()), ("main", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = lru_cache(maxsize=50_000)(Judge(profiles, size)) if profiles else None
        for batch in batches:
            out: list = []
            for name, said, body in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(i, *judged(line), len(line)) for i, line in enumerate(body.split("\n")) if judged and sum(1 for w in line.split() if _WORD.search(w)) >= min_words]
                if not found:
                    continue
                chars: Counter = Counter()
                sure: Counter = Counter()
                for _, lang, confidence, n in found:
                    chars[lang] += n
                    sure[lang] += n * confidence
                main = max(sorted(chars), key=chars.__getitem__)
                out.append((name, said, -1, main, sure[main] / chars.total(), chars[main], main))
                out += [(name, said, *row, main) for row in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, kinds)], schema=kinds)

    schema = "key string, label string, line_no long, lang string, confidence double, n_chars long, main string"
    return rows.mapInArrow(judge, schema).withColumnRenamed("key", key).distinct()


def mislabelled(judged: DataFrame, key: str = "place_id") -> DataFrame:
    """(key, line_no, lang): documents whose label is missing or names another language, as line -1,
    and lines in another language than the document's main one."""
    wrong = (F.col("line_no") == -1) & ~F.col("main").eqNullSafe(F.col("label"))
    return judged.where(wrong | ((F.col("line_no") >= 0) & (F.col("lang") != F.col("main")))).select(key, "line_no", "lang").distinct()
