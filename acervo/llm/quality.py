"""Text quality statistics and an induced rule list that tells prose from lists, tables and junk.

The statistics are native expressions over the whole text. The rules are induced by incremental
reduced-error pruning on a bounded sample of documents, labelled by voters that read the sample
without the statistics (`reading.py`); texts the voters disagree on aren't learned from. The learned
thresholds become one CASE expression that runs on all documents without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.reading import label
from acervo.runtime import materialise

#: Distinct documents sampled for the labels, at most; words taken from the table of common words, at most.
SAMPLE, MAX_COMMON = 4000, 10_000

_ITEM = r"^[ \t]*(?:\d+(?:\.\d+)*[.)]|[a-z]\)|[-*•·–])[ \t]+"
_STOP = r"(?m)[.!?…](?<=(?:\p{L}{2}|\p{L}[ \n]\d{1,4})[.!?…])[)»\"”]?(?=\s+[(«\"“¿¡]?[\p{Lu}\d]|[ \t]*$)"
_NO_VOWEL = r"(?<!\p{L})[^\P{L}aeiouyàáâèéêëìíîïòóôöùúûüœæ]++(?!\p{L})"
_USUAL = r"[\p{Nd}.,;:()/%'’\"«»“”!?¿¡·€–-]++"

STATISTICS = (
    "words", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "line_end_ratio", "common_ratio",
    "distinct_ratio", "words_per_stop", "vowel_ratio", "odd_ratio", "single_ratio", "item_ratio", "words_per_line",
)


def common_list(common: DataFrame) -> list[str]:
    """The distinct words, a bounded table; a longer one is refused."""
    rows = common.select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().orderBy("w").limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return [r[0] for r in rows]


def statistics(df: DataFrame, common: list[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and STATISTICS of the whole text. A null, empty or blank text has 0 words and nulls.

    words_per_stop: tokens for each end of a sentence, a mark after two letters or a word and a number,
    before a capital, a number or the end of a line (all tokens where there is none). A token is what
    whitespace separates, a word what letters make.
    """
    t = F.col("_text")
    size = lambda c: F.length(c).cast("double")
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    rows = rows.withColumns(
        {
            "_tokens": F.filter(F.split(t, r"\s+"), lambda x: x != ""),
            "_lines": F.filter(F.split(t, r"\n"), lambda x: F.trim(x) != ""),
            "_words": F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda x: x != ""),
            "_rest": F.regexp_replace(t, r"\p{L}+", ""),
        }
    )
    rows = rows.withColumn("_marks", F.regexp_replace("_rest", r"\s+", ""))  # what is neither letter nor white space, a small part of a text
    rows = rows.withColumns({"_letters": size(t) - size("_rest"), "_digits": size(F.regexp_replace("_marks", r"\P{Nd}+", "")), "_odd": size(F.regexp_replace("_marks", _USUAL, ""))})
    rows = rows.withColumn("_chars", F.col("_letters") + F.length("_marks"))
    n, m, lines, chars = F.size("_tokens").cast("double"), F.size("_words").cast("double"), F.size("_lines").cast("double"), F.col("_chars")
    ratio = lambda c, of, test: F.when(of > 0, F.size(F.filter(c, test)) / of)
    some = lambda value: F.when(n > 0, value)
    stops = F.regexp_count(t, F.lit(_STOP))
    values = {
        "words": F.coalesce(F.size("_tokens"), F.lit(0)),
        "mean_word_length": some(chars / n),
        "letter_ratio": some(F.col("_letters") / chars),
        "digit_ratio": some(F.col("_digits") / chars),
        "symbol_ratio": some((chars - F.col("_letters") - F.col("_digits")) / chars),
        "line_end_ratio": ratio("_lines", lines, lambda x: x.rlike(r"[.!?:]\s*$")),
        "common_ratio": ratio("_words", m, lambda x: x.isin(common)) if common else F.lit(0.0),
        "distinct_ratio": some(F.size(F.array_distinct("_tokens")) / n),
        "words_per_stop": some(n / F.greatest(stops, F.lit(1))),
        "vowel_ratio": F.when(m > 0, F.greatest(F.lit(0.0), 1 - F.regexp_count(F.lower(t), F.lit(_NO_VOWEL)) / m)),
        "odd_ratio": some(F.col("_odd") / chars),
        "single_ratio": ratio("_tokens", n, lambda x: F.length(x) == 1),
        "item_ratio": ratio("_lines", lines, lambda x: x.rlike(_ITEM)),
        "words_per_line": F.when(lines > 0, n / lines),
    }
    return rows.select(*keep, *[values[c].cast("double").alias(c) for c in STATISTICS])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, STATISTICS.index(self.name)]
        return column > self.value if self.above else column <= self.value

    def sql(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), dtype=bool)
    for c in rule:
        found &= c.holds(x)
    return found


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Conditions by information gain until no negative is covered. All cuts between two values are
    tried; of equal ones the one with most room to its neighbours is taken."""
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < 6 and (inside & ~y).any():
        p, n = (inside & y).sum(), (inside & ~y).sum()
        best = None
        for j, name in enumerate(STATISTICS):
            values, at = np.unique(x[inside, j], return_inverse=True)
            if len(values) < 2:
                continue
            below = np.stack([np.bincount(at, y[inside], len(values)), np.bincount(at, ~y[inside], len(values))]).cumsum(axis=1)[:, :-1]
            room = np.diff(values) / (values[-1] - values[0])
            for above in (True, False):
                p1, n1 = (p - below[0], n - below[1]) if above else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n))), 0.0)
                top = np.lexsort((-room, -np.round(gain, 9)))[0]
                if gain[top] > 1e-9 and (best is None or (gain[top], room[top]) > best[0]):
                    best = (gain[top], room[top]), Condition(name, above, float((values[top] + values[top + 1]) / 2))
        if best is None:
            break
        rule, inside = (*rule, best[1]), inside & best[1].holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The first conditions that do best on the pruning set; shorter rules win ties."""

    def worth(r: Rule) -> float:
        covered = _covers(r, x)
        p, n = (covered & y).sum(), (covered & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
    tight: dict = {}  # of conditions on one side of a statistic only the last one binds
    for c in best:
        tight[c.name, c.above] = c
    return tuple(tight.values())


def induce(x: np.ndarray, y: np.ndarray, seed: int = 3, most: int = 24, tries: int = 4) -> list[Rule]:
    """An ordered list of rules for y, by incremental reduced-error pruning: grow on two thirds of each
    class, prune on the rest, remove what is covered. A rule that errs on half of the pruning set or
    covers nothing new is dropped; after `tries` such splits in a row the list is complete."""
    rng, rules, failed = np.random.default_rng(seed), [], 0
    while y.any() and len(rules) < most and failed < tries:
        place = rng.permutation(len(x))
        growing = np.zeros(len(x), dtype=bool)
        for side in (y, ~y):
            mine = place[side[place]]
            growing[mine[: -(-2 * len(mine) // 3)]] = True
        rule = _grow(x[growing], y[growing])
        rule = _prune(rule, x[~growing], y[~growing]) or rule
        covered = _covers(rule, x[~growing])
        if not rule or (covered.any() and (covered & ~y[~growing]).sum() > 0.5 * covered.sum()) or not (_covers(rule, x) & y).any():
            failed += 1
            continue
        rules.append(rule)
        failed = 0
        left = ~_covers(rule, x)
        x, y = x[left], y[left]
    return rules


def labelled_sample(df: DataFrame, common: list[str], text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and the labels (true: not prose) of at most `sample` distinct texts chosen by
    hash, without those the voters leave unlabelled; in the order of the hash."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h")).where(F.col("text").rlike(r"\S"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return np.empty((0, len(STATISTICS))), np.empty(0, dtype=bool)
    some = materialise(rows.where(F.col("h") <= last).groupBy("h").agg(F.max("text").alias("text")), "sample")  # copies count once
    labels = label(some).where("prose IS NOT NULL").select("h", "prose")
    found = statistics(some, common, "text", ("h",)).join(labels, "h").orderBy("h").collect()  # at most `sample` rows of numbers
    x = np.array([[r[c] if r[c] is not None else 0.0 for c in STATISTICS] for r in found]).reshape(-1, len(STATISTICS))
    return np.nan_to_num(x), np.array([not r["prose"] for r in found], dtype=bool)


def fit_rules(df: DataFrame, common: list[str], text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules for texts that aren't prose, from a labelled sample."""
    x, y = labelled_sample(df, common, text, sample)
    return induce(x, y) if len(y) else []


def case(rules: list[Rule]) -> Column:
    """The rule list as SQL: the number of the first rule that holds, 0 for blank texts, else null."""
    whens = " ".join(f"WHEN {' AND '.join(f'coalesce({c.sql()}, false)' for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1))
    return F.expr(f"CASE WHEN words = 0 THEN 0 {whens} END")


def judge(df: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, STATISTICS, rule, prose): for every row; rule is the rule that says it isn't prose, null
    for prose, 0 for null, empty and blank texts. Repeated rows are judged each; other columns are
    ignored; no rows give no rows."""
    words = common_list(common)
    rules = fit_rules(df, words, text, sample)
    out = statistics(df, words, text, (key,)).withColumn("rule", case(rules))
    return out.withColumn("prose", F.col("rule").isNull())
