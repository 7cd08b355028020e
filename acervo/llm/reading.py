"""Labels of prose for a bounded sample of texts, by weak voters that may abstain.

None of the voters uses a statistic the rules are learned from. They read the sample as a whole:

* words: the part of a text's characters in words that occur in several other sampled texts. Where it
  is small the text can't be read: not prose.
* openings: whether its units (split at ends of sentences and at lines that start anew) begin as units
  begin in the other texts, or with words that stand inside units there, as the entries of a list do.
* entries: the part of its characters in lines, or parts between semicolons, that are short and have one
  form, numbers and marks at the same places: a table or a list.
* repetition: the part of its words that are one and the same.

A text is prose if its units begin as sentences, mostly end as such, and no other voter objects; it
isn't if it can't be read, consists of entries or repeats itself, or if its units begin inside
sentences and nothing says they end as such; else it has no label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.runtime import materialise

#: Texts that must share a word before it counts as one; occurrences an opening needs before it is judged.
SHARED, SEEN = 3, 4
#: Below this part of its characters in known words a text can't be read.
READABLE = 0.6
#: From this part of its characters in well begun units a text speaks for prose, to this one against it.
BEGUN, NOT_BEGUN = 0.6, 0.4
#: Part of the characters in entries of one form, words of an entry at most, part of the words that are the same.
ENTRIES, ENTRY_WORDS, SAME = 0.6, 9, 0.3

_WORD = re.compile(r"[^\W\d_]+(?:['’·-][^\W\d_]+)*")
_STARTS = re.compile(r"(?<=[.!?])[)»\"”]?\s+(?=[(«\"“¿¡]?[^\W\d_a-zà-ÿ]|\d+(?:\.\d+)+\s|$)")
_BREAK = re.compile(r"\n\s*\n|\n(?=\s*(?:[^\W\d_a-zà-ÿ]|\d|[-*•·–|]|[a-z]\)))")
_CLOSED = re.compile(r"[.!?][)»\"”]?\s*$")
_FORM = (re.compile(r"\d+"), re.compile(r"[^\W\d_]+(?:['’·-]?[^\W\d_]+)*"), re.compile(r"a(?:\s+a)+"))


def units(text: str) -> list[str]:
    """Sentences, lines that start anew, paragraphs. Broken words at line ends are joined; in texts in
    capitals a line that begins with one doesn't start anew."""
    text = re.sub(r"([^\W\d_])-\n\s*([^\W\d_])", r"\1\2", text)
    letters = [c for c in text if c.isalpha()]
    shouted = sum(map(str.isupper, letters)) > 0.5 * len(letters)
    parts = re.split(r"\n\s*\n", text) if shouted else _BREAK.split(text)
    joined: list[str] = []
    for part in parts:
        joined += [u for u in _STARTS.split(part) if u and u.strip()]
    return joined


def words(unit: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(unit)]


def entry_share(text: str) -> float:
    """The part of the characters in lines, or in parts between semicolons where there are no lines, that
    are entries: short, with a number or mark, and of a form that comes three times."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 3:
        lines = [x for x in re.split(r";|\n", text) if x.strip()]
    forms = []
    for line in lines:
        form = line.strip()
        for pattern, by in zip(_FORM, ("0", "a", "a")):
            form = pattern.sub(by, form)
        short = len(_WORD.findall(line)) <= ENTRY_WORDS
        forms.append(re.sub(r"([^\w\s])\1+", r"\1", form) if short and form != "a" else None)
    counts = Counter(f for f in forms if f is not None)
    return sum(len(x.strip()) for x, f in zip(lines, forms) if counts[f] >= 3) / max(1, sum(len(x.strip()) for x in lines))


def _hash(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(parts)) - (1 << 63)


_READ = (
    "h long, openers array<array<long>>, sizes array<long>, closed array<boolean>, grams array<long>, words array<string>, "
    "letters array<long>, characters long, entries double, same double"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _READ.split(", ")]
    for batch in batches:
        rows: list = []
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            openers, sizes, closed, grams, found = [], [], [], [], Counter()
            for unit in units(text):
                w = words(unit)
                found.update(w)
                sizes.append(sum(map(len, unit.split())))
                closed.append(bool(_CLOSED.search(unit)))
                openers.append([_hash(w[:n]) for n in (3, 2)] if len(w) >= 3 else [])
                grams += [_hash(w[i : i + n]) for n in (3, 2) for i in range(1, len(w) - n + 1)]
            long = {w: n for w, n in found.items() if len(w) > 1}
            same = max(found.values(), default=0) / max(1, found.total())
            rows.append((h, openers, sizes, closed, grams, list(long), [n * len(w) for w, n in long.items()], sum(map(len, text.split())), entry_share(text), same))
        kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def read(texts: DataFrame) -> DataFrame:
    """texts(h long, text string, none null or blank) as units, n-grams and words."""
    return texts.select("h", "text").mapInArrow(_read, _READ)


def label(texts: DataFrame) -> DataFrame:
    """(h, readable, begun, ended, entries, same, prose) of every text in texts(h, text): what the voters
    measured and the label, null where they disagree or can't tell."""
    rows = materialise(read(texts), "read")
    at = rows.select("h", F.posexplode("openers").alias("unit", "o")).where(F.size("o") == 2).select("h", "unit", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col("o")[i].alias("g")) for i, n in ((0, 3), (1, 2))])))
    opens = at.groupBy("g", "h").agg(F.count(F.lit(1)).alias("open"))
    inside = rows.select("h", F.explode("grams").alias("g")).groupBy("g", "h").agg(F.count(F.lit(1)).alias("inside"))
    met = opens.join(inside, ["g", "h"], "left")  # what a text holds itself doesn't speak for it
    total = opens.groupBy("g").agg(F.sum("open").alias("opens")).join(inside.groupBy("g").agg(F.sum("inside").alias("insides")), "g", "left")
    others = met.join(total, "g").select("h", "g", (F.col("opens") - F.col("open")).alias("x"), (F.coalesce("insides", F.lit(0)) - F.coalesce("inside", F.lit(0))).alias("y"))
    odds = others.where(F.col("x") + F.col("y") >= SEEN).select("h", "g", ((F.col("x") + 1) / (F.col("x") + F.col("y") + 2)).alias("odds"))
    judged = at.join(odds, ["h", "g"]).groupBy("h", "unit").agg(F.max_by("odds", "n").alias("odds"))  # three words before two
    parts = rows.select("h", F.posexplode(F.arrays_zip("sizes", "closed", F.transform("openers", lambda o: F.size(o) > 0).alias("full"))).alias("unit", "u"))
    parts = parts.select("h", "unit", "u.sizes", "u.closed", F.col("u")["full"].alias("full")).join(judged, ["h", "unit"], "left")
    known = parts.groupBy("h").agg(
        (F.sum(F.when(~F.col("full"), 0.0).otherwise(F.col("odds") * F.col("sizes"))) / F.nullif(F.sum(F.when(~F.col("full") | F.col("odds").isNotNull(), F.col("sizes"))), F.lit(0))).alias("begun"),
        (F.sum(F.when(F.col("closed") & F.col("full"), F.col("sizes")).otherwise(0)) / F.nullif(F.sum("sizes"), F.lit(0))).alias("ended"),
    )
    used = rows.select("h", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("letters").alias("n"))))
    common = used.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SHARED).select("word")
    readable = used.join(common, "word").groupBy("h").agg(F.sum("n").alias("n"))
    out = rows.select("h", "characters", "entries", "same").join(known, "h", "left").join(readable, "h", "left")
    out = out.withColumn("readable", F.coalesce("n", F.lit(0)) / F.greatest("characters", F.lit(1)))
    begun, ended = F.coalesce("begun", F.lit(0.5)), F.coalesce("ended", F.lit(0.0))
    junk = (F.col("readable") < READABLE) | (F.col("entries") >= ENTRIES) | (F.col("same") >= SAME)
    prose = F.when(junk | ((begun <= NOT_BEGUN) & (ended < 0.5)), False).when((begun >= BEGUN) & (ended >= 0.5), True)
    return out.select("h", "readable", "begun", "ended", "entries", "same", prose.alias("prose"))
