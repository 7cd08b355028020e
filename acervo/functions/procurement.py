"""Codes, dates, embeddings and anchors of tender records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a missing date.
NULL_LIKE = ("nan", "nat", "none", "null", "", "n/a", "na")


def null_like(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*NULL_LIKE), c)


def cpv_list(c: Column) -> Column:
    """Brackets stripped, split at commas, cut at the dot, left-padded to 8, distinct and sorted."""
    parts = F.split(F.regexp_replace(c, r"[\[\]'\"\s]", ""), ",")
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lpad(F.substring_index(x, ".", 1), 8, "0"))))


def cpv_prefixes(c: Column, n: int = 2) -> Column:
    return F.array_sort(F.array_distinct(F.transform(cpv_list(c), lambda x: F.substring(x, 1, n))))


def cpv_depth(code: Column) -> Column:
    """Digits left when trailing zeros are stripped."""
    return F.length(F.rtrim(code, F.lit("0")))


def comma_list(c: Column) -> Column:
    """Trimmed non-empty parts; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def bag(c: Column) -> Column:
    """`term|count term|count` of whitespace tokens, terms in order: sorted, and the runs of equal ones measured
    by where the next begins."""
    words = F.array_sort(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))

    def runs(w: Column) -> Column:
        n = F.size(w)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
        return F.aggregate(F.array(first), F.array().cast("array<string>"), lambda _, s: F.transform(s, lambda i, k: F.concat(F.element_at(w, i), F.lit("|"), (F.when(k + 2 <= F.size(s), F.get(s, k + 1)).otherwise(n + 1) - i).cast("string"))))

    held = F.aggregate(F.array(words), F.array().cast("array<string>"), lambda _, w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>")))
    return F.array_join(held, " ")


def searchable(*fields: Column) -> Column:
    """Space-joined non-empty values, `nan` and `none` left out."""
    return F.concat_ws(" ", *[F.when(~F.lower(F.trim(f.cast("string"))).isin("", "nan", "none"), f.cast("string")) for f in fields])


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def iso_z(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_vector(c: Column) -> Column:
    """Numbers of a bracketed, comma- or space-separated string; unusable parts are null."""
    return F.transform(F.filter(F.split(F.regexp_replace(c, r"[\[\],]", " "), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("float"))


def cpv5(c: Column) -> Column:
    """Classifier output repaired: digits only, cut at five, four get a zero, else null."""
    d = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 5)
    return F.when(F.length(d) == 5, d).when(F.length(d) == 4, F.concat(d, F.lit("0")))


def garbage(c: Column) -> Column:
    """Texts under 20 characters, or with less than half letters and spaces."""
    good = F.length(F.regexp_replace(c, r"[^\p{L} ]", ""))
    return (F.length(c) < 20) | (good / F.length(c) < 0.5)


def normalise_layout(c: Column) -> Column:
    """CR removed, bullets removed, blanks within lines squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r", ""), "[•·▪]", ""), r"[ \t]+", " ")


def unwrapped(c: Column) -> Column:
    """The trimmed, non-empty items of a list written as text, however deep its brackets; null stays null."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]'\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def finite(c: Column) -> Column:
    """A number as JSON can hold it: null if it isn't one."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def to_record(df: DataFrame, *fields: str) -> Column:
    """A record of these fields as JSON, without those that are null, empty lists or empty maps."""
    kinds = dict(df.dtypes)
    some = lambda f: F.when(F.size(f) > 0, F.col(f)) if kinds[f].startswith(("array", "map")) else F.col(f)
    return F.to_json(F.struct(*[some(f).alias(f) for f in fields]))


_LOT = "ItemClassificationCode string, TaxExclusiveAmount string, numLotes string, name string"


def lots(c: Column) -> Column:
    """The lots of a text: one object or an object with a list `lotes`, as JSON or as a Python literal. Lots
    without any field are left out; other texts give none."""
    text = F.when(F.ltrim(c).startswith("{"), F.regexp_replace(c, r":\s*None\b", ": null"))
    read = lambda schema: F.from_json(text, schema, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    flat, many = read(_LOT), read(f"lotes array<struct<{', '.join(f.replace(' ', ': ') for f in _LOT.split(', '))}>>")["lotes"]
    found = F.coalesce(many, F.when(flat.isNotNull(), F.array(flat)), F.array().cast(f"array<struct<{', '.join(f.replace(' ', ': ') for f in _LOT.split(', '))}>>"))
    return F.filter(found, lambda x: x["ItemClassificationCode"].isNotNull() | x["TaxExclusiveAmount"].isNotNull() | x["numLotes"].isNotNull())
