"""JVM-side cleaning and typing of free-text values. Every function maps null to null."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "requested", "none" and "unknown", lower case: the default of a parameter of the wide table.
PLACEHOLDERS = (
    "", "-", "--", "?", "??", "n/a", "n.a.", "na", "n/d", "n.d.", "nd", "nan", "nat", "none", "null", "s/n", "solicitado", "solicitada",
    "requested", "unknown", "desconocido", "desconocida", "ninguno", "ninguna", "pendiente", "a determinar", "ver pliego", "ver anexo",
    "ver anexo ii", "consultar", "varios", "según oferta",
)
#: Spanish month names in calendar order, and words for true and false.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
TRUE, FALSE = ("true", "verdadero", "si", "sí", "s", "1", "1.0", "yes"), ("false", "falso", "no", "n", "0", "0.0")

_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]+"


@cache
def _accents() -> tuple[str, str]:
    """Composed letters of the Latin blocks and their base letters, by Unicode decomposition."""
    pairs = [(c, d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", c := chr(i))) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def squeeze(c: Column) -> Column:
    """Trimmed, inner runs of any whitespace as one space."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def unaccent(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")


def key_of(c: Column) -> Column:
    """Comparison form of a name: no case, accents, punctuation or spacing."""
    return F.regexp_replace(unaccent(F.lower(c)), r"[^\p{L}\p{N}]+", "")


def is_placeholder(s: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return F.lower(s).isin(*placeholders)


def _matched(c: Column, pattern: str, value: Column) -> Column:
    return F.when(c.rlike(pattern), value)


# The parsers take squeezed text.


def as_text(c: Column) -> Column:
    return c


def as_cpv(c: Column) -> Column:
    """Eight digits; check digit or decimal part dropped, one lost leading zero restored."""
    return _matched(c, r"^[0-9]{7,8}(-[0-9]|\.0+)?$", F.lpad(F.regexp_extract(c, r"^([0-9]+)", 1), 8, "0"))


def as_postal(c: Column) -> Column:
    """Five digits of a Spanish province (01-52); one lost leading zero restored."""
    five = F.lpad(F.regexp_extract(c, r"^([0-9]+)", 1), 5, "0")
    return F.when(c.rlike(r"^[0-9]{4,5}(\.0+)?$") & F.substring(five, 1, 2).between("01", "52"), five)


def as_integer(c: Column) -> Column:
    """Plain digits of a non-negative whole number, a unit word after it allowed."""
    return _matched(c, r"(?iU)^\+?[0-9]{1,18}([.,]0+)?( ?\p{L}+\.?)?$", F.regexp_replace(F.regexp_extract(c, r"^\+?([0-9]+)", 1), r"^0+(?=[0-9])", ""))


def as_decimal(c: Column) -> Column:
    """Two decimals and a dot, no grouping; groups by dot, comma or space, currency dropped.
    What follows the last separator is the decimal part, two digits."""
    s = F.regexp_replace(F.lower(c), r"€|euros?|eur\b| ", "")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^\+?(.*?)([.,][0-9]{2})?$", 1), r"[.,]", ""), r"^0+(?=[0-9])", "")
    cents = F.regexp_extract(s, r"[.,]([0-9]{2})$", 1)
    ok = s.rlike(r"^\+?([0-9]{1,30}|[0-9]{1,3}(\.[0-9]{3}){1,9}(?=,|$)|[0-9]{1,3}(,[0-9]{3}){1,9}(?=\.|$))([.,][0-9]{2})?$") & (cents != "")
    return F.when(ok, F.concat(whole, F.lit("."), cents))


def as_date(c: Column) -> Column:
    """yyyy-mm-dd of year-first forms (with or without time), day-first forms and `d de mes de yyyy`."""
    s = F.lower(c)
    first = r"^([0-9]{4})[-/.]?([0-9]{2})[-/.]?([0-9]{2})([t ][0-9:.]+(z|[+-][0-9:]+)?)?$"
    last = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
    words = r"^([0-9]{1,2}) de (\p{L}+) de ([0-9]{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(s, words, 2)).cast("string")
    g = lambda p, i: F.regexp_extract(s, p, i)
    ymd = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    text = F.when(s.rlike(first), ymd(g(first, 1), g(first, 2), g(first, 3))).when(s.rlike(last), ymd(g(last, 3), g(last, 2), g(last, 1))).when(s.rlike(words), ymd(g(words, 3), month, g(words, 1)))
    return text.try_cast("date").cast("string")


def as_boolean(c: Column) -> Column:
    s = F.lower(c)
    return F.when(s.isin(*TRUE), "true").when(s.isin(*FALSE), "false")


#: value type -> (canonical text of squeezed text or null if impossible, type of the column)
PARSERS = {
    "text": (as_text, "string"), "cpv": (as_cpv, "string"), "postal": (as_postal, "string"), "integer": (as_integer, "bigint"),
    "decimal": (as_decimal, "decimal(38,2)"), "date": (as_date, "date"), "boolean": (as_boolean, "boolean"),
}
#: The same for text as it comes.
TYPES = {kind: (lambda c, parse=parse: parse(squeeze(c)), column) for kind, (parse, column) in PARSERS.items()}
