"""Anchors, snippets, noise and layout of technical texts (regular expressions of the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings and phrases that introduce the object of a contract, by language.
HEADS = (
    r"objeto\s+de\s+la\s+contrataci[oó]n", r"objeto\s+del\s+contrato", r"objeto\s+dei\s+contrato",
    r"objeto\s+del\s+procedimiento\s+de\s+contrataci[oó]n", r"informaci[oó]n\s+sobre\s+el\s+procedimiento\s+de\s+contrataci[oó]n",
    r"objetivos?\s+del\s+contrato", r"objeto\s+del\s+pliego", r"proyecto\s+b[aá]sico\s+y(?:\s+de)?\s+ejecuci[oó]n",
    r"objecte\s+de\s+la\s+contractaci[oó]", r"objecte\s+del\s+contracte", r"objecte\s+del\s+procediment\s+de\s+contractaci[oó]n?",
    r"informaci[oó]?\s+sobre\s+el\s+procediment\s+de\s+contractaci[oó]n?", r"objectius?\s+del\s+contracte", r"objecte\s+del\s+plec",
    r"obxecto\s+da\s+contrataci[oó]n", r"obxecto\s+do\s+contrato", r"obxecto\s+do\s+prego",
    r"kontratuaren\s+xedea", r"kontratazioaren\s+xedea", r"kontratuaren\s+helburua", r"kontratazioaren\s+helburua",
)
VERBS = (
    r"el\s+presente\s+(?:pliego|proyecto|contrato)\s+(?:tiene|tendr[aá])\s+por\s+objeto", r"tiene\s+por\s+objeto", r"definir\s+las\s+obras\s+de",
    r"suministro\s+de", r"el\s+objeto\s+es", r"el\s+objetivo\s+es",
    r"el\s+present\s+(?:plec|projecte|contracte)\s+(?:t[eé]|tindr[aà])\s+per\s+objecte", r"t[eé]\s+per\s+objecte", r"definir\s+les\s+obres\s+de",
    r"subministrament\s+de", r"l'?objecte\s+é?s", r"l'?objectiu\s+é?s",
    r"ten\s+por\s+obxecto", r"definir\s+as\s+obras\s+de", r"subministraci[oó]n\s+de", r"o\s+obxecto\s+é?s", r"o\s+obxectivo\s+é?s",
    r"xedea\s+da", r"helburua\s+da", r"lanak\s+definitzea", r"hornidura\s+de",
)
#: What precedes an objective, in the order tried.
ANCHORS = (
    r"el\s+presente\s+(?:pliego|proyecto|contrato)\s+(?:tiene|tendr[aá])\s+por\s+objeto", r"tiene\s+por\s+objeto", r"el\s+objeto\s+es", r"el\s+objetivo\s+es",
    r"definir\s+las\s+obras\s+de", r"proyecto\s+b[aá]sico\s+y(?:\s+de)?\s+ejecuci[oó]n", r"proyecto\s+b[aá]sico\s+y(?:\s+de)?\s+ejecuci[oó]n\s+de", r"suministro\s+de",
    r"el\s+present\s+(?:plec|projecte|contracte)\s+(?:t[eé]|tindr[aà])\s+per\s+objecte", r"t[eé]\s+per\s+objecte", r"l'?objecte\s+é?s", r"l'?objectiu\s+é?s",
    r"definir\s+les\s+obres\s+de", r"subministrament\s+de",
    r"ten\s+por\s+obxecto", r"o\s+obxecto\s+é?s", r"o\s+obxectivo\s+é?s", r"definir\s+as\s+obras\s+de", r"subministraci[oó]n\s+de",
    r"xedea\s+da", r"helburua\s+da", r"lanak\s+definitzea", r"hornidura\s+de",
)
#: Words of norms and machinery that mark noise. The last one also meets the plain word "do".
NOISE = (
    r"art[ií]culo", r"cap[ií]tulo", "normativa", r"legislaci[oó]n", "obligaciones?", r"protecci[oó]n\s+de\s+datos", r"control\s+de\s+calidad", r"prevenci[oó]n",
    r"seguridad\s+y\s+salud", r"revisi[oó]n\s+de\s+precios", r"valoraci[oó]n", r"abono\s+de\s+las\s+obras", "maquinaria", r"medios\s+personales",
    r"director[a]?\s+de\s+obra", r"D\.?O\.?",
)
#: Lines of tables of contents, numbered headers, machinery and page numbers; dot leaders.
TOC = r"^\s*(?:\d+(?:[\.\s]\d+){0,3})\s*[-–.]?\s*[A-ZÁÉÍÓÚÑa-záéíóúñ][^.\n]{2,}\.{3,}\s*\d+\s*$"
HEADER = r"^\s*(?:\d+(?:[\.\-\s]\d+){0,4})\s*[-–\.]*\s*[A-ZÁÉÍÓÚÑa-záéíóúñ].{0,120}$"
MACHINERY = r"^\s*(?:\d+(?:\.\d+)*\.-?\s*)?[A-ZÁÉÍÓÚÑ]{3,}(?:\s+[A-ZÁÉÍÓÚÑ]{3,}){0,6}\.?(\s*\.)*\s*$"
PAGE = r"^\s*\d+\s*(?:/\s*\d+)?\s*$"
LEADER = r"\.{5,}"
LEADER_LINE, HEADER_LINE = 200, 80
#: Phrases of answers that hold no objective.
REFUSALS = (
    "no se ha proporcionado", "no aplicable", "no se ha proporcionado información suficiente", "no incluye información específica",
    "no se puede redactar una descripción detallada", "mensaje de error de la plataforma de contratación",
    "no aparece de forma explícita en el contexto proporcionado", "descripción detallada, precisa y fiel de la actividad contratada",
    "mix of catalan", "the text you provided appears to be a mix", "unclear objective",
)
#: Messages of pages that aren't the document, and the classes of extracted text.
NOT_THE_DOCUMENT = (
    "Consiga Adobe Reader", "un error de acceso", "una copia impresa del documento electrónico",
    "El documento no aplica a la contratación específica", "Redireccionando a la pagina principal del Portal",
)
FILTERED, ILLEGIBLE, UNOPENED = "PDF CON ERROR (Sin información válida)", "PDF CON ERROR (Texto ilegible)", "PDF CON ERROR (Apertura)"

_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _any(patterns: tuple[str, ...]) -> str:
    return f"(?iu){_LEFT}(?:{'|'.join(patterns)}){_RIGHT}"


def has_anchor(c: Column) -> Column:
    return F.coalesce(c.rlike(_any(HEADS + VERBS)), F.lit(False))


def flow(c: Column) -> Column:
    """Line ends alike, blanks within lines and empty lines squeezed, outer white space gone."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r"\n+", "\n"), r"^\s+|\s+$", "")


def snippet(c: Column, least: int = 15, most: int = 350) -> Column:
    """What follows the first anchor of the list whose first place gives least..most characters, up to a
    full stop, a line end or a semicolon; null if none does."""
    text = flow(c)

    def one(anchor: str) -> Column:
        found = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?iu)(?:{anchor})[ \t]*[:\-]?[ \t]*([^\n.;]+)", 1), r"\s+", " "))
        return F.when(F.length(found).between(least, most), found)

    return F.coalesce(*[one(a) for a in ANCHORS])


def noise(c: Column, least: int = 8, per: int = 30) -> Column:
    """min(1, noisy words / max(8, words / 30)); 1 for null and empty texts."""
    words = F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")))
    bad = F.regexp_count(c, F.lit(_any(NOISE)))
    return F.when(F.length(c) > 0, F.least(F.lit(1.0), bad / F.greatest(F.lit(float(least)), words / float(per)))).otherwise(1.0)


def purpose(c: Column) -> Column:
    """1 for an anchor, less a half for a noisy word, within 0..1."""
    bad = F.coalesce(c.rlike(_any(NOISE)), F.lit(False))
    return F.greatest(F.lit(0.0), has_anchor(c).cast("double") - 0.5 * bad.cast("double"))


def strip_layout(c: Column) -> Column:
    """Blank lines, page numbers, lines of contents, machinery, short dot leaders and numbered headers dropped;
    a line with an anchor stays unless it is one of contents or a page number. Runs of four dots or
    more become an ellipsis."""

    def keep(x: Column) -> Column:
        line = F.regexp_replace(x, r"^\s+|\s+$", "")
        plain = line.rlike(PAGE) | line.rlike(TOC)
        leader = line.rlike(LEADER) & (F.length(line) < LEADER_LINE)
        header = line.rlike(HEADER) & (F.length(line) <= HEADER_LINE)
        return (line != "") & ~plain & (has_anchor(line) | ~(leader | line.rlike(MACHINERY) | header))

    return F.regexp_replace(F.array_join(F.filter(F.split(c, r"\r\n|\r|\n"), keep), "\n"), r"\.{4,}", "…")


def clip(c: Column, limit: int, least: float = 0.6) -> Column:
    """Cut to limit characters, back to the last end of a sentence before white space, or to the first empty
    line where there is none, if that keeps more than 60 % of them."""
    head = F.substring(c, 1, limit)
    ends = F.regexp_extract(head, r"(?s)^(.*[.!?]\s+)", 1)
    whole = F.when(ends != "", ends).otherwise(F.regexp_extract(head, r"(?s)^(.*?\n\n)", 1))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(F.length(c) <= limit, c).when(F.length(whole) > least * limit, trimmed(whole)).otherwise(trimmed(head))


def window(c: Column, part: Column, before: int = 300, after: int = 500) -> Column:
    """The text around the first place of a snippet; null if it isn't there."""
    at = F.instr(c, part)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, c.substr(start, at - start + F.length(part) + after))


def page_similarity(a: Column, b: Column) -> Column:
    """Share of equal characters by position, digits alike, over the longer text; null if both are empty."""
    mask = lambda c: F.split(F.regexp_replace(c, r"\d", "@"), "")
    x, y = mask(a), mask(b)
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "")), lambda e: e))
    return same / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0))


def sections(c: Column, headers: dict[str, str]) -> dict[str, Column]:
    """The text under each `### header` (patterns, case doesn't matter) up to the next of them, trimmed; empty if
    the header is missing or the text null."""
    stop = "|".join(headers.values())

    def one(pattern: str) -> Column:
        found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?isu)###\s+(?:{pattern})\s*(.*?)(?=###\s+(?:{stop})|\z)", 1)
        return F.regexp_replace(found, r"^\s+|\s+$", "")

    return {name: one(pattern) for name, pattern in headers.items()}


def refused(c: Column) -> Column:
    """Model answers without an objective, null ones and unfinished thoughts become `/`; others are trimmed."""
    low = F.lower(c)
    empty = c.isNull() | c.startswith("<think>")
    for phrase in REFUSALS:
        empty = empty | low.contains(phrase)
    return F.when(empty, "/").otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def letters(c: Column) -> Column:
    """The number of letters and white space."""
    return F.regexp_count(c, F.lit(r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ\s]"))


def plain(c: Column) -> Column:
    """Plain characters only, white space squeezed and trimmed."""
    kept = F.regexp_replace(c, r"[^a-zA-Z0-9áéíóúÁÉÍÓÚñÑ.,;()\[\]\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def legible(c: Column) -> Column:
    """False under 20 characters or with less than half letters and white space."""
    return (F.length(c) >= 20) & (letters(c) / F.greatest(F.length(c), F.lit(1)) >= 0.5)


def extracted(c: Column) -> Column:
    """Text of a file as it goes on: the message of its class, or the text kept to plain characters with
    white space squeezed. Null is a file that can't be opened; an empty text is illegible."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    other = F.lit(False)
    for part in NOT_THE_DOCUMENT:
        other = other | text.contains(part)
    return F.when(c.isNull(), UNOPENED).when(other, FILTERED).when(~legible(text), ILLEGIBLE).otherwise(plain(text))


def plain_string(c: Column) -> Column:
    """Composed form, characters of Spanish texts only, marks to spaces, dots dropped with their spaces."""
    import unicodedata

    import pandas as pd

    nfc = F.pandas_udf(lambda s: pd.Series([None if x is None else unicodedata.normalize("NFC", x) for x in s], dtype=object), "string")
    text = F.regexp_replace(nfc(c), r"[^\x00-\x7fáéíóúÁÉÍÓÚñÑüÜ¿¡]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[¡!#\\/{}&^_-]", " "), r"\.{2,}", ".")
    return F.regexp_replace(F.regexp_replace(text, r"(?:\s*\.\s*)+", " "), r"^\s+|\s+$", "")


def pieces(c: Column, size: int) -> Column:
    """Consecutive pieces of `size` characters; none of an empty text."""
    count = F.ceil(F.length(c) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: c.substr(i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentence_pieces(c: Column, most: int = 1536) -> Column:
    """Sentences (split at a full stop and a space) packed in order into pieces under `most` characters; a
    longer sentence is a piece of its own. A text of at most `most` is one piece."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["now"], x, F.lit(". "))
        flushed = F.when(s["now"] != "", F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"])
        fits = F.length(s["now"]) + F.length(x) + 2 < most
        return F.when(fits, F.struct(s["done"].alias("done"), more.alias("now"))).otherwise(F.struct(flushed.alias("done"), F.concat(x, F.lit(". ")).alias("now")))

    packed = F.aggregate(F.split(c, r"\. "), start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"]))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= most, F.array(c)).otherwise(packed)


def top_label(labels: Column, scores: Column, threshold: float) -> Column:
    """The first label of the highest score, of those at or above the threshold if there are any (which is the
    highest of all)."""
    best = F.array_max(scores)
    return F.struct(labels[F.array_position(scores, best).cast("int") - 1].alias("label"), best.alias("score"), (best >= threshold).alias("sure"))
