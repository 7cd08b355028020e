"""Anchors, snippets, noise and layout against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from acervo.functions import objective as O


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("El presente pliego tiene por objeto el suministro de 20 farolas.", True), ("El present plec té per objecte la millora.", True), ("Ten por obxecto a subministración de papel.", True),
        ("Kontratuaren xedea da hiri bideen hobekuntza.", True), ("Describe condiciones generales sin decir el objeto.", False), ("TIENE  POR\nOBJETO", True), (None, False), ("", False), ("suministros de", False),
    ],
)
def test_anchor(spark, text, found):
    assert one(spark, O.has_anchor, text) is found


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tiene por objeto: la mejora de la vía pública.", "la mejora de la vía pública"), ("El objeto es la renovación de luminarias\ny otros trabajos.", "la renovación de luminarias"),
        ("El objetivo es pavimentar la calle; incluyendo aceras.", "pavimentar la calle"), ("L'objecte és la millora del clavegueram.", "la millora del clavegueram"),
        ("O obxecto é: a subministración de papeleiras.", "papeleiras"), ("Helburua da hiri argiteria berritzea.", "hiri argiteria berritzea"),
        ("El objeto es " + "x" * 400, None), ("Tiene  por\tobjeto   la   limpieza", "la limpieza"), ("suministro de agua. El objeto es la poda de los árboles.", "la poda de los árboles"), (None, None), ("nada", None),
    ],
)
def test_snippet(spark, text, want):
    assert one(spark, lambda c: O.snippet(c, 3, 350), text) == want


def test_lengths_of_a_snippet(spark):
    assert one(spark, lambda c: O.snippet(c, 5, 350), "Tiene por objeto: X.") is None
    assert one(spark, O.snippet, "El objeto es podar. Se hará el suministro de árboles y arbustos.") == "árboles y arbustos"  # the first anchor gives too little


def test_noise_and_purpose(spark):
    assert one(spark, O.noise, "La mejora del firme y la señal.") == 0 and one(spark, O.noise, "") == 1 and one(spark, O.noise, None) == 1
    assert one(spark, O.noise, "Artículo 3. Seguridad y salud en el trabajo. Revisión de precios.") == pytest.approx(3 / 8)
    assert one(spark, O.noise, "obxecto do contrato") == pytest.approx(1 / 8)
    assert one(spark, O.purpose, "Tiene por objeto la poda.") == 1 and one(spark, O.purpose, "Tiene por objeto la poda. Artículo 5: normativa.") == 0.5
    assert one(spark, O.purpose, "Capítulo 2. Normativa aplicable.") == 0 and one(spark, O.purpose, None) == 0


def test_strip_layout(spark):
    lines = ["1.2 Objeto del contrato..................15", "12", "12/45", "EXCAVADORA HIDRÁULICA", "2.3 Condiciones generales", "Tiene por objeto la poda.", "", "Texto normal sin patrones.", "Título.........", "uno.... dos"]
    assert one(spark, O.strip_layout, "\n".join(lines)) == "Tiene por objeto la poda.\nTexto normal sin patrones.\nuno… dos"
    assert one(spark, O.strip_layout, "Objeto del contrato y fin del mismo") == "Objeto del contrato y fin del mismo"
    assert one(spark, O.strip_layout, None) is None


def test_clip(spark):
    text = "Una frase corta. Otra frase algo más larga. Y el resto sin fin"
    assert one(spark, lambda c: O.clip(c, 50), text) == "Una frase corta. Otra frase algo más larga."
    assert one(spark, lambda c: O.clip(c, 20), "sin ningún punto hasta el final") == "sin ningún punto has"
    assert one(spark, lambda c: O.clip(c, 30), "hola " * 3 + "\n\n" + "resto " * 9) == ("hola " * 3 + "\n\n" + "resto " * 9)[:30].strip()


def test_extracted(spark):
    assert one(spark, O.extracted, None) == O.UNOPENED and one(spark, O.extracted, "") == O.ILLEGIBLE and one(spark, O.extracted, "% 12 $$ 45 == 99 ## 1234 !!") == O.ILLEGIBLE
    assert one(spark, O.extracted, "Ha habido un error de acceso a la página") == O.FILTERED
    assert one(spark, O.extracted, "  El  pliego «técnico» nº 5,\ncon (anexo) [1]; fin. ") == "El pliego técnico n 5, con (anexo) [1]; fin."


def test_pieces(spark):
    assert one(spark, lambda c: O.pieces(c, 4), "abcdefghij") == ["abcd", "efgh", "ij"] and one(spark, lambda c: O.pieces(c, 4), "") == []
    assert one(spark, lambda c: O.sentence_pieces(c, 20), "Uno dos tres. Cuatro. Cinco seis siete ocho") == ["Uno dos tres.", "Cuatro.", "Cinco seis siete ocho."]
    assert one(spark, lambda c: O.sentence_pieces(c, 20), "corto") == ["corto"]


def test_refused(spark):
    assert [one(spark, O.refused, x) for x in (None, "<think> a", "Aquí No Aplicable.", " Suministro de agua ")] == ["/", "/", "/", "Suministro de agua"]


def test_plain_string(spark):
    assert one(spark, O.plain_string, "Café #1 -- niño… fin... ya. ¡sí") == "Café  1    niño fin ya sí"
