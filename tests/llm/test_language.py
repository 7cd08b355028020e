import random

from acervo.llm.language import Judge, fit_profiles, grams, languages, mislabelled

ES = ["el contrato de la obra se adjudica a la empresa que presenta la oferta", "los residuos de la ciudad son recogidos por el servicio municipal cada noche", "la mesa revisa las ofertas y propone una adjudicación al órgano"]
EN = ["the contract for the works is awarded to the company with the best bid", "the waste of the city is collected every night by the municipal service", "the board reviews the bids and proposes an award to the authority"]


def labelled(spark):
    rows = [(i, lang, " ".join(random.Random(i).sample(texts, 3))) for lang, texts in (("es", ES), ("ENG", EN)) for i in range(20)]
    return spark.createDataFrame([*rows, (99, "es", None), (98, "xx", "zzz"), (None, None, "q")], "doc_id int, lang string, text string")


def test_languages(spark):
    profiles = fit_profiles(labelled(spark))
    assert set(profiles) == {"es", "en"} and profiles["es"]["_"] < 3
    rows = [
        ("a", "es-ES", f"{ES[0]}\nTítulo corto\n{EN[1]}\n{ES[1]}\n{ES[2]}", 1), ("b", "fr", EN[0], 1), ("c", None, EN[0].upper(), 1), ("d", " ENG ", EN[2], 1), ("e", "en", "[ERROR: x] " + ES[0], 1),
        ("f", "en", None, 1), ("g", "en", "", 1), ("h", "en", "one two three four five", 1), (None, "en", EN[0], 1), ("b", "fr", EN[0], 1), ("i", "??", "1 2 3 4 5 6 7 8", 1),
    ]
    df = spark.createDataFrame(rows, "place_id string, lang string, raw_text string, line_no int")
    judged = languages(df, profiles)
    got = sorted(tuple(r) for r in mislabelled(judged).collect())
    assert got == [("a", 2, "en"), ("b", -1, "en"), ("c", -1, "en")]
    assert all(0 <= r["confidence"] <= 1 for r in judged.collect())
    assert languages(df.limit(0), profiles).collect() == [] and languages(df, {}).collect() == []


def test_out_of_place_against_plain_loop():
    profiles = {"es": {g: i for i, (g, _) in enumerate(grams(" ".join(ES)).most_common(200))}, "en": {g: i for i, (g, _) in enumerate(grams(" ".join(EN)).most_common(200))}}
    judge = Judge(profiles, 200)
    for line in ES + EN:
        ranked = sorted(grams(line).items(), key=lambda x: -x[1])
        place = {g: sum(i for i, (_, m) in enumerate(ranked) if m == n) / sum(m == n for _, m in ranked) for g, n in ranked}
        far = {k: sum(abs(i - p[g]) if g in p else 200 for g, i in place.items()) for k, p in profiles.items()}
        lang, confidence = judge(line)
        assert lang == min(far, key=far.get) and abs(confidence - (1 - min(far.values()) / max(far.values()))) < 1e-12


def test_held_out_accuracy(spark):
    """Lines of delivered documents, judged by profiles from another table, agree with the labels."""
    sf = "/root/testdata/sf0.001"
    profiles = fit_profiles(spark.read.parquet(f"{sf}/documents.parquet"))
    judged = languages(spark.read.parquet(f"{sf}/pliegos.parquet"), profiles).where("line_no = -1 AND label IS NOT NULL")
    assert judged.count() > 50 and judged.where("label = main").count() > 0.75 * judged.count()  # labels are partly wrong


def test_planted_mixed_lines(spark):
    """Lines of labelled documents that no profile saw, mixed into documents of another language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "lang", "text")
    rows = [r for r in docs.orderBy("doc_id").collect() if r["lang"] in ("es", "ca", "gl", "eu", "en", "fr") and r["text"]]
    train, held = [r for r in rows if r["doc_id"] % 2], [r for r in rows if not r["doc_id"] % 2]
    profiles = fit_profiles(spark.createDataFrame(train, docs.schema))
    pool = {}
    for r in held:
        prose = [x for x in r["text"].split("\n") if len(x.split()) >= 8 and x.rstrip().endswith(".") and x[0].isalpha() and "|" not in x and len(x) / len(x.split()) > 4]
        pool.setdefault(r["lang"], []).extend(prose[:3])
    langs = sorted(pool)
    assert len(langs) == 6
    bodies, want = [], {}
    for i in range(60):
        main, other = langs[i % 6], langs[(i + 1 + i // 6 % 5) % 6]
        lines = [pool[main][(i + j) % len(pool[main])] for j in range(3)]
        lines.insert(i % 4, pool[other][i % len(pool[other])])
        bodies.append((f"d{i}", None, "\n".join(lines)))
        want[f"d{i}"] = [other if j == i % 4 else main for j in range(4)]
    got = languages(spark.createDataFrame(bodies, "place_id string, lang string, raw_text string"), profiles).where("line_no >= 0").collect()
    right = sum(r["lang"] == want[r["place_id"]][r["line_no"]] for r in got)
    assert len(got) == 240 and right >= 0.98 * len(got), right
