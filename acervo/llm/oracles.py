"""DuckDB statements equal to pN_ queries, where SQL can express them on whole tables."""

_TERMS = r"""
WITH newest AS (
  SELECT * FROM (SELECT place_id, lemmas, bow, row_number() OVER (PARTITION BY place_id ORDER BY indexed_at DESC NULLS LAST, lemmas DESC NULLS LAST, bow DESC NULLS LAST) AS rn
                 FROM corpus WHERE place_id IS NOT NULL) WHERE rn = 1),
spaced AS (
  SELECT place_id, trim(regexp_replace(nfc_normalize(lower(lemmas)), '[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS l,
         trim(regexp_replace(nfc_normalize(lower(bow)), '[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS b FROM newest),
tokens AS (
  SELECT place_id, unnest(string_split(l, ' ')) AS term, 1::BIGINT AS n FROM spaced WHERE coalesce(l, '') <> ''
  UNION ALL
  SELECT place_id, regexp_extract(e, '^(.+)\|([0-9]+)$', 1), TRY_CAST(regexp_extract(e, '^(.+)\|([0-9]+)$', 2) AS BIGINT)
  FROM (SELECT place_id, unnest(string_split(b, ' ')) AS e FROM spaced WHERE coalesce(l, '') = '' AND coalesce(b, '') <> '')
  WHERE regexp_matches(e, '^(.+)\|([0-9]+)$')),
per AS (SELECT place_id, term, sum(n) AS n FROM tokens WHERE n > 0 GROUP BY ALL),
counted AS (SELECT place_id FROM per GROUP BY place_id HAVING sum(n) >= 3),
freq AS (SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS records FROM per SEMI JOIN counted USING (place_id) GROUP BY term),
marked AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.5 * (SELECT count(*) FROM counted) THEN 'common' END AS mark FROM freq)
"""

_VECTORS = """
WITH newest AS (SELECT place_id, embeddings FROM (SELECT place_id, embeddings, row_number() OVER (PARTITION BY place_id ORDER BY indexed_at DESC NULLS LAST, embeddings DESC NULLS LAST) AS rn FROM corpus WHERE place_id IS NOT NULL) WHERE rn = 1),
good AS (SELECT place_id AS id, embeddings::DOUBLE[] AS v FROM newest WHERE len(embeddings) = 96 AND len(list_filter(embeddings, lambda x: x IS NOT NULL AND isfinite(x))) = 96 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
unit AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good),
pairs AS (SELECT a.id, b.id AS neighbour, list_dot_product(a.v, b.v) AS cosine FROM unit a, unit b WHERE a.id <> b.id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, neighbour) AS rank FROM pairs) WHERE rank <= 10)
"""

_VOTES = r"""
WITH said AS (SELECT annotation_id, annotator, instance_id, annotated_at, regexp_extract(lower(trim(regexp_replace(selected_model, '\s+', ' ', 'g'))), '^(?:\{ ?["''] ?)?(a es mejor|b es mejor|ambos son malos)(?: ?["''] ?:[^:]*\})?$', 1) AS label FROM annotations),
v AS (SELECT instance_id, annotator, label FROM (SELECT *, row_number() OVER (PARTITION BY annotator, instance_id ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) AS rn FROM said WHERE label <> '' AND annotator IS NOT NULL) WHERE rn = 1 AND instance_id IN (SELECT id FROM pair_comparisons)),
m AS (SELECT instance_id, label, count(*) AS m FROM v GROUP BY ALL), u AS (SELECT instance_id, sum(m) AS n FROM m GROUP BY 1 HAVING sum(m) > 1),
o AS (SELECT count(DISTINCT instance_id) AS items, sum(m)::BIGINT AS votes, sum(m * (n - m) / (n - 1)::DOUBLE) AS d FROM m JOIN u USING (instance_id)),
t AS (SELECT label, sum(m)::DOUBLE AS t FROM m SEMI JOIN u USING (instance_id) GROUP BY 1)
"""

# The fits as plain recursion: the same fixed points by another path (no extrapolation, the classes' prior in every sweep).
_NAME = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))".format
_RANKED = _VOTES.strip().removeprefix("WITH").split("\nm AS")[0].rstrip().rstrip(",")
_RANKING = f"""
WITH RECURSIVE {_RANKED},
nm AS (SELECT {_NAME("alias")} AS k, min(model) AS m FROM (SELECT alias, model FROM model_alias UNION ALL SELECT model, model FROM model_alias) GROUP BY 1),
pc AS (SELECT DISTINCT id, {_NAME("task_type")} AS task, x.m AS a, y.m AS b FROM pair_comparisons JOIN nm x ON x.k = {_NAME("item_a_model")} JOIN nm y ON y.k = {_NAME("item_b_model")} WHERE x.m <> y.m),
w AS (SELECT task, CASE label WHEN 'a es mejor' THEN a ELSE b END AS winner, CASE label WHEN 'a es mejor' THEN b ELSE a END AS loser FROM v JOIN pc ON pc.id = instance_id WHERE label <> 'ambos son malos'),
n AS (SELECT task, item, other, count(*)::DOUBLE AS n, sum(won)::DOUBLE AS won FROM (SELECT task, winner AS item, loser AS other, 1 AS won FROM w UNION ALL SELECT task, loser, winner, 0 FROM w) GROUP BY ALL),
st AS (SELECT 0 AS turn, task, item, sum(won) AS won, 1.0::DOUBLE AS p FROM n GROUP BY task, item
  UNION ALL SELECT turn + 1, task, item, won, (won + 0.5) / (s + 1.0 / (p + 1)) FROM (
    SELECT x.turn, x.task, x.item, any_value(x.won) AS won, any_value(x.p) AS p, sum(n.n / (x.p + y.p)) AS s FROM st x JOIN n ON n.task = x.task AND n.item = x.item JOIN st y ON y.task = n.task AND y.item = n.other WHERE x.turn < 600 GROUP BY x.turn, x.task, x.item)),
r AS (SELECT task, item, row_number() OVER (PARTITION BY task ORDER BY p DESC, item) AS rank FROM st WHERE turn = 600)
"""
_PSI = lambda x: f"(ln({x} + 6) - 0.5 / ({x} + 6) - 1 / (12.0 * pow({x} + 6, 2)) + 1 / (120.0 * pow({x} + 6, 4)) - 1 / (252.0 * pow({x} + 6, 6))" + "".join(f" - 1 / ({x} + {i}.0)" for i in range(6)) + ")"
_K3 = range(3)
_CONSENSUS = f"""
WITH RECURSIVE {_RANKED},
z AS (SELECT instance_id, annotator, CASE label WHEN 'a es mejor' THEN 0 WHEN 'b es mejor' THEN 1 ELSE 2 END AS l FROM v),
st AS (SELECT 0 AS turn, instance_id, count(*) AS n, {", ".join(f"(count_if(l = {k}) + 0.1) / (count(*) + 0.3) AS q{k}" for k in _K3)} FROM z GROUP BY instance_id
  UNION ALL (WITH c AS (SELECT annotator, {", ".join(f"sum(CASE WHEN l = {j} THEN q{k} ELSE 0 END) + {2 if j == k else 1}.0 AS c{k}{j}" for k in _K3 for j in _K3)} FROM z JOIN st USING (instance_id) GROUP BY annotator),
    g AS (SELECT annotator, {", ".join(f"{_PSI(f'c{k}{j}')} - {_PSI('(' + ' + '.join(f'c{k}{i}' for i in _K3) + ')')} AS l{k}{j}" for k in _K3 for j in _K3)} FROM c),
    a AS (SELECT {", ".join(f"{_PSI(f'(sum(q{k}) + 1.0)')} AS d{k}" for k in _K3)}, any_value(turn) AS turn FROM st),
    e AS (SELECT instance_id, count(*) AS n, {", ".join(f"sum(CASE l {' '.join(f'WHEN {j} THEN l{k}{j}' for j in _K3)} END) AS e{k}" for k in _K3)} FROM z JOIN g USING (annotator) GROUP BY instance_id),
    x AS (SELECT instance_id, n, turn, {", ".join(f"e{k} + d{k} AS e{k}" for k in _K3)} FROM e, a),
    y AS (SELECT instance_id, n, turn, {", ".join(f"exp(e{k} - greatest(e0, e1, e2)) AS w{k}" for k in _K3)} FROM x)
    SELECT turn + 1, instance_id, n, {", ".join(f"w{k} / (w0 + w1 + w2)" for k in _K3)} FROM y WHERE turn < 40))
"""

SQL = {
    "p2_neighbours": _VECTORS + "SELECT id, neighbour, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM near",
    "p2_found": _VECTORS + "SELECT a.id AS place_id_1, a.neighbour AS place_id_2 FROM near a JOIN near b ON a.id = b.neighbour AND a.neighbour = b.id WHERE a.id < a.neighbour AND a.cosine >= 0.85",
    "p3_found": _RANKING + "SELECT task AS task_type, item AS model FROM r WHERE rank <= 5",
    "p6_found": _CONSENSUS + "SELECT instance_id, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 'A es mejor' WHEN q1 >= q2 THEN 'B es mejor' ELSE 'Ambos son malos' END AS selected_model FROM st WHERE turn = 40 AND n >= 3",
    "p6_agreement": _VOTES + "SELECT items, votes, round(1 - d / ((SELECT sum(t * (votes - t)) FROM t) / (votes - 1)), 9) AS alpha FROM o",
    "p1_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p1_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
}
