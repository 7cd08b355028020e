"""Attribute-value rows into wide tables (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acervo.operators.wide import cells, widen
from acervo.plans.registry import query
from acervo.runtime import table


@query("p4_wide")
def p4_wide(spark, d):
    return _wide(spark, d, True)


def _wide(spark, d, blank):
    return widen(table(spark, d, "metadatos"), table(spark, d, "metadata_keys"), table(spark, d, "uploads"), blank=blank)


_SQL = r"""
WITH names AS (SELECT attribute, value_type, regexp_replace(strip_accents(lower(unnest([attribute, label]))), '[^\p{L}\p{N}]+', '', 'g') AS k FROM metadata_keys),
r AS (SELECT m.id, m.document_id, n.attribute, n.value_type AS t, trim(regexp_replace(metadata_value, '[\s\x{a0}]+', ' ', 'g')) AS v
      FROM metadatos m JOIN (SELECT DISTINCT * FROM names) n ON regexp_replace(strip_accents(lower(m.metadata_key)), '[^\p{L}\p{N}]+', '', 'g') = n.k
      WHERE m.document_id IN (SELECT id FROM uploads)),
l AS (SELECT *, lower(v) AS w, regexp_extract(v, '^\+?([0-9]+)', 1) AS d, regexp_replace(lower(v), '€|euros?|eur|[ ]', '', 'g') AS a FROM r WHERE lower(v) NOT IN ('', '-', '--', '?', '??', 'n/a', 'n.a.', 'na', 'n/d', 'n.d.', 'nd', 'nan', 'nat', 'none', 'null', 's/n', 'solicitado', 'solicitada', 'requested', 'unknown', 'desconocido', 'desconocida', 'ninguno', 'ninguna', 'pendiente', 'a determinar', 'ver pliego', 'ver anexo', 'ver anexo ii', 'consultar', 'varios', 'según oferta')),
c AS (SELECT id, document_id, attribute, CASE t
  WHEN 'text' THEN v
  WHEN 'cpv' THEN CASE WHEN regexp_matches(v, '^[0-9]{7,8}(-[0-9]|\.0+)?$') THEN lpad(d, 8, '0') END
  WHEN 'postal' THEN CASE WHEN regexp_matches(v, '^[0-9]{4,5}(\.0+)?$') AND lpad(d, 5, '0')[1:2] BETWEEN '01' AND '52' THEN lpad(d, 5, '0') END
  WHEN 'integer' THEN CASE WHEN regexp_matches(v, '^\+?[0-9]{1,18}([.,]0+)?( ?\p{L}+\.?)?$') THEN TRY_CAST(d AS BIGINT)::VARCHAR END
  WHEN 'decimal' THEN CASE WHEN regexp_matches(a, '^\+?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+|[0-9]{1,3}(,[0-9]{3})+)[.,][0-9]{2}$') THEN TRY_CAST(regexp_replace(a[:-4], '[^0-9]', '', 'g') || '.' || a[-2:] AS DECIMAL(38, 2))::VARCHAR END
  WHEN 'date' THEN TRY_CAST(CASE
     WHEN regexp_matches(w, '^[0-9]{4}-?[0-9]{2}-?[0-9]{2}(t.*)?$') THEN regexp_replace(w, '^([0-9]{4})-?([0-9]{2})-?([0-9]{2}).*$', '\1-\2-\3')
     WHEN regexp_matches(w, '^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}$') THEN regexp_extract(w, '([0-9]{4})$', 1) || '-' || lpad(regexp_extract(w, '^[0-9]+[-/]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(w, '^([0-9]+)', 1), 2, '0')
     WHEN regexp_matches(w, '^[0-9]{1,2} de [a-z]+ de [0-9]{4}$') THEN right(w, 4) || '-' || lpad(list_position(['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'], regexp_extract(w, ' de ([a-z]+) de', 1))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(w, '^([0-9]+)', 1), 2, '0')
     END AS DATE)::VARCHAR
  WHEN 'boolean' THEN CASE WHEN w IN ('true', 'verdadero', 'si', 'sí', 's', '1', '1.0', 'yes') THEN 'true' WHEN w IN ('false', 'falso', 'no', 'n', '0', '0.0') THEN 'false' END
  END AS cell_value FROM l)
SELECT document_id, attribute, cell_value FROM (SELECT *, row_number() OVER (PARTITION BY document_id, attribute ORDER BY id DESC, cell_value DESC) AS rn FROM c WHERE cell_value IS NOT NULL) WHERE rn = 1"""


_FAILED = _SQL.replace("n.value_type AS t, trim(", "n.value_type AS t, metadata_value AS raw, trim(").replace("c AS (SELECT id, document_id, attribute, CASE t", "c AS (SELECT id, document_id, attribute, raw, CASE t")
_FAILED = _FAILED[: _FAILED.rindex("SELECT document_id, attribute, cell_value FROM")] + "SELECT document_id, attribute, raw AS failed FROM (SELECT *, row_number() OVER (PARTITION BY document_id, attribute ORDER BY id DESC, raw DESC) AS rn FROM c WHERE cell_value IS NULL) WHERE rn = 1"


@query("p4_failures", _FAILED)
def p4_failures(spark, d):
    """Of every document and attribute the newest value that could not be cast."""
    return _wide(spark, d, True).select("document_id", F.explode("failures").alias("attribute", "failed"))


@query("p4_found", _SQL)
def p4_found(spark, d):
    return cells(_wide(spark, d, False))  # a row of nulls has no cells
