"""Attribute-value rows into wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.clean import PARSERS, PLACEHOLDERS, TYPES, is_placeholder, key_of, squeeze

#: The attributes become columns, so their number is bounded; a longer list is refused.
MAX_ATTRIBUTES = 2000


def attributes_of(keys: DataFrame) -> list[tuple[str, str, str]]:
    """(attribute, label, value_type) of the attribute table, in attribute order."""
    rows = keys.select("attribute", "label", "value_type").where("attribute IS NOT NULL").distinct().orderBy("attribute", "label", "value_type").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return [(r[0], r[1] or r[0], r[2] if r[2] in TYPES else "text") for r in rows]


def resolved_pairs(eav: DataFrame, attributes: list[tuple[str, str, str]], entity: str, key: str, value: str, order: str, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """(entity, attribute, value, failed): per pair the newest valid canonical value, and the newest
    value that is neither valid nor a placeholder. Aggregated in every task before the shuffle."""
    by_key: dict[str, tuple[str, str]] = {}
    names = eav.sparkSession.createDataFrame([(a, l) for a, l, _ in attributes] or [("", "")], "a string, l string")
    for a, ka, kl in names.select("a", key_of(F.col("a")), key_of(F.col("l"))).collect():
        kind = next((t for x, _, t in attributes if x == a), "text")
        by_key.setdefault(ka, (a, kind)), by_key.setdefault(kl, (a, kind))
    by_key.pop("", None)
    if not by_key:
        by_key = {"\0": ("\0", "text")}
    attr = F.create_map(*[F.lit(x) for k, (a, t) in by_key.items() for x in (k, f"{t}:{a}")])
    rows = eav.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{order}`").alias("id"), F.col(f"`{value}`").alias("raw"), F.try_element_at(attr, key_of(F.col(f"`{key}`"))).alias("ta"))
    rows = rows.where("entity IS NOT NULL AND ta IS NOT NULL AND raw IS NOT NULL")
    rows = rows.select("entity", "id", "raw", F.substring_index("ta", ":", 1).alias("type"), F.expr("substring(ta, locate(':', ta) + 1)").alias("attribute"), squeeze(F.col("raw")).alias("text"))
    typed = F.lit(None).cast("string")
    for t, (parse, _) in PARSERS.items():
        typed = F.when(F.col("type") == t, parse(F.col("text"))).otherwise(typed)
    rows = rows.where(~is_placeholder(F.col("text"), placeholders)).select("entity", "attribute", "id", "raw", typed.alias("value"))
    best = lambda c, ok: F.max(F.when(ok, F.struct("id", c)))[c]
    return rows.groupBy("entity", "attribute").agg(best("value", F.col("value").isNotNull()).alias("value"), best("raw", F.col("value").isNull()).alias("failed"))


def widen(
    eav: DataFrame, keys: DataFrame, entities: DataFrame, entity: str = "document_id", key: str = "metadata_key",
    value: str = "metadata_value", order: str = "id", entity_id: str = "id", blank: bool = False, placeholders: tuple[str, ...] = PLACEHOLDERS,
) -> DataFrame:
    """One row per entity of `entities` that has a countable row in `eav`, with `blank` one per entity
    that has any: a typed column per attribute, and `failures`, a map of attribute to the newest value
    that could not be cast.

    A key belongs to an attribute if it equals its name or label apart from case, accents,
    punctuation and spacing; rows with other keys, null keys, null entities or null values don't
    count, nor do values spelled like one of `placeholders` (lower case). The cell is the value of the largest `order` among those valid for the type (ties: the
    larger value). Repeated rows change nothing. An entity whose values are all invalid has a row of
    nulls; with `blank` so has one none of whose rows count, its failures empty. Empty tables give no rows; extra columns are ignored.
    """
    attributes = attributes_of(keys)
    pairs = resolved_pairs(eav, attributes, entity, key, value, order, placeholders)
    some = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("attribute", c))))
    maps = pairs.groupBy("entity").agg(some("value").alias("cells"), some("failed").alias("failures"))  # at most one pair per attribute
    if blank:
        there = eav.select(F.col(f"`{entity}`").alias("entity")).where("entity IS NOT NULL").distinct()
        maps = there.join(maps, "entity", "left").withColumn("failures", F.coalesce("failures", F.create_map().cast("map<string,string>")))
    known = entities.select(F.col(f"`{entity_id}`").alias("entity"))
    maps = maps.join(known, "entity", "left_semi")
    kinds = {a: TYPES[t][1] for a, _, t in attributes}
    return maps.select(F.col("entity").alias(entity), *[F.try_element_at("cells", F.lit(a)).try_cast(k).alias(a) for a, k in kinds.items()], "failures")


def cells(wide: DataFrame, entity: str = "document_id") -> DataFrame:
    """Every filled cell of a wide table as (entity, attribute, cell_value)."""
    names = [c for c in wide.columns if c not in (entity, "failures")]
    entries = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"`{c}`").cast("string").alias("cell_value")) for c in names])
    return wide.select(entity, F.inline(F.filter(entries, lambda e: e["cell_value"].isNotNull())))
