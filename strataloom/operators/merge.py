"""Canonical merging of raw entities and relationships, each in one aggregation with map-side partials.

``ord`` is the order of the raw rows: what comes first wins ties, as an ordered fold would have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def _first(c: str, order: Column, when: Column | None = None) -> Column:
    return F.min_by(F.when(when, F.col(c)) if when is not None else F.col(c), F.when(when, order) if when is not None else order)


def _longest(c: str, order: Column) -> Column:
    """The longest text, the earliest of equals."""
    n = F.length(c)
    return F.min_by(c, F.when(n > 0, F.struct((-n).alias("n"), order.alias("o"))))


def _all_aliases(df: DataFrame, key: str) -> DataFrame:
    """(key, aliases): all aliases of each key, sorted. They are made distinct before they come together."""
    one = df.select(key, F.explode("aliases").alias("a")).distinct()
    return one.groupBy(key).agg(F.array_sort(F.collect_list("a")).alias("aliases"))


def _with_aliases(merged: DataFrame, df: DataFrame, key: str) -> DataFrame:
    both = merged.join(_all_aliases(df, key), key, "left")
    return both.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def merge_entities(df: DataFrame, key: str, order: list[str], type_col: str = "type", default_type: str = "Concept") -> DataFrame:
    """One row per ``key`` (rows with a null or blank one go): name, type, description, aliases, confidence, mentions.

    name: the first that differs from the key, else the first; type: the first that isn't the default, else the first;
    description: the longest; aliases: all, sorted; confidence: the highest."""
    o = F.struct(*order)
    named = df.where(F.length(F.trim(F.coalesce(F.col(key), F.lit("")))) > 0)
    merged = named.groupBy(key).agg(
        F.coalesce(_first("name", o, (F.col("name") != F.col(key)) & (F.col("name") != "")), _first("name", o)).alias("name"),
        F.coalesce(_first(type_col, o, F.col(type_col) != default_type), _first(type_col, o)).alias(type_col),
        _longest("description", o).alias("description"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("mentions"),
    )
    return _with_aliases(merged, named, key).select(key, "name", type_col, "description", "aliases", "confidence", "mentions")


def merge_code_entities(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per canonical_id with the first name, type and provenance, the longest description, all aliases and the
    properties that any row has, the first non-empty value of each. Properties and aliases are merged entry by entry, so an
    id that every repository shares gathers no list of its rows."""
    order = order or ["extracted_at", "record_id"]
    o = F.struct(*order)
    named = df.where(F.length(F.trim(F.coalesce("canonical_id", F.lit("")))) > 0)
    entries = named.select("canonical_id", o.alias("o"), F.posexplode(F.map_entries("properties")).alias("i", "e")).select("canonical_id", "o", "i", "e.*").where("value <> ''")
    first = entries.groupBy("canonical_id", "key").agg(F.min_by("value", F.struct("o", "i")).alias("value"))  # a row a key, whatever the number of rows
    properties = first.groupBy("canonical_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    merged = named.groupBy("canonical_id").agg(
        _first("name", o).alias("name"),
        _first("entity_type", o).alias("entity_type"),
        _longest("description", o).alias("description"),
        F.min_by("provenance", o).alias("provenance"),
        F.max("confidence").alias("confidence"),
        F.min("extracted_at").alias("first_seen"),
        F.count("*").alias("n_records"),
    )
    whole = _with_aliases(merged, named, "canonical_id").join(properties, "canonical_id", "left")
    none = F.create_map().cast("map<string,string>")
    return whole.select("canonical_id", "name", "entity_type", "description", F.coalesce("properties", none).alias("properties"), "provenance", "aliases", "confidence", "first_seen", "n_records")


def merge_relationships(df: DataFrame, source: str, target: str, type_col: str, order: list[str]) -> DataFrame:
    """One row per (source, type, target): weight of the first and a half for each further one, the longest description.

    Rows with a null or blank end go, loops too. A hot end is no problem: the aggregation is partial on the map side."""
    o = F.struct(*order)
    ends = [F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0 for c in (source, target)]
    clean = df.where(ends[0] & ends[1] & (F.col(source) != F.col(target))).withColumn(type_col, text.relationship_type(F.coalesce(type_col, F.lit(""))))
    return clean.groupBy(F.col(source).alias("src"), F.col(type_col).alias("label"), F.col(target).alias("dst")).agg(
        (F.min_by("weight", o) + 0.5 * (F.count("*") - 1)).alias("weight"),
        _longest("description", o).alias("description"),
        F.min_by("provenance", o).alias("provenance") if "provenance" in df.columns else F.lit(None).alias("provenance"),
        F.count("*").alias("n_records"),
    )


def resolve_ends(relationships: DataFrame, entities: DataFrame, key: str = "canonical_name", columns: tuple[str, str] = ("source_entity", "target_entity")) -> DataFrame:
    """Relationships with both ends replaced by keys of entities: the key itself, else the entity of which it is an
    alias (the smallest key of several), else the name in its canonical spelling."""
    alias = entities.select(F.explode("aliases").alias("a"), F.col(key).alias("k")).groupBy(F.lower("a").alias("a")).agg(F.min("k").alias("by_alias"))
    keys = entities.select(F.col(key).alias("k")).distinct()
    out = relationships
    for c in columns:
        out = out.join(keys.select(F.col("k").alias(c), F.col("k").alias("__same")), c, "left").join(alias.select(F.col("a").alias("__low"), "by_alias"), F.lower(c) == F.col("__low"), "left")
        out = out.withColumn(c, F.coalesce("__same", "by_alias", text.canonical_name(c))).drop("__same", "__low", "by_alias")
    return out


def prune_ends(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends exist."""
    ids = vertices.select(F.col(key).alias("__id"))
    return edges.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_semi")


def create_ends(edges: DataFrame, entities: DataFrame, key: str = "canonical_name") -> DataFrame:
    """Entities with one of type Concept and confidence 0.8 for each end of an edge that has none."""
    ends = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst").alias(key))).distinct()
    new = ends.join(entities.select(key), key, "left_anti").select(key, F.col(key).alias("name"), F.lit("Concept").alias("type"), F.lit(0.8).alias("confidence"))
    return entities.unionByName(new, allowMissingColumns=True)
