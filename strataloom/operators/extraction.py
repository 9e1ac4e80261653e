"""Entities and relationships out of chunks of text, and the structural graph of tables, as column expressions.

A chunk stays one row until its relationships are exploded, so nothing is shuffled. The known names are one alternation
that the scanner tries at every word: each place gives the longest name that begins there, and shorter names inside it
are added from a table made beforehand, which equals one search per name."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gazetteer, refdata, text
from .lineage import cut



def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_FOUND = "array<struct<cname:string,name:string,type:string,confidence:double>>"


def _word(name: str, java: bool = True) -> str:
    """A name as a word, bounded where its own ends are word characters."""
    return (r"\b" if re.match(r"\w", name) else "") + re.escape(name).replace(r"\ ", " ") + (r"\b" if re.search(r"\w$", name) else "")


def _trie(names: list[str]) -> str:
    """One pattern for all names that branches by character and prefers the longest."""
    root: dict = {}
    for n in names:
        node = root
        for c in n:
            node = node.setdefault(c, {})
        node[""] = r"(?!\w)" if re.match(r"\w", n[-1]) else ""

    def spell(node: dict) -> str:
        parts = [re.escape(c) + spell(node[c]) for c in node if c]
        if "" in node:
            parts.append(node[""])
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return spell(root)


def known_entities(c: Column, names: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """Known names in a text: canonical name, the spelling that is listed first of those found, type, confidence 0.98."""
    names = names or gazetteer.known()
    spelled = [(s, can, kind, (i, j)) for i, (can, kind, other) in enumerate(names) for j, s in enumerate([can, *other])]
    by_length = sorted({s.lower() for s, *_ in spelled})
    pattern = r"(?<![A-Za-z0-9_])(?=(" + _trie(by_length) + "))"
    inside = {low: sorted({k for k, (s, *_) in enumerate(spelled) if re.search(r"(?<!\w)" + re.escape(s.lower()) + r"(?!\w)", low)}) for low in by_length}
    hits = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1)))
    table = F.expr("map(" + ", ".join(f"{refdata.quoted(low)}, array({', '.join(map(str, ks))})" for low, ks in inside.items()) + ")")
    numbers = lambda hits: F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.element_at(table, h)))))
    q = refdata.quoted
    rows = F.expr("array(" + ", ".join(f"named_struct('cname', {q(can)}, 'name', {q(s)}, 'type', {q(kind)}, 'confidence', 0.98D)" for s, can, kind, _ in spelled) + ")")
    return let(hits, lambda h: F.when(F.size(h) > 0, _once(F.transform(numbers(h), lambda k: F.element_at(rows, k + 1)))).otherwise(F.array().cast(_FOUND)))


def _once(found: Column) -> Column:
    """The first of each canonical name."""
    return let(found, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda y: y["cname"] == x["cname"])))


def people(c: Column, first_chunk: Column, stop: frozenset[str] = gazetteer.NOT_NAMES) -> Column:
    """The name that the first line of a document's first chunk is, if it is two or three capitalised words."""
    stops = refdata.words(sorted(stop))
    line = F.try_element_at(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), text.strip), lambda x: x != ""), F.lit(1))

    def person(line: Column) -> Column:
        name = text.title_case(line)
        ok = first_chunk & F.coalesce(line.rlike(r"^[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){1,2}$"), F.lit(False)) & ~F.array_contains(stops, F.upper(name))
        return F.when(ok, F.array(F.struct(name.alias("cname"), name.alias("name"), F.lit("Person").alias("type"), F.lit(0.95).alias("confidence")))).otherwise(F.array().cast(_FOUND))

    return let(line, person)


# Words that the name of an organisation goes on with, and beginnings of words that begin none.
_ORG_TAIL = "Institute|University|College|Corporation|Foundation|Technologies|Solutions|Labs|Company|Group|Department|Center|Centre|of|and|for|in|Information|Technology|Science|Engineering|Research"


_NO_ORG = "PARTICIPAT|EVALUAT|DEVELOP|BUILD|STUDY|USED|PURPOSE"


def organisations(c: Column, stop: frozenset[str] = gazetteer.NOT_NAMES) -> Column:
    """Capitalised phrases that end in words of organisations, longer than twelve characters."""
    raw = F.regexp_extract_all(c, F.lit(rf"\b([A-Z][a-zA-Z']+(?:\s+(?:{_ORG_TAIL}))+)\b"), F.lit(1))
    names = F.transform(raw, lambda x: F.regexp_replace(x, r"(?i)^(?:in|for|of|and|with|by|at|from)\s+", ""))
    stops = refdata.words(sorted(stop))
    first = lambda x: F.upper(F.regexp_extract(x, r"^(\S+)", 1))
    ok = lambda x: (F.length(x) > 12) & ~F.array_contains(stops, F.upper(x)) & ~F.array_contains(stops, first(x)) & ~first(x).rlike(_NO_ORG)
    return F.transform(F.array_distinct(F.filter(names, ok)), lambda x: F.struct(x.alias("cname"), x.alias("name"), F.lit("Organization").alias("type"), F.lit(0.90).alias("confidence")))


def projects(c: Column, stop: frozenset[str] = gazetteer.NOT_NAMES) -> Column:
    stops = refdata.words(sorted(stop))
    names = F.regexp_extract_all(c, F.lit(r"(?i)(?:Project|Project Name)\s*[:\-]\s*([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){1,4})"), F.lit(1))
    ok = F.filter(names, lambda x: (F.length(x) > 5) & ~F.array_contains(stops, F.upper(x)))
    return F.transform(F.array_distinct(ok), lambda x: F.struct(x.alias("cname"), x.alias("name"), F.lit("Project").alias("type"), F.lit(0.85).alias("confidence")))


def with_entities(chunks: DataFrame, names: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """chunks with found: what they name, in order, once per canonical name."""
    t = F.coalesce("text", F.lit(""))
    parts = F.concat(known_entities(t, names), people(t, (F.col("page_number") == 1) & (F.col("chunk_index") == 0)), organisations(t), projects(t))
    return chunks.withColumn("found", _once(parts))


def entities(chunks: DataFrame, names: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """(document_id, page_number, chunk_id, cname, name, type, confidence, snippet)"""
    one = with_entities(chunks, names).select("document_id", "page_number", "chunk_id", "text", F.explode("found").alias("e"))
    low = F.lower(F.col("e.name"))
    return one.select("document_id", "page_number", "chunk_id", "e.*", F.when(F.col("e.type") == "Organization", text.snippet(F.lower("text"), low, 40)).otherwise(text.snippet(F.lower("text"), low, 50)).alias("snippet"))


def routed(chunks: DataFrame, provider: Callable[[str], list[dict]] | None = None, names=None, most: int = 10) -> DataFrame:
    """(document_id, page_number, chunk_id, cname, name, type, confidence, snippet, method) of entities by a provider, a
    function of a text that a model answers with dictionaries of name, canonical_name, type and confidence.

    It sees the first ``most`` chunks of each document. Without one, and for documents of which it fails on any chunk, the
    rules extract from all chunks; method tells MODEL or HEURISTIC."""
    by_rules = lambda df: entities(df, names).withColumn("method", F.lit("HEURISTIC"))
    if provider is None:
        return by_rules(chunks)

    def run(batches):
        for b in batches:
            found, failed = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                try:
                    found.append([{k: e.get(k) for k in ("name", "canonical_name", "type", "confidence")} for e in provider(t or "")])
                    failed.append(False)
                except Exception:
                    found.append([])
                    failed.append(True)
            kind = pa.list_(pa.struct([("name", pa.string()), ("canonical_name", pa.string()), ("type", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind), pa.array(failed)], names=[*b.schema.names, "found", "failed"])

    first = chunks.select("document_id", "page_number", "chunk_id", "text", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "chunk_index")).alias("k")).where(F.col("k") <= most).drop("k")
    asked = cut(first.mapInArrow(run, "document_id string, page_number int, chunk_id string, text string, found array<struct<name:string,canonical_name:string,type:string,confidence:double>>, failed boolean"), "answers")
    failed = asked.where("failed").select("document_id").distinct()
    e = F.col("e")
    told = asked.join(failed, "document_id", "left_anti").select("document_id", "page_number", "chunk_id", "text", F.explode("found").alias("e")).where(F.length("e.name") > 0)
    told = told.select("document_id", "page_number", "chunk_id", F.coalesce(e["canonical_name"], text.canonical_name(e["name"])).alias("cname"), e["name"].alias("name"), F.coalesce(e["type"], F.lit("Concept")).alias("type"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"), text.snippet(F.lower("text"), F.lower(e["name"]), 50).alias("snippet"), F.lit("MODEL").alias("method"))
    return told.unionByName(by_rules(chunks.join(failed, "document_id", "left_semi")))


def segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.?!;]+|\n\n+"), text.strip), lambda s: F.length(s) >= 10)


def _match(raw: Column, found: Column) -> Column:
    """The first found name that a stretch of text holds."""
    low = F.lower(text.strip(raw))
    return F.when(F.length(low) >= 2, F.try_element_at(F.filter(found, lambda e: low.contains(F.lower(e["cname"]))), F.lit(1))["cname"])


def relationships(chunks: DataFrame, names: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """(document_id, page_number, chunk_id, source_entity, relationship_type, target_entity, weight, description).

    Verbs between two names (1.0), arrow chains (0.9), a person's tools and schools (0.9), and known pairs (0.95, 0.9)."""
    live = with_entities(chunks, names).where(F.size("found") > 1)
    seg = live.select("document_id", "page_number", "chunk_id", "found", F.explode(segments(F.col("text"))).alias("s"))
    found, s = F.col("found"), F.col("s")
    edge = lambda a, kind, b, w, d: F.struct(a.alias("source_entity"), kind.alias("relationship_type"), b.alias("target_entity"), F.lit(w).alias("weight"), d.alias("description"))

    def stated(kind: str):
        return lambda a, b: edge(_match(a, found), F.lit(kind), _match(b, found), 1.0, F.concat_ws(" ", _match(a, found), F.lit(kind), _match(b, found)))

    lists = []
    for kind, verbs in refdata.PREDICATES.items():
        p = rf"(?i)\b([A-Za-z0-9_\s]{{2,40}}?)\s+(?:{verbs})\s+([A-Za-z0-9_\s]{{2,40}}?)\b"
        lists.append(F.zip_with(F.regexp_extract_all(s, F.lit(p), F.lit(1)), F.regexp_extract_all(s, F.lit(p), F.lit(2)), stated(kind)))
    steps = F.filter(F.transform(F.split(s, r"[→↓]|->"), lambda x: _match(x, found)), lambda x: x.isNotNull())
    rest = F.greatest(F.size(steps) - 1, F.lit(0))
    step = lambda a, b: edge(a, F.when(b.contains("AGE") & a.contains("Postgre"), "EXTENDS").otherwise("FLOWS_TO"), b, 0.9, F.concat_ws(" → ", a, b))
    flow = F.zip_with(F.slice(steps, F.lit(1), rest), F.slice(steps, F.lit(2), rest), step)
    lists.append(F.when(s.rlike("→|->|↓"), flow).otherwise(F.slice(flow, 1, 0)))
    person = F.try_element_at(F.filter(found, lambda e: e["type"] == "Person"), F.lit(1))["cname"]
    said = lambda e: F.lower(s).contains(F.lower(e["cname"]))
    tools = F.filter(found, lambda e: e["type"].isin("Technology", "Concept") & said(e) & person.isNotNull())
    uses = F.transform(tools, lambda e: edge(person, F.lit("USES"), e["cname"], 0.9, F.concat_ws(" USES ", person, e["cname"])))
    lists.append(F.when(F.lower(s).rlike("experience in|hands-on|skilled in|proficient in|worked with|using|developed with"), uses).otherwise(F.slice(uses, 1, 0)))
    schools = F.filter(found, lambda e: (e["type"] == "Organization") & said(e) & person.isNotNull())
    lists.append(F.transform(schools, lambda e: edge(person, F.lit("STUDIED_AT"), e["cname"], 0.9, F.concat_ws(" STUDIED_AT ", person, e["cname"]))))
    has = lambda n: F.exists(found, lambda e: e["cname"] == n)
    parts = F.filter(found, lambda e: e["cname"].isin("Operational Data", "Analytical Data", "Telemetry", "Documents", "Business Definitions"))
    combos = F.transform(parts, lambda e: edge(F.lit("Context Lakehouse"), F.lit("COMBINES"), e["cname"], 0.95, F.concat_ws(" COMBINES ", F.lit("Context Lakehouse"), e["cname"])))
    lists.append(F.when(has("Context Lakehouse") & F.lower(s).contains("combines"), combos).otherwise(F.slice(combos, 1, 0)))
    keys = ["document_id", "page_number", "chunk_id"]
    by_segment = seg.select(*keys, F.explode(F.concat(*lists)).alias("r")).select(*keys, "r.*").where("source_entity is not null and target_entity is not null and source_entity <> target_entity")
    t = F.lower("text")
    rules = [
        (has("Apache AGE") & has("PostgreSQL") & t.rlike("extension|work together|installed|creates|graph layer|database"), "Apache AGE", "EXTENDS", "PostgreSQL", 0.95, "stated together: a graph layer of the database"),
        (has("Apache AGE") & has("Cypher"), "Apache AGE", "USES", "Cypher", 0.95, "stated together: the query language of the graph layer"),
        (has("Streamlit") & has("Python"), "Streamlit", "USES", "Python", 0.90, "stated together: the language of the user interface"),
    ]
    pairs = F.array_compact(F.array(*[F.when(cond, edge(F.lit(a), F.lit(k), F.lit(b), w, F.lit(d))) for cond, a, k, b, w, d in rules]))
    by_chunk = live.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.*")
    return by_segment.unionByName(by_chunk)


# -- structure of tables ----------------------------------------------------------------------------------------------


def structural(schema: DataFrame, document_col: str = "document_name") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of (document_name, table_name, column_name, data_type): Table, Column and DataType.

    Types are shared; columns are scoped by document and table. Each is one projection over the schema rows."""
    d, t, c, k = (F.col(x) for x in (document_col, "table_name", "column_name", "data_type"))
    table, column = F.concat(d, F.lit("::"), t), F.concat(d, F.lit("::"), t, F.lit("."), c)
    es = schema.select(
        F.explode(
            F.array(
                F.struct(table.alias("canonical_name"), t.alias("name"), F.lit("Table").alias("type")),
                F.struct(column.alias("canonical_name"), F.concat(t, F.lit("."), c).alias("name"), F.lit("Column").alias("type")),
                F.struct(k.alias("canonical_name"), k.alias("name"), F.lit("DataType").alias("type")),
            )
        ).alias("e")
    ).select("e.*")
    rs = schema.select(
        F.explode(F.array(F.struct(table.alias("source_entity"), F.lit("CONTAINS_COLUMN").alias("relationship_type"), column.alias("target_entity")), F.struct(column.alias("source_entity"), F.lit("HAS_DATA_TYPE").alias("relationship_type"), k.alias("target_entity")))).alias("r")
    ).select("r.*")
    return es.where("canonical_name is not null").distinct(), rs.where("source_entity is not null and target_entity is not null").distinct()


def structural_workbook(schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As structural(), of spreadsheets (document_name, sheet_name, column_name, data_type): Workbook, Sheet, Column, DataType."""
    d, t, c, k = (F.col(x) for x in ("document_name", "sheet_name", "column_name", "data_type"))
    sheet, column = F.concat(d, F.lit("::"), t), F.concat(d, F.lit("::"), t, F.lit("."), c)
    entity = lambda key, name, kind: F.struct(key.alias("canonical_name"), name.alias("name"), F.lit(kind).alias("type"))
    link = lambda a, kind, b: F.struct(a.alias("source_entity"), F.lit(kind).alias("relationship_type"), b.alias("target_entity"))
    es = schema.select(F.explode(F.array(entity(d, d, "Workbook"), entity(sheet, t, "Sheet"), entity(column, F.concat(t, F.lit("."), c), "Column"), entity(k, k, "DataType"))).alias("e")).select("e.*")
    rs = schema.select(F.explode(F.array(link(d, "CONTAINS_SHEET", sheet), link(sheet, "CONTAINS_COLUMN", column), link(column, "HAS_DATA_TYPE", k))).alias("r")).select("r.*")
    return es.where("canonical_name is not null").distinct(), rs.where("source_entity is not null and target_entity is not null").distinct()


def structural_keys(paths: DataFrame, document_col: str = "document_name", path_col: str = "path", sep: str = "/") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of nested keys or elements: each path's parent is the path without its last part."""
    d, p = F.col(document_col), F.col(path_col)
    cut = F.regexp_replace(p, re.escape(sep) + r"[^" + re.escape(sep) + r"]+$", "")
    me = F.concat(d, F.lit("::"), p)
    es = paths.select(me.alias("canonical_name"), F.element_at(F.split(p, re.escape(sep)), -1).alias("name"), F.lit("Field").alias("type")).distinct()
    rs = paths.select(F.when(cut == p, d).otherwise(F.concat(d, F.lit("::"), cut)).alias("source_entity"), F.lit("CONTAINS").alias("relationship_type"), me.alias("target_entity")).distinct()
    return es, rs


def without_schema_names(found: DataFrame, structure: DataFrame) -> DataFrame:
    """Entities without the concepts that only repeat a name of the schema."""
    names = structure.where(F.col("type").isin("Table", "Column", "Dataset", "Sheet", "Field")).select(F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("low")).union(structure.select(F.lower("name"))).distinct()
    concepts = found.where("type = 'Concept'").join(names, F.lower("name") == F.col("low"), "left_anti")
    return found.where("type <> 'Concept'").unionByName(concepts)
