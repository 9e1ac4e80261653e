"""Queries on the code graph: merging, upserts, degrees, neighbours, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import refdata, text
from ..operators import graph, insights, merge
from ..operators.lineage import kept


def raw(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return s.read.parquet(f"{d}/git_entities.parquet"), s.read.parquet(f"{d}/git_relationships.parquet")


def tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Merged vertices and edges, made once for all queries of a session."""
    e, r = raw(s, d)
    sources = [f"{d}/git_entities.parquet", f"{d}/git_relationships.parquet"]
    vs = kept(s, "vertices", sources, lambda: graph.vertices(e))
    return vs, kept(s, "edges", sources, lambda: graph.edges(r, vs))


def _on(f):
    return lambda s, d: f(*tables(s, d))


def entity_merge(s: SparkSession, d: str) -> DataFrame:
    m = merge.merge_code_entities(raw(s, d)[0])
    keys = F.array_join(F.array_sort(F.map_keys("properties")), ",")
    return m.select("canonical_id", "name", "entity_type", "description", F.array_join("aliases", ", ").alias("aliases"), "confidence", keys.alias("property_keys"), F.size("properties").alias("n_properties"), "n_records", F.col("provenance.commit_sha").alias("commit_sha"))


def edge_merge(s: SparkSession, d: str) -> DataFrame:
    m = merge.merge_relationships(raw(s, d)[1], "source_canonical_id", "target_canonical_id", "relationship_type", ["extracted_at", "record_id"])
    return m.select("src", "label", "dst", "weight", "description", "n_records")


def upsert_counts(s: SparkSession, d: str) -> DataFrame:
    """The later half of the records as a batch against the earlier one."""
    e, r = raw(s, d)
    at = F.col("extracted_at") < F.lit("2025-11-07 12:00:00").cast("timestamp_ntz")
    old_v = graph.vertices(e.where(at))
    new_v = graph.vertices(e.where(~at))
    key = lambda x, vs: graph.edges(x, vs)
    return graph.ingest_counts(old_v, key(r.where(at), old_v), new_v, key(r.where(~at), new_v))


def upsert_result(s: SparkSession, d: str) -> DataFrame:
    e, _ = raw(s, d)
    at = F.col("extracted_at") < F.lit("2025-11-07 12:00:00").cast("timestamp_ntz")
    both = graph.upsert_vertices(graph.vertices(e.where(at)), graph.vertices(e.where(~at)), None)
    return both.groupBy("label").agg(F.count("*").alias("n"), F.max("confidence").alias("top_confidence"))


def repo_counts(vs: DataFrame, es: DataFrame) -> DataFrame:
    """Vertices by label and repository together with edges by type: one union, one aggregation."""
    one = vs.select("repository_name", F.lit("vertex").alias("kind"), "label").unionByName(es.select("repository_name", F.lit("edge").alias("kind"), "label"))
    return one.groupBy("repository_name", "kind", "label").agg(F.count("*").alias("n"))


def alias_resolve(s: SparkSession, d: str) -> DataFrame:
    """Names of mentions resolved to merged entities, by key, alias or canonical spelling."""
    m = s.read.parquet(f"{d}/doc_entities.parquet")
    es = merge.merge_entities(m, "canonical_name", ["mention_id"])
    rel = m.select(F.col("name").alias("source_entity"), F.col("canonical_name").alias("target_entity"))
    return merge.resolve_ends(rel, es).groupBy(F.col("source_entity").alias("resolved")).agg(F.count("*").alias("n"))


def document_merge(s: SparkSession, d: str) -> DataFrame:
    m = merge.merge_entities(s.read.parquet(f"{d}/doc_entities.parquet"), "canonical_name", ["mention_id"])
    return m.select("canonical_name", "name", "type", "description", F.array_join("aliases", ", ").alias("aliases"), "confidence", "mentions")


def neighbour_rows(vs: DataFrame, es: DataFrame) -> DataFrame:
    return graph.neighbours(es, vs, vs.where(F.col("label") == "Class")).select("id", "direction", "label", "other", "other_name", "other_label")


def typed_paths(vs: DataFrame, es: DataFrame) -> DataFrame:
    """File - DEFINES -> Class: labels are filtered before the joins."""
    named = graph.with_ends(es.where(F.col("label") == "DEFINES"), vs)
    return named.where("src_label = 'File' and dst_label = 'Class'").select("src_name", "dst_name", "weight")


def hops(s: SparkSession, d: str) -> DataFrame:
    """What three steps reach from repositories."""
    vs, es = tables(s, d)
    return graph.k_hop(es, vs.where(F.col("label") == "Repository"), 3)


def document_subgraph(s: SparkSession, d: str) -> DataFrame:
    """Every repository's subgraph: its vertices together with the ends of its edges, and its edges."""
    vs, es = graph.document_subgraph(*tables(s, d))
    return vs.select("scope", F.col("id").alias("a"), "label", F.lit("").alias("b")).unionByName(es.select("scope", F.col("src").alias("a"), "label", F.col("dst").alias("b")))


def library_names(s: SparkSession, d: str) -> DataFrame:
    libs = s.read.parquet(f"{d}/config_files.parquet").select(F.explode("libraries").alias("l")).select("l.*")
    return libs.groupBy(text.canonical_library("name").alias("library")).agg(F.count("*").alias("n"), F.count_if("is_dev").alias("n_dev"), F.count("version_spec").alias("n_versions"))


def technology_mentions(s: SparkSession, d: str) -> DataFrame:
    t = s.read.parquet(f"{d}/markdown_docs.parquet").select("doc_id", F.explode("technologies").alias("t")).select("doc_id", "t.*")
    return t.groupBy("canonical_name").agg(F.sum("mention_count").alias("mentions"), F.count_distinct("doc_id").alias("n_docs"), F.min("start_line").alias("first_line"))


def service_links(s: SparkSession, d: str) -> DataFrame:
    """Services to technologies: CONNECTS_TO databases by their name, else USES."""
    t = s.read.parquet(f"{d}/docker_services.parquet").where("inferred_technology is not null")
    link = F.when(F.col("service_name").rlike("(?i)(db|age|postgres)"), "CONNECTS_TO").otherwise("USES")
    return t.groupBy("inferred_technology", link.alias("link")).agg(F.count("*").alias("n"), F.count_distinct("repository_name").alias("n_repositories"))


QUERIES = {
    "entity_merge": entity_merge,
    "edge_merge": edge_merge,
    "document_merge": document_merge,
    "alias_resolve": alias_resolve,
    "upsert_counts": upsert_counts,
    "upsert_vertices": upsert_result,
    "graph_stats": _on(graph.stats),
    "repo_counts": _on(repo_counts),
    "degrees": _on(graph.degrees),
    "edge_endpoints": _on(lambda v, e: graph.with_ends(e, v).select("src", "label", "dst", "src_name", "dst_name", "weight")),
    "neighbours": _on(neighbour_rows),
    "typed_paths": _on(typed_paths),
    "isolated": _on(lambda v, e: graph.isolated(v, e).select("id", "label")),
    "k_hop": hops,
    "components": lambda s, d: graph.components(tables(s, d)[1], tables(s, d)[0]).groupBy("component").agg(F.count("*").alias("n")),
    "document_subgraph": document_subgraph,
    "entity_search": _on(lambda v, e: graph.search(v, "Class", "store").select("id", "name", "file_path")),
    "token_match": _on(lambda v, e: v.where(graph.matching(["name", "description", "file_path", "source_snippet"], "pivot")).select("id", "label")),
    "usage": _on(insights.usage),
    "important_files": _on(lambda v, e: insights.important_files(v, e).select("id", "in_degree", "out_degree", "definitions", "imports", "line_count", "importance")),
    "definitions_by_file": _on(lambda v, e: insights.definitions_by_file(v).select("repository_name", "file_path", F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"))),
    "class_methods": _on(lambda v, e: insights.class_methods(v, e).select("class_id", "class_name", "n_members", F.array_join("members", ",").alias("members"))),
    "functions": _on(lambda v, e: insights.functions(v, e).select("id", "name", "parent_class", "is_async")),
    "apis": _on(lambda v, e: insights.apis(v)),
    "dependencies": _on(lambda v, e: insights.dependencies(v, e).select("src", "src_name", "label", "dst", "dst_name")),
    "code_flows": _on(insights.code_flows),
    "repositories": _on(lambda v, e: insights.repositories(v)),
    "directory_closure": lambda s, d: insights.directory_closure(s.read.parquet(f"{d}/documents.parquet")),
    "library_names": library_names,
    "technology_mentions": technology_mentions,
    "service_links": service_links,
}

_UP = "regexp_replace(regexp_replace(upper(regexp_replace(trim(relationship_type), '[^a-zA-Z0-9_]', '_', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
_TIDY = lambda c: f"regexp_replace(regexp_replace(replace({c}, '\\', '/'), '^(?:\\./)+', ''), '^/+|/+$', '', 'g')"
_LINE = lambda c: f"trim(regexp_replace({c}, '[\\r\\n]', ' ', 'g'))"


def _vertices(name: str = "v", where: str = "true") -> str:
    return f"""
{name}_raw as (select * from git_entities where trim(coalesce(canonical_id, '')) <> '' and {where}),
{name}_al as (select canonical_id as id, array_to_string(list_sort(list_distinct(list(a))), ', ') as aliases from (select canonical_id, unnest(aliases) as a from {name}_raw) group by 1),
{name}_pr as (select canonical_id as id, k, arg_min(val, (extracted_at, record_id, i)) as val from (select canonical_id, extracted_at, record_id, unnest(map_keys(properties)) as k, unnest(map_values(properties)) as val, unnest(range(len(map_keys(properties)))) as i from {name}_raw) where coalesce(val, '') <> '' group by 1, 2),
{name}_m as (select canonical_id as id, arg_min(entity_type, (extracted_at, record_id)) as entity_type, arg_min(name, (extracted_at, record_id)) as name, arg_min(description, (-length(description), extracted_at, record_id)) filter (where length(description) > 0) as description,
  max(confidence) as confidence, count(*) as n_records, arg_min(provenance, (extracted_at, record_id)) as p from {name}_raw group by 1),
{name} as (select m.id, regexp_replace(regexp_replace(entity_type, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') as label, {_LINE('name')} as name, description, coalesce(al.aliases, '') as aliases, confidence, n_records,
  p.repository_name as repository_name, p.repository_url as repository_url, p.commit_sha as commit_sha, {_TIDY('p.file_path')} as file_path, p.start_line as start_line, p.end_line as end_line, p.extraction_method as extraction_method, left({_LINE('p.source_snippet')}, 400) as source_snippet
  from {name}_m m left join {name}_al al using (id))"""


def _edges(name: str = "e", vs: str = "v", where: str = "true") -> str:
    return f"""
{name}_raw as (select *, case when length({_UP}) > 1 then {_UP} else 'RELATED_TO' end as label from (select * replace (coalesce(relationship_type, '') as relationship_type) from git_relationships)
  where trim(coalesce(source_canonical_id, '')) <> '' and trim(coalesce(target_canonical_id, '')) <> '' and source_canonical_id <> target_canonical_id and {where}),
{name}_m as (select source_canonical_id as src, label, target_canonical_id as dst, arg_min(weight, (extracted_at, record_id)) + 0.5 * (count(*) - 1) as weight, arg_min(description, (-length(description), extracted_at, record_id)) filter (where length(description) > 0) as description,
  count(*) as n_records, arg_min(provenance, (extracted_at, record_id)) as p from {name}_raw group by 1, 2, 3),
{name} as (select src, label, dst, weight, description, p.repository_name as repository_name, p.commit_sha as commit_sha, p.start_line as start_line, p.end_line as end_line, p.extraction_method as extraction_method, {_TIDY('p.file_path')} as file_path from {name}_m semi join {vs} on src = {vs}.id semi join {vs} as v2 on dst = v2.id)"""


_G = "with " + _vertices() + "," + _edges()
_EARLY = "extracted_at < timestamp '2025-11-07 12:00:00'"
_HALVES = "with " + _vertices("v", _EARLY) + "," + _edges("e", "v", _EARLY) + "," + _vertices("w", f"not ({_EARLY})") + "," + _edges("g", "w", f"not ({_EARLY})")
_DEG = ", ends as (select src as id, 0 as i, 1 as o from e union all select dst, 1, 0 from e), deg as (select v.id, coalesce(sum(i), 0)::bigint as in_degree, coalesce(sum(o), 0)::bigint as out_degree from v left join ends using (id) group by 1)"
_DOC = """
m as (select * from doc_entities where trim(coalesce(canonical_name, '')) <> ''),
al as (select canonical_name, array_to_string(list_sort(list_distinct(list(a))), ', ') as aliases from (select canonical_name, unnest(aliases) as a from m) group by 1),
dm as (select canonical_name, coalesce(arg_min(name, mention_id) filter (where name <> canonical_name and name <> ''), arg_min(name, mention_id)) as name, coalesce(arg_min(type, mention_id) filter (where type <> 'Concept'), arg_min(type, mention_id)) as type,
  arg_min(description, (-length(description), mention_id)) filter (where length(description) > 0) as description, max(confidence) as confidence, count(*) as mentions from m group by 1)
"""
ORACLE = {
    "entity_merge": "with " + _vertices() + ", k as (select id, string_agg(k, ',' order by k) as ks, count(*) as n from v_pr group by 1) select v.id as canonical_id, v_m.name, v_m.entity_type, v.description, v.aliases, v.confidence, coalesce(k.ks, '') as property_keys, coalesce(k.n, 0)::int as n_properties, v.n_records, v.commit_sha from v join v_m using (id) left join k using (id)",
    "edge_merge": "with " + _vertices() + "," + _edges() + " select src, label, dst, weight, description, n_records from e_m",
    "alias_resolve": "with " + _DOC + r""", k as (select canonical_name as k from dm), a as (select lower(a) as a, min(canonical_name) as k from (select canonical_name, unnest(aliases) as a from m) group by 1), r as (select name as e, regexp_replace(regexp_replace(name, '^[\s"''`\x{201C}\x{2018}]+|[\s"''`\x{201D}\x{2019}]+$', '', 'g'), '\s+', ' ', 'g') as x0 from doc_entities), x as (select e, trim(x0, ' ') as x from r),
f as (select x.e, coalesce(k.k, a.k, c.v, case when x = lower(x) and regexp_matches(x, '[a-z]') and length(x) > 2 then array_to_string(list_transform(regexp_extract_all(x, '(\p{L}+|[^\p{L}]+)'), lambda p: upper(p[1]) || lower(p[2:])), '') else x end) as resolved from x left join k on x.e = k.k left join a on lower(x.e) = a.a left join (values """ + ", ".join(f"('{k}', '{v}')" for k, v in refdata.CANONICAL_NAMES.items()) + """) as c(l, v) on lower(x) = c.l) select resolved, count(*) as n from f group by 1""",
    "document_merge": "with " + _DOC + " select dm.canonical_name, name, type, description, coalesce(aliases, '') as aliases, confidence, mentions from dm left join al using (canonical_name)",
    "upsert_counts": _HALVES + " select (select count(*) from w anti join v using (id)) as vertices_created, (select count(*) from w semi join v using (id)) as vertices_existing, (select count(*) from g anti join e using (src, label, dst)) as edges_created, (select count(*) from g semi join e using (src, label, dst)) as edges_existing",
    "upsert_vertices": _HALVES + " , u as (select label, confidence from v union all select label, confidence from w anti join v using (id)) select label, count(*) as n, max(confidence) as top_confidence from u group by 1",
    "graph_stats": _G + " select 'vertex' as kind, label, count(*) as n from v group by 2 union all select 'edge', label, count(*) from e group by 2",
    "repo_counts": _G + " select repository_name, 'vertex' as kind, label, count(*) as n from v group by 1, 3 union all select repository_name, 'edge', label, count(*) from e group by 1, 3",
    "degrees": _G + _DEG + " select id, in_degree, out_degree from deg",
    "edge_endpoints": _G + " select src, e.label, dst, a.name as src_name, b.name as dst_name, weight from e join v a on src = a.id join v b on dst = b.id",
    "neighbours": _G + ", bo as (select src as id, 'out' as direction, label, dst as other from e union all select dst, 'in', label, src from e) select bo.id, direction, bo.label, other, o.name as other_name, o.label as other_label from bo join v c on bo.id = c.id and c.label = 'Class' join v o on other = o.id",
    "typed_paths": _G + " select a.name as src_name, b.name as dst_name, weight from e join v a on src = a.id join v b on dst = b.id where e.label = 'DEFINES' and a.label = 'File' and b.label = 'Class'",
    "isolated": _G + " select id, label from v where id not in (select src from e) and id not in (select dst from e)",
    "k_hop": "with recursive " + _G[5:] + ", st as (select src as a, dst as b from e union select dst, src from e), r as (select id, 0 as hop from v where label = 'Repository' union select b, hop + 1 from r join st on r.id = st.a where hop < 3), f as (select id, min(hop) as hop from r group by 1) select id, hop from f",
    "components": "with recursive " + _G[5:] + ", und as (select src as a, dst as b from e where src <> dst union select dst, src from e where src <> dst), cc(id, comp) using key (id) as (select id, id from v union select und.b, min(cc.comp) from cc join und on cc.id = und.a join recurring.cc as old on old.id = und.b where cc.comp < old.comp group by und.b) select comp as component, count(*) as n from cc group by 1",
    "document_subgraph": _G + ", x as (select repository_name as scope, id from v union select repository_name, src from e union select repository_name, dst from e) select scope, id as a, label, '' as b from x join v using (id) where scope is not null union all select repository_name, src, label, dst from e where repository_name is not null",
    "entity_search": _G + " select id, name, file_path from v where label = 'Class' and contains(lower(name), 'store')",
    "token_match": _G + " select id, label from v where " + " or ".join(f"coalesce(regexp_matches({c}, '(?i)\\bpivot\\b'), false)" for c in ("name", "description", "file_path", "source_snippet")),
    "usage": _G + ", n as (select name, label, (select count(*) from e where dst = v.id) as n from v), s as (select name, sum(n)::bigint as usage from n group by 1) select distinct label as category, n.name, usage from n join s using (name) where label in ('Technology', 'Library') and n.name <> ''",
    "important_files": _G + _DEG + """, f as (select v.id, repository_name, case when coalesce(file_path, '') = '' then name else file_path end as file_path, coalesce(try_cast(l.val as int), end_line - coalesce(start_line, 1) + 1, 0) as line_count from v left join v_pr l on l.id = v.id and l.k = 'line_count' where label = 'File'),
d as (select repository_name, file_path, count(*) filter (where label <> 'Library') as definitions, count(*) filter (where label = 'Library') as imports from v where label in ('Class', 'Function', 'Library') and file_path <> '' and name <> '' group by 1, 2)
select f.id, in_degree, out_degree, coalesce(definitions, 0) as definitions, coalesce(imports, 0) as imports, line_count, round(3.0 * in_degree + 2.0 * coalesce(definitions, 0) + out_degree + 0.01 * line_count, 2)::double as importance from f join deg using (id) left join d using (repository_name, file_path)""",
    "definitions_by_file": _G + " select repository_name, file_path, coalesce(string_agg(name, ',' order by name) filter (where label = 'Class'), '') as classes, coalesce(string_agg(name, ',' order by name) filter (where label = 'Function'), '') as functions from v where label in ('Class', 'Function') and file_path <> '' group by 1, 2",
    "class_methods": _G + ", i as (select distinct src, dst from e where label in ('DEFINES', 'CONTAINS')), m as (select src, count(*) as n, string_agg(name, ',' order by name) as ms from i join v on dst = id where label in ('Function', 'Method') group by 1) select id as class_id, name as class_name, coalesce(n, 0) as n_members, coalesce(ms, '') as members from v left join m on src = id where label = 'Class'",
    "functions": _G + ", up as (select dst, min(c.name) as parent_class from e join v c on src = c.id where e.label in ('DEFINES', 'CONTAINS') and c.label = 'Class' group by 1) select v.id, v.name, parent_class, coalesce(lower(a.val) = 'true', false) as is_async from v left join up on dst = v.id left join v_pr a on a.id = v.id and a.k = 'is_async' where v.label in ('Function', 'Method')",
    "apis": _G + " select id, case when regexp_extract(name, '^([A-Za-z]+) +/', 1) = '' then 'GET' else upper(regexp_extract(name, '^([A-Za-z]+) +/', 1)) end as http_method, regexp_replace(name, '^[A-Za-z]+ +/', '/') as endpoint from v where label = 'API'",
    "dependencies": _G + " select src, a.name as src_name, e.label, dst, b.name as dst_name from e join v a on src = a.id join v b on dst = b.id where e.label in ('IMPORTS', 'DEPENDS_ON', 'USES')",
    "code_flows": _G + ", k as (select * from e where label in ('CALLS', 'USES', 'IMPLEMENTED_BY', 'DEFINES') order by src, label, dst limit 100) select (row_number() over (order by src, k.label, dst))::int as step_number, a.name as src_name, a.label as src_label, b.name as dst_name, b.label as dst_label, k.label as relationship_type, a.label || ' ''' || a.name || ''' ' || lower(k.label) || ' ' || b.label || ' ''' || b.name || '''' as description from k join v a on src = a.id join v b on dst = b.id",
    "repositories": _G + " select name, coalesce(repository_url, '') as url, (starts_with(name, 'tmp') or name = '.' or contains(coalesce(repository_url, ''), 'AppData') or contains(coalesce(repository_url, ''), '\\Temp\\') or contains(coalesce(repository_url, ''), '/tmp/')) as legacy from v where label = 'Repository'",
    "directory_closure": f"with p as (select distinct repository_name, string_split({_TIDY('file_path')}, '/') as p from documents where length(file_path) > 0), s as (select repository_name, p, unnest(range(1, len(p) + 1)) as k from p) select distinct repository_name, array_to_string(p[1 : k - 1], '/') as parent, array_to_string(p[1 : k], '/') as child from s",
    "technology_mentions": "with t as (select doc_id, unnest(technologies) as t from markdown_docs) select t.canonical_name as canonical_name, sum(t.mention_count)::bigint as mentions, count(distinct doc_id) as n_docs, min(t.start_line) as first_line from t group by 1",
    "service_links": "select inferred_technology, case when regexp_matches(service_name, '(?i)(db|age|postgres)') then 'CONNECTS_TO' else 'USES' end as link, count(*) as n, count(distinct repository_name) as n_repositories from docker_services where inferred_technology is not null group by 1, 2",
    "library_names": "with l as (select unnest(libraries) as l from config_files), n as (select replace(lower(trim(l.name)), '_', '-') as n, l from l) select case n when 'psycopg2-binary' then 'psycopg2' when 'py-pdf' then 'pypdf' when 'pypdf2' then 'pypdf' when 'openai-python' then 'openai' else n end as library, count(*) as n, count(*) filter (where l.is_dev) as n_dev, count(l.version_spec) as n_versions from n group by 1",
}
