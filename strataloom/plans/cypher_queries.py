"""Queries in the Cypher subset, each with the join that it stands for."""

from __future__ import annotations

from .cypher import TEMPLATES, CypherGraph
from .graph_queries import _G, tables

TEXTS = {
    **{f"cypher_{k}": v for k, v in TEMPLATES.items()},
    "cypher_where": "MATCH (a:File)-[r]->(b) WHERE (r.weight >= 1.5 OR b.name IN ['Docker', 'Redis']) AND NOT a.name STARTS WITH 'scan' AND b.description IS NOT NULL RETURN a.name AS file, label(b) AS kind, b.name AS name, r.weight AS weight",
    "cypher_regex": "MATCH (n:Class) WHERE n.name =~ '(?i).*store.*' RETURN DISTINCT n.name AS name",
    "cypher_counts": "MATCH (a)-[r]->(b) RETURN label(a) AS source, type(r) AS relationship, label(b) AS target, count(r) AS n",
    "cypher_two_hops": "MATCH (d:Directory)-[:CONTAINS]->(f:File)-[:DEFINES]->(c:Class) RETURN d.id AS directory, c.name AS class",
    "cypher_top": "MATCH (a)-[r]->(b) RETURN b.id AS id, count(r) AS n ORDER BY n DESC, id LIMIT 20",
    "cypher_properties": "MATCH (f:File {start_line: 1})-[r:DEFINES {weight: 1.0}]->(c:Class) RETURN f.id AS file, c.id AS class",
    "cypher_unequal": "MATCH (a:File)-[r:DEFINES]->(b), (a)-[q:IMPORTS]->(l:Library) WHERE 1 = 1 AND a.name <> b.name AND label(b) <> 'Class' RETURN a.id AS file, b.id AS name, l.name AS library",
    "cypher_undirected": "MATCH (a:Library)-[r:IMPORTS]-(b) RETURN a.name AS library, b.id AS other",
}


def _run(text: str):
    return lambda s, d: CypherGraph(*tables(s, d)).query(text)


QUERIES = {k: _run(t) for k, t in TEXTS.items()}

_AB = " from e r join v a on r.src = a.id join v b on r.dst = b.id "
ORACLE = {
    "cypher_all_entities": _G + " select id, name, label from v",
    "cypher_all_relationships": _G + " select a.name as source, r.label as relationship, b.name as target" + _AB,
    "cypher_classes": _G + " select a.name as file, b.name as class" + _AB + "where r.label = 'DEFINES' and a.label = 'File' and b.label = 'Class'",
    "cypher_functions": _G + " select a.name as owner, b.name as function" + _AB + "where r.label = 'DEFINES' and b.label in ('Function', 'Method')",
    "cypher_library_imports": _G + " select a.name as file, b.name as library" + _AB + "where r.label = 'IMPORTS' and b.label = 'Library'",
    "cypher_api_handlers": _G + " select a.name as api, b.name as handler" + _AB + "where r.label = 'IMPLEMENTED_BY' and a.label = 'API'",
    "cypher_technologies": _G + ", l as (select src as t, dst as x from e union all select dst, src from e) select t.name as technology, count(*) as links from l join v t on l.t = t.id join v x on l.x = x.id where t.label = 'Technology' group by 1",
    "cypher_concepts": _G + " select a.name as document, b.name as concept" + _AB + "where r.label = 'DESCRIBES' and b.label = 'Concept'",
    "cypher_directory_tree": _G + " select a.id as parent, b.id as child" + _AB + "where r.label = 'CONTAINS'",
    "cypher_where": _G + " select a.name as file, b.label as kind, b.name as name, r.weight as weight" + _AB + "where a.label = 'File' and (r.weight >= 1.5 or b.name in ('Docker', 'Redis')) and not starts_with(a.name, 'scan') and b.description is not null",
    "cypher_regex": _G + " select distinct name from v where label = 'Class' and regexp_full_match(name, '(?i).*store.*')",
    "cypher_counts": _G + " select a.label as source, r.label as relationship, b.label as target, count(*) as n" + _AB + "group by 1, 2, 3",
    "cypher_two_hops": _G + " select d.id as directory, c.name as class from e r join v d on r.src = d.id join v f on r.dst = f.id join e s on s.src = f.id join v c on s.dst = c.id where d.label = 'Directory' and f.label = 'File' and c.label = 'Class' and r.label = 'CONTAINS' and s.label = 'DEFINES'",
    "cypher_top": _G + " select b.id as id, count(*) as n" + _AB + "group by 1 order by n desc, id limit 20",
    "cypher_properties": _G + " select a.id as file, b.id as class" + _AB + "where r.label = 'DEFINES' and r.weight = 1.0 and a.label = 'File' and a.start_line = 1 and b.label = 'Class'",
    "cypher_unequal": _G + " select a.id as file, b.id as name, l.name as library from e r join v a on r.src = a.id join v b on r.dst = b.id join e q on q.src = a.id join v l on q.dst = l.id where r.label = 'DEFINES' and q.label = 'IMPORTS' and a.label = 'File' and l.label = 'Library' and a.name <> b.name and b.label <> 'Class'",
    "cypher_undirected": _G + ", l as (select src as a, dst as b from e where label = 'IMPORTS' union all select dst, src from e where label = 'IMPORTS') select a.name as library, b.id as other from l join v a on l.a = a.id join v b on l.b = b.id where a.label = 'Library'",
}
