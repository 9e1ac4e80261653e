"""Queries of whole pipelines: repositories to graphs, the lakehouse, changes to a graph, and what views need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, refdata, text
from ..operators import code, extraction, graph, insights, merge, retrieval
from ..operators.lineage import application_folder, cut
from ..sources import formats, readers
from ..sources.lakehouse import Lakehouse
from . import engine, extraction_queries, repository, retrieval_queries
from .cypher import CypherGraph
from .extraction_queries import _LINES, _TERM, _named
from .graph_queries import _DEG, _G, _HALVES, _TIDY, raw, tables
from .text_queries import _CLEAN, _STRIP, _docs


def compose(s: SparkSession, d: str) -> DataFrame:
    """Services of every compose file that is YAML."""
    found = code.compose(_named(s, d, r"(?i)compose[^/]*\.ya?ml$")).where("parsed")
    return found.select("doc_id", "service_name", F.array_join("ports", ",").alias("ports"), F.array_join("depends_on", ",").alias("depends_on"), "line_number")


def analyze(s: SparkSession, d: str) -> DataFrame:
    """What structure, configuration and documentation of all repositories amount to, by repository."""
    docs = _docs(s, d)
    es, rs = repository.configuration(docs)  # the tables tell other technologies of services than their images do
    parts = [repository.structure(docs), (es.where("entity_type <> 'Technology'"), rs.where("relationship_type not in ('USES', 'CONNECTS_TO')")), repository.documentation(docs)]
    es = repository._union([p[0] for p in parts]).select("repository_name", F.lit("vertex").alias("kind"), F.col("entity_type").alias("label"), F.col("canonical_id").alias("x"))
    rs = repository._union([p[1] for p in parts]).select("repository_name", F.lit("edge").alias("kind"), F.col("relationship_type").alias("label"), F.concat_ws("|", "source_canonical_id", "target_canonical_id").alias("x"))
    return es.unionByName(rs).distinct().groupBy("repository_name", "kind", "label").agg(F.count("*").alias("n"))


def analyze_code(s: SparkSession, d: str) -> DataFrame:
    """The whole graph of all repositories, source code included, merged and pruned."""
    es, rs = repository.extracted(_docs(s, d))
    es, rs = cut(es, "entities"), cut(rs, "relationships")  # vertices() reads entities three times
    vs = cut(graph.vertices(es), "vertices")
    return graph.stats(vs, graph.edges(rs, vs))


def _lake(s: SparkSession, d: str) -> Lakehouse:
    """A lakehouse of all documents of flowing formats, catalogued and extracted."""
    docs = _docs(s, d).where(formats.detect("file_path").isin("txt", "markdown", "sql") & (F.length("text") > 0))
    lake = Lakehouse(s, f"{application_folder(s)}/lake-{uuid.uuid4().hex}")
    lake.ingest_contents(docs.select(F.concat(F.col("doc_id"), F.lit("/"), F.col("file_path")).alias("document_name"), F.col("text").alias("content")))
    lake.extract()
    return lake


def _lake_pages(lake: Lakehouse) -> DataFrame:
    return lake.read("extracted_pages").groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum("char_count").alias("n_chars"))


def lake_reprocess(s: SparkSession, d: str) -> DataFrame:
    """Pages after a second run over the same documents, and after they were ingested again."""
    lake = _lake(s, d)
    known = lake.read("metadata").count()
    lake.extract(reprocess=True)
    again = lake.ingest_contents(lake.read("raw").select("document_name", "content"))
    if again.count() or lake.read("metadata").count() != known:
        raise ValueError("known contents were catalogued again")
    return _lake_pages(lake)


def lake_delete(s: SparkSession, d: str) -> DataFrame:
    """Pages after all Markdown documents were deleted."""
    lake = _lake(s, d)
    lake.delete_rows(lake.documents().where("format = 'markdown'").select("document_id"))
    return _lake_pages(lake)


def lake_status(s: SparkSession, d: str) -> DataFrame:
    """Statuses after scripts were marked as failed and the rest stayed extracted."""
    lake = _lake(s, d)
    lake.set_status(lake.documents().where("format = 'sql'").select("document_id"), "FAILED", "refused")
    return lake.documents().groupBy("format", "status", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def upsert_edges(s: SparkSession, d: str) -> DataFrame:
    e, r = raw(s, d)
    at = F.col("extracted_at") < F.lit("2025-11-07 12:00:00").cast("timestamp_ntz")
    old_v, new_v = graph.vertices(e.where(at)), graph.vertices(e.where(~at))
    both = graph.upsert_edges(graph.edges(r.where(at), old_v), graph.edges(r.where(~at), new_v), graph.upsert_vertices(old_v, new_v))
    return both.select("src", "label", "dst", "weight")


def upsert_rows(s: SparkSession, d: str) -> DataFrame:
    """Vertices after the later half was upserted; those of repositories take new values."""
    e, _ = raw(s, d)
    at = F.col("extracted_at") < F.lit("2025-11-07 12:00:00").cast("timestamp_ntz")
    return graph.upsert_vertices(graph.vertices(e.where(at)), graph.vertices(e.where(~at))).select("id", "label", "name", "description", "confidence", "commit_sha", "start_line")


def cypher_changes(s: SparkSession, d: str) -> DataFrame:
    """A graph after CREATE of a vertex, CREATE of edges between matched vertices and by ids, and SET."""
    g = CypherGraph(*tables(s, d))
    g = g.mutate("CREATE (n:Concept {id: 'concept:reviewed', name: 'reviewed', confidence: 0.5}), (m:Concept {id: 'concept:open', name: 'open'})")
    g = g.mutate("MATCH (f:File)-[r:DEFINES]->(c:Class) WHERE r.weight >= 1 CREATE (c)-[:PART_OF {weight: 2.0}]->(f)")
    g = g.mutate("MATCH (a {id: 'concept:reviewed'}), (b {id: 'concept:open'}) CREATE (a)-[:FOLLOWS {weight: 0.5}]->(b)")
    g = g.mutate("MATCH (c:Class) WHERE c.name CONTAINS 'Store' SET c.description = 'kept', c.reviewed = 'yes'")
    v, e = g.vertices, g.edges
    vs = v.where("label in ('Concept', 'Class')").select("id", "label", "name", F.when(F.col("description") == "kept", "kept").alias("description"), F.try_element_at("properties", F.lit("reviewed")).alias("reviewed"))
    es = e.where("label in ('PART_OF', 'FOLLOWS')").select(F.concat_ws("|", "src", "label", "dst").alias("id"), "label", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.col("weight").cast("string").alias("reviewed"))
    return vs.unionByName(es)


def graph_values(s: SparkSession, d: str) -> DataFrame:
    """Vertices as a graph database prints them, and values that are none, read again."""
    vs, _ = tables(s, d)
    printed = vs.select("id", F.concat(F.to_json(F.struct("id", "label")), F.lit("::vertex")).alias("value")).unionByName(vs.select(F.concat("id", F.lit("#")).alias("id"), F.concat(F.lit("plain "), "label", F.lit("::path")).alias("value")))
    read, plain = identity.graph_value("value")
    return printed.select("id", F.get_json_object(read, "$.label").alias("label"), F.get_json_object(read, "$.properties").alias("properties"), plain.alias("plain"))


def view_fields(s: SparkSession, d: str) -> DataFrame:
    """Sizes and statuses as a view shows them."""
    return _docs(s, d).select("doc_id", text.human_size(F.octet_length("text")).alias("size"), text.status_group(F.when(F.col("text").isNull(), "failed: no text").when(F.col("license_file").isNull(), "Running").otherwise(F.col("lang"))).alias("status"))


def name_lists(s: SparkSession, d: str) -> DataFrame:
    """Services and functions of each repository, once each, sorted."""
    vs, _ = tables(s, d)
    return insights.name_lists(vs, ("Service", "Function")).select("repository_name", "label", F.array_join("names", ",").alias("names"))


def entity_provenance(s: SparkSession, d: str) -> DataFrame:
    """Where each library and class stands, with its first neighbours."""
    vs, es = tables(s, d)
    return graph.provenance(vs, es, F.col("label").isin("Library", "Class"), 5).select("id", "name", "file_path", "direction", "relationship", "other", "other_name")


def subgraph_view(s: SparkSession, d: str) -> DataFrame:
    """The vertices that a view of each question's best items draws."""
    vs, es = tables(s, d)
    items = retrieval.top_k(retrieval_queries._ranked(s, d), 8, ["qid"])
    return graph.subgraph_of(items, vs, es)[0].select("qid", "id", "label")


def _nations(s: SparkSession, d: str) -> list[tuple[str, bytes]]:
    """The table of nations, which never grows, as files of every format that a writer is at hand for."""
    import csv
    import io
    import json
    import zipfile

    import pyarrow.feather
    import pyarrow.parquet

    t = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").toArrow()
    rows, names = t.to_pylist(), t.column_names

    def separated(mark: str) -> bytes:
        out = io.StringIO()
        w = csv.writer(out, delimiter=mark)
        w.writerow(names)
        w.writerows([list(r.values()) for r in rows])
        return out.getvalue().encode()

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x)
        return out.getvalue()

    pq, fe = io.BytesIO(), io.BytesIO()
    pyarrow.parquet.write_table(t, pq)
    pyarrow.feather.write_feather(t, fe)
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *(r.values() for r in rows)])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="nations" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>",
    }
    para = "".join(f"<w:p><w:r><w:t>{r['n_name']}</w:t></w:r></w:p>" for r in rows)
    return [
        ("n.csv", separated(",")), ("n.tsv", separated("\t")), ("n.json", json.dumps(rows).encode()), ("n.jsonl", "\n".join(map(json.dumps, rows)).encode()), ("n.parquet", pq.getvalue()), ("n.feather", fe.getvalue()), ("n.xlsx", zipped(book)),
        ("n.xml", ("<nations>" + "".join(f"<n><name>{r['n_name']}</name></n>" for r in rows) + "</nations>").encode()), ("n.yaml", ("nations:\n" + "".join(f"  - {r['n_name']!r}\n" for r in rows)).encode()), ("n.sql", "".join(f"INSERT INTO n VALUES ({r['n_nationkey']});\n" for r in rows).encode()),
        ("n.docx", zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{para}</w:body></w:document>'})), ("n.rtf", ("{\\rtf1 " + " ".join(r["n_name"] for r in rows) + "}").encode()), ("n.html", ("<html><title>N</title><body>" + "".join(f"<p>{r['n_name']}</p>" for r in rows) + "</body></html>").encode()), ("n.txt", "\n".join(r["n_name"] for r in rows).encode("utf-8-sig")),
    ]


def read_formats(s: SparkSession, d: str) -> DataFrame:
    """What the readers tell of one table in every format."""
    cat = cut(readers.catalog(s.createDataFrame(_nations(s, d), "document_name string, content binary").withColumns({"path": F.lit(None).cast("string"), "size_bytes": F.octet_length("content").cast("long")})), "files")
    pages, meta = readers.extract(cat)
    said = meta.join(cat.select("document_id", "document_name"), "document_id").select("document_name", F.explode("metadata").alias("name", "value")).where(F.col("name").isin("record_count", "column_count", "column_types", "schema_keys", "element_count", "root_tag", "top_keys", "sql_statement_count", "sheet_count"))
    words = pages.groupBy("document_name").agg(F.sum("word_count").cast("string").alias("value")).select("document_name", F.lit("words").alias("name"), "value")
    return said.unionByName(words.where("document_name in ('n.docx', 'n.rtf', 'n.txt', 'n.html')"))


def lake_lookup(s: SparkSession, d: str) -> DataFrame:
    """The first document by hash, found again by its hash and by its id."""
    lake = _lake(s, d)
    first = lake.documents().agg(F.min("sha256").alias("h")).first().h
    one = lake.by_hash(first)
    again = lake.metadata(one.first().document_id)
    return one.select(F.lit("hash").alias("by"), "document_id", "sha256", "size_bytes").unionByName(again.select(F.lit("id").alias("by"), "document_id", "sha256", "size_bytes"))


def nested_keys(s: SparkSession, d: str) -> DataFrame:
    """Paths of files as nested keys of their repositories."""
    paths = _docs(s, d).where(F.length("file_path") > 0).select(F.col("repository_name").alias("document_name"), identity.tidy_path("file_path").alias("path")).where("document_name is not null")
    es, rs = extraction.structural_keys(paths)
    return es.select(F.col("canonical_name").alias("a"), F.lit("Field").alias("kind"), F.col("name").alias("b")).unionByName(rs.select(F.col("source_entity").alias("a"), F.col("relationship_type").alias("kind"), F.col("target_entity").alias("b")))


def schema_names(s: SparkSession, d: str) -> DataFrame:
    """Mentions without the concepts that only repeat names of the tables' schemas: columns are made concepts for it."""
    es, _ = extraction.structural(extraction_queries._schemas(s, d))
    columns = es.where("type = 'Column'").select(F.element_at(F.split("name", r"\."), -1).alias("name"), F.lit("Concept").alias("type"))
    mentions = s.read.parquet(f"{d}/doc_entities.parquet").select("name", F.lit("Concept").alias("type")).unionByName(columns)
    return extraction.without_schema_names(mentions, es).groupBy("name").agg(F.count("*").alias("n"))


def asked_files(s: SparkSession, d: str) -> DataFrame:
    """The prepared question for the main files, of the first repository by name."""
    vs, es = tables(s, d)
    return engine.ask(vs, es, vs.agg(F.min("repository_name")).first()[0], "important_files").select("id", "importance")


def document_scope(s: SparkSession, d: str) -> DataFrame:
    """Passages in the scope of the first document by id or the last by name, in any case."""
    pages = s.read.parquet(f"{d}/extracted_pages.parquet").where("document_id is not null").select("document_id", "document_name", "page_number", F.md5("text").alias("pid")).distinct().withColumn("repository_name", F.lit(None).cast("string"))
    r = pages.agg(F.min("document_id").alias("i"), F.max("document_name").alias("n")).first()
    return engine.Scope(document_id=r.i, document_name=r.n.upper()).passages(pages).select("document_id", "page_number", "pid")


# Literal rows, for what the tables hold none of.
_GRAPH = [("a1", "API", "GET /items", "r/api.py"), ("a2", "API", "/plain", "r/api.py"), ("a3", "API", "delete /items/{id}", "r/api.py"), ("f1", "Function", "list_items", "r/api.py"), ("f2", "Function", "drop_item", "r/api.py"), ("t1", "Technology", "Redis", ""), ("t2", "Technology", "Docker", ""), ("d1", "File", "guide.md", "guide.md"), ("c1", "Concept", "Provenance", ""), ("c2", "Concept", "Lineage", ""), ("s1", "Service", "cache", "compose.yml")]
_LINKS = [("a1", "IMPLEMENTED_BY", "f1"), ("a3", "IMPLEMENTED_BY", "f2"), ("s1", "USES", "t1"), ("d1", "USES", "t1"), ("d1", "USES", "t2"), ("d1", "DESCRIBES", "c1"), ("d1", "DESCRIBES", "c2")]
_HEADS = [("a.bin", "255044462D312E37"), ("b.bin", "50415231"), ("c.bin", "4152524F5731"), ("d.bin", "46454131"), ("e.bin", "7B5C72746631"), ("f.bin", "3C3F786D6C20"), ("g.bin", "3C68746D6C3E"), ("h.bin", "7B226122"), ("i.bin", "5B312C"), ("j.bin", "00FF"), ("k.pdf", "00FF"), ("l.parquet", "00FF"), ("m.rtf", "7B5C727466"), ("n.parquet", "50415231")]


# Literal texts and sources with what must come of them, told by hand from the rules.
_SAID = [
    "Docker is part of Kafka.", "Airflow depends on Python.", "Tableau integrates with Snowflake.", "Streamlit uses Pandas.", "Google created TensorFlow.", "DuckDB provides SQL.", "PostgreSQL → Apache AGE → Cypher", "Jane Miller\nJane is skilled in Python and Docker", "Context Lakehouse combines Telemetry.", "Looker works with BigQuery.",
    "Streamlit and Python, side by side.", "Nothing known is said in here.",
]
_STATED = [
    ("Docker", "PART_OF", "Kafka", 1, 1.0), ("Airflow", "DEPENDS_ON", "Python", 1, 1.0), ("Tableau", "INTEGRATES_WITH", "Snowflake", 1, 1.0), ("Streamlit", "USES", "Pandas", 1, 1.0), ("Google", "CREATES", "TensorFlow", 1, 1.0), ("DuckDB", "PROVIDES", "SQL", 1, 1.0), ("PostgreSQL", "EXTENDS", "Apache AGE", 1, 0.9), ("Apache AGE", "FLOWS_TO", "Cypher", 1, 0.9),
    ("Apache AGE", "USES", "Cypher", 1, 0.95), ("Jane Miller", "USES", "Python", 1, 0.9), ("Jane Miller", "USES", "Docker", 1, 0.9), ("Context Lakehouse", "COMBINES", "Telemetry", 2, 1.0), ("Looker", "EXTENDS", "BigQuery", 1, 1.0), ("Streamlit", "USES", "Python", 1, 0.9),
]
_SOURCES = [
    (1, "a/b.py", "import os\nfrom fastapi import FastAPI\nimport psycopg2\n\nLIMIT = 3\n\n\nclass A(Base):\n    def m(self, x):\n        return helper(x)\n\n    @app.get('/m')\n    def n(self):\n        pass\n\n\n@app.post('/login')\nasync def login(q):\n    return helper(q)\n\n\ndef helper(z):\n    \"\"\"Helps.\"\"\"\n"),
    (2, "c.js", "import x, { y as z } from 'mod';\nconst q = require('r');\nexport class K extends L {}\nexport async function f() {}\nconst g = (a) => a;\nrouter.get('/items', f);\n"), (3, "d.py", "def (\n"),
]
_SYMBOLS = [
    (1, "import", "os", None, 1), (1, "import", "fastapi", None, 2), (1, "import", "psycopg2", None, 3), (1, "variable", "LIMIT", None, 5), (1, "class", "A", None, 8), (1, "method", "m", "A", 9), (1, "call", "helper", "A.m", 10), (1, "method", "n", "A", 13), (1, "route", "GET /m", "A.n", 13), (1, "function", "login", None, 18), (1, "route", "POST /login", "login", 18),
    (1, "call", "helper", "login", 19), (1, "function", "helper", None, 22), (1, "docstring", "helper", None, 23), (2, "import", "mod", None, 1), (2, "import", "r", None, 2), (2, "class", "K", None, 3), (2, "function", "f", None, 4), (2, "function", "g", None, 5), (2, "route", "GET /items", None, 6), (3, "error", "SyntaxError", None, 1), (1, "call", "app.get", "A.n", 12), (1, "call", "app.post", "login", 17),  # a decorator's call is one of its function
]
_PY, _CJS = "repo:r:file:a/b.py", "repo:r:file:c.js"
_CODE_LINKS = [
    (_PY, "DEFINES", _PY + ":class:A"), (_PY, "DEFINES", _PY + ":func:login"), (_PY, "DEFINES", _PY + ":func:helper"), (_PY + ":class:A", "CONTAINS", _PY + ":class:A:method:m"), (_PY + ":class:A", "CONTAINS", _PY + ":class:A:method:n"), (_PY, "IMPORTS", "lib:fastapi"), (_PY, "IMPORTS", "lib:psycopg2"),
    ("repo:r:api:GET_m", "IMPLEMENTED_BY", _PY + ":class:A:method:n"), ("repo:r:api:POST_login", "IMPLEMENTED_BY", _PY + ":func:login"), (_PY + ":class:A:method:m", "CALLS", _PY + ":func:helper"), (_PY + ":func:login", "CALLS", _PY + ":func:helper"),
    (_CJS, "DEFINES", _CJS + ":class:K"), (_CJS, "DEFINES", _CJS + ":func:f"), (_CJS, "DEFINES", _CJS + ":func:g"), (_CJS, "IMPORTS", "lib:mod"), (_CJS, "IMPORTS", "lib:r"),
]


def stated(s: SparkSession, d: str) -> DataFrame:
    chunks = s.createDataFrame([(f"d{i}", 1, f"d{i}_c", 0, t) for i, t in enumerate(_SAID)], "document_id string, page_number int, chunk_id string, chunk_index int, text string")
    return extraction.relationships(chunks).groupBy("source_entity", "relationship_type", "target_entity").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


def _sources(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, "r", p, t) for i, p, t in _SOURCES], "doc_id long, repository_name string, file_path string, text string")


def code_links(s: SparkSession, d: str) -> DataFrame:
    docs = _sources(s)
    return code.code_graph(docs, code.symbols(docs, formats.classify("file_path")[0]), calls=True)[1]


def created_sample(s: SparkSession, d: str) -> DataFrame:
    """Ends of the stated relationships that the tables' mentions don't name, made as concepts."""
    es = s.read.parquet(f"{d}/doc_entities.parquet").where("canonical_name is not null").select(F.col("canonical_name"), "name", F.lit("Known").alias("type"), F.lit(1.0).alias("confidence")).groupBy("canonical_name").agg(F.min("name").alias("name"), F.min("type").alias("type"), F.min("confidence").alias("confidence"))
    rel = stated(s, d).select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"))
    return merge.create_ends(rel, es).where("type = 'Concept'")


def _sample(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    return s.createDataFrame(_GRAPH, "id string, label string, name string, file_path string"), s.createDataFrame(_LINKS, "src string, label string, dst string")


def sniffed(s: SparkSession, d: str) -> DataFrame:
    """Formats that names and first bytes tell, and whether the bytes allow them."""
    df = s.createDataFrame(_HEADS, "name string, hex string").withColumn("head", F.unhex("hex"))
    fmt = formats.detect("name", F.col("head"))
    return df.select("name", fmt.alias("format"), formats.verified(fmt, F.col("head")).alias("verified"))


def workbooks(s: SparkSession, d: str) -> DataFrame:
    """The tables' schemas as sheets of one workbook."""
    schema = extraction_queries._schemas(s, d).withColumnRenamed("table_name", "sheet_name")
    es, rs = extraction.structural_workbook(schema)
    return es.select(F.col("canonical_name").alias("a"), F.col("type").alias("kind"), F.col("name").alias("b")).unionByName(rs.select(F.col("source_entity").alias("a"), F.col("relationship_type").alias("kind"), F.col("target_entity").alias("b")))


QUERIES = {
    "read_formats": read_formats,
    "lake_lookup": lake_lookup,
    "nested_keys": nested_keys,
    "schema_names": schema_names,
    "asked_files": asked_files,
    "document_scope": document_scope,
    "compose": compose,
    "analyze": analyze,
    "analyze_code": analyze_code,
    "lake_pages": lambda s, d: _lake_pages(_lake(s, d)),
    "lake_reprocess": lake_reprocess,
    "lake_delete": lake_delete,
    "lake_status": lake_status,
    "upsert_rows": upsert_rows,
    "upsert_edges": upsert_edges,
    "cypher_changes": cypher_changes,
    "graph_values": graph_values,
    "view_fields": view_fields,
    "name_lists": name_lists,
    "entity_provenance": entity_provenance,
    "subgraph_view": subgraph_view,
    "target_files": lambda s, d: retrieval_queries._questions(s, d).select("qid", text.target_file(text.question_targets("query")).alias("target_file")),
    "apis_sample": lambda s, d: insights.apis(_sample(s)[0]),
    "cypher_sample_handlers": lambda s, d: CypherGraph(*_sample(s)).query("MATCH (a:API)-[r:IMPLEMENTED_BY]->(h) RETURN a.name AS api, h.name AS handler"),
    "cypher_sample_technologies": lambda s, d: CypherGraph(*_sample(s)).query("MATCH (t:Technology)-[r]-(x) RETURN t.name AS technology, count(x) AS links"),
    "cypher_sample_concepts": lambda s, d: CypherGraph(*_sample(s)).query("MATCH (d)-[r:DESCRIBES]->(c:Concept) RETURN d.name AS document, c.name AS concept"),
    "stated_sample": stated,
    "created_sample": created_sample,
    "symbols_sample": lambda s, d: code.symbols(_sources(s), formats.classify("file_path")[0]).select("doc_id", "kind", "name", "parent", "start_line"),
    "code_links_sample": code_links,
    "sniffed": sniffed,
    "structural_workbook": workbooks,
    "markdown": lambda s, d: code.markdown(_named(s, d, r"\.md$")).select("doc_id", "title", F.md5("summary").alias("summary"), F.size("sections").alias("n_sections"), "line_count"),
}

_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda p: upper(p[1]) || lower(p[2:])), '')"
_LAKE = rf"""
with c as (select distinct text, case when regexp_matches(lower(file_path), '\.(txt|text)$') then 'txt' when regexp_matches(lower(file_path), '\.(md|markdown)$') then 'markdown' else 'sql' end as format, doc_id || '/' || file_path as name from documents where regexp_matches(lower(file_path), '\.(txt|text|md|markdown|sql)$') and text <> ''),
one as (select text, arg_min(format, name) as format from c group by 1),
t as (select 'doc_' || substr(sha256(text), 1, 10) as document_id, format, {_CLEAN} as text from one),
l as (select document_id, format, regexp_extract_all(text, '([^\n]*\n|[^\n]+$)', 1) as ls from t),
f as (select document_id, format, list_reduce(ls, lambda a, x: case when length(a.cur) + length(x) > 3000 and length(a.cur) > 0 then {{'done': list_append(a.done, a.cur), 'cur': x}} else {{'done': a.done, 'cur': a.cur || x}} end, {{'done': []::varchar[], 'cur': ''}}) as v from l),
p as (select document_id, format, unnest(list_append(v.done, v.cur)) as x from f), pg as (select document_id, format, {_STRIP('x')} as text from p)"""
_LAKE_PAGES = _LAKE + " select document_id, count(*) as n_pages, sum(length(text))::bigint as n_chars from pg where text <> ''"
_SQL_LIBS = rf"""
rq as (with l as ({_LINES} regexp_matches(file_path, 'requirements[^/]*\.txt$')), t as (select *, trim(raw, ' ' || chr(9)) as line from l), k as (select *, regexp_extract(line, '^([a-zA-Z0-9_\-.]+)(.*)$', 1) as name from t where line <> '' and not regexp_matches(line, '^(#|-r|-e)')) select doc_id, regexp_replace(replace(lower(name), '_', '-'), '-binary$', '') as library from k where name <> ''),
pj as (with j as (select doc_id, case when json_valid(text) then text::json end as j from documents where regexp_matches(file_path, '(^|/)package\.json$') and text is not null), n as (select doc_id, unnest(json_keys(j, '$.dependencies')) as name from j union all select doc_id, unnest(json_keys(j, '$.devDependencies')) from j), m as (select doc_id, replace(lower(trim(name)), '_', '-') as n from n) select doc_id, case n when 'psycopg2-binary' then 'psycopg2' when 'py-pdf' then 'pypdf' when 'pypdf2' then 'pypdf' when 'openai-python' then 'openai' else n end as library from m),
lib as (select * from rq union select * from pj),
md as (select doc_id, kind, mark, how, c from (select doc_id, lower(text) as t from documents where file_path like '%.md' and text is not null) join (values {", ".join("('\\b" + __import__('re').escape(t) + "\\b', '" + c + "', 'Technology', 'tech', 'USES')" for t, c in refdata.MARKDOWN_TECHNOLOGIES.items())}, {", ".join("('\\b" + __import__('re').escape(t) + "\\b', '" + c + "', 'Concept', 'concept', 'DESCRIBES')" for t, c in refdata.MARKDOWN_CONCEPTS.items())}) as k(p, c, kind, mark, how) on regexp_matches(t, p)),
sv as (select doc_id, service_name, inferred_technology as tech, depends_on from docker_services)"""
_SAMPLE = "with v(id, label, name) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c, _ in _GRAPH) + "), e(src, label, dst) as (values " + ", ".join(map(str, _LINKS)) + ")"
_COLS = "(select table_name, column_name, case data_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' end as k from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem'))"
ORACLE = {
    "compose": "select distinct doc_id, service_name, coalesce(array_to_string(ports, ','), '') as ports, coalesce(array_to_string(depends_on, ','), '') as depends_on, line_number from docker_services",
    "analyze": f"""with paths as (select distinct repository_name, {_TIDY('file_path')} as p from documents where length(file_path) > 0), pre as (select repository_name, string_split(p, '/') as ps from paths), st as (select repository_name, ps, unnest(range(1, len(ps) + 1)) as k from pre),
cl as (select distinct repository_name, array_to_string(ps[1 : k - 1], '/') as parent, array_to_string(ps[1 : k], '/') as child from st), kinds as (select cl.*, child in (select p from paths where paths.repository_name = cl.repository_name) as is_file from cl), {_SQL_LIBS},
d as (select doc_id, repository_name as r, 'repo:' || repository_name || ':file:' || {_TIDY('file_path')} as f from documents),
x as (select repository_name as r, 'vertex' as kind, 'Repository' as label, 'repo:' || repository_name as x from documents where repository_name is not null
  union select repository_name, 'vertex', case when is_file then 'File' else 'Directory' end, child from kinds union select repository_name, 'edge', 'CONTAINS', parent || '|' || child from kinds
  union select r, 'vertex', 'Library', library from lib join d using (doc_id) where library <> '' union select r, 'edge', 'DEPENDS_ON', f || '|lib:' || library from lib join d using (doc_id) where library <> ''
  union select r, 'vertex', kind, c from md join d using (doc_id) union select r, 'edge', how, f || '|' || mark || ':' || c from md join d using (doc_id)
  union select r, 'vertex', 'Service', service_name from sv join d using (doc_id) union select r, 'edge', 'DEFINES', f || '|' || service_name from sv join d using (doc_id)
  union select r, 'edge', 'DEPENDS_ON', 'service:' || service_name || '|' || other from (select doc_id, service_name, unnest(depends_on) as other from sv) join d using (doc_id))
select r as repository_name, kind, label, count(*) as n from x group by all""",
    "read_formats": """with n as (select count(*)::varchar as c, sum(len(regexp_split_to_array(n_name, ' ')))::varchar as w from nation), k(document_name, name, value) as (values
  ('n.csv', 'column_count', '3'), ('n.csv', 'column_types', '{"n_nationkey": "Integer", "n_name": "String", "n_regionkey": "Integer"}'), ('n.tsv', 'column_count', '3'), ('n.tsv', 'column_types', '{"n_nationkey": "Integer", "n_name": "String", "n_regionkey": "Integer"}'), ('n.json', 'schema_keys', '["n_nationkey", "n_name", "n_regionkey"]'), ('n.jsonl', 'schema_keys', '["n_nationkey", "n_name", "n_regionkey"]'),
  ('n.parquet', 'column_count', '3'), ('n.feather', 'column_count', '3'), ('n.xlsx', 'sheet_count', '1'), ('n.xml', 'root_tag', 'nations'), ('n.yaml', 'top_keys', '["nations"]'))
select * from k union all select x, 'record_count', c from n, (values ('n.csv'), ('n.tsv'), ('n.json'), ('n.jsonl'), ('n.parquet'), ('n.feather'), ('n.xlsx')) as f(x) union all select 'n.sql', 'sql_statement_count', c from n union all select 'n.xml', 'element_count', (1 + 2 * c::int)::varchar from n union all select x, 'words', w from n, (values ('n.docx'), ('n.rtf'), ('n.txt')) as f(x) union all select 'n.html', 'words', (3 + w::int)::varchar from n
union all select x, 'column_types', '{"n_nationkey": "' || t || '", "n_name": "string", "n_regionkey": "' || t || '"}' from (values ('n.parquet'), ('n.feather')) as f(x), (select case data_type when 'INTEGER' then 'int32' else 'int64' end as t from information_schema.columns where table_name = 'nation' and column_name = 'n_nationkey')""",
    "lake_lookup": _LAKE + ", h as (select 'doc_' || substr(sha256(text), 1, 10) as document_id, sha256(text) as sha256, strlen(text)::bigint as size_bytes from one order by 2 limit 1) select 'hash' as \"by\", * from h union all select 'id', * from h",
    "nested_keys": f"with p as (select distinct repository_name as d, {_TIDY('file_path')} as path from documents where length(file_path) > 0 and repository_name is not null) select distinct d || '::' || path as a, 'Field' as kind, string_split(path, '/')[-1] as b from p union all select distinct case when contains(path, '/') then d || '::' || regexp_replace(path, '/[^/]+$', '') else d end, 'CONTAINS', d || '::' || path from p",
    "schema_names": f"with c as {_COLS}, m as (select name from doc_entities union all select distinct column_name from (select table_name, column_name from c)), bad as (select lower(column_name) as x from c union select lower(table_name || '.' || column_name) from c union select lower(table_name) from c union select lower(k) from c) select name, count(*) as n from m where name is not null and lower(name) not in (select x from bad) group by 1",
    "asked_files": _G + ", r as (select min(repository_name) as r from v), e2 as (select e.* from e join r on e.repository_name = r.r), v2 as (select * from v where repository_name = (select r from r) or id in (select src from e2) or id in (select dst from e2)), ends as (select src as id, 0 as i, 1 as o from e2 union all select dst, 1, 0 from e2), deg as (select v2.id, coalesce(sum(i), 0)::bigint as i, coalesce(sum(o), 0)::bigint as o from v2 left join ends using (id) group by 1), f as (select v2.id, repository_name, case when coalesce(file_path, '') = '' then name else file_path end as file_path, coalesce(try_cast(l.val as int), end_line - coalesce(start_line, 1) + 1, 0) as n from v2 left join v_pr l on l.id = v2.id and l.k = 'line_count' where label = 'File'), d as (select repository_name, file_path, count(*) filter (where label <> 'Library') as c from v2 where label in ('Class', 'Function', 'Library') and file_path <> '' and name <> '' group by 1, 2) select f.id, round(3.0 * i + 2.0 * coalesce(c, 0) + o + 0.01 * n, 2)::double as importance from f join deg using (id) left join d using (repository_name, file_path) order by importance desc, f.file_path limit 10",
    "document_scope": "with p as (select distinct document_id, document_name, page_number, md5(text) as pid from extracted_pages where document_id is not null) select document_id, page_number, pid from p where document_id = (select min(document_id) from p) or lower(document_name) = (select lower(max(document_name)) from p)",
    "lake_pages": _LAKE_PAGES + " group by 1",
    "lake_reprocess": _LAKE_PAGES + " group by 1",
    "lake_delete": _LAKE_PAGES + " and format <> 'markdown' group by 1",
    "lake_status": _LAKE + " select format, case when format = 'sql' then 'FAILED' else 'EXTRACTED' end as status, case when format = 'sql' then 'refused' else '' end as error, count(*) as n from t group by 1",
    "upsert_rows": _HALVES + " select v.id, v.label, case when v.label = 'Repository' and w.label = 'Repository' then coalesce(w.name, v.name) else v.name end as name, case when v.label = 'Repository' and w.label = 'Repository' then coalesce(w.description, v.description) else v.description end as description, case when v.label = 'Repository' and w.label = 'Repository' then coalesce(w.confidence, v.confidence) else v.confidence end as confidence, case when v.label = 'Repository' and w.label = 'Repository' then coalesce(w.commit_sha, v.commit_sha) else v.commit_sha end as commit_sha, case when v.label = 'Repository' and w.label = 'Repository' then coalesce(w.start_line, v.start_line) else v.start_line end as start_line from v left join w using (id) union all select id, label, name, description, confidence, commit_sha, start_line from w anti join v using (id)",
    "upsert_edges": _HALVES + " select src, label, dst, weight from e union all select src, label, dst, weight from g anti join e using (src, label, dst)",
    "cypher_changes": _G + ", n as (select c.id || '|PART_OF|' || f.id as id from e join v f on e.src = f.id join v c on e.dst = c.id where e.label = 'DEFINES' and f.label = 'File' and c.label = 'Class' and e.weight >= 1) select id, label, name, case when label = 'Class' and contains(name, 'Store') then 'kept' end as description, case when label = 'Class' and contains(name, 'Store') then 'yes' end as reviewed from v where label in ('Concept', 'Class') union all select * from (values ('concept:reviewed', 'Concept', 'reviewed', null, null), ('concept:open', 'Concept', 'open', null, null), ('concept:reviewed|FOLLOWS|concept:open', 'FOLLOWS', null, null, '0.5')) union all select distinct id, 'PART_OF', null, null, '2.0' from n",
    "graph_values": _G + " select id, label, '{}' as properties, null as plain from v union all select id || '#', null, null, 'plain ' || label from v",
    "view_fields": "select doc_id, case when coalesce(strlen(text), 0) = 0 then '0 KB' when strlen(text) >= 1048576 then printf('%.2f MB', strlen(text) / 1048576.0) else printf('%.1f KB', strlen(text) / 1024.0) end as size, case when text is null then 'FAILED' when license_file is null then 'PROCESSING' else 'PENDING' end as status from documents",
    "name_lists": _G + " select repository_name, label, array_to_string(list_sort(list_distinct(list(name))), ',') as names from v where label in ('Service', 'Function') and name <> '' group by 1, 2",
    "entity_provenance": _G + ", f as (select * from v where label in ('Library', 'Class')), bo as (select src as id, 'out' as direction, label as relationship, dst as other from e union all select dst, 'in', label, src from e), n as (select bo.*, o.name as other_name from bo join f using (id) join v o on other = o.id qualify row_number() over (partition by bo.id order by other, relationship, direction) <= 5) select f.id, f.name, f.file_path, direction, relationship, other, other_name from f left join n using (id)",
    "subgraph_view": "with z as (" + retrieval_queries.ORACLE["rank_topk"] + "), i as (select qid, item_id from z), n as (select qid, substr(item_id, 11) as id from i where starts_with(item_id, 'code:node:') union select qid, string_split(item_id, '|')[2] from i where starts_with(item_id, 'code:edge|') union select qid, string_split(item_id, '|')[4] from i where starts_with(item_id, 'code:edge|')), " + _G[5:] + " select qid, id, label from n join v using (id)",
    "target_files": f"with {retrieval_queries._TERMS[1:]}, {retrieval_queries._ASK} select item_id as qid, t.e as target_file from benchmark left join (select qid, arg_min(e, o) as e from tgt where regexp_matches(e, '\\.(?:py|js|json|md|pdf|xlsx|csv)$') group by 1) t on t.qid = item_id",
    "apis_sample": _SAMPLE + " select id, case when regexp_extract(name, '^([A-Za-z]+) +/', 1) = '' then 'GET' else upper(regexp_extract(name, '^([A-Za-z]+) +/', 1)) end as http_method, regexp_replace(name, '^[A-Za-z]+ +/', '/') as endpoint from v where label = 'API'",
    "cypher_sample_handlers": _SAMPLE + " select a.name as api, b.name as handler from e join v a on src = a.id join v b on dst = b.id where e.label = 'IMPLEMENTED_BY'",
    "cypher_sample_technologies": _SAMPLE + " select t.name as technology, count(*) as links from v t join e on e.dst = t.id or e.src = t.id where t.label = 'Technology' group by 1",
    "cypher_sample_concepts": _SAMPLE + " select a.name as document, b.name as concept from e join v a on src = a.id join v b on dst = b.id where e.label = 'DESCRIBES'",
    "stated_sample": "select source_entity, relationship_type, target_entity, n::bigint as n, weight::double as weight from (values " + ", ".join(map(str, _STATED)) + ") as t(source_entity, relationship_type, target_entity, n, weight)",
    "created_sample": "with t(s, k, d, n, w) as (values " + ", ".join(map(str, _STATED)) + ") select distinct e as canonical_name, e as name, 'Concept' as type, 0.8::double as confidence from (select s as e from t union select d from t) where e not in (select canonical_name from doc_entities where canonical_name is not null)",
    "symbols_sample": "select * from (values " + ", ".join(str(r).replace("None", "null") for r in _SYMBOLS) + ") as t(doc_id, kind, name, parent, start_line)",
    "code_links_sample": "select * from (values " + ", ".join(map(str, _CODE_LINKS)) + ") as t(source, relationship_type, target)",
    "sniffed": "with h(name, hex) as (values " + ", ".join(map(str, _HEADS)) + "), s as (select *, case when hex like '255044462D%' then 'pdf' when hex like '50415231%' then 'parquet' when hex like '4152524F5731%' or hex like '46454131%' then 'feather' when hex like '7B5C727466%' then 'rtf' when hex like '3C3F786D6C%' then 'xml' when hex like '3C68746D6C%' then 'html' when hex like '7B%' or hex like '5B%' then 'json' end as found, case when name like '%.pdf' then 'pdf' when name like '%.parquet' then 'parquet' when name like '%.rtf' then 'rtf' end as named from h) select name, coalesce(named, found) as format, case when coalesce(named, found) in ('parquet', 'rtf') then coalesce(found = coalesce(named, found), false) else true end as verified from s",
    "structural_workbook": f"with c as (select 'star::' || table_name as t, table_name, column_name, k from {_COLS}) select 'star' as a, 'Workbook' as kind, 'star' as b union all select distinct t, 'Sheet', table_name from c union all select t || '.' || column_name, 'Column', table_name || '.' || column_name from c union all select distinct k, 'DataType', k from c union all select distinct 'star', 'CONTAINS_SHEET', t from c union all select t, 'CONTAINS_COLUMN', t || '.' || column_name from c union all select t || '.' || column_name, 'HAS_DATA_TYPE', k from c",
    "markdown": rf"""with m as (select doc_id, text, file_path, list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: {_STRIP('x')}) as ls from documents where regexp_matches(file_path, '\.md$') and text is not null),
a as (select *, list_filter(ls, lambda x: starts_with(x, '# '))[1] as h, list_reduce(ls, lambda a, x: case when a.over or (len(a.said) = 0 and regexp_matches(x, '^(#|!|\[|$)')) then a when regexp_matches(x, '^(#|$)') then {{'said': a.said, 'over': true}} else {{'said': list_append(a.said, x), 'over': false}} end, {{'said': []::varchar[], 'over': false}}) as v from m),
b as (select *, coalesce(nullif(regexp_replace(h, '^[# ]+|[# ]+$', '', 'g'), ''), {_TITLE("replace(regexp_extract(file_path, '([^/\\\\]+?)(\\.[^./\\\\]+)?$', 1), '_', ' ')")}) as title, array_to_string(v.said, ' ') as first from a)
select doc_id, title, md5(case when first = '' then 'Documentation for ' || title when length(first) > 400 then left(first, 400) || '...' else first end) as summary, len(list_filter(ls, lambda x: regexp_matches(x, '^#{{1,4}}\s+.+$')))::int as n_sections, (case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end)::int as line_count from b""",
}
