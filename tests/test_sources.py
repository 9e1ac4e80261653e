"""Readers of every format, the lakehouse from files to a graph, extraction and code."""

import io
import json
import re
import zipfile

import pyarrow as pa
import pyarrow.feather
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from strataloom.functions import gazetteer
from strataloom.operators import code, extraction
from strataloom.plans import extraction_queries, registry
from strataloom.sources import export, readers
from strataloom.sources.lakehouse import Lakehouse

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return out.getvalue()


def samples():
    t = pa.table({"id": [1, 2, 3], "technology": ["a", "b", "c"], "score": [0.5, 1.0, 2.0]})
    pq, fe = io.BytesIO(), io.BytesIO()
    pyarrow.parquet.write_table(t, pq)
    pyarrow.feather.write_feather(t, fe)
    docx = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Overview</w:t></w:r></w:p><w:p><w:r><w:t>A paragraph.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = zipped({
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Tools" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><t>Engine</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    })
    return {
        "notes.txt": b"Plain text about PostgreSQL.\nApache AGE is an extension for PostgreSQL.", "readme.md": b"# Title\n\nBuilt with FastAPI and Docker.", "page.html": b"<html><title>Hi</title><script>x()</script><p>Some phrase</p></html>", "t.csv": b"id,name,spend\n1,a,1.5\n\n2,b,2\n", "t.tsv": b"a\tb\n1\t2\n",
        "o.json": json.dumps({"application": 1, "features": [1]}).encode(), "l.jsonl": b'{"e": 1}\n{"e": 2}\n{"e": 3}\n', "c.xml": b"<catalog><book id='1'><author>x</author><title>y</title><technology>z</technology></book></catalog>", "d.docx": docx, "w.xlsx": xlsx, "p.parquet": pq.getvalue(), "f.feather": fe.getvalue(),
        "y.yaml": b"pipeline:\n  steps: [a, b]\n", "q.sql": b"CREATE TABLE a (b int);\nSELECT 1;", "r.rtf": b"{\\rtf1\\b Bold text}", "bad.json": b"{oops", "bad.xml": b"<a>", "empty.txt": b"", "x.exe": b"MZ", "fake.parquet": b"nope", "copy.txt": b"Plain text about PostgreSQL.\nApache AGE is an extension for PostgreSQL.",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for n, raw in samples().items():
        (d / n).write_bytes(raw)
    return d


def test_every_format(spark, folder):
    cat = readers.catalog(readers.files(spark, str(folder))).cache()
    errors = {r.document_name for r in cat.where("error is not null").collect()}
    assert errors == {"x.exe", "fake.parquet"}  # the file source leaves empty files out
    names = {r.document_id: r.document_name for r in cat.where("document_name <> 'copy.txt'").collect()}
    pages, meta = readers.extract(cat)
    text = {names[r.document_id]: r.text for r in pages.collect() if r.document_id in names}
    info = {names[r.document_id]: (r.metadata, r.error) for r in meta.collect() if r.document_id in names}
    assert "Some phrase" in text["page.html"] and "x()" not in text["page.html"] and text["page.html"].startswith("# Hi")
    assert "## Overview" in text["d.docx"] and "k | v" in text["d.docx"] and "Bold text" in text["r.rtf"] and "rtf1" not in text["r.rtf"]
    assert info["t.csv"][0]["record_count"] == "2" and json.loads(info["t.csv"][0]["column_types"]) == {"id": "Integer", "name": "String", "spend": "Float"}
    assert info["c.xml"][0]["element_count"] == "5" and info["c.xml"][0]["root_tag"] == "catalog"
    assert info["w.xlsx"][0]["sheet_count"] == "1" and info["w.xlsx"][0]["record_count"] == "1"
    assert info["p.parquet"][0]["record_count"] == info["f.feather"][0]["record_count"] == info["l.jsonl"][0]["record_count"] == "3"
    assert "application" in info["o.json"][0]["schema_keys"] and info["q.sql"][0]["sql_statement_count"] == "2" and "pipeline" in info["y.yaml"][0]["top_keys"]
    assert info["bad.json"][1] and info["bad.xml"][1]


def test_lakehouse(spark, folder, tmp_path):
    lake = Lakehouse(spark, str(tmp_path / "lake"))
    assert lake.documents().count() == 0
    n = lake.ingest(str(folder)).count()
    assert n == 17  # two of the sound files have the same content
    lake.ingest(str(folder))
    assert lake.documents().count() == n
    first = lake.process()
    assert first["vertices_created"] >= 3 and first["edges_created"] >= 1
    status = {r.document_name: r.status for r in lake.documents().collect()}
    assert status["bad.json"] == "FAILED" and status["readme.md"] == "COMPLETED"
    assert lake.process() == {"vertices_created": 0, "vertices_existing": 0, "edges_created": 0, "edges_existing": 0}
    gone = lake.documents().where("document_name = 'readme.md'").first()
    assert lake.by_hash(gone.sha256).count() == 1
    lake.delete([gone.document_id])
    assert lake.documents().count() == n - 1 and lake.read("chunks").where(F.col("document_id") == gone.document_id).count() == 0
    with pytest.raises(ValueError):
        lake.set_status(lake.documents(), "ODD")


def test_extraction(spark):
    text = "Jane Miller\nJane is skilled in Python and Docker. Apache AGE is an extension for PostgreSQL. PostgreSQL → Apache AGE → Knowledge Graph. She studied at Hill Valley University of Science."
    df = spark.createDataFrame([("d", 1, "d_p1_c0", 0, text), ("d", 2, "d_p2_c0", 1, None), ("d", 3, "d_p3_c0", 2, "")], "document_id string, page_number int, chunk_id string, chunk_index int, text string")
    es = {r.cname: r.type for r in extraction.entities(df).collect()}
    assert es["Apache AGE"] == "Technology" and es["Jane Miller"] == "Person" and es["Knowledge Graph"] == "Concept" and es["Apache Software Foundation"] == "Organization"
    rs = {(r.source_entity, r.relationship_type, r.target_entity) for r in extraction.relationships(df).collect()}
    assert {("Jane Miller", "USES", "Python"), ("Jane Miller", "USES", "Docker"), ("PostgreSQL", "EXTENDS", "Apache AGE"), ("Apache AGE", "FLOWS_TO", "Knowledge Graph"), ("Apache AGE", "EXTENDS", "PostgreSQL")} <= rs
    assert len(gazetteer.known()) == 87
    schema = spark.createDataFrame([("Book1", "Sheet1", c, k) for c, k in (("ID", "Integer"), ("Name", "String"))], "document_name string, table_name string, column_name string, data_type string")
    a, b = extraction.structural(schema)
    assert a.count() == 5 and b.count() == 4
    assert extraction.entities(df.limit(0)).count() == 0


def brute_entities(first: bool, text: str) -> set[tuple[str, str]]:
    """(canonical name, type) by one search per known name and plain loops over lines and matches."""
    known = {(can, kind) for can, kind, other in gazetteer.known() for n in [can, *other] if re.search(r"(?<![a-z0-9_])" + re.escape(n.lower()) + (r"(?!\w)" if n[-1].isalnum() else ""), text.lower())}
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    people = {(lines[0].title(), "Person")} if first and lines and re.fullmatch(r"[A-Z][a-zA-Z]+(\s+[A-Z][a-zA-Z]+){1,2}", lines[0]) and lines[0].upper() not in gazetteer.NOT_NAMES else set()
    orgs = {(m[1], "Organization") for m in re.finditer(rf"\b([A-Z][a-zA-Z']+(?:\s+(?:{extraction._ORG_TAIL}))+)\b", text) if len(m[1]) > 12 and m[1].split()[0].upper() not in gazetteer.NOT_NAMES}
    projects = {(m[1], "Project") for m in re.finditer(r"(?i)(?:Project|Project Name)\s*[:\-]\s*([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){1,4})", text) if len(m[1]) > 5 and m[1].upper() not in gazetteer.NOT_NAMES}
    out: dict[str, str] = {}
    for name, kind in [*known, *people, *orgs, *projects]:
        out.setdefault(name, kind)
    return set(out.items())


def test_all_entities_against_brute_force(spark, tmp_path):
    docs = [(1, "Jane Miller\nDocker and Python at Rivertown University, kept by Hill Technologies."), (2, None), (3, ""), (4, "plain words only"), (5, "Project: Quiet Harbor\nuses PostgreSQL; postgres again")]
    pages = [("a", "a.pdf", 1, "Omar Stone Reed\nLakeside Institute of Technology runs Apache AGE"), ("a", "a.pdf", 2, "Second Page\nProject: Amber Gate\nKubernetes"), ("a", "a.pdf", 2, "Second Page\nProject: Amber Gate\nKubernetes"), ("b", "b.pdf", 1, None), ("b", "b.pdf", 2, "Streamlit. " * 120 + "Northern Foundation for Science")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "document_id string, document_name string, page_number int, text string").write.parquet(f"{tmp_path}/extracted_pages.parquet")
    got = registry.queries()["all_entities"](spark, str(tmp_path))
    chunks = extraction_queries._chunks(spark, str(tmp_path)).collect()
    want = {(c.chunk_id, *e) for c in chunks for e in brute_entities(c.page_number == 1 and c.chunk_index == 0, c.text or "")}
    rows = got.collect()
    assert {(r.chunk_id, r.canonical_name, r.type) for r in rows} == want and len(rows) == len(want)
    assert {r.type for r in rows} >= {"Person", "Organization", "Project", "Technology"} and {r.chunk_id.startswith("file_") for r in rows} == {True, False}
    assert len({r.chunk_id for r in rows if r.document_id == "b"}) >= 2


PY = "import os\nfrom fastapi import FastAPI\nimport psycopg2\n\nclass A(Base):\n    def m(self, x):\n        return helper(x)\n\n@app.post('/login')\nasync def login(q):\n    return helper(q)\n\ndef helper(z):\n    pass\n"
JS = "import x, { y as z } from 'mod';\nconst q = require('r');\nexport class K extends L {}\nexport async function f() {}\nconst g = (a) => a;\nrouter.get('/items', f);\n"


def test_code(spark):
    df = spark.createDataFrame([(1, PY, "r", "a/b.py", "Python"), (2, JS, "r", "c.js", "JavaScript"), (3, "def (", "r", "d.py", "Python"), (4, None, "r", "e.py", "Python"), (5, "", "r", "f.py", "Python")], "doc_id long, text string, repository_name string, file_path string, kind string")
    found = code.symbols(df, F.col("kind"))
    rows = {(r.doc_id, r.kind, r.name) for r in found.collect()}
    assert {(1, "class", "A"), (1, "method", "m"), (1, "route", "POST /login"), (1, "import", "fastapi"), (2, "import", "mod"), (2, "import", "r"), (2, "class", "K"), (2, "function", "f"), (2, "function", "g"), (2, "route", "GET /items"), (3, "error", "SyntaxError")} <= rows
    es, rs = code.code_graph(df, found, calls=True)
    ids = {r.canonical_id for r in es.collect()}
    assert {"lib:fastapi", "lib:psycopg2", "repo:r:file:a/b.py:class:A:method:m", "repo:r:api:POST_login"} <= ids and "lib:os" not in ids
    edges = {(r.source, r.relationship_type, r.target) for r in rs.collect()}
    assert ("repo:r:api:POST_login", "IMPLEMENTED_BY", "repo:r:file:a/b.py:func:login") in edges and ("repo:r:file:a/b.py:func:login", "CALLS", "repo:r:file:a/b.py:func:helper") in edges


def test_repository_scan(spark, tmp_path):
    for p, t in {"api/app.py": "x = 1\n", "requirements.txt": "a\nb\n", "Dockerfile": "FROM x", ".git/HEAD": "abc123", "node_modules/z.js": "1", "tests/test_a.py": "", ".github/w.yml": "a: 1"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.relative_path: (r.language, r.line_count, r.is_test_file) for r in readers.repository(spark, str(tmp_path)).collect()}
    assert got == {"api/app.py": ("Python", 1, False), "requirements.txt": ("Requirements", 2, False), "Dockerfile": ("Dockerfile", 1, False), "tests/test_a.py": ("Python", 0, True), ".github/w.yml": ("YAML", 1, False)}
    assert readers.commit_of(str(tmp_path)) == "abc123" and readers.commit_of(str(tmp_path / "api")) == "local-head-00000000"


def test_export(spark):
    vs = spark.createDataFrame([("a<1", "A & b", "File", None, "", "r", "main", "c", "p", 1, 2, "M", 1.0)], "id string, name string, label string, description string, aliases string, repository_name string, branch string, commit_sha string, file_path string, start_line int, end_line int, extraction_method string, confidence double")
    es = spark.createDataFrame([("a<1", "a<1", "USES", None, 1.0, "r", "c", "p", 1)], "src string, dst string, label string, description string, weight double, repository_name string, commit_sha string, file_path string, start_line int")
    from xml.etree import ElementTree

    ElementTree.fromstring(export.graphml(vs, es).encode())
    with zipfile.ZipFile(io.BytesIO(export.zip_bytes(vs, es))) as z:
        assert sorted(z.namelist()) == ["README.txt", "edges.csv", "graph.jsonl", "vertices.csv"] and b"A & b" in z.read("vertices.csv")


def test_registry():
    q, o = registry.queries(), registry.oracle_sql()
    assert len(q) > 80 and set(o) <= set(q) and {"p3_found", "bm25_topk"} <= set(q)


def test_lakehouse_again_and_again(spark, tmp_path):
    for n, t in {"a.txt": "Apache AGE is an extension for PostgreSQL.", "b.txt": "PostgreSQL uses Docker."}.items():
        (tmp_path / n).write_text(t)
    lake = Lakehouse(spark, str(tmp_path / "lake"))
    assert [r.document_name for r in lake.ingest(str(tmp_path / "a.txt")).collect()] == ["a.txt"]
    lake.process()
    assert [r.document_name for r in lake.ingest(str(tmp_path / "b.txt")).collect()] == ["b.txt"]
    assert lake.ingest(str(tmp_path / "b.txt")).count() == 0
    lake.process()
    sizes = {t: lake.read(t).count() for t in ("entities", "relationships", "vertices", "edges", "extracted_pages", "chunks")}
    weights = sorted(r.weight for r in lake.read("edges").collect())
    lake.process(reprocess=True)
    assert {t: lake.read(t).count() for t in sizes} == sizes and sorted(r.weight for r in lake.read("edges").collect()) == weights
    assert lake.read("graph_sync").count() == 3
    a, b = (lake.documents().where(F.col("document_name") == n).first().document_id for n in ("a.txt", "b.txt"))
    assert lake.document(a)["extracted_pages"].count() == 1 and lake.document(a)["vertices"].count() >= 2 and lake.path_of(a).endswith("a.txt") and lake.path_of("none") is None
    lake.delete([a])
    assert "Apache AGE" not in {r.id for r in lake.read("vertices").collect()} and "PostgreSQL" in {r.id for r in lake.read("vertices").collect()}
    lake.delete([b])
    assert lake.read("vertices").count() == lake.read("edges").count() == lake.read("entities").count() == 0
    lake.ingest_contents(spark.createDataFrame([("x.md", b"# Docker"), ("y.md", b"# Docker"), ("z.md", None)], "document_name string, content binary"))
    lake.process()
    assert [(r.document_name, r.status) for r in lake.documents().collect()] == [("x.md", "COMPLETED")]


def test_repository_pipeline(spark, tmp_path):
    from strataloom.operators import graph
    from strataloom.plans import repository

    for p, t in {
        "api/app.py": "import fastapi\nfrom fastapi import FastAPI\n\n\nclass Store(Base):\n    @app.get('/items')\n    def items(self):\n        return helper()\n\n\ndef helper():\n    return 1\n",
        "requirements.txt": "fastapi>=1\nPyYAML\n", "docker-compose.yml": "services:\n  db:\n    image: postgres:16\n  web:\n    image: x\n    depends_on: [db]\n", "README.md": "# Title\n\nBuilt with Docker and a knowledge graph.\n", "bad-compose.yml": "services: [\n",
    }.items():
        (tmp_path / "proj" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "proj" / p).write_text(t)
    none = graph.vertices(spark.createDataFrame([], "canonical_id string, name string, entity_type string, description string, properties map<string,string>, provenance struct<repository_url:string,repository_name:string,branch:string,commit_sha:string,file_path:string,start_line:int,end_line:int,source_snippet:string,extraction_method:string>, aliases array<string>, confidence double, extracted_at timestamp, record_id long"))
    no_edges = spark.createDataFrame([], "src string, label string, dst string, weight double, description string, repository_name string, commit_sha string, file_path string, start_line int, end_line int, extraction_method string")
    told = []
    summary, vs, es = repository.analyze(spark, str(tmp_path / "proj"), none, no_edges, progress=lambda n, step: told.append((n, step)))
    assert told == list(enumerate(repository.STEPS, 1)) and summary["files_scanned"] == 5 and summary["languages"]["Python"] == 1 and summary["vertices_existing"] == 0
    edges = {(r.src, r.label, r.dst) for r in es.collect()}
    f = "repo:proj:file:api/app.py"
    assert {("repo:proj", "CONTAINS", "repo:proj:dir:api"), ("repo:proj:dir:api", "CONTAINS", f), (f, "DEFINES", f + ":class:Store"), (f + ":class:Store", "CONTAINS", f + ":class:Store:method:items"), ("repo:proj:api:GET_items", "IMPLEMENTED_BY", f + ":class:Store:method:items"), (f + ":class:Store:method:items", "CALLS", f + ":func:helper")} <= edges
    assert {("repo:proj:file:requirements.txt", "DEPENDS_ON", "lib:fastapi"), ("repo:proj:service:web", "DEPENDS_ON", "repo:proj:service:db"), ("repo:proj:service:db", "CONNECTS_TO", "tech:PostgreSQL"), ("repo:proj:file:README.md", "DESCRIBES", "concept:Knowledge Graph")} <= edges
    again, vs2, es2 = repository.analyze(spark, str(tmp_path / "proj"), vs, es)
    assert again["vertices_created"] == again["edges_created"] == 0 and vs2.count() == vs.count() and es2.count() == es.count()


def test_compose_services():
    rows = code.compose_services("services:\n  db:\n    image: redis:7\n    environment: ['A=b=c', 'BARE']\n    ports: [1, '2:3']\n  odd: 5\n  age-x: {depends_on: {db: {}}}\n")
    assert rows == [("db", "redis:7", ["1", "2:3"], {"A": "b=c"}, [], "Redis", 2, True), ("age-x", None, [], {}, ["db"], "Apache AGE", 7, True)]
    assert code.compose_services("services:\n\tweb:\n  cache:\n") == [("web", None, [], {}, [], None, 2, False), ("cache", None, [], {}, [], None, 3, False)]
    assert code.compose_services("") == []


def test_shared_folder_needs_one_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from strataloom.operators import lineage

    far = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {}, master="spark://head:7077"), conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(ValueError):
        lineage.shared_folder(far)
    t = lineage.cut(spark.range(3), "t")
    assert t.count() == 3
    lineage.sweep(spark)
    import os

    assert not os.path.exists(lineage.application_folder(spark).removeprefix("file://"))


def test_clone_of_a_local_repository(tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=a", "-c", "user.email=a@example.invalid", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "main")
    commits = []
    for n in "ab":
        (tmp_path / "r" / n).write_text(n)
        git("add", n)
        git("commit", "-q", "-m", n)
        commits.append(git("rev-parse", "HEAD"))
    git("pack-refs", "--all")
    assert readers.commit_of(str(tmp_path / "r")) == commits[1]
    with readers.cloned(str(tmp_path / "r"), branch="nowhere") as (path, sha):  # tried again without the name
        assert sha == commits[1] and path != str(tmp_path / "r")
    import os

    assert not os.path.exists(path)
    with readers.cloned(str(tmp_path / "r"), commit=commits[0]) as (path, sha):
        assert sha == commits[0] and not os.path.exists(f"{path}/b")
    with readers.cloned(str(tmp_path / "r")) as (path, sha):
        assert path == str(tmp_path / "r")
    with pytest.raises(readers.CloneError), readers.cloned(f"file://{tmp_path}/none"):
        pass


def test_provider_and_fallback(spark):
    df = spark.createDataFrame([("d", 1, f"d_p1_c{i}", i, t) for i, t in enumerate(["Docker here", "more", "Redis"])] + [("f", 1, "f_p1_c0", 0, "Docker, boom")], "document_id string, page_number int, chunk_id string, chunk_index int, text string")

    def provider(t):
        if "boom" in t:
            raise RuntimeError(t)
        return [{"name": t.split()[0], "type": "Thing"}]

    got = {(r.document_id, r.cname, r.type, r.method) for r in extraction.routed(df, provider, most=2).collect()}
    assert got == {("d", "Docker", "Thing", "MODEL"), ("d", "More", "Thing", "MODEL"), ("f", "Docker", "Technology", "HEURISTIC")}
    assert {r.method for r in extraction.routed(df).collect()} == {"HEURISTIC"}
