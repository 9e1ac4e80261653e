"""The graph of many repositories in plans that a driver of little memory holds."""

from strataloom.functions import refdata
from strataloom.operators import code
from strataloom.plans import repository

FILES = [
    (1, "r", "u", "api/app.py", "import fastapi\n\n\nclass Store(Base):\n    def items(self):\n        return helper()\n\n\ndef helper():\n    return a.b.c(1)[0].d()\n", "x"),
    (2, "r", "u", "requirements.txt", "fastapi>=1\n", "x"),
    (3, "q", "v", "docker-compose.yml", "services:\n  db:\n    image: postgres:16\n", "y"),
    (4, "q", "v", "README.md", "# Title\n\nBuilt with DOCKER,\nand docker; storage of ages.\n", "y"),
    (5, "q", "v", "none.md", None, "y"),
]


def test_parts_of_a_graph_are_written_where_they_are_found(spark):
    files = spark.createDataFrame(FILES, "doc_id long, repository_name string, repository_url string, file_path string, text string, commit_sha string")
    es, rs = repository.extracted(files)
    for df in (es, rs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "regexp_extract_all" not in plan
    ids = {r.canonical_id for r in es.collect()}
    assert {"repo:r", "repo:r:dir:api", "repo:r:file:api/app.py:class:Store:method:items", "lib:fastapi", "repo:q:service:db", "tech:PostgreSQL", "tech:Docker", "repo:q:file:none.md"} <= ids and "tech:Apache AGE" not in ids
    links = {(r.source_canonical_id, r.relationship_type, r.target_canonical_id) for r in rs.collect()}
    assert {("repo:r:file:api/app.py:class:Store:method:items", "CALLS", "repo:r:file:api/app.py:func:helper"), ("repo:q:file:README.md", "USES", "tech:Docker"), ("repo:r:file:requirements.txt", "DEPENDS_ON", "lib:fastapi")} <= links


def test_terms_and_calls_are_told_as_before(spark):
    docs = spark.createDataFrame(FILES, "doc_id long, repository_name string, repository_url string, file_path string, text string, commit_sha string")
    rows = [(r.doc_id, r.term, r.mentions, r.first_line) for r in code.markdown_terms(docs.where("doc_id >= 4"), refdata.MARKDOWN_TECHNOLOGIES).collect()]
    assert rows == [(4, "Docker", 2, 3)]
    assert [x[1] for x in code.python_symbols(FILES[0][4]) if x[0] == "call"] == ["helper", "a.b.c(1)[0].d", "a.b.c"]
