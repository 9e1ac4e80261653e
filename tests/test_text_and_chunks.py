"""Text functions and chunking: facts that are known, and plain versions of the folds."""

import random
import re

from pyspark.sql import functions as F

from strataloom.functions import identity, text
from strataloom.operators import chunking
from strataloom.sources import formats


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(c(F.col("x")).alias("y")).first().y


def plain_chunks(t, size=800, overlap=150):
    out, cur, n = [], [], 0
    for s in [x for x in re.split(r"(?<=[.?!;:\n])\s+", t) if x]:
        if n + len(s) > size and cur:
            out.append(" ".join(cur).strip())
            keep, k = [], 0
            for y in reversed(cur):
                if k + len(y) >= overlap:
                    break
                keep.insert(0, y)
                k += len(y)
            cur, n = keep + [s], k + len(s)
        else:
            cur.append(s)
            n += len(s)
    return [x for x in [*out, " ".join(cur).strip()] if x]


def plain_pages(t, size=3000):
    out, cur = [], ""
    for line in t.split("\n")[:-1]:
        line += "\n"
        if len(cur) + len(line) > size and cur:
            out.append(cur)
            cur = line
        else:
            cur += line
    rest = t.split("\n")[-1]
    if rest and len(cur) + len(rest) > size and cur:
        out.append(cur)
        cur = rest
    else:
        cur += rest
    return [x.strip() for x in [*out, cur] if x.strip()]


def test_folds_against_plain_versions(spark):
    rng = random.Random(3)
    texts = ["", " ", "x" * 2000, *("".join(rng.choice(["word ", "Sentence here. ", "so? ", "\n", "a;b: c ", "é" * 9 + " "]) for _ in range(rng.randint(1, 700))) for _ in range(25))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", chunking.chunk_texts("t").alias("c"), chunking.page_texts("t").alias("p")).collect():
        assert r.c == plain_chunks(r.t) and r.p == plain_pages(r.t)


def test_chunk_table(spark):
    df = spark.createDataFrame([("d", "n", 1, "short"), ("d", "n", 2, None), ("d", "n", 3, "A sentence. " * 150), ("e", "n", 1, "  ")], "document_id string, document_name string, page_number int, text string")
    rows = chunking.chunks(df).orderBy("chunk_index").collect()
    assert rows[0].chunk_id == "d_p1_c0" and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[1].chunk_id == "d_p3_c0"
    assert chunking.chunks(df.limit(0)).count() == 0


def test_known_facts(spark):
    assert one(spark, text.clean_text, "Hello\x00   World!  \n\n\n\n  This is a test.  ") == "Hello World!\n\nThis is a test."
    assert one(spark, text.clean_text, None) == ""
    assert one(spark, text.tokenize, "Data. is_in a-b (X) z") == ["data.", "is_in", "a-b"]
    assert one(spark, text.canonical_name, " 'postgres' ") == "PostgreSQL" and one(spark, text.canonical_name, "o'reilly data-base") == "O'Reilly Data-Base"
    assert one(spark, text.relationship_type, " depends on ") == "DEPENDS_ON" and one(spark, text.relationship_type, "!") == "RELATED_TO"
    assert one(spark, text.label, "9 my-label!") == "9_my_label" and one(spark, text.label, "!!") == "Concept"
    assert one(spark, text.estimate_tokens, "") == 0 and one(spark, text.estimate_tokens, "abc") == 1
    assert one(spark, text.intent, "How does login with a JWT token work?") == "authentication" and one(spark, text.intent, "zzz") == "general"
    assert one(spark, text.question_entities, 'Does "Apache AGE" use ContextEngine and the JWT?') == ["Apache AGE", "ContextEngine", "AGE", "JWT"]
    assert one(spark, text.question_targets, "see app/main.py and get_data() or age_client") == ["app/main.py", "get_data", "age_client"]
    assert one(spark, lambda c: text.expand_terms(F.array(c)), "dependencies") == ["dependencies", "dependency"]
    assert one(spark, text.line_count, "a\nb\n") == 2 and one(spark, text.line_count, "a\nb") == 2 and one(spark, text.line_count, "") == 0


def test_identity(spark):
    assert one(spark, identity.url_repo, "https://forge.example/team/my-repo.git") == "my-repo" and one(spark, identity.url_owner, "https://forge.example/team/my-repo.git") == "team"
    assert one(spark, identity.tidy_path, ".\\a\\b//".replace("//", "/")) == "a/b"
    assert one(spark, lambda c: identity.api_id(F.lit("r"), F.lit("post"), c), "/users/{id}") == "repo:r:api:POST_users_{id}"
    assert one(spark, identity.document_id, "x").startswith("doc_")


def test_formats(spark):
    names = {"a.PDF": "pdf", "b.ndjson": "jsonl", "c.arrow": "feather", "d.yml": "yaml", "e.exe": None, "noext": None}
    for n, f in names.items():
        assert one(spark, formats.detect, n) == f
    assert one(spark, formats.sniff, bytearray(b"%PDF-1.7"), "binary") == "pdf" and one(spark, formats.sniff, bytearray(b"  <!DOCTYPE html>"), "binary") == "html"
    assert one(spark, formats.decoded, bytearray("é".encode()), "binary") == "é" and one(spark, formats.decoded, bytearray(b"\xe9"), "binary") == "é"
    assert one(spark, formats.html_text, "<title>t</title><script>x</script><p>a <b>b</b></p>") == "t a b"
    assert one(spark, formats.sql_statements, "CREATE TABLE a (b int);\nSELECT 1;\n") == 2
    lang = {"src/a.tsx": ("TypeScript", "SOURCE_CODE", False), "Dockerfile.dev": ("Dockerfile", "DOCKER", False), "tests/test_x.py": ("Python", "SOURCE_CODE", True), "requirements-dev.txt": ("Requirements", "CONFIG", False), "q": ("Unknown", "OTHER", False)}
    for p, want in lang.items():
        df = spark.createDataFrame([(p,)], "p string")
        assert tuple(df.select(*formats.classify("p")).first()) == want
    t = spark.createDataFrame([("1", "1.5", "yes", "", "x"), ("0", "2", "no", None, "1")], "i string, f string, b string, e string, s string")
    assert {r.column: r.type for r in formats.infer_types(t).collect()} == {"i": "Integer", "f": "Float", "b": "Boolean", "e": "String", "s": "String"}
