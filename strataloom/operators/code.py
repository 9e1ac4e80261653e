"""Parsed source: imports, classes, functions, calls and routes of Python and JavaScript, configuration and Markdown.

Only the languages' own parsers run in Python, batch by batch; configuration and Markdown are column expressions."""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, refdata, text

SYMBOL = "doc_id long, kind string, name string, parent string, start_line int, end_line int, detail string"
_NAMES = ["doc_id", "kind", "name", "parent", "start_line", "end_line", "detail"]
_ROUTE_VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "api_route")


def _spelled(node: ast.expr) -> str:
    """ast.unparse, without its cost for names joined by dots."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else ast.unparse(node)


def python_symbols(source: str) -> list[tuple]:
    """(kind, name, parent, start, end, detail): import, class, method, function, call, route, docstring, variable (of the
    module), or one error row."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", type(e).__name__, None, getattr(e, "lineno", None), None, str(e)[:200])]
    out: list[tuple] = []

    def routes(node, owner) -> None:
        for d in node.decorator_list:
            spelled = ast.unparse(d)
            for verb in _ROUTE_VERBS:
                if f".{verb}(" in spelled or spelled.startswith(f"{verb}("):
                    m = re.search(r"['\"]([^'\"]+)['\"]", spelled)
                    out.append(("route", f"{verb.upper()} {m[1] if m else '/'}", f"{owner}.{node.name}" if owner else node.name, node.lineno, node.end_lineno, None))

    def docstring(node, owner) -> None:
        if said := ast.get_docstring(node):
            out.append(("docstring", getattr(node, "name", "module"), owner, node.body[0].lineno, node.body[0].end_lineno, said[:200]))

    def function(node, owner) -> None:
        docstring(node, owner)
        args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
        flags = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        out.append(("method" if owner else "function", node.name, owner, node.lineno, node.end_lineno, f"{flags}({', '.join(args)})"))
        routes(node, owner)
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                name = _spelled(x.func) if isinstance(x.func, (ast.Name, ast.Attribute)) else None
                if name:
                    out.append(("call", name[:200], f"{owner}.{node.name}" if owner else node.name, x.lineno, x.end_lineno, None))

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, None, node.lineno, node.end_lineno, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(("import", "." * node.level + (node.module or ""), None, node.lineno, node.end_lineno, ", ".join(a.name for a in node.names)))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, None, node.lineno, node.end_lineno, ", ".join(ast.unparse(b) for b in node.bases)))
            docstring(node, None)
            for item in node.body:
                if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(item, node.name)
    docstring(tree, None)
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out += [("variable", t.id, None, node.lineno, node.end_lineno, None) for t in targets if isinstance(t, ast.Name)]
    return out


_JS = {
    "import": re.compile(r"^\s*import\s+(?:(?P<a>[\w*$]+)\s*,\s*)?(?:\{\s*(?P<b>[^}]+)\s*\}|(?P<c>[\w*$]+(?:\s+as\s+\w+)?))?\s*from\s*['\"](?P<name>[^'\"]+)['\"]", re.M),
    "require": re.compile(r"^\s*(?:const|let|var)\s+(?:\{\s*(?P<b>[^}]+)\s*\}|(?P<a>[\w$]+))\s*=\s*require\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)", re.M),
    "class": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:\s*<[^>{]*>)?(?:\s+extends\s+(?P<a>[\w$.]+))?", re.M),
    "function": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?P<a>async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*[(<]", re.M),
    "arrow": re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<a>async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", re.M),
    "route": re.compile(r"\b(?:app|router|server)\.(?P<a>get|post|put|delete|patch|all)\(\s*['\"`](?P<name>[^'\"`]+)['\"`]"),
}
#: A class or function is taken to end so many lines after its head, or at the file's end.
_JS_SPAN = {"class": 40, "function": 15, "arrow": 15}


def javascript_symbols(source: str) -> list[tuple]:
    out, last = [], source.count("\n") + 1
    for kind, pattern in _JS.items():
        for m in pattern.finditer(source):
            start = source.count("\n", 0, m.start("name")) + 1
            g = m.groupdict()
            if kind in ("import", "require"):
                symbols = [x.strip() for x in (g.get("a"), g.get("c")) if x] + [re.split(r" as |:", x.strip())[0].strip() for x in (g.get("b") or "").split(",") if x.strip()]
                out.append(("import", g["name"], None, start, source.count("\n", 0, m.end()) + 1, ", ".join(symbols)))
            elif kind == "route":
                out.append(("route", f"{g['a'].upper()} {g['name']}", None, start, start, None))
            else:
                out.append(("class" if kind == "class" else "function", g["name"], None, start, min(last, start + _JS_SPAN[kind]), (g.get("a") or "").strip() or None))
    return out


def symbols(docs: DataFrame, language: Column) -> DataFrame:
    """Symbols of Python, JavaScript and TypeScript documents (doc_id, text). Null texts have none."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in _NAMES]
            for i, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                for row in python_symbols(source) if lang == "Python" else javascript_symbols(source):
                    for column, v in zip(out, (i, *row)):
                        column.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=_NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language.alias("language"), "text").where(F.col("language").isin("Python", "JavaScript", "TypeScript") & F.col("text").isNotNull())
    return rows.mapInArrow(run, SYMBOL)


def placed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols with repo, path and file (an id) of their documents (doc_id, repository_name, file_path)."""
    where = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("repository_name").alias("repo"), identity.tidy_path("file_path").alias("path"))
    return found.join(where, "doc_id").withColumn("file", identity.part_id(F.col("repo"), "file", F.col("path")))


def code_graph(docs: DataFrame, found: DataFrame, calls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities (canonical_id, name, entity_type) and relationships of symbols of documents (doc_id, repository_name,
    file_path): files, modules, classes, functions, methods, libraries and APIs. Imports of the standard library make
    no library. calls: CALLS and EXTENDS too, to functions of the same repository."""
    return graph_of(placed(docs, found), calls)


def graph_of(s: DataFrame, calls: bool = False) -> tuple[DataFrame, DataFrame]:
    """code_graph() of symbols that placed() gave; each kind of row reads them again, so they are best written first."""
    kind, name, parent = F.col("kind"), F.col("name"), F.col("parent")
    me = (
        F.when(kind == "class", F.concat("file", F.lit(":class:"), "name"))
        .when(kind == "method", F.concat("file", F.lit(":class:"), "parent", F.lit(":method:"), "name"))
        .when(kind == "function", F.concat("file", F.lit(":func:"), "name"))
    )
    defined = s.where(kind.isin("class", "method", "function")).withColumn("id", me)
    top = F.regexp_extract("name", r"^(@[^/]+/[^/]+|[^./][^./]*)", 1)
    libs = s.where((kind == "import") & ~name.startswith(".")).withColumn("lib", text.canonical_library(top)).where(~F.col("lib").isin(*refdata.STDLIB) & (F.col("lib") != ""))
    routes = s.where(kind == "route").withColumn("method", F.split("name", " ")[0]).withColumn("at", F.split("name", " ")[1]).withColumn("id", identity.api_id(F.col("repo"), F.col("method"), F.col("at")))
    entity = lambda df, i, n, k: df.select(i.alias("canonical_id"), n.alias("name"), F.lit(k).alias("entity_type") if isinstance(k, str) else k.alias("entity_type"))
    label = F.when(kind == "class", "Class").when(kind == "method", "Method").otherwise("Function")
    es = entity(s, F.col("file"), F.element_at(F.split("path", "/"), -1), "File").unionByName(entity(defined, F.col("id"), name, label)).unionByName(entity(libs, identity.shared_id("lib", F.col("lib")), F.col("lib"), "Library")).unionByName(entity(routes, F.col("id"), name, "API"))
    # a route or call within a method names its class before a dot
    owner = F.when(parent.contains("."), F.concat("file", F.lit(":class:"), F.split("parent", r"\.")[0], F.lit(":method:"), F.split("parent", r"\.")[1])).otherwise(F.concat("file", F.lit(":func:"), "parent"))
    edge = lambda df, a, k, b: df.select(a.alias("source"), F.lit(k).alias("relationship_type"), b.alias("target"))
    rs = (
        edge(defined.where(kind != "method"), F.col("file"), "DEFINES", F.col("id"))
        .unionByName(edge(defined.where(kind == "method"), F.concat("file", F.lit(":class:"), "parent"), "CONTAINS", F.col("id")))
        .unionByName(edge(libs, F.col("file"), "IMPORTS", identity.shared_id("lib", F.col("lib"))))
        .unionByName(edge(routes.where(parent.isNotNull()), F.col("id"), "IMPLEMENTED_BY", owner))
    )
    if calls:
        targets = defined.where(kind == "function").select("repo", F.col("name").alias("called"), "id").groupBy("repo", "called").agg(F.min("id").alias("to"))
        made = s.where(kind == "call").withColumn("called", F.element_at(F.split("name", r"\."), -1)).join(targets, ["repo", "called"])
        rs = rs.unionByName(edge(made, owner, "CALLS", F.col("to")))
        bases = defined.where((kind == "class") & (F.length("detail") > 0)).select("repo", "id", F.explode(F.split("detail", ", ")).alias("base"))
        classes = defined.where(kind == "class").groupBy("repo", F.col("name").alias("base")).agg(F.min("id").alias("to"))
        rs = rs.unionByName(edge(bases.join(classes, ["repo", "base"]), F.col("id"), "EXTENDS", F.col("to")))
    return es.distinct(), rs.distinct()


# -- configuration and Markdown, as column expressions -----------------------------------------------------------------


def requirements(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, name, canonical_name, version_spec) of requirement lists."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "raw")).select("doc_id", (F.col("i") + 1).alias("line_number"), text.strip("raw").alias("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(#|-r|-e)"))
    name = F.regexp_extract("line", r"^([a-zA-Z0-9_\-.]+)(.*)$", 1)
    canon = F.regexp_replace(F.replace(F.lower(name), F.lit("_"), F.lit("-")), "-binary$", "")
    return kept.where(name != "").select("doc_id", "line_number", name.alias("name"), canon.alias("canonical_name"), F.nullif(F.trim(F.regexp_extract("line", r"^([a-zA-Z0-9_\-.]+)(.*)$", 2)), F.lit("")).alias("version_spec"))


def package_json(docs: DataFrame) -> DataFrame:
    """(doc_id, name, version_spec, is_dev) of package.json files; files that aren't JSON objects have none."""
    j = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    one = docs.where(F.col("text").isNotNull()).select("doc_id", j.alias("j"))
    part = lambda c, dev: one.select("doc_id", F.explode(f"j.{c}").alias("name", "version_spec")).withColumn("is_dev", F.lit(dev))
    return part("dependencies", False).unionByName(part("devDependencies", True))


def dockerfile(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, instruction, value) of Dockerfiles."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("i", "raw"))
    p = r"^\s*(?i:(FROM|RUN|CMD|COPY|ADD|ENV|ARG|EXPOSE|WORKDIR|ENTRYPOINT|USER|VOLUME|LABEL|HEALTHCHECK))\s+(.*?)\s*$"
    return lines.select("doc_id", (F.col("i") + 1).alias("line_number"), F.upper(F.regexp_extract("raw", p, 1)).alias("instruction"), F.regexp_extract("raw", p, 2).alias("value")).where("instruction <> ''")


_SERVICE = "doc_id long, service_name string, image string, ports array<string>, environment map<string,string>, depends_on array<string>, inferred_technology string, line_number int, parsed boolean"
_BLOCK_NAME = re.compile(r"^\s*([a-zA-Z0-9_\-]+):\s*$", re.M)
# What an image, or a service's name, tells of the technology; the first that fits.
SERVICE_TECHNOLOGIES = {"age": ("Apache AGE", True), "postgres": ("PostgreSQL", True), "redis": ("Redis", False), "mongo": ("MongoDB", False)}


def compose_services(source: str) -> list[tuple]:
    """(service, image, ports, environment, depends_on, technology, line, parsed) of a compose file; of one that is no YAML
    the names of its blocks alone."""
    try:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        data, tree = yaml.load(source, Loader=loader), yaml.compose(source, Loader=loader)
    except Exception:  # no parser, or no YAML
        data = tree = None
    if not isinstance(data, dict) or not isinstance(data.get("services"), dict):
        named = [(m[1], source.count("\n", 0, m.start(1)) + 1) for m in _BLOCK_NAME.finditer(source)]
        return [(n, None, [], {}, [], None, line, False) for n, line in named if n not in ("services", "version", "volumes", "networks")]
    node = next(v for k, v in tree.value if k.value == "services")
    lines = {k.value: k.start_mark.line + 1 for k, _ in node.value}
    out = []
    for name, c in data["services"].items():
        if not isinstance(c, dict):
            continue
        image, env, after = str(c.get("image") or ""), c.get("environment") or {}, c.get("depends_on") or []
        if isinstance(env, list):
            env = dict(str(x).split("=", 1) for x in env if "=" in str(x))
        env = {str(k): None if v is None else str(v) for k, v in env.items()} if isinstance(env, dict) else {}
        after = [str(x) for x in after] if isinstance(after, (list, dict)) else []
        kind = next((t for word, (t, by_name) in SERVICE_TECHNOLOGIES.items() if word in image.lower() or by_name and word in str(name).lower()), "Service")
        out.append((str(name), image or None, [str(x) for x in c.get("ports") or []], env, after, kind, lines.get(str(name), 1), True))
    return out


def compose(docs: DataFrame) -> DataFrame:
    """Services of compose files (doc_id, text). Null texts have none; parsed tells whether the file was YAML."""

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in compose_services(source)]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            columns[4] = [list(m.items()) for m in columns[4]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[x.split(" ")[0] for x in ("doc_id", "service_name", "image", "ports", "environment", "depends_on", "inferred_technology", "line_number", "parsed")])

    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SERVICE)


def markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, title, summary, sections, line_count): the first # heading, the first paragraph (400 characters), and all
    headings of one to four #."""
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), text.strip)
    heads = F.filter(lines, lambda x: x.rlike(r"^#{1,4}\s+.+$"))
    title = F.try_element_at(F.filter(lines, lambda x: x.startswith("# ")), F.lit(1))
    named = text.title_case(F.replace(F.regexp_extract("file_path", r"([^/\\]+?)(\.[^./\\]+)?$", 1), F.lit("_"), F.lit(" ")))
    zero = F.struct(F.array().cast("array<string>").alias("said"), F.lit(False).alias("over"))
    step = lambda a, x: (
        F.when(a["over"] | ((F.size(a["said"]) == 0) & x.rlike(r"^(#|!|\[|$)")), a)
        .when(x.rlike("^(#|$)"), F.struct(a["said"].alias("said"), F.lit(True).alias("over")))
        .otherwise(F.struct(F.concat(a["said"], F.array(x)).alias("said"), F.lit(False).alias("over")))
    )
    first = F.aggregate(lines, zero, step, lambda a: F.array_join(a["said"], " "))
    one = docs.where(F.col("text").isNotNull()).select("doc_id", F.coalesce(F.nullif(F.regexp_replace(title, r"^[# ]+|[# ]+$", ""), F.lit("")), named).alias("title"), first.alias("first"), F.transform(heads, lambda x: F.regexp_replace(x, r"^#{1,4}\s+", "")).alias("sections"), text.line_count("text").alias("line_count"))
    summary = F.when(F.col("first") == "", F.concat(F.lit("Documentation for "), "title")).otherwise(text.truncate("first", 400, dots=True))
    return one.select("doc_id", "title", summary.alias("summary"), "sections", "line_count")


def markdown_terms(docs: DataFrame, terms: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, term, mentions, first_line): known terms in Markdown, spelled as one. Each term is counted on its own."""
    terms = terms or refdata.MARKDOWN_TECHNOLOGIES
    t = F.col("t")
    counts = []
    for term, canon in terms.items():
        p = F.lit(rf"\b{re.escape(term)}\b")
        before = F.split(t, rf"\b{re.escape(term)}\b", 2)[0]
        held = lambda x, term=term: F.when(t.contains(term), x).otherwise(0)  # noqa: E731  # patterns only where the letters are
        counts.append(F.struct(F.lit(canon).alias("term"), held(F.size(F.regexp_extract_all(t, p, F.lit(0)))).alias("n"), held(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line")))
    some = F.filter(F.array(*counts), lambda x: x["n"] > 0)
    lower = docs.where(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("t"))
    one = lower.select("doc_id", F.explode(some).alias("x")).select("doc_id", "x.*")
    return one.groupBy("doc_id", "term").agg(F.sum("n").alias("mentions"), F.min("line").cast("int").alias("first_line"))
