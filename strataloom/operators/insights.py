"""What a repository's graph tells: files by importance, libraries, classes, APIs, dependencies, flows, tree, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text
from . import graph


def usage(vs: DataFrame, es: DataFrame, labels: tuple[str, ...] = ("Technology", "Library")) -> DataFrame:
    """(category, name, usage): edges that lead to any vertex of a name, summed over the vertices that share it."""
    into = es.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    counted = vs.select("id", "label", "name").join(into, "id", "left")
    named = counted.groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usage"), F.collect_set(F.when(F.col("label").isin(*labels), F.col("label"))).alias("labels"))
    return named.where("name <> ''").select(F.explode("labels").alias("category"), "name", "usage")


def important_files(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(id, repository_name, file_path, name, in_degree, out_degree, definitions, imports, line_count, importance).

    importance = 3 in + 2 definitions + out + 0.01 lines. Classes, functions and libraries are counted per
    (repository, path) before they are joined."""
    files = vs.where(F.col("label") == "File").select("id", "repository_name", text.text_or(F.col("file_path"), F.col("name")).alias("file_path"), "name", F.coalesce(F.try_element_at("properties", F.lit("line_count")).try_cast("int"), F.col("end_line") - F.coalesce("start_line", F.lit(1)) + 1, F.lit(0)).alias("line_count"))
    defs = vs.where(F.col("label").isin("Class", "Function", "Library") & (F.col("file_path") != "") & (F.col("name") != ""))
    defs = defs.groupBy("repository_name", "file_path").agg(F.count_if(F.col("label") != "Library").alias("definitions"), F.count_if(F.col("label") == "Library").alias("imports"))
    deg = graph.degrees(files, es)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = files.join(deg, "id").join(defs, ["repository_name", "file_path"], "left").select("id", "repository_name", "file_path", "name", "in_degree", "out_degree", zero("definitions"), zero("imports"), "line_count")
    score = 3.0 * F.col("in_degree") + 2.0 * F.col("definitions") + 1.0 * F.col("out_degree") + 0.01 * F.col("line_count")
    return out.withColumn("importance", F.round(score, 2))


def name_lists(vs: DataFrame, labels: tuple[str, ...] = ("Service", "Concept")) -> DataFrame:
    """(repository_name, label, names): the names of some kinds of vertex, once each, sorted."""
    once = vs.where(F.col("label").isin(*labels) & (F.col("name") != "")).select("repository_name", "label", "name").distinct()
    return once.groupBy("repository_name", "label").agg(F.array_sort(F.collect_list("name")).alias("names"))


def definitions_by_file(vs: DataFrame) -> DataFrame:
    """(repository_name, file_path, classes, functions): sorted names."""
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("label") == kind, F.col("name"))))
    return vs.where(F.col("label").isin("Class", "Function") & (F.col("file_path") != "")).groupBy("repository_name", "file_path").agg(names("Class").alias("classes"), names("Function").alias("functions"))


def class_methods(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(class_id, class_name, file_path, n_members, members): members by DEFINES or CONTAINS edges."""
    inner = es.where(F.col("label").isin("DEFINES", "CONTAINS")).select(F.col("src").alias("class_id"), F.col("dst").alias("id")).distinct()
    members = inner.join(vs.where(F.col("label").isin("Function", "Method")).select("id", "name"), "id").groupBy("class_id").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("name")).alias("members"))
    classes = vs.where(F.col("label") == "Class").select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), "file_path")
    return classes.join(members, "class_id", "left").select("class_id", "class_name", "file_path", F.coalesce("n_members", F.lit(0)).alias("n_members"), F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def functions(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(id, name, file_path, parent_class, is_async): the class that defines it, the smallest name of several."""
    fs = vs.where(F.col("label").isin("Function", "Method"))
    up = es.where(F.col("label").isin("DEFINES", "CONTAINS")).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    parents = up.join(vs.where(F.col("label") == "Class").select(F.col("id").alias("parent"), F.col("name").alias("class_name")), "parent").groupBy("id").agg(F.min("class_name").alias("parent_class"))
    return fs.join(parents, "id", "left").select("id", "name", "file_path", "parent_class", F.coalesce(F.lower(F.try_element_at("properties", F.lit("is_async"))) == "true", F.lit(False)).alias("is_async"))


def apis(vs: DataFrame) -> DataFrame:
    """(id, http_method, endpoint): the method is the name's first word where that is one, else GET."""
    m = F.upper(F.regexp_extract("name", r"^([A-Za-z]+) +/", 1))
    return vs.where(F.col("label") == "API").select("id", F.when(m == "", "GET").otherwise(m).alias("http_method"), F.regexp_replace("name", r"^[A-Za-z]+ +(?=/)", "").alias("endpoint"))


def dependencies(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(src_name, label, dst_name, file_path) of IMPORTS, DEPENDS_ON and USES."""
    return graph.with_ends(es.where(F.col("label").isin("IMPORTS", "DEPENDS_ON", "USES")), vs).select("src", "src_name", "label", "dst", "dst_name", "file_path")


def code_flows(vs: DataFrame, es: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` links of CALLS, USES, IMPLEMENTED_BY and DEFINES in the order of their ids, numbered.

    The limit comes before the numbering, so the window holds that many rows and no more."""
    kept = es.where(F.col("label").isin("CALLS", "USES", "IMPLEMENTED_BY", "DEFINES")).orderBy("src", "label", "dst").limit(most)
    named = graph.with_ends(kept, vs)
    n = F.row_number().over(Window.orderBy("src", "label", "dst"))
    return named.select(n.alias("step_number"), "src_name", "src_label", "dst_name", "dst_label", F.col("label").alias("relationship_type"), F.concat("src_label", F.lit(" '"), "src_name", F.lit("' "), F.lower("label"), F.lit(" "), "dst_label", F.lit(" '"), "dst_name", F.lit("'")).alias("description"))


def repositories(vs: DataFrame) -> DataFrame:
    """(name, url, legacy): repositories in order, leftovers of temporary clones last."""
    r = vs.where(F.col("label") == "Repository").select("name", F.coalesce("repository_url", F.lit("")).alias("url"))
    return r.withColumn("legacy", identity.legacy_temporary(F.col("name"), F.col("url"))).orderBy("legacy", F.lower("name"), "name", "url")


def directory_closure(paths: DataFrame, path_col: str = "file_path", repo_col: str = "repository_name") -> DataFrame:
    """(repository_name, parent, child): one CONTAINS link per path prefix, once each; '' is the repository itself."""
    parts = F.split(identity.tidy_path(F.col(path_col)), "/")
    one = paths.where(F.length(path_col) > 0).select(F.col(repo_col).alias("repository_name"), parts.alias("p"))
    steps = one.select("repository_name", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    at = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    return steps.select("repository_name", F.when(F.col("k") == 1, "").otherwise(at(F.col("k") - 1)).alias("parent"), at(F.col("k")).alias("child")).distinct()


def render_tree(links: DataFrame, repository: str, most: int = 500) -> str:
    """A repository's tree as text, of at most ``most`` entries (a report for people)."""
    rows = sorted(r.child for r in links.where(F.col("repository_name") == repository).select("child").orderBy("child").limit(most).collect())
    out = [repository + "/"]
    for path in rows:
        depth = path.count("/")
        out.append("    " * depth + "└── " + path.rsplit("/", 1)[-1])
    return "\n".join(out)


def summaries(vs: DataFrame, es: DataFrame, repository: str) -> dict[str, str]:
    """Three short texts from aggregates: what it is built of, its main files, its interface."""
    v, e = graph.repository_graph(vs, es, repository)
    counts = {r.label: r["count"] for r in v.groupBy("label").count().collect()}  # as many rows as labels
    top = important_files(v, e).orderBy(F.desc("importance"), "file_path").limit(5).collect()
    libs = [r.name for r in usage(v, e).orderBy(F.desc("usage"), "name").limit(8).collect()]
    return {
        "technical": f"{repository} has {counts.get('File', 0)} files, {counts.get('Class', 0)} classes and {counts.get('Function', 0)} functions; it uses {', '.join(libs) or 'no known library'}.",
        "files": "Main files: " + (", ".join(f"{r.file_path} ({r.importance})" for r in top) or "none") + ".",
        "interface": f"{counts.get('API', 0)} API routes and {counts.get('Service', 0)} services.",
    }
