"""Exports of a graph: rows, JSON lines, CSV pairs, GraphML, a ZIP of them, and the payload of a network view."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the CSV files, and keys of GraphML with their types.
VERTEX_COLUMNS = "id canonical_id label name entity_type file_path start_line end_line commit_sha extraction_method confidence description repository_name".split()
EDGE_COLUMNS = "id source_id source_canonical_id target_id target_canonical_id label relationship_type file_path start_line end_line commit_sha extraction_method weight description repository_name".split()
NODE_KEYS = {"canonical_id": "string", "name": "string", "label": "string", "entity_type": "string", "file_path": "string", "start_line": "int", "end_line": "int", "commit_sha": "string", "extraction_method": "string", "confidence": "double", "repository_name": "string"}
EDGE_KEYS = {"label": "string", "relationship_type": "string", "file_path": "string", "start_line": "int", "end_line": "int", "weight": "double", "repository_name": "string"}
# Colours of a network view, by label.
COLOURS = {
    "Repository": "#8b5cf6", "Directory": "#64748b", "File": "#3b82f6", "Module": "#06b6d4", "Class": "#10b981", "Function": "#f59e0b", "Method": "#fbbf24", "Library": "#ef4444", "Technology": "#ec4899", "Concept": "#a855f7", "API": "#14b8a6", "Service": "#f97316",
}


def _or(df: DataFrame, c: str, kind: str, default) -> Column:
    """A column with its default for nulls, or the default alone where there is no such column."""
    return F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in df.columns else F.lit(default).cast(kind)


def _place(df: DataFrame) -> dict[str, Column]:
    out = {c: _or(df, c, "string", "") for c in ("file_path", "commit_sha", "extraction_method", "description", "repository_name")}
    return out | {c: _or(df, c, "int", 1) for c in ("start_line", "end_line")}


def vertex_rows(vs: DataFrame) -> DataFrame:
    """VERTEX_COLUMNS of every vertex; places default to line 1, confidence to 1."""
    more = _place(vs) | {"canonical_id": F.col("id"), "entity_type": F.col("label"), "confidence": _or(vs, "confidence", "double", 1.0)}
    return vs.select(*[more.get(c, F.col(c)).alias(c) for c in VERTEX_COLUMNS])


def edge_rows(es: DataFrame, vs: DataFrame | None = None) -> DataFrame:
    """EDGE_COLUMNS of every edge; with vertices the names of both ends too."""
    more = _place(es) | {
        "id": F.concat_ws("|", "src", "label", "dst"), "source_id": F.col("src"), "source_canonical_id": F.col("src"), "target_id": F.col("dst"), "target_canonical_id": F.col("dst"), "relationship_type": F.col("label"), "weight": _or(es, "weight", "double", 1.0),
    }
    if vs is None:
        return es.select(*[more.get(c, F.col(c)).alias(c) for c in EDGE_COLUMNS])
    end = lambda a, b: vs.select(F.col("id").alias(a), F.col("name").alias(b))
    return edge_rows(es).join(end("source_id", "src_name"), "source_id", "left").join(end("target_id", "dst_name"), "target_id", "left").select(*EDGE_COLUMNS, "src_name", "dst_name")


def json_rows(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(kind, json): one JSON object per vertex and edge, with its place nested as provenance."""
    nested = ["file_path", "start_line", "end_line", "commit_sha", "extraction_method"]

    def one(rows: DataFrame, kind: str) -> DataFrame:
        flat = [c for c in rows.columns if c not in nested]
        return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*flat, F.struct(*nested).alias("provenance"))).alias("json"))

    return one(vertex_rows(vs), "vertex").unionByName(one(edge_rows(es), "edge"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def graphml_fragments(vs: DataFrame, es: DataFrame) -> DataFrame:
    """(kind, xml): a node or edge element per row; a document is these between graphml_head() and GRAPHML_TAIL."""
    data = lambda mark, names: F.concat_ws("", *[F.concat(F.lit(f'<data key="{mark}_{n}">'), _xml(F.col(n).cast("string")), F.lit("</data>")) for n in names])
    node = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("d", NODE_KEYS), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('">'), data("e", EDGE_KEYS), F.lit("</edge>"))
    return vertex_rows(vs).select(F.lit("node").alias("kind"), node.alias("xml")).unionByName(edge_rows(es).select(F.lit("edge").alias("kind"), edge.alias("xml")))


GRAPHML_TAIL = "</graph></graphml>"


def graphml_head(name: str = "graph") -> str:
    keys = "".join(f'<key id="{m}_{k}" for="{of}" attr.name="{k}" attr.type="{t}"/>' for m, of, ks in (("d", "node", NODE_KEYS), ("e", "edge", EDGE_KEYS)) for k, t in ks.items())
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph id="{name}" edgedefault="directed">'


def graphml_lines(vs: DataFrame, es: DataFrame, name: str = "graph"):
    """The lines of a GraphML document, nodes first, as they come: no more than a partition is held at once."""
    yield graphml_head(name)
    for kind in ("node", "edge"):
        yield from (r.xml for r in graphml_fragments(vs, es).where(F.col("kind") == kind).select("xml").toLocalIterator())
    yield GRAPHML_TAIL


def graphml(vs: DataFrame, es: DataFrame) -> str:
    """A whole GraphML document, for graphs that one machine is to open."""
    return "\n".join(graphml_lines(vs, es))


def write_graphml(vs: DataFrame, es: DataFrame, path: str) -> None:
    """A local file of GraphML, written line by line; the elements alone are written by the executors with write.text."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in graphml_lines(vs, es))


def write_csv(vs: DataFrame, es: DataFrame, path: str) -> None:
    vertex_rows(vs).write.mode("overwrite").option("header", True).csv(f"{path}/vertices")
    edge_rows(es, vs).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_json(vs: DataFrame, es: DataFrame, path: str) -> None:
    json_rows(vs, es).write.mode("overwrite").partitionBy("kind").text(path)


def write_zip(vs: DataFrame, es: DataFrame, out) -> None:
    """JSON lines, two CSV files and a note in one archive, written to a file object row by row."""
    import csv

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("graph.jsonl", "w") as f:
            for r in json_rows(vs, es).toLocalIterator():
                f.write((r.json + "\n").encode())
        for name, df in (("vertices.csv", vertex_rows(vs)), ("edges.csv", edge_rows(es))):
            with z.open(name, "w") as f, io.TextIOWrapper(f, "utf-8", newline="") as t:
                w = csv.writer(t)
                w.writerow(df.columns)
                w.writerows(tuple(r) for r in df.toLocalIterator())
        z.writestr("README.txt", "vertices.csv and edges.csv hold the graph; graph.jsonl holds both with provenance.\n")


def zip_bytes(vs: DataFrame, es: DataFrame) -> bytes:
    """write_zip() in memory, for small graphs."""
    out = io.BytesIO()
    write_zip(vs, es, out)
    return out.getvalue()


def network_view(vs: DataFrame, es: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with colour and tooltip, and edges, as a view in the browser takes them."""
    from ..functions import refdata

    colour = F.coalesce(refdata.lookup(COLOURS, F.col("label")), F.lit("#94a3b8"))
    nodes = vs.select("id", F.col("name").alias("label"), F.col("label").alias("group"), colour.alias("color"), F.concat_ws("\n", F.concat("label", F.lit(": "), "name"), "description", "file_path").alias("title"))
    return nodes, es.select(F.col("src").alias("from"), F.col("dst").alias("to"), "label", F.coalesce("description", "label").alias("title"))
