"""A closed subset of openCypher over the vertex and edge tables, planned as scans, filters and equi-joins.

MATCH with labels, property maps, directed and undirected edges and comma patterns; WHERE with AND, OR, NOT, comparisons,
IN, =~, CONTAINS, STARTS WITH, ENDS WITH and IS [NOT] NULL; RETURN [DISTINCT] with aliases, id(), label(), properties and
count(); ORDER BY, SKIP, LIMIT. mutate() takes CREATE of vertices, MATCH with CREATE of an edge, and MATCH with SET, and gives
the graph after it, as upserts of operators.graph. Anything else raises CypherError.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph


class CypherError(ValueError):
    """The text isn't in the subset."""


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op><>|<=|>=|=~|->|<-|[-=<>(){}\[\],.:*|]))")
_KEYWORDS = frozenset("MATCH WHERE RETURN ORDER BY SKIP LIMIT AND OR NOT IN IS NULL AS DISTINCT CONTAINS STARTS ENDS WITH ASC DESC TRUE FALSE CREATE SET".split())


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            if not text[at:].strip():
                break
            raise CypherError(f"at {text[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), value[1:-1])
        out.append(("key" if kind == "name" and value.upper() in _KEYWORDS else kind, value))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.anonymous = _tokens(text), 0, 0
        self.nodes: dict[str, dict] = {}
        self.edges: list[dict] = []

    def peek(self, *values: str) -> bool:
        k, v = self.t[self.i]
        return (k == "op" and v in values) or (k == "key" and v.upper() in values)

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CypherError(f"expected {value}, not {self.t[self.i][1]!r}")

    def name(self) -> str:
        k, v = self.t[self.i]
        if k not in ("name", "key"):
            raise CypherError(f"expected a name, not {v!r}")
        self.i += 1
        return v

    def literal(self):
        k, v = self.t[self.i]
        self.i += 1
        if k == "str":
            return v
        if k == "num":
            return float(v) if "." in v else int(v)
        if k == "key" and v.upper() in ("TRUE", "FALSE"):
            return v.upper() == "TRUE"
        if k == "key" and v.upper() == "NULL":
            return None
        raise CypherError(f"expected a literal, not {v!r}")

    def properties(self) -> dict:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                out[key] = self.literal()
                if not self.peek("}"):
                    self.need(",")
        return out

    def inside(self, close: str) -> dict:
        var = self.name() if self.t[self.i][0] == "name" else None
        labels = []
        if self.take(":"):
            labels.append(self.name())
            while self.take("|"):
                self.take(":")
                labels.append(self.name())
        if self.peek("*"):
            raise CypherError("paths of variable length")
        props = self.properties()
        self.need(close)
        if var is None:
            self.anonymous += 1
            var = f"_{self.anonymous}"
        return {"var": var, "labels": labels, "props": props}

    def node(self) -> str:
        self.need("(")
        n = self.inside(")")
        known = self.nodes.setdefault(n["var"], {"labels": [], "props": {}})
        known["labels"] += n["labels"]
        known["props"] |= n["props"]
        return n["var"]

    def skip_where(self, *stop: str) -> int | None:
        """Where a WHERE's condition begins, if there is one; the reader stands behind it then."""
        if not self.take("WHERE"):
            return None
        start, depth = self.i, 0
        while self.t[self.i][0] != "end" and not (depth == 0 and self.peek(*stop)):
            depth += self.peek("(") - self.peek(")")
            self.i += 1
        return start

    def finish(self) -> None:
        if self.t[self.i][0] != "end":
            raise CypherError(f"unexpected {self.t[self.i][1]!r}")

    def pattern(self) -> None:
        a = self.node()
        while self.peek("-", "<-"):
            left = self.take("<-")
            if not left:
                self.need("-")
            e = self.inside("]") if self.take("[") else {"var": None, "labels": [], "props": {}}
            if e["var"] is None:
                self.anonymous += 1
                e["var"] = f"_{self.anonymous}"
            right = self.take("->")
            if not right:
                self.need("-")
            if left and right:
                raise CypherError("an edge of two directions")
            b = self.node()
            self.edges.append(e | ({"src": b, "dst": a} if left else {"src": a, "dst": b}) | {"directed": left or right})
            a = b


class CypherGraph:
    """Runs queries over vertices (id, label, ...) and edges (src, label, dst, ...)."""

    def __init__(self, vertices: DataFrame, edges: DataFrame) -> None:
        self.vertices, self.edges = vertices, edges

    def query(self, text: str) -> DataFrame:
        """The rows of RETURN, with its names or aliases as columns."""
        p = _Parser(text)
        p.need("MATCH")
        p.pattern()
        while p.take(","):
            p.pattern()
        where = p.skip_where("RETURN")
        p.need("RETURN")
        distinct = p.take("DISTINCT")
        items = [self._item(p)]
        while p.take(","):
            items.append(self._item(p))
        order, skip, limit = [], 0, None
        if p.take("ORDER"):
            p.need("BY")
            while True:
                e = self._item(p)
                down = p.take("DESC")
                if not down:
                    p.take("ASC")
                order.append((e, down))
                if not p.take(","):
                    break
        if p.take("SKIP"):
            skip = int(p.literal())
        if p.take("LIMIT"):
            limit = int(p.literal())
        p.finish()
        df = self._match(p)
        if where is not None:
            q = _Parser("")
            q.t, q.i = p.t, where
            df = df.where(self._or(q, p))
            if not q.peek("RETURN"):
                raise CypherError(f"unexpected {q.t[q.i][1]!r}")
        return self._project(df, p, items, distinct, order, skip, limit)

    # changes

    def mutate(self, text: str) -> "CypherGraph":
        """The graph after a change: CREATE (n:Label {...}), ... | MATCH ... CREATE (a)-[:TYPE {...}]->(b) | MATCH ... SET a.key = value, ...

        A vertex needs an id (or canonical_id); one that is there already stays as it is, and so does an edge. The two
        ends of a new edge are found by one pattern, or each by its own id."""
        p = _Parser(text)
        if p.take("CREATE"):
            return self._create_vertices(p)
        p.need("MATCH")
        p.pattern()
        while p.take(","):
            p.pattern()
        where = p.skip_where("CREATE", "SET")
        if p.take("CREATE"):
            known = {v: dict(n, labels=list(n["labels"])) for v, n in p.nodes.items()}
            before = len(p.edges)
            p.pattern()
            new = p.edges[before:]
            p.edges, p.nodes = p.edges[:before], known
            if len(new) != 1 or not new[0]["directed"] or len(new[0]["labels"]) != 1 or {new[0]["src"], new[0]["dst"]} - set(known):
                raise CypherError("one edge of one type between matched vertices")
            p.finish()
            return self._create_edge(p, where, new[0])
        p.need("SET")
        changes: dict[str, dict] = {}
        while True:
            var = p.name()
            p.need(".")
            key = p.name()
            p.need("=")
            changes.setdefault(var, {})[key] = p.literal()
            if not p.take(","):
                break
        p.finish()
        if len(changes) != 1 or next(iter(changes)) not in p.nodes:
            raise CypherError("SET of one vertex's properties")
        var, values = next(iter(changes.items()))
        hit = self._filtered(p, where).select(F.col(f"`{var}.id`").alias("id")).distinct().withColumn("__hit", F.lit(True))
        return CypherGraph(self._changed(self.vertices.join(hit, "id", "left"), values), self.edges)

    def _changed(self, vs: DataFrame, values: dict) -> DataFrame:
        out, own = vs, {}
        for k, v in values.items():
            k = {"entity_type": "label"}.get(k, k)
            if k in ("id", "canonical_id"):
                raise CypherError("an id can't be changed")
            if k in self.vertices.columns:
                out = out.withColumn(k, F.when(F.col("__hit"), F.lit(v).cast(self.vertices.schema[k].dataType)).otherwise(F.col(k)))
            else:
                own[k] = None if v is None else str(v)
        if own:
            if "properties" not in self.vertices.columns:
                raise CypherError(f"no property {next(iter(own))}")
            none = F.create_map().cast("map<string,string>")
            kept = F.map_filter(F.coalesce("properties", none), lambda k, _: ~k.isin(*own))
            more = F.create_map(*[F.lit(x) for pair in own.items() if pair[1] is not None for x in pair]) if any(v is not None for v in own.values()) else none
            out = out.withColumn("properties", F.when(F.col("__hit"), F.map_concat(kept, more)).otherwise(F.col("properties")))
        return out.select(*self.vertices.columns)

    def _row(self, like: DataFrame, values: dict) -> list[Column]:
        """A row with the columns of a table out of literals; what has no column goes to properties."""
        own = {k: str(v) for k, v in values.items() if k not in like.columns and v is not None}
        made = []
        for f in like.schema:
            if f.name == "properties" and f.name not in values:
                made.append((F.create_map(*[F.lit(x) for pair in own.items() for x in pair]) if own else F.create_map()).cast(f.dataType).alias(f.name))
            else:
                made.append(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name))
        return made

    def _create_vertices(self, p: _Parser) -> "CypherGraph":
        p.pattern()
        while p.take(","):
            p.pattern()
        p.finish()
        if p.edges:
            raise CypherError("an edge is created between matched vertices")
        new = None
        for n in p.nodes.values():
            values = {{"canonical_id": "id", "entity_type": "label"}.get(k, k): v for k, v in n["props"].items()}
            if values.get("id") is None or len(n["labels"]) > 1:
                raise CypherError("a vertex needs an id and one label")
            one = self.vertices.sparkSession.range(1).select(*self._row(self.vertices, {"label": (n["labels"] or ["Concept"])[0]} | values))
            new = one if new is None else new.unionByName(one)
        return CypherGraph(graph.upsert_vertices(self.vertices, new, None), self.edges)

    def _create_edge(self, p: _Parser, where: int | None, e: dict) -> "CypherGraph":
        a, b = e["src"], e["dst"]
        ids = [p.nodes[v]["props"].get("id", p.nodes[v]["props"].get("canonical_id")) for v in (a, b)]
        if not p.edges and where is None and len(p.nodes) == 2 and None not in ids:  # each by its id: one aggregation finds both
            found = self._scan(a, p.nodes[a]).select(F.col(f"`{a}.id`").alias("x"), F.lit(0).alias("k")).unionByName(self._scan(b, p.nodes[b]).select(F.col(f"`{b}.id`").alias("x"), F.lit(1).alias("k")))
            ends = found.agg(F.max(F.when(F.col("k") == 0, F.col("x"))).alias("src"), F.max(F.when(F.col("k") == 1, F.col("x"))).alias("dst")).where("src is not null and dst is not null")
        else:
            ends = self._filtered(p, where).select(F.col(f"`{a}.id`").alias("src"), F.col(f"`{b}.id`").alias("dst")).distinct()
        row = [c for c, f in zip(self._row(self.edges, {"label": e["labels"][0]} | e["props"]), self.edges.schema) if f.name not in ("src", "dst")]
        new = ends.select("src", "dst", *row)
        return CypherGraph(self.vertices, graph.upsert_edges(self.edges, new.select(*self.edges.columns), self.vertices))

    def _filtered(self, p: _Parser, where: int | None) -> DataFrame:
        df = self._match(p)
        if where is None:
            return df
        q = _Parser("")
        q.t, q.i = p.t, where
        return df.where(self._or(q, p))

    # planning

    def _scan(self, var: str, node: dict) -> DataFrame:
        df = self.vertices
        if node["labels"]:
            df = df.where(F.col("label").isin(node["labels"]))  # before any join
        for k, v in node["props"].items():
            df = df.where(self._column(df.columns, "", k) == F.lit(v))
        return df.select(*[F.col(c).alias(f"{var}.{c}") for c in df.columns])

    def _match(self, p: _Parser) -> DataFrame:
        bound: set[str] = set()
        df: DataFrame | None = None

        def bind(df: DataFrame | None, var: str) -> DataFrame:
            one = self._scan(var, p.nodes[var])
            bound.add(var)
            if df is None:
                return one
            raise CypherError("patterns that share nothing")  # would be a product

        pending = list(p.edges)
        if not pending:
            for var in p.nodes:
                df = bind(df, var)
            return df
        while pending:
            e = next((e for e in pending if df is None or e["src"] in bound or e["dst"] in bound), None)
            if e is None:
                raise CypherError("patterns that share nothing")
            pending.remove(e)
            es = self.edges
            if e["labels"]:
                es = es.where(F.col("label").isin(e["labels"]))
            for k, v in e["props"].items():
                es = es.where(self._column(es.columns, "", k) == F.lit(v))
            es = es.select(*[F.col(c).alias(f"{e['var']}.{c}") for c in es.columns], F.col("src").alias("__a"), F.col("dst").alias("__b"))
            if not e["directed"]:
                es = es.unionByName(es.withColumn("__x", F.col("__a")).withColumn("__a", F.col("__b")).withColumn("__b", F.col("__x")).drop("__x").where("__a <> __b"))
            if df is None:
                df = es
            else:
                on = [F.col(f"`{v}.id`") == F.col(c) for v, c in ((e["src"], "__a"), (e["dst"], "__b")) if v in bound]
                df = df.join(es, on[0] if len(on) == 1 else on[0] & on[1])
            for v, c in ((e["src"], "__a"), (e["dst"], "__b")):
                if v not in bound:
                    df = df.join(self._scan(v, p.nodes[v]), F.col(c) == F.col(f"`{v}.id`"))
                    bound.add(v)
                elif e["src"] == e["dst"]:
                    df = df.where("__a = __b")
            df = df.drop("__a", "__b")
        missing = [v for v in p.nodes if v not in bound]
        if missing:
            raise CypherError("patterns that share nothing")
        return df

    def _column(self, columns: list[str], prefix: str, key: str) -> Column:
        key = {"canonical_id": "id", "entity_type": "label", "relationship_type": "label"}.get(key, key)
        if prefix + key in columns:
            return F.col(f"`{prefix}{key}`")
        if prefix + "properties" in columns:
            return F.try_element_at(F.col(f"`{prefix}properties`"), F.lit(key))
        return F.lit(None)

    def _item(self, p: _Parser) -> dict:
        start = p.i
        word = p.name()
        item: dict = {}
        if p.take("("):
            fn = word.lower()
            if fn not in ("id", "label", "type", "count"):
                raise CypherError(f"function {word}")
            item = {"fn": fn, "distinct": p.take("DISTINCT"), "var": "*" if p.take("*") else p.name(), "key": p.name() if p.take(".") else None}
            p.need(")")
        else:
            item = {"fn": None, "var": word, "key": p.name() if p.take(".") else None}
        item["text"] = "".join(v for _, v in p.t[start : p.i])
        item["alias"] = p.name() if p.take("AS") else item["text"]
        return item

    def _value(self, columns: list[str], p: _Parser, item: dict) -> Column:
        var, key = item["var"], item["key"]
        names = set(p.nodes) | {e["var"] for e in p.edges}
        if var != "*" and var not in names:
            raise CypherError(f"unknown {var}")
        if item["fn"] == "count":
            if var == "*":
                return F.count(F.lit(1))
            c = self._column(columns, f"{var}.", key or ("id" if var in p.nodes else "src"))
            return F.count_distinct(c) if item["distinct"] else F.count(c)
        if item["fn"] in ("label", "type"):
            return F.col(f"`{var}.label`")
        if item["fn"] == "id":
            return F.col(f"`{var}.id`") if var in p.nodes else F.concat_ws("|", f"`{var}.src`", f"`{var}.label`", f"`{var}.dst`")
        if key:
            return self._column(columns, f"{var}.", key)
        return F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in columns if c.startswith(f"{var}.")])

    def _project(self, df, p, items, distinct, order, skip, limit) -> DataFrame:
        cols = df.columns
        if any(i["fn"] == "count" for i in items):
            keys = [self._value(cols, p, i).alias(i["alias"]) for i in items if i["fn"] != "count"]
            out = df.groupBy(*keys).agg(*[self._value(cols, p, i).alias(i["alias"]) for i in items if i["fn"] == "count"]).select(*[F.col(f"`{i['alias']}`") for i in items])
            keys_of = lambda i: F.col(f"`{next((x['alias'] for x in items if x['alias'] == i['text'] or x['text'] == i['text']), i['text'])}`")
            out = out.orderBy(*[keys_of(i).desc() if d else keys_of(i).asc() for i, d in order]) if order else out
        else:
            aliases = {i["alias"]: i for i in items}
            sort = [self._value(cols, p, aliases.get(i["text"], i)) for i, _ in order]
            ordered = df.orderBy(*[c.desc() if d else c.asc() for c, (_, d) in zip(sort, order)]) if order and not distinct else df
            out = ordered.select(*[self._value(cols, p, i).alias(i["alias"]) for i in items])
            if distinct:
                out = out.distinct()
                if order:
                    out = out.orderBy(*[F.col(f"`{aliases.get(i['text'], i)['alias']}`").desc() if d else F.col(f"`{aliases.get(i['text'], i)['alias']}`").asc() for i, d in order])
            elif not order and (skip or limit is not None):
                out = out.orderBy(*[F.col(f"`{c}`") for c in out.columns if "map<" not in out.schema[c].dataType.simpleString()])  # a limit needs an order to be repeatable
        if skip:
            out = out.offset(skip)
        return out.limit(limit) if limit is not None else out

    # predicates

    def _or(self, q: _Parser, p: _Parser) -> Column:
        out = self._and(q, p)
        while q.take("OR"):
            out = out | self._and(q, p)
        return out

    def _and(self, q: _Parser, p: _Parser) -> Column:
        out = self._not(q, p)
        while q.take("AND"):
            out = out & self._not(q, p)
        return out

    def _not(self, q: _Parser, p: _Parser) -> Column:
        if q.take("NOT"):
            return ~self._not(q, p)
        if q.peek("("):
            q.i += 1
            out = self._or(q, p)
            q.need(")")
            return out
        return self._comparison(q, p)

    def _operand(self, q: _Parser, p: _Parser) -> Column:
        if q.t[q.i][0] in ("str", "num") or q.peek("TRUE", "FALSE", "NULL"):
            return F.lit(q.literal())
        item = self._item(q)
        cols = [f"{v}.{c}" for v in p.nodes for c in self.vertices.columns] + [f"{e['var']}.{c}" for e in p.edges for c in self.edges.columns]
        return self._value(cols, p, item)

    def _comparison(self, q: _Parser, p: _Parser) -> Column:
        left = self._operand(q, p)
        if q.take("IS"):
            no = q.take("NOT")
            q.need("NULL")
            return left.isNotNull() if no else left.isNull()
        if q.take("IN"):
            q.need("[")
            values = []
            while not q.take("]"):
                values.append(q.literal())
                if not q.peek("]"):
                    q.need(",")
            return left.isin(values)
        if q.take("CONTAINS"):
            return left.contains(self._operand(q, p))
        if q.peek("STARTS", "ENDS"):
            starts = q.take("STARTS") or not q.take("ENDS")
            q.need("WITH")
            right = self._operand(q, p)
            return left.startswith(right) if starts else left.endswith(right)
        if q.take("=~"):
            pattern = str(q.literal()).replace(r"\y", r"\b")
            return F.rlike(left, F.lit(f"^(?:{pattern})$" if not pattern.startswith("(?i)") else f"(?i)^(?:{pattern[4:]})$"))
        for op, f in (("=", lambda a, b: a == b), ("<>", lambda a, b: a != b), ("<=", lambda a, b: a <= b), (">=", lambda a, b: a >= b), ("<", lambda a, b: a < b), (">", lambda a, b: a > b)):
            if q.take(op):
                return f(left, self._operand(q, p))
        raise CypherError(f"unexpected {q.t[q.i][1]!r}")


# The named queries of the graph page.
TEMPLATES = {
    "all_entities": "MATCH (n) RETURN n.id AS id, n.name AS name, label(n) AS label",
    "all_relationships": "MATCH (a)-[r]->(b) RETURN a.name AS source, type(r) AS relationship, b.name AS target",
    "classes": "MATCH (f:File)-[r:DEFINES]->(c:Class) RETURN f.name AS file, c.name AS class",
    "functions": "MATCH (f)-[r:DEFINES]->(fn) WHERE label(fn) = 'Function' OR label(fn) = 'Method' RETURN f.name AS owner, fn.name AS function",
    "library_imports": "MATCH (f)-[r:IMPORTS]->(l:Library) RETURN f.name AS file, l.name AS library",
    "api_handlers": "MATCH (a:API)-[r:IMPLEMENTED_BY]->(h) RETURN a.name AS api, h.name AS handler",
    "technologies": "MATCH (t:Technology)-[r]-(x) RETURN t.name AS technology, count(x) AS links",
    "concepts": "MATCH (d)-[r:DESCRIBES]->(c:Concept) RETURN d.name AS document, c.name AS concept",
    "directory_tree": "MATCH (p)-[r:CONTAINS]->(c) RETURN p.id AS parent, c.id AS child",
}
