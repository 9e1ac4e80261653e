"""Source files that do not parse, and their rates per repository and language.

JavaScript, TypeScript, Java, Go and SQL are read as chunks whose lexer states follow from one another and whose bracket
summaries are reduced associatively (see lexing); what the reduction leaves open is broken, and no other step looks for
that. What is balanced goes to the local grammars of its statements. Files of Java, Go and SQL beyond LARGE characters
are first spread over the cluster as chunks, whose effects from every state are reduced per file. Python, JSON, YAML,
TOML and lists of requirements are parsed whole by the grammars that the interpreter and its libraries bring.
"""

from __future__ import annotations

import json
import re
import sys
import tomllib
import warnings
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import grammars, lexing

try:
    import yaml

    _YAML = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:  # then no YAML file can be judged, and _yaml raises
    yaml = None

LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".go": "Go", ".sql": "SQL",
    ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".txt": "Requirements", ".md": "Markdown",
}
#: Characters of a spread chunk, of a file from which on its chunks are spread, and calls that a grammar may nest.
CHUNK, LARGE, DEEP = 1 << 16, 1 << 20, 100_000


def language(path: str | None) -> str | None:
    """The language that a file's name stands for, if it is one of those checked."""
    base = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    return LANGUAGES.get("." + base.rsplit(".", 1)[-1]) if "." in base else None


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "file", "exec", dont_inherit=True)
        except (SyntaxError, ValueError) as e:
            raise lexing.Broken(str(e)) from None
        except (RecursionError, MemoryError):
            raise lexing.Broken("nested deeper than Python itself reads") from None


def _constant(name: str):
    raise ValueError(name)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<atom>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def _deep_json(text: str) -> None:
    """JSON of any depth, on a stack of its own."""
    at, stack, want = 0, [], "value"  # value, first (value or ]), key, name (key or }), colon, next (comma or closing)
    text = text.rstrip(" \t\n\r")
    while at < len(text):
        m = _JSON_TOKEN.match(text, at)
        if not m or (want == "next" and not stack):
            raise lexing.Broken(f"at {at}")
        at, mark = m.end(), m["mark"]
        if want in ("value", "first") and (m["atom"] or m["str"]):
            want = "next"
        elif want in ("value", "first") and mark in ("{", "["):
            stack.append(mark)
            want = "name" if mark == "{" else "first"
        elif want in ("key", "name") and m["str"]:
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif mark in ("}", "]") and stack and stack[-1] == lexing.PAIRS[mark] and want in ("next", "name" if mark == "}" else "first"):
            stack.pop()
            want = "next"
        else:
            raise lexing.Broken(f"at {at}")
    if stack or want != "next":
        raise lexing.Broken("ends too early")


def _json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_constant)
    except RecursionError:
        _deep_json(text)
    except ValueError as e:
        raise lexing.Broken(str(e)) from None


def _yaml(text: str) -> None:
    """What composing the documents tells, by their events, which need no stack: composing itself ends the process where
    texts nest too deep for the machine's. Anchors are of one document and differ; an alias needs one before it."""
    if yaml is None:
        raise RuntimeError("YAML files can't be judged without PyYAML: install it where Spark's Python workers run")
    anchors: set[str] = set()
    try:
        for e in yaml.parse(text, Loader=_YAML):
            if isinstance(e, yaml.DocumentStartEvent):
                anchors = set()
            elif isinstance(e, yaml.AliasEvent):
                if e.anchor not in anchors:
                    raise lexing.Broken(f"undefined alias {e.anchor}")
            elif anchor := getattr(e, "anchor", None):
                if anchor in anchors:
                    raise lexing.Broken(f"duplicate anchor {anchor}")
                anchors.add(anchor)
    except yaml.YAMLError as e:
        raise lexing.Broken(str(e)) from None


def _toml(text: str) -> None:
    try:
        tomllib.loads(text)
    except ValueError as e:
        raise lexing.Broken(str(e)) from None


_VERSION = r"(?:===|==|~=|!=|<=|>=|<|>)\s*[A-Za-z0-9_.*+!\-]+"
_MARKER_ATOM = r"(?:\(\s*)*(?:[a-z_]+|\"[^\"]*\"|'[^']*')\s*(?:===|==|~=|!=|<=|>=|<|>|\bnot\s+in\b|\bin\b)\s*(?:[a-z_]+|\"[^\"]*\"|'[^']*')(?:\s*\))*"
_REQUIREMENT = re.compile(
    rf"[A-Za-z0-9](?:[A-Za-z0-9._\-]*[A-Za-z0-9])?\s*(?:\[\s*(?:[A-Za-z0-9][\w.\-]*(?:\s*,\s*[A-Za-z0-9][\w.\-]*)*)?\s*\])?\s*"
    rf"(?:@\s*\S+|\(?\s*(?:{_VERSION}(?:\s*,\s*{_VERSION})*\s*,?)?\s*\)?)\s*(?:;\s*{_MARKER_ATOM}(?:\s+(?:and|or)\s+{_MARKER_ATOM})*)?\s*(?:--hash[= ]\S+\s*)*"
)
_OPTION = re.compile(
    r"(?:(?:-r|-c|-e|-f|-i|--requirement|--constraint|--editable|--index-url|--extra-index-url|--find-links|--no-binary|--only-binary|--trusted-host|--use-feature|--config-settings|--global-option)(?:\s+|=)\S.*|--(?:no-index|pre|prefer-binary|require-hashes|no-deps))"
)
_LOCATION = re.compile(r"(?:(?:git|hg|svn|bzr)\+)?[a-z]+://\S+|(?:\.{0,2}/|[A-Za-z]:\\)\S+|\S+\.(?:whl|tar\.gz|zip)(?:\[[^\]]*\])?")


def _requirements(text: str) -> None:
    for line in re.sub(r"\\\r?\n", " ", text).splitlines():
        line = re.sub(r"(?:^|\s)#.*$", "", line).strip()
        if line and not (_REQUIREMENT.fullmatch(line) or _OPTION.fullmatch(line) or _LOCATION.fullmatch(line)):
            raise lexing.Broken(line[:60])


def _markdown(text: str) -> None:
    """Only merge conflicts count, outside fenced code: a marker with a label, and another marker."""
    fence, marks = "", []
    for line in text.splitlines():
        bare = line.lstrip(" ")
        if fence:
            if len(line) - len(bare) < 4 and bare.startswith(fence) and not bare.strip(fence[0] + " \t"):
                fence = ""
            continue
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and not (m[1][0] == "`" and "`" in line[m.end() :]):
            fence = m[1]
        elif line[:7] in ("<<<<<<<", ">>>>>>>", "|||||||") and (len(line) == 7 or line[7] == " "):
            marks.append(line[0])
        elif line.rstrip() == "=======":
            marks.append("=")
    if len(set(marks)) > 1 and ("<" in marks or ">" in marks):
        raise lexing.Broken("conflict")


CHECKS = {
    "Python": _python, "JSON": _json, "YAML": _yaml, "TOML": _toml, "Requirements": _requirements, "Markdown": _markdown,
    "JavaScript": grammars.check_javascript, "TypeScript": grammars.check_typescript, "Java": grammars.check_java, "Go": grammars.check_go, "SQL": grammars.check_sql,
}


def error(lang: str, text: str) -> str | None:
    """Why a text is not valid in a language; None if it is. What nests deeper than DEEP calls counts as broken."""
    text = text.removeprefix("\ufeff")
    try:
        try:
            CHECKS[lang](text)
        except RecursionError:  # calls of Python need no room on the machine's stack, so the limit may be raised
            usual = sys.getrecursionlimit()
            sys.setrecursionlimit(DEEP)
            try:
                CHECKS[lang](text)
            finally:
                sys.setrecursionlimit(usual)
    except lexing.Broken as e:
        return str(e)[:200] or "broken"
    except RecursionError:
        return "nested too deep"
    except IndexError:
        return "ends too early"
    return None


def _name_column(path: str) -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.when(ext != "", ext))


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, repository_name, language, broken, reason) of each document whose name stands for a checked language.

    Null and empty texts are left out; rows with repeated ids are judged each; other columns are ignored. One pass, no
    shuffle, but for files beyond LARGE in languages with chunk effects."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "repository_name", _name_column("file_path").alias("language"), "text").where("language is not null and text is not null and text <> ''")
    schema = "doc_id long, repository_name string, language string, broken boolean, reason string"

    def run(batches):
        for b in batches:
            why = [error(lang, t) for lang, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([w is not None for w in why]), pa.array(why, pa.string())], names=["doc_id", "repository_name", "language", "broken", "reason"])

    spread = (F.length("text") > LARGE) & F.col("language").isin("Java", "Go", "SQL")
    small = rows.where(~spread).mapInArrow(run, schema)
    # rows of one id may differ, so a text's digest is part of its key; equal rows have one verdict
    large = cut(rows.where(spread).withColumn("digest", F.xxhash64("text", "language")), "large")  # few files, read three times
    tangled = unbalanced(large)
    key = ["doc_id", "digest"]
    sound = large.join(tangled, key, "left_anti").select(*rows.columns).mapInArrow(run, schema)
    lost = large.join(tangled, key, "left_semi").select("doc_id", "repository_name", "language", F.lit(True).alias("broken"), F.lit("brackets").alias("reason"))
    return small.unionByName(sound).unionByName(lost)


def unbalanced(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, digest) of each row (doc_id, digest, language, text) whose chunks' effects don't reduce to balance.

    Chunks are read in any task, from every state; only their effects, a few characters each, come together per text. A
    text that takes the states of effects beyond their reach isn't told here: its own task reads it whole."""

    def cut_up(batches):
        for b in batches:
            for i, digest, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "language", "text"))):
                parts = lexing.chunks(text, size)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array([digest] * len(parts), pa.int64()), pa.array([lang] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "digest", "language", "k", "chunk"])

    def read(batches):
        for b in batches:
            effects = [json.dumps(lexing.effect(lang.lower(), c)) for lang, c in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(effects, pa.string())], names=["doc_id", "digest", "k", "effect"])

    pieces = rows.select("doc_id", "digest", "language", "text").mapInArrow(cut_up, "doc_id long, digest long, language string, k int, chunk string").repartition("doc_id", "digest", "k")
    effects = pieces.mapInArrow(read, "doc_id long, digest long, k int, effect string").dropDuplicates(["doc_id", "digest", "k"])
    whole = effects.groupBy("doc_id", "digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "effect"))), lambda x: x["effect"]).alias("effects"))

    def join(batches):
        for b in batches:
            bad = [k for k, es in enumerate(b.column(2).to_pylist()) if lexing.balanced(reduce(lexing.combine, [json.loads(e) for e in es])) is False]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(bad, pa.int32())) for c in b.columns[:2]], names=["doc_id", "digest"])

    return whole.mapInArrow(join, "doc_id long, digest long")


def rates(docs: DataFrame) -> DataFrame:
    """(repository_name, language, n_files, n_broken, rate) over all checked documents; rate to six digits."""
    return checked(docs).groupBy("repository_name", "language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"), F.round(F.count_if("broken") / F.count("*"), 6).alias("rate"))
