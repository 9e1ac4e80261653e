"""Generated, minified, vendored and data files among source code, so that hand-written source remains.

Copies are found by hashes from the bottom up: blocks of a file, files, and directory trees by Merkle hashes. A
directory's hash is made of the names and hashes of what it holds, files and directories, combined in any order. In the
order of paths all that lies in a directory is one stretch, so a single pass closes each directory behind its last file;
only those that reach over the ends of a partition are closed afterwards. Blocks, files and trees that unrelated
repositories share mark vendored code, however its header was changed or its end cut off, and hashes are asked of every
file. Headers, banners and layout tell what a tool wrote, what is packed and what is data; a copy that only one
repository holds is told by its header or its directory.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.skew import join_counted
from . import residue

# Extensions of source code.
CODE = frozenset(".py .js .mjs .cjs .jsx .ts .tsx .java .go .sql .c .h .cc .cpp .hpp .cs .rb .php .rs .kt .scala .swift .css .lua .pl .r .sh".split())
# Directories that hold packages of others.
VENDOR_DIRS = frozenset("vendor _vendor third_party thirdparty 3rdparty third-party node_modules bower_components jspm_packages external extern externals godeps deps pods carthage site-packages".split())
#: Directories between a vendor directory and a package.
_BETWEEN = frozenset("_workspace src import github.com gitlab.com golang.org packages @types".split())
#: What a shared block has at least, and what share of a file's blocks makes it a copy.
BLOCK, SHARED = 60, 0.6

_COMMENT = re.compile(r"^\s*(?://+|#+!?|--|;+|/\*+!?|\*+/?|<!--|%|\"\"\"|''')\s?")
_MARKS = re.compile(r"^[\s/#*;\-=<>!%]+|[\s/#*;\-=<>!%]+$")
_GENERATED = re.compile(
    r"(?i)^(?:@generated\b|<?auto-?generated\b|auto ?generated\b|automatically (?:generated|created|produced|written)|machine[- ](?:generated|written|made)|"
    r"(?:this|the) (?:file|code|source|module|class|document) (?:is|was|has been|were|gets) (?:(?:automatically|auto|machine)[- ]?)?(?:generated|created|written|produced|built|emitted)(?: automatically| by| from)|"
    r"(?:code|file|source|bindings?|stubs?|module|class|client|schema|migration)?\s*(?:auto-?)?(?:generated|created|produced|emitted|compiled|built) (?:automatically |code )?(?:by|from|with|using|via)\b|generated (?:code|file|source|client|protocol buffer|grpc|output|by|from)|"
    r"(?:do not|don't|never) (?:edit|modify|change|touch)\b.{0,60}(?:generat|overwritten|lost|by hand|manually)?|(?:manual |any )?(?:changes|edits|modifications)[^.]{0,40}(?:will|would) be (?:lost|overwritten|discarded)|"
    r"automatisch (?:erzeugt|generiert|erstellt)|(?:diese datei|dieser code) (?:wurde|ist|wird) (?:automatisch |maschinell )?(?:erzeugt|generiert|erstellt)|(?:nicht|bitte nicht) (?:von hand )?(?:bearbeiten|[aä]ndern|editieren)|maschinell (?:erzeugt|erstellt)|generiert (?:von|aus|mit)|erzeugt (?:von|aus|mit)|"
    r"(?:ce )?fichier (?:a [eé]t[eé] )?(?:g[eé]n[eé]r[eé]|cr[eé][eé])|g[eé]n[eé]r[eé] (?:par|automatiquement|[aà] partir)|ne pas (?:modifier|[eé]diter|toucher)|(?:archivo|fichero|c[oó]digo) generado|generado (?:autom|por|a partir)|no (?:editar|modificar)\b|(?:arquivo|c[oó]digo) gerado|n[aã]o edit|file generato|generato (?:da|autom)|non modificare|"
    r"(?:этот )?файл (?:был )?(?:создан|сгенерирован)|сгенерирован|автоматически (?:создан|сгенерирован)|не редактир|自動生成|このファイルは.{0,20}生成|自动生成|由.{0,30}生成|请勿(?:编辑|修改))"
)
_REGENERATE = re.compile(r"(?i)re-?run `?[^`]{2,40}`? (?:rather than|instead of) \w+ing\b|regenerate (?:with|by|using)|source: \S+\.proto\b")
_UPSTREAM = re.compile(
    r"(?i)^(?:vendored (?:from|copy of|in from)|(?:copied|taken|imported|adapted|borrowed|forked|lifted|backported) (?:verbatim |unmodified |unchanged |as is |directly )?from|bundled (?:copy of|from)|verbatim copy of|copy of|third[- ]party (?:code|file|source|library)|upstream[: ]|this file is (?:part of|from|a copy of)|"
    r"(?:(?:copyright|\(c\)|©)\s*)+(?:\d{4}(?:\s*[-–,]\s*(?:\d{4}|present))*,?\s*)?(?:by\s+)?(?:the\s+)?(?P<who>[\w.\- ]{2,40}?)\s+(?:authors|contributors|developers|project|team|foundation|maintainers)\b|(?P<what>[\w.\-]{2,40})\s+v?\d+\.\d+(?:\.\d+)*\s*[|\-–—*]\s*(?:https?://|\(?c\)?|mit|bsd|apache|isc|©|license|released?))"
)
_OWN = re.compile(r"(?i)\b(?:this|our|the) project'?s?\b|\bour team\b")
_BANNER = re.compile(r"^\s*/\*!.{0,200}?(?:v?\d+\.\d+|license|MIT|BSD|Apache)")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_LITERALS = re.compile(r"[-+]?\b\d[\w.]*|[\s,;:{}\[\]()=\-+|&.\"'`]+")
_NUMBER_OR_NAME = re.compile(r"[A-Za-z_]\w*|\d[\w.]*")
_IMPORT = re.compile(r"^\s*(?:import|from|package|use|using|require|include|#include|const \w+ = require|export \* from|\"[\w./\-]+\"|[()]|\w+ = (?:logging\.)?getLogger\b|$)")
#: Names that tools give to what they write.
_TOOL_NAME = re.compile(r"_pb2(?:_grpc)?\.|\.pb\.|\.gen(?:erated)?\.|_gen(?:erated)?\.|\.g\.|\.designer\.|stub\.java$|_string\.go$|auto_?migration|zz_generated|_mock\.go$")
_KEYWORDS = frozenset("def class return self func type struct package public private protected final static void int string bool float double if else for while import from export function const let var new this None null true false raise throw try catch except case switch alter table add column create insert into values index on set update where integer text not primary key default".split())


def tidy_path(path: str) -> str:
    """One spelling of a path: forward slashes, no leading ./ or /, no empty or . parts."""
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))


def extension(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    return "." + base.rsplit(".", 1)[-1].lower() if "." in base[1:] else ""


def header(text: str) -> tuple[list[str], int]:
    """Comment lines at the top, without their marks, and where the code after them begins."""
    out, at, inside = [], 0, False
    for line in text.splitlines(keepends=True):
        bare = line.strip().lstrip("﻿")
        if bare and not inside and not _COMMENT.match(line.lstrip("﻿")) and not bare.startswith(("#!", "<?", "'use strict'", '"use strict"')):
            break
        if bare.startswith(("\"\"\"", "'''")) and not inside:
            break  # a docstring is code
        if "/*" in bare:
            inside = True
        if "*/" in bare:
            inside = False
            if bare.rpartition("*/")[2].strip():
                break
        if bare:
            out.append(_MARKS.sub("", _COMMENT.sub("", bare)).strip())
        at += len(line)
    return out, at


def generated_header(top: list[str]) -> bool:
    return any(_GENERATED.match(line) or _REGENERATE.search(line) for line in top)


def foreign_header(top: list[str], repository: str | None) -> bool:
    """Whether the head names another project as the origin."""
    own = set(re.findall(r"\w+", (repository or "").lower()))
    for line in top:
        m = _UPSTREAM.match(line)
        if m and not _OWN.search(line):
            named = (m["who"] or m["what"] or "").lower()
            if not named or set(re.findall(r"\w+", named)) - own:
                return True
    return False


def vendor_path(path: str) -> bool:
    """Whether a path leads through a directory of packages of others and into one of them."""
    parts = path.lower().split("/")
    for i, p in enumerate(parts[:-1]):
        if p in VENDOR_DIRS:
            rest = parts[i + 1 : -1]
            while rest and rest[0] in _BETWEEN:
                rest = rest[1:]
            if rest:
                return True
    return False


def shape(line: str) -> str:
    """A line with its own names and numbers blanked out."""
    return _NUMBER_OR_NAME.sub(lambda m: m[0] if m[0].lower() in _KEYWORDS else "0" if m[0][0].isdigit() else "a", _STRING.sub("s", line.strip()))


def minified(text: str, least: int = 400) -> bool:
    """Few line breaks and hardly any blanks between short names."""
    if len(text) < least:
        return False
    code = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    bare = _STRING.sub('""', code)
    if len(bare) < least // 2:
        return False
    lines = [x for x in bare.split("\n") if x.strip()]
    dense = sum(len(x) for x in lines if len(x) > min(110, least) and sum(c.isspace() for c in x) < 0.09 * len(x) and re.search(r"[;{}]", x))
    marks = sum(bare.count(c) for c in "(){}[];,=")
    return dense >= 0.6 * sum(map(len, lines)) and marks > 0.12 * len(bare) and len(re.findall(r"[A-Za-z_$]\w*", bare)) > 0.06 * len(bare)


def data(text: str) -> bool:
    """Nearly all literals: arrays, tables or encoded bytes behind a name or two."""
    if len(text) < 600:
        return False
    plain = re.sub(r"(?m)^[^\S\n]*(?://|#|--)[^\n]*$|/\*[\s\S]*?\*/", "", text)
    strings = [m.group() for m in _STRING.finditer(plain)]
    if sum(" " in s and len(re.findall(r"[a-z]{2,} [a-z]{2,}", s)) > 0 for s in strings) > 0.2 * len(strings) + 1:
        return False
    if len(plain.strip()) < 500:
        return False
    left = _LITERALS.sub("", _STRING.sub("", plain))
    return len(left) <= max(60, 0.12 * len(plain)) and not re.search(r"\b(?:if|for|while|return|def|function|func)\b[^\n]*[({:]|=>", _STRING.sub("", plain))


_WORDS_AND_BLANKS = re.compile(r"[\w\s]+")


def _may_repeat(lines: list[str], share: float) -> bool:
    """Whether the four commonest skeletons of marks reach a share of the lines: no fewer lines have one skeleton than one
    shape, as a shape tells the skeleton."""
    marks = Counter(_WORDS_AND_BLANKS.sub("", _STRING.sub("s", x) if '"' in x or "'" in x or "`" in x else x) for x in lines)
    return sum(n for _, n in marks.most_common(4)) >= share * len(lines)


def machine_layout(text: str, ext: str, named: bool = False) -> bool:
    """The same one to three shapes of line over and over, as a tool writes members, getters or statements."""
    code = [x for x in text.split("\n") if x.strip() and not _COMMENT.match(x)]
    if len(code) < (3 if named else 8):
        return False
    if not _may_repeat([x for x in code if x.strip("{}()[];, \t\r\f\v") != ""], 0.5 if "protobuf:" in text else 0.7):
        return False
    lines = [shape(x) for x in code]
    counts = Counter(x for x in lines if x.strip("{}()[];, ") != "")
    total = sum(counts.values())
    top = counts.most_common(4)
    if not top or top[0][1] < (2 if named else 5):
        return False
    if ext == ".sql":
        return len(top[0][0]) > 12 and top[0][1] >= 0.8 * total
    few = sum(n for _, n in top[:3] if n >= 4)
    names = re.findall(r"(?m)^\s*(?:public |private |static |async |export |function |def |func |final |\w+ )*((?:get|set|Get|Set|field|has|clear)_?\w+)", text)
    if named and sum(n for _, n in top) >= 0.7 * total:
        return True
    if few >= 0.7 * total and (len(names) >= 4 or "protobuf:" in text):
        return True
    return "protobuf:" in text and counts.total() > 8 and few >= 0.5 * total


def kind_of(path: str, text: str, repository: str | None) -> str | None:
    """generated, minified, vendored or data, as far as the file alone tells."""
    ext = extension(path)
    if ext not in CODE or not text.strip():
        return None
    top, at = header(text)
    if generated_header(top):
        return "generated"
    base = path.rsplit("/", 1)[-1].lower()
    if minified(text, 80 if re.search(r"[.\-](?:min|bundle|pack|prod)\.|\.[0-9a-f]{8,}\.", base) else 400) or (_BANNER.match(text) and len(text) > 300 and max(map(len, text.split("\n"))) > 300):
        return "minified"
    if data(text):
        return "data"
    if machine_layout(text, ext, bool(_TOOL_NAME.search(base))):
        return "generated"
    if vendor_path(path) or foreign_header(top, repository):
        return "vendored"
    return None


def blocks(text: str) -> list[tuple[int, int]]:
    """(hash, size) of the blocks between blank lines, blanks left out; small ones and mere imports don't count."""
    _, at = header(text)
    out = []
    for block in re.split(r"\n\s*\n", text[at:].replace("\r", "")):
        lines = block.split("\n")
        if all(_IMPORT.match(x) for x in lines):
            continue
        dense = "".join(block.split())
        if len(dense) >= BLOCK:
            out.append((xxhash.xxh64_intdigest(dense.encode("utf-8", "replace")) - (1 << 63), len(dense)))
    return out


def read_files(docs: DataFrame) -> DataFrame:
    """One row per document of source code with its kind, content hash, size and blocks; no shuffle."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], [], []]
            for i, repo, path, text, at in zip(*(c.to_pylist() for c in b.columns)):
                if not text or not path or not text.strip():
                    continue
                path = tidy_path(path)
                if extension(path) not in CODE:
                    continue
                kind = kind_of(path, text, repo)
                if kind != "generated" and residue.checked(residue.shares(text)):
                    continue  # an error page or a template's rest
                dense = "".join(text[header(text)[1] :].split())
                whole = xxhash.xxh64_intdigest(dense.encode("utf-8", "replace")) - (1 << 63)
                for column, v in zip(out, (i, repo or "", path, kind, whole, len(dense), at, [{"h": h, "n": n} for h, n in blocks(text)])):
                    column.append(v)
            t = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), t]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names=["doc_id", "repo", "path", "kind", "file_hash", "dense", "at", "blocks"])

    at = F.unix_micros(F.col("committed_at").cast("timestamp")) if "committed_at" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "repository_name", "file_path", "text", at.alias("at"))
    return rows.mapInArrow(run, "doc_id long, repo string, path string, kind string, file_hash long, dense int, at long, blocks array<struct<h: long, n: int>>")


def _member(name: str, h: int) -> int:
    """What a file, or a directory with a slash behind its name, adds to the hash of the directory that holds it."""
    return xxhash.xxh64_intdigest(f"{name}\0{h}".encode("utf-8", "surrogatepass"))


def _tree(mixed: int, n: int, held: int) -> int:
    return xxhash.xxh64_intdigest(f"{mixed} {n} {held}".encode()) - (1 << 63)


class Open:
    """A directory whose members are still being read: the mix of what it holds, its files at any depth, its members."""

    __slots__ = ("name", "mixed", "n", "held", "partial")

    def __init__(self, name: str, partial: bool) -> None:
        self.name, self.partial, self.mixed, self.n, self.held = name, partial, 0, 0, 0

    def take(self, name: str, h: int, n: int) -> None:
        self.mixed ^= _member(name, h)
        self.n += n
        self.held += 1


def _close_directories(batches):
    """Rows (repo, dir, value, n, held, partial) of sorted rows (repo, path, h): the tree hash of each directory that lies
    within the partition, and the mix so far of those that may begin before it or go on behind it."""
    stack: list[Open] = []
    here, first = None, True
    names = ["repo", "dir", "value", "n", "held", "partial"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    out: list[list] = [[] for _ in names]

    def emit(d: Open, partial: bool) -> int:
        value = d.mixed - (1 << 63) if partial else _tree(d.mixed, d.n, d.held)
        for column, v in zip(out, (here, "/".join([*(x.name for x in stack), d.name]), value, d.n, d.held, partial)):
            column.append(v)
        return value

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            d = stack.pop()
            value = emit(d, d.partial)
            if stack and not d.partial:
                stack[-1].take(d.name + "/", value, d.n)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for column in out:
            column.clear()
        return made

    for b in batches:
        for repo, path, h in zip(*(c.to_pylist() for c in b.columns)):
            *dirs, name = path.split("/")
            same = 0
            while repo == here and same < min(len(stack), len(dirs)) and stack[same].name == dirs[same]:
                same += 1
            close(same)
            here = repo
            stack += [Open(d, first) for d in dirs[same:]]
            stack[-1].take(name, h, 1)
            first = False
        yield batch()
    while stack:  # whether these are at their end, only the next partition knows
        emit(stack.pop(), True)
    yield batch()


def _complete(rows) -> list[tuple[str, str, int, int]]:
    """(repo, dir, tree, n) of the directories whose mixes come from several partitions, the deepest first. What holds such a
    directory is one itself."""
    whole: dict[tuple[str, str], Open] = {}
    for r in rows:
        d = whole.setdefault((r.repo, r.dir), Open(r.dir.rsplit("/", 1)[-1], True))
        d.mixed ^= r.value + (1 << 63)
        d.n += r.n
        d.held += r.held
    out = []
    for (repo, path), d in sorted(whole.items(), key=lambda x: -x[0][1].count("/")):
        value = _tree(d.mixed, d.n, d.held)
        out.append((repo, path, value, d.n))
        if "/" in path:
            whole[repo, path.rsplit("/", 1)[0]].take(d.name + "/", value, d.n)
    return out


def tree_hashes(files: DataFrame) -> DataFrame:
    """(repo, dir, tree, n) of each directory of files (repo, path, file_hash, at): its Merkle hash and number of files.

    A path that was scanned more than once counts as its newest scan left it (``at``; of equal ones the greatest hash).
    One sort by repository and path and one pass with a stack as deep as a path. What comes to the driver are the
    directories around the ends of partitions: twice a path's depth per partition at most, whatever the number of files."""
    spark = files.sparkSession
    newest = F.struct("at", "file_hash") if "at" in files.columns else F.struct("file_hash")
    once = files.groupBy("repo", "path").agg(F.max_by("file_hash", newest).alias("h")).where(F.col("path").contains("/"))
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, so that no partitions are put together later
    ordered = once.repartitionByRange(ways, "repo", "path").sortWithinPartitions("repo", "path")
    closed = cut(ordered.mapInArrow(_close_directories, "repo string, dir string, value long, n long, held long, partial boolean"), "trees")
    rest = spark.createDataFrame(_complete(closed.where("partial").collect()), "repo string, dir string, tree long, n long")
    return closed.where("not partial").select("repo", "dir", F.col("value").alias("tree"), "n").unionByName(rest)


def shared_trees(files: DataFrame, least: int = 2) -> DataFrame:
    """(repo, dir) of each directory tree of at least ``least`` files that another repository holds alike."""
    trees = tree_hashes(files).where(F.col("n") >= least)
    shared = trees.groupBy("tree", "n").agg(F.min("repo").alias("first"), F.max("repo").alias("last")).where("first <> last").select("tree", "n")
    return trees.join(shared, ["tree", "n"], "left_semi").select("repo", "dir")


def _inside(files: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of files in a shared directory or below one. Directories are matched once each, then their files."""
    parts = F.split("path", "/")
    placed = files.withColumn("dir", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    dirs = placed.where("dir <> ''").select("repo", "dir").distinct().withColumn("parts", F.split("dir", "/"))
    every = dirs.select("repo", F.col("dir").alias("held"), F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("dir"))
    held = every.join(shared, ["repo", "dir"], "left_semi").select("repo", F.col("held").alias("dir")).distinct()
    counted = cut(held.join(placed.groupBy("repo", "dir").agg(F.count("*").alias("n")), ["repo", "dir"]), "held")
    return join_counted(placed, counted, ["repo", "dir"])


def evidence(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, evidence, kind): each reason for which a document isn't hand-written; rid tells rows of one id apart.

    evidence: tree, file or block (an unrelated repository holds it alike) or alone (the file itself says so). Only files
    of source code count; null or empty texts and paths never do. A second scan of a repository's own file is no copy."""
    rid = F.xxhash64("doc_id", "repo", "path", "file_hash", "kind")
    files = cut(read_files(docs).withColumn("rid", rid).dropDuplicates(["rid"]), "files")
    shared = lambda keyed, k: cut(keyed.groupBy(k).agg(F.min("repo").alias("first"), F.max("repo").alias("last"), F.count("*").alias("n")).where("first <> last").select(k, "n"), "shared")
    size = F.aggregate("blocks.n", F.lit(0), lambda a, x: a + x)
    pieces = files.select("rid", "doc_id", size.alias("size"), F.explode("blocks").alias("b")).select("rid", "doc_id", "size", "b.h", "b.n")
    known = shared(files.select("repo", F.explode("blocks.h").alias("h")), "h")
    copies = (
        join_counted(pieces.withColumnRenamed("n", "chars"), known, "h")
        .groupBy("rid", "doc_id")
        .agg(F.sum("chars").alias("held"), F.max("size").alias("size"))
        .where((F.col("held") >= SHARED * F.col("size")) & (F.col("held") >= 3 * BLOCK))
    )
    whole = files.where(F.col("dense") >= 3 * BLOCK)
    alike = join_counted(whole, shared(whole.select("repo", "file_hash"), "file_hash"), "file_hash")
    said = lambda df, why, kind="vendored": df.select("doc_id", "rid", F.lit(why).alias("evidence"), F.lit(kind).alias("kind") if kind else F.col("kind"))
    return said(copies, "block").unionByName(said(alike, "file")).unionByName(said(_inside(files, shared_trees(files)), "tree")).unionByName(said(files.where("kind is not null"), "alone", None))


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, evidence) of each document that isn't hand-written: generated, minified, data or vendored; see evidence().

    What the file itself says of being made by a tool names the kind first. Repeated doc_ids are judged each, equal rows
    once; other columns are ignored."""
    rank = F.when((F.col("evidence") == "alone") & (F.col("kind") != "vendored"), 0).otherwise(1)
    return evidence(docs).groupBy("doc_id", "rid").agg(F.min_by("kind", rank).alias("kind"), F.array_sort(F.collect_set("evidence")).alias("evidence")).select("doc_id", "kind", "evidence")


def handwritten(docs: DataFrame) -> DataFrame:
    """The documents of source code that remain."""
    code = F.lower(F.regexp_extract("file_path", r"(\.[^./\\]+)$", 1)).isin(*CODE)
    return docs.where(code & (F.length(F.trim("text")) > 0)).join(classified(docs).select("doc_id"), "doc_id", "left_anti")
