"""File formats by name and first bytes, and text out of simple formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refdata, text


def extension(name: Column | str) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.\\/]+)$", 1))


def detect(name: Column | str, head: Column | None = None) -> Column:
    """The format by extension, else by the first bytes of the content; null if neither tells."""
    by_name = refdata.lookup(refdata.EXTENSION_FORMAT, F.nullif(extension(name), F.lit("")))
    return F.coalesce(by_name, sniff(head)) if head is not None else by_name


def sniff(head: Column) -> Column:
    """The format that the first bytes of a binary column show."""
    starts = lambda *marks: F.startswith(F.hex(F.substring(head, 1, 64)), F.lit(marks[0])) if len(marks) == 1 else starts(marks[0]) | starts(*marks[1:])
    first = F.lower(F.ltrim(F.decode(F.substring(head, 1, 64), "ISO-8859-1")))
    return (
        F.when(starts("255044462D"), "pdf")
        .when(starts("50415231"), "parquet")
        .when(starts("4152524F5731", "46454131"), "feather")
        .when(starts("7B5C727466"), "rtf")
        .when(first.startswith("<?xml"), "xml")
        .when(first.startswith("<html") | first.startswith("<!doctype html"), "html")
        .when(first.startswith("{") | first.startswith("["), "json")
    )


def verified(fmt: Column, head: Column) -> Column:
    """Whether the first bytes allow the format: only Parquet and RTF are refused, as the others may begin otherwise."""
    found = sniff(head)
    return F.when(fmt.isin("parquet", "rtf"), F.coalesce(found == fmt, F.lit(False))).otherwise(F.lit(True))


def mime(fmt: Column) -> Column:
    return refdata.lookup(refdata.FORMAT_MIME, fmt)


def category(fmt: Column) -> Column:
    return refdata.lookup(refdata.FORMAT_CATEGORY, fmt)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, without its mark, else Latin-1, which takes any."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def rtf_text(c: Column | str) -> Column:
    x = F.regexp_replace(c, r"\\'[0-9a-fA-F]{2}", "")
    x = F.regexp_replace(x, r"\\[a-zA-Z]+-?\d* ?", "")
    return text.strip(F.regexp_replace(x, r"[{}]", ""))


def html_text(c: Column | str) -> Column:
    """Text of HTML: scripts, styles, notes for browsers without scripts and drawings go with what they hold; tags turn to
    blanks, and with them those of meta, which hold nothing."""
    for tag in ("script", "style", "noscript", "svg"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"[ \t\r\n]+", " "))


def html_title(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def sql_statements(c: Column | str) -> Column:
    """Statements of a script, as semicolons part them."""
    return F.size(F.filter(F.split(c, r";\s*"), lambda s: text.strip(s) != ""))


def column_type(values: Column | str) -> Column:
    """Aggregate: Integer, Float, Boolean or String for values of a column; blanks don't count, none at all is String."""
    v = text.strip(values)
    some = v != ""
    every = lambda cond: F.coalesce(F.bool_and(F.when(some, cond)), F.lit(False))
    return (
        F.when(F.count_if(some) == 0, "String")
        .when(every(v.rlike(r"^-?[0-9]+$")), "Integer")
        .when(every(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$")), "Float")
        .when(every(F.lower(v).isin("true", "false", "yes", "no", "0", "1")), "Boolean")
        .otherwise("String")
    )


def infer_types(df: DataFrame) -> DataFrame:
    """(column, type) of every column of a table of strings."""
    agg = df.agg(*[column_type(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("type")) for c in df.columns])
    return agg.select(F.explode(pairs).alias("x")).select("x.*")


def classify(path: Column | str) -> tuple[Column, Column, Column]:
    """(language, file type, is a test) of a file by its path."""
    p = F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/")))
    base = F.regexp_extract(p, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r".(\.[^.]+)$", 1)

    def pick(i: int) -> Column:
        by_name = refdata.lookup({k: v[i] for k, v in refdata.LANGUAGE_BY_NAME.items()}, base)
        by_ext = refdata.lookup({k: v[i] for k, v in refdata.LANGUAGE_BY_EXTENSION.items()}, F.nullif(ext, F.lit("")))
        return (
            F.when(by_name.isNotNull(), by_name)
            .when(base.startswith("dockerfile"), ("Dockerfile", "DOCKER")[i])
            .when(base.contains("docker-compose") | base.contains("compose."), ("DockerCompose", "DOCKER")[i])
            .when(base.startswith("requirements") & (ext == ".txt"), ("Requirements", "CONFIG")[i])
            .otherwise(F.coalesce(by_ext, F.lit(("Unknown", "OTHER")[i])))
        )

    rooted = F.concat(F.lit("/"), p)
    test = base.startswith("test_") | base.rlike(r"(_test\.py|\.(test|spec)\.(js|ts))$") | rooted.contains("/tests/") | rooted.contains("/test/")
    return pick(0), pick(1), test


def inventory(files: DataFrame, path_col: str = "file_path", text_col: str = "text") -> DataFrame:
    """(language, file_type, n_files, n_lines, n_bytes, n_tests) of files with their texts; null texts count no line."""
    lang, kind, test = classify(path_col)
    one = files.select(lang.alias("language"), kind.alias("file_type"), test.alias("test"), text.line_count(F.coalesce(text_col, F.lit(""))).alias("lines"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("bytes"))
    return one.groupBy("language", "file_type").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines"), F.sum("bytes").alias("n_bytes"), F.count_if("test").alias("n_tests"))
