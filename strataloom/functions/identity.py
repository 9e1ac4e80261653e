"""Ids that follow from content or place, and parts of repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def document_id(content: Column | str) -> Column:
    """doc_ and ten hex digits of the content's hash: the same content has the same id in every run."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 10))


def chunk_id(document: Column | str, page: Column | str, sub: Column | str) -> Column:
    return F.concat(document, F.lit("_p"), page, F.lit("_c"), sub)


def tidy_path(c: Column | str) -> Column:
    """Forward slashes, none at the ends, no leading ./"""
    x = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    return F.regexp_replace(x, "^/+|/+$", "")


def repo_id(repo: Column) -> Column:
    return F.concat(F.lit("repo:"), repo)


def part_id(repo: Column, kind: str, what: Column) -> Column:
    """repo:R:dir:P, repo:R:file:P, repo:R:mod:M, repo:R:service:S"""
    return F.concat(repo_id(repo), F.lit(f":{kind}:"), tidy_path(what) if kind in ("dir", "file") else what)


def member_id(file: Column, owner_class: Column | None, name: Column, kind: str) -> Column:
    """...:class:C, ...:func:F, or ...:class:C:method:M"""
    return F.concat(file, F.lit(":class:"), owner_class, F.lit(f":{kind}:"), name) if owner_class is not None else F.concat(file, F.lit(f":{kind}:"), name)


def api_id(repo: Column, method: Column, path: Column) -> Column:
    return F.concat(repo_id(repo), F.lit(":api:"), F.upper(method), F.lit("_"), F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/", "_"))


def shared_id(kind: str, name: Column) -> Column:
    """lib:X, tech:X and concept:X are one for all repositories."""
    return F.concat(F.lit(f"{kind}:"), name)


def valid_url(c: Column | str) -> Column:
    return F.coalesce(F.rlike(F.col(c) if isinstance(c, str) else c, F.lit(r"^(?:https?://|git@|ssh://)[\w.@:/\-~]+$")), F.lit(False))


def url_repo(c: Column | str) -> Column:
    return F.regexp_extract(c, r"[/:]([^/:]+?)(?:\.git)?/*$", 1)


def url_owner(c: Column | str) -> Column:
    return F.regexp_extract(c, r"[/:]([^/:]+)/[^/:]+/*$", 1)


def legacy_temporary(name: Column, url: Column) -> Column:
    """Whether a repository is a leftover of a temporary clone."""
    u = F.coalesce(url, F.lit(""))
    return name.startswith("tmp") | (name == ".") | u.contains("AppData") | u.contains("\\Temp\\") | u.contains("/tmp/")


# Casts that a graph database puts behind its values.
_CASTS = "vertex|edge|path|numeric|int|float|bool|agtype"


def graph_value(c: Column | str) -> tuple[Column, Column]:
    """(json, plain) of a value as a graph database prints it: its JSON without the cast, with empty properties where a
    labelled value has none; the bare text where it is no JSON."""
    bare = F.trim(F.regexp_replace(F.trim(c), f"::({_CASTS})$", ""))
    known = F.is_valid_utf8(bare) & F.try_parse_json(bare).isNotNull()
    bald = F.coalesce(F.get_json_object(bare, "$.label").isNotNull() & F.get_json_object(bare, "$.properties").isNull(), F.lit(False))
    whole = F.when(bald & bare.endswith("}"), F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(', "properties": {}}'))).otherwise(bare)
    return F.when(known, whole), F.when(~known, bare)
