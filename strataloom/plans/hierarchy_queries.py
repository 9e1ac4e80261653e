"""Queries of problem 3: hierarchies of CONTAINS links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import hierarchy as H


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return H.contains_links(spark.read.parquet(f"{sf}/git_relationships.parquet"))


QUERIES = {
    "p3_found": lambda s, d: H.hierarchy(_links(s, d)),
    "p3_paths": lambda s, d: H.full_paths(_links(s, d)),
    "p3_descendants": lambda s, d: H.ancestor_pairs(_links(s, d)),
    "p3_descendant_counts": lambda s, d: H.descendant_counts(_links(s, d)),
}

_LINKS = """
with recursive links as (
  select target_canonical_id as child, min(source_canonical_id) as parent from git_relationships
  where upper(trim(relationship_type)) = 'CONTAINS' and trim(source_canonical_id) <> '' and trim(target_canonical_id) <> ''
    and source_canonical_id <> target_canonical_id
  group by 1),
"""
_DOWN = """
down as (
  select l.child as node_id, l.parent as root_id, 1 as depth, l.parent || ' > ' || l.child as path
  from links l anti join links u on l.parent = u.child
  union all
  select l.child, d.root_id, d.depth + 1, d.path || ' > ' || l.child from links l join down d on l.parent = d.node_id)
"""
_WALK = """
stuck as (select child, parent from links anti join down on child = node_id),
walk as (
  select child as node, parent as spot, 1 as n from stuck
  union all
  select w.node, s.parent, w.n + 1 from walk w join stuck s on w.spot = s.child where w.n < (select 2 * count(*) + 1 from stuck)),
ring as (select node, min(spot) as root_id from walk where n > (select count(*) from stuck) group by 1)
"""
_PAIRS = """
up as (
  select child as node_id, parent as ancestor_id, 1 as distance from links semi join down on child = node_id
  union all
  select u.node_id, l.parent, u.distance + 1 from up u join links l on u.ancestor_id = l.child)
"""
ORACLE = {
    "p3_found": _LINKS + _DOWN + "," + _WALK + "select node_id, root_id, depth from down union all select node, root_id, -1 from ring",
    "p3_paths": _LINKS + _DOWN + "," + _WALK + "select node_id, path, root_id, depth from down union all select node, null, root_id, -1 from ring",
    "p3_descendants": _LINKS + _DOWN + "," + _PAIRS + "select ancestor_id, node_id, distance from up",
    "p3_descendant_counts": _LINKS + _DOWN + "," + _PAIRS + "select ancestor_id as node_id, count(*) as descendants, max(distance) as height from up group by 1",
}
