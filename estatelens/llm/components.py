"""Groups of ids that matches link directly or indirectly.

Deterministic Boruvka hooking over distributed edges: in every round each component hooks onto
its smallest neighbour, which under the order of edges by (smaller end, larger end) is its
smallest outgoing edge, so only two-cycles arise and the smaller end becomes the root. Trees
collapse by pointer doubling, edges are relabelled and deduplicated, and rounds go on until no
edge is left. A round at least halves the components that still have edges.

Nothing is collected. Labels, parents and edges are cut with reliable checkpoints, so a lost
executor costs no more than one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.session import cut


def clean_id(c: Column) -> Column:
    """Id without surrounding white space and in lower case; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)


def undirected(links: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct edges (u < v) without loops and without links that lack an end."""
    ends = links.select(clean_id(F.col(left)).alias("a"), clean_id(F.col(right)).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _collapse(parents: DataFrame) -> DataFrame:
    """Pointer doubling of (id, up) until every id points to a root (a root points to itself)."""
    while True:
        upper = parents.select(F.col("id").alias("p_id"), F.col("up").alias("p_up"))
        doubled = cut(parents.join(upper, F.col("up") == F.col("p_id")).select("id", F.col("p_up").alias("up"), (F.col("p_up") != F.col("up")).alias("moved")))
        parents = doubled.select("id", "up")
        if doubled.filter("moved").isEmpty():
            return parents


def follow(up: DataFrame) -> DataFrame:
    """(id, up) where chains of (id, up) are followed to their end; an end need not have a row, and chains have no cycles."""
    while True:
        upper = up.select(F.col("id").alias("p_id"), F.col("up").alias("p_up"))
        doubled = cut(up.join(upper, F.col("up") == F.col("p_id"), "left").select("id", F.coalesce("p_up", "up").alias("up"), F.col("p_id").isNotNull().alias("moved")))
        up = doubled.select("id", "up")
        if doubled.filter("moved").isEmpty():
            return up


def connected_groups(edges: DataFrame) -> DataFrame:
    """(id, group) for every end of ``edges`` (u, v with u < v, distinct); group is the smallest id of the component."""
    edges = cut(edges)
    labels = None
    while not edges.isEmpty():
        ways = edges.select(F.col("u").alias("id"), F.col("v").alias("to")).unionAll(edges.select(F.col("v").alias("id"), F.col("u").alias("to")))
        hooks = cut(ways.groupBy("id").agg(F.min("to").alias("up")))
        upper = hooks.select(F.col("id").alias("p_id"), F.col("up").alias("p_up"))
        # of two ends that hook onto each other the smaller is the root
        parents = hooks.join(upper, F.col("up") == F.col("p_id")).select("id", F.when((F.col("p_up") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up"))
        parents = _collapse(cut(parents))
        if labels is None:
            labels = parents.select("id", F.col("up").alias("label"))
        else:
            labels = cut(labels.join(parents.select(F.col("id").alias("p_id"), "up"), F.col("label") == F.col("p_id"), "left").select("id", F.coalesce("up", "label").alias("label")))
        left, right = (parents.select(F.col("id").alias(f"{x}_id"), F.col("up").alias(f"{x}_up")) for x in "uv")
        moved = edges.join(left, F.col("u") == F.col("u_id")).join(right, F.col("v") == F.col("v_id")).filter(F.col("u_up") != F.col("v_up"))
        edges = cut(moved.select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v")).distinct())
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    names = labels.groupBy("label").agg(F.min("id").alias("group"))
    return labels.join(names, "label").select("id", "group")


def match_groups(links: DataFrame, left: str = "left_cluster_id", right: str = "right_cluster_id", is_match: str = "is_match") -> DataFrame:
    """(cluster_id, group_id) of every id that a true match joins to a different id.

    Links that are false or null, loops, repeats, reversed repeats and links lacking an end add
    nothing. An empty table gives an empty result. Further columns are not read.
    """
    return connected_groups(undirected(links.filter(F.col(is_match).eqNullSafe(F.lit(True))), left, right)).select(F.col("id").alias("cluster_id"), F.col("group").alias("group_id"))
