"""Outline trees kept as edges: depth-first order without recursion."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.ranking import with_group_rank
from shelfmark.plans.skew import salted_lookup
from shelfmark.session import cut_lineage


def outline_paths(nodes: DataFrame) -> DataFrame:
    """Append ``path``, the (ord, node_id) steps from the root down, to every reachable node.

    Siblings with equal ``ord`` are ordered by id, so their children stay together. Only the narrow rows of
    nodes still on their way go through the rounds; titles are joined at the end.
    Each round joins a node to the ancestor it has reached so far, which doubles the
    distance covered: a tree of depth d takes about log2(d) joins instead of d. A parent
    with very many children is salted. Nodes that reach no root (missing parent, cycle)
    are not part of any outline and are left out, as in a nested list.
    """
    step = F.struct("ord", "node_id")
    state = nodes.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.array(step).alias("path"))
    waiting, done = None, []
    while True:
        pending = state.where(F.col("up").isNotNull())
        done.append(state.where(F.col("up").isNull()))
        above = reduce(DataFrame.unionByName, [pending, *done]).select(
            "doc_id",
            F.col("node_id").alias("up"),
            F.col("up").alias("next_up"),
            F.col("path").alias("prefix"),
        )
        state = cut_lineage(salted_lookup(pending, above, ["doc_id", "up"], ["node_id"], "inner").select(
            "doc_id", "node_id", F.col("next_up").alias("up"), F.concat("prefix", "path").alias("path")))
        left = state.where(F.col("up").isNotNull()).count()
        if left == 0 or left == waiting:
            settled = reduce(DataFrame.unionByName, [*done, state.where(F.col("up").isNull())]).drop("up")
            return nodes.join(settled, ["doc_id", "node_id"])
        waiting = left


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """Entries with depth and ``path``; ordering by ``doc_id, path`` is depth-first."""
    return outline_paths(nodes).select(
        "doc_id", "node_id", "title", "page_index", (F.size("path") - 1).alias("depth"), "path"
    )


def preorder_rank(nodes: DataFrame) -> DataFrame:
    """Position of each entry in the depth-first order of its document."""
    flat = flatten_outline(nodes)
    return with_group_rank(flat, ["doc_id"], ["path"], "position", ["node_id"]).select(
        "doc_id", "node_id", "title", "page_index", "depth", "position"
    )
