"""Connected components of an undirected edge list, by contraction.

Each round every node takes its least neighbour, if that is less than itself, as its parent;
parents are followed some steps; then the ends of all edges become their parents and equal edges
one. Only a node less than all its neighbours stays, so a graph is gone after few rounds,
paths and stars alike. Edges of a hub are dealt into parts and its parent is sent to each of
them, so that no task gathers a hub or a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.sources.shared import drop, materialise

#: Edges of a node that one key of a join has.
HUB = 50_000
#: Rows of a table that is sent to every executor, two ids each; a longer one is joined by key.
BROADCAST_ROWS = 500_000
#: Times that parents become parents' parents in a round: a chain of 2 ** STEPS nodes becomes one.
STEPS = 3


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _parents(edges: DataFrame, name: str) -> DataFrame:
    """``node, label, parts``: each node's parent and the parts its edges are dealt into."""
    near = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    found = materialise(near, f"{name}-parents")
    for _ in range(STEPS):
        # Parents that have a parent themselves, each once, however many children it has.
        above = found.where("label < node").select("node", F.col("label").alias("further"))
        hop = materialise(found.select(F.col("label").alias("node")).distinct().join(above, "node").withColumnRenamed("node", "label"), f"{name}-hop")
        if hop.isEmpty():
            drop(hop)
            break
        moved = materialise(found.join(_sent(hop), "label", "left").select("node", F.coalesce("further", "label").alias("label"), "parts"), f"{name}-parents")
        drop(found)
        drop(hop)
        found = moved
    return found


def _contracted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between different parents, each once."""
    hubs = parents.where("parts > 1").select("node", "parts")
    part = lambda n, other: F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col(n))).cast("int")
    a, b = (_sent(hubs.select(F.col("node").alias(end), F.col("parts").alias(f"{end}_parts"))) for end in "ab")
    dealt = edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", part("a_parts", "b").alias("a_part"), part("b_parts", "a").alias("b_part"))
    told = lambda end: parents.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{end}_part"))
    both = dealt.join(told("a"), ["a", "a_part"]).join(told("b"), ["b", "b_part"])
    return both.where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct()


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; the label is the least node of its component.

    Each round's edges and parents are written tables, smaller from round to round; edges of a
    round before are dropped. An empty edge list gives an empty table. Edges with a null end are
    left out; a node whose only edge is to itself is its own component.
    """
    sound = edges.where("a is not null and b is not null").select("a", "b")
    # Written at once, as the caller may remove its edges when it has the labels.
    alone = materialise(sound.where("a = b").select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")), f"{name}-alone")
    left = materialise(sound.where("a <> b").union(sound.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    rounds = []
    while not left.isEmpty():
        rounds.append(_parents(left, name))
        smaller = materialise(_contracted(left, rounds[-1]), f"{name}-edges")
        drop(left)
        left = smaller
    drop(left)
    known = None
    for parents in reversed(rounds):
        found = parents.select("node", "label")
        if known is not None:
            roots = known.select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = found.join(_sent(roots), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
        found = materialise(found, f"{name}-labels")
        for done in [parents] + [known] * (known is not None):
            drop(done)
        known = found
    if known is None:
        return alone
    return known.unionByName(alone.join(known.select("node"), "node", "left_anti"))
