"""Connected components of a link table, by contraction.

First every task joins up what it holds (union-find over at most ``block`` links), which leaves one link a node and task.
Then, in every round, each node points to the neighbour (or itself) that comes first - by number in the first round, later
in a pseudo-random order drawn for the round - and the links are rewritten between the targets. A constant share of the nodes
disappears in each round whatever the shape of the graph - paths included - so the number of rounds is logarithmic. Links
never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as one link (node, least node reachable within the task) for each node but the least."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, places = np.unique(np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()]), return_inverse=True)
    at, n = list(range(len(nodes))), table.num_rows
    for x, y in zip(places[:n].tolist(), places[n:].tolist()):
        while at[x] != x:
            at[x] = x = at[at[x]]
        while at[y] != y:
            at[y] = y = at[at[y]]
        if x < y:
            at[y] = x
        else:
            at[x] = y
    for x in range(len(at)):  # parents have smaller places
        at[x] = at[at[x]]
    root = nodes[at]
    moved = root != nodes
    yield pa.record_batch([pa.array(root[moved]), pa.array(nodes[moved])], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 100, block: int = 1 << 20) -> DataFrame:
    """links: (a BIGINT, b BIGINT). Returns a table (node, component) for every node with a link to another one;
    component is the least node reachable. Self-links, repeated links and nulls are ignored."""
    given = cut(links.select("a", "b").where("a <> b"))
    parts = -(-given.count() // block) or 1
    edges = cut((given.coalesce(1) if parts == 1 else given.repartition(parts)).mapInArrow(forest, "a long, b long").distinct())
    drop_cut(given)
    if parts == 1:  # one task has seen every link: its forest is the answer
        out = cut(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct()))
        drop_cut(edges)
        return out
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("at"))
    first, steps = edges, []
    for k in range(most_rounds):
        if edges.isEmpty():
            break
        order = lambda c: F.struct((F.xxhash64(F.lit(k), c) if k else c).alias("h"), c.alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        near = both.groupBy("v").agg(F.min(order(F.col("w"))).alias("w"))
        point = cut(near.select("v", F.least(F.col("w"), order(F.col("v"))).getField("to").alias("to")).where("v <> to"))
        steps.append(point)
        left, right = point.select(F.col("v").alias("a"), F.col("to").alias("ta")), point.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        old, edges = edges, cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if old is not first:
            drop_cut(old)
    else:
        raise RuntimeError("contraction did not end")
    for point in steps:  # where each node went, round by round; one job in the end
        nodes = nodes.join(point.select(F.col("v").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    out = cut(nodes.join(least, "at").select("node", "component"))
    for t in {id(x): x for x in (first, edges, *steps)}.values():
        drop_cut(t)
    return out
