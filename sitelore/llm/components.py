"""Connected components in few shuffles: every node keeps its smallest neighbour, then parents are followed to the root.

1. A node that has several smaller neighbours keeps the smallest and passes it on to the others, which keeps components
   as they are. This is repeated until every node has one smaller neighbour at most, its parent. A round is one shuffle of
   the edges, streamed in the order of the nodes.
2. A node's parent is replaced by its parent's parent until all parents are roots, which halves the paths each time.

Edges that a node repeats count once; self links are ignored; a component is named by its smallest node; nodes without
edges are not in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.common import cut_lineage, partitions

MAX_ROUNDS = 100


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v, more) of edges u > v: each u with its smallest v, and, marked, the others of its v with that one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = last = None  # of the rows so far; they come ordered by u and v
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.r_[u[0] != node, u[1:] != u[:-1]]
            begin = np.flatnonzero(first)
            own = np.maximum.accumulate(np.where(first, np.arange(len(u)), -1))
            floor = np.where(own >= 0, v[np.maximum(own, 0)], least if least is not None else 0)
            again = np.r_[not first[0] and v[0] == last, (v[1:] == v[:-1]) & ~first[1:]]
            other = ~first & ~again & (v != floor)
            yield pa.record_batch([
                pa.array(np.r_[u[begin], v[other]]), pa.array(np.r_[v[begin], floor[other]]),
                pa.array(np.r_[np.zeros(len(begin), bool), np.ones(int(other.sum()), bool)])], ["u", "v", "more"])
            node, least, last = u[-1], floor[-1], v[-1]

    dealt = edges.select("u", "v").repartition(partitions(edges), "u").sortWithinPartitions("u", "v")
    return cut_lineage(dealt.mapInArrow(run, "u long, v long, more boolean"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the nodes of undirected edges (id_a, id_b)."""
    tree = edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u != v")
    for _ in range(MAX_ROUNDS):
        tree = _smallest(tree)
        if not tree.filter("more").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    tree = tree.select("u", "v")
    for _ in range(MAX_ROUNDS):
        above = tree.select(F.col("u").alias("v"), F.col("v").alias("w"))
        tree = cut_lineage(tree.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("more")))
        if not tree.filter("more").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = tree.select("v").distinct()
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
