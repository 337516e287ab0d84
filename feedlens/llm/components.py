"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the given links but the smallest ones."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _condense(links: DataFrame, held_rows: int = 1_000_000) -> DataFrame:
    """Replace the links of each task by stars, ``held_rows`` links at a time: at most one row for each node of those."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def stars():
            t = pa.Table.from_batches(held)
            v, u = star_forest(t.column(0).to_numpy(), t.column(1).to_numpy())
            for lo in range(0, len(v), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 100_000]), pa.array(u[lo : lo + 100_000])], ["v", "u"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= held_rows:
                    yield from stars()
                    held = []
        if held:
            yield from stars()

    return links.mapInArrow(run, "v long, u long")


def _unfinished(edges: DataFrame) -> bool:
    """True while a node has two edges down, or is at both ends of edges."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("u", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes that links (a, b) join to a smaller one; root is the smallest of the component.

    Links in either direction, repeated ones and links of a node with itself
    are allowed; nodes that are their own root aren't returned. Each round
    brings the edges of a node together, contracts what meets in one task to
    stars, and sends each edge on to its end's own smaller end, so the longest
    chain halves. A node with very many links costs one row for each task that
    holds some of them. Nothing but the answer, whether it is done, reaches the driver.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).where("v <> u")
    edges = settle(_condense(_condense(links).repartition("v")), "edges")
    while _unfinished(edges):
        hop = edges.groupBy("v").agg(F.min("u").alias("next")).withColumnRenamed("v", "u")
        moved = edges.join(hop, "u", "left").select("v", F.coalesce("next", "u").alias("u"))
        new = settle(_condense(_condense(moved).repartition("v")), "edges")
        forget(edges)
        edges = new
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
