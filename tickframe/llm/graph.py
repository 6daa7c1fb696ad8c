"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them. Links point downwards: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Links that one task contracts on its own before the rounds.
TASK_LINKS = 500_000


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected to it) for the nodes of these links that are not the smallest themselves."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = places[:len(a)], places[len(a):]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        high, low = np.maximum(p, q)[apart], np.minimum(p, q)[apart]
        up = np.arange(len(nodes))
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _contract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(source)
    if held:
        links = pa.Table.from_batches(held)
        node, root = spanning_stars(links.column("a").to_numpy(), links.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the smallest node it reaches. ``links`` has long
    columns a and b; either order, repeats, loops and nulls (ignored) are allowed.

    First every task contracts a bounded number of links to a forest of their nodes, so that the many links of a dense
    group do not reach the rounds. Each round is written to the shared folder. The rounds grow with the logarithm of the
    longest path, and end when a round leaves a star forest as it was. Sums are of decimals, so no value is too large.
    """
    raw = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    parts = raw.count() // TASK_LINKS + 1
    now = saved(raw.coalesce(parts).mapInArrow(_contract, "a long, b long"), "forests")
    before = None
    while True:
        key = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if key == before or key[0] == 0:
            break
        before = key
        now = saved(_small_star(_large_star(now)), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
