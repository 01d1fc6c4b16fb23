"""Connected components of an edge list: in one task while it is small, else by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ship_package
from .scratch import Scratch

#: Edges up to which one task (of some 100 MB) settles the components; beyond, the distributed rounds do.
ONE_TASK = 1_000_000


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least node of the component of each node, by the same rounds on arrays."""
    edges = [b[["a", "b"]].to_numpy(dtype=np.int64) for b in batches]
    if not edges:
        return
    both = np.concatenate(edges)
    nodes, places = np.unique(both, return_inverse=True)
    a, b = places.reshape(both.shape).T
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least)
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    yield pd.DataFrame({"node": nodes, "label": nodes[label]})


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) as a written table (node, label): the least node that each node is connected with.

    Each round takes the least label around every node, gives it to the node of
    the former label as well, and then takes the label's own label, so rounds grow
    with the logarithm of a chain's length; labels only fall, and the loop ends
    when none does.  Every round is a written table: no lineage builds up and nothing but
    a count of changes reaches the driver.  Edges are few next to documents; up
    to ONE_TASK of them, which edges must be a written table to count cheaply,
    are settled in one task instead.
    """
    if edges.count() <= ONE_TASK:
        ship_package(scratch.spark)
        return scratch.keep(edges.select("a", "b").coalesce(1).mapInPandas(_settle, "node bigint, label bigint"), "labels")
    both = edges.where("a != b").select("a", "b").union(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        least = scratch.keep(labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "least")
        hooks = least.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        hooked = scratch.keep(least.join(hooks, "node", "left").select("node", "old", F.least("label", "hook").alias("label")), "hooked")
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = scratch.keep(hooked.join(above, "label").select("node", "old", F.col("next").alias("label")), "jumped")
        scratch.drop(labels)
        scratch.drop(least)
        scratch.drop(hooked)
        labels = jumped
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            break
    scratch.drop(both)
    out = labels.select("node", "label")
    out._scratch_path = labels._scratch_path
    return out
