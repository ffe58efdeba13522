"""Connected components by contraction: point every node at its least neighbour, jump to the roots, relabel, repeat.

Only aggregates and joins of written tables move rows, so a node or component that a third of all rows belong to is
pre-aggregated or split by the join; the driver sees a count a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import materialize

#: Degree of the trees that stand for a group of linked rows: no node gets many edges, and trees stay shallow.
FAN = 16


def tree_edges(groups: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Few edges with the same components: ids of equal group label form a tree with smaller ids nearer the root."""
    order = np.lexsort((ids, groups))
    g, x = groups[order], ids[order]
    if not len(g):
        return
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])).tolist()
    for a, b in zip(starts, [*starts[1:], len(g)], strict=True):
        part = x[a:b].tolist()
        for k in range(1, len(part)):
            yield part[(k - 1) // FAN], part[k]


def matrix_groups(linked: np.ndarray) -> np.ndarray:
    """The least row reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of edges (a long, b long).

    Repeated edges, loops and either direction are fine; no edges give no rows. The number of rounds grows with the
    logarithm of the longest path.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent")), "parents")
        parents = _jump(parents)
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            to = parents.select(F.col("node").alias("label"), "parent")
            labels = materialize(labels.join(to, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialize(moved.distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def _jump(parents: DataFrame) -> DataFrame:
    """Every node points at the root of its tree."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        jumped = materialize(parents.join(up, "parent").select("node", F.col("upper").alias("parent"), (F.col("upper") != F.col("parent")).alias("moved")), "jumped")
        done = jumped.filter("moved").isEmpty()
        parents = jumped.drop("moved")
        if done:
            return parents
