"""Near-duplicate embeddings by cover trees and a dual traversal, exact at the threshold.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2 t). The top level of a label's tree is
a table: some vectors are centres, and every vector belongs to the cell of its nearest one. A vector also visits the
later cells whose border it is near enough to, since all that lies beyond a border is at least as far. Cells are cut into chunks of
bounded size; a chunk's tree has nested levels whose radii halve, and each node knows how far its farthest member lies. Two trees
are walked together: a pair of nodes is left as soon as their centres lie farther apart than the threshold and both
covering radii, and counted whole as soon as even their farthest members lie within it.

A task emits how many links each vector has and few edges with the same components, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.components import components, tree_edges
from linkspark.llm.grouping import name_components
from linkspark.llm.storage import materialize

THRESHOLD = 0.98
#: Vectors in a chunk, and cells of a label at most; larger cells have more chunks.
CHUNK = 2048
MAX_CELLS = 256
#: Centres that gather nothing, after which a node tries no more.
_TRIES = 64
_SLACK = 1e-6


class Points:
    """Unit vectors of some rows, and how many distances between them were taken."""

    def __init__(self, raw: np.ndarray) -> None:
        self.unit = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        self.taken = 0

    def cosines(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        self.taken += len(x) * len(y)
        return self.unit[x] @ self.unit[y].T

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.cosines(x, y)))


@dataclass
class Node:
    """center: the first member. reach: distance of the farthest. below: nodes of half the radius; a leaf has none."""

    members: np.ndarray
    reach: float
    below: list[Node]

    @property
    def center(self) -> int:
        return int(self.members[0])


def cover_tree(points: Points, members: np.ndarray, least: float, radius: float = 2.0) -> Node:
    """A tree over some rows; nodes of a radius up to ``least`` are leaves.

    Centres are tried in turn, each gathering what lies within half the radius. Those that gather nothing, and what is
    left after _TRIES such centres, make one leaf, whose radius isn't halved: too far apart for a tree to help.
    """
    far = points.apart(members[:1], members)[0]
    node = Node(members, float(far.max()), [])
    while radius / 2 >= node.reach and radius > least:
        radius /= 2
    if len(members) == 1 or radius <= least:
        return node
    left, near, gathered, alone = members, far <= radius / 2, [], []
    while True:
        near[0] = True
        (gathered if near.sum() > 1 else alone).append(left[near])
        left = left[~near]
        if not len(left) or len(alone) >= _TRIES:
            break
        near = points.apart(left[:1], left)[0] <= radius / 2
    node.below = [cover_tree(points, x, least, radius / 2) for x in gathered]
    if gathered and (alone or len(left)):
        rest = np.concatenate([*alone, left])
        node.below.append(Node(rest, float(points.apart(rest[:1], rest)[0].max()), []))
    return node


def dual_pairs(points: Points, first: Node, second: Node, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(members, members, all) of the pairs of nodes that may hold a pair within ``distance``, or whose pairs all are;
    a tree may meet itself, and then the pairs are those of distinct rows."""
    stack = [(first, second)]
    while stack:
        a, b = stack.pop()
        if not a.below and not b.below:
            yield a.members, b.members, False
            continue
        left, right = a.below or [a], b.below or [b]
        apart = points.apart(np.array([n.center for n in left]), np.array([n.center for n in right]))
        reach = np.array([n.reach for n in left])[:, None] + np.array([n.reach for n in right])[None, :]
        near, inside = apart <= distance + _SLACK + reach, apart + reach <= distance - _SLACK
        if a is b:
            near, inside = np.triu(near), np.triu(inside)
        for i, j in zip(*np.nonzero(near), strict=True):
            if inside[i, j]:
                yield left[i].members, right[j].members, True
            else:
                stack.append((left[i], right[j]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.values.slice(rows.offsets[0].as_py(), rows.offsets[-1].as_py() - rows.offsets[0].as_py()), np.float64).reshape(len(rows), -1)


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """One group: (a, null, links) for each class with links, and (a, b, 0) for edges of the same components."""
    ids, weight = np.asarray(table.column("class")), np.asarray(table.column("weight"))
    points, chunk = Points(_matrix(table.column("vector"))), np.asarray(table.column("chunk"))
    distance = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    parts = [np.flatnonzero(chunk == c) for c in sorted({lo, hi})]
    trees = [cover_tree(points, x, distance) for x in parts] if all(map(len, parts)) else []
    links, pairs = np.zeros(len(ids), np.int64), []
    for x, y, whole in dual_pairs(points, trees[0], trees[-1], distance) if trees else ():
        if whole:
            links[x] += weight[y].sum() - (weight[x] if x is y else 0)
            links[y] += 0 if x is y else weight[x].sum()
            pairs += [np.stack([np.broadcast_to(x[0], len(y)), y]), np.stack([x, np.broadcast_to(y[0], len(x))])]
            continue
        close = points.cosines(x, y) >= threshold
        if x is y:
            close = np.triu(close, 1)
        i, j = (k.astype(np.int64) for k in np.nonzero(close))
        np.add.at(links, x[i], weight[y[j]])
        np.add.at(links, y[j], weight[x[i]])
        pairs.append(np.stack([x[i], y[j]]))
    i, j = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    some = np.flatnonzero(links)
    edges = list(tree_edges(label[some], ids[some]))
    a = np.concatenate([ids[some], np.array([x for x, _ in edges], np.int64)])
    b = pa.array([None] * len(some) + [y for _, y in edges], pa.int64())
    return pa.table([pa.array(a, pa.int64()), b, pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]), pa.int64())], ["a", "b", "links"])


def cells_of(raw: np.ndarray, centers: np.ndarray, distance: float) -> tuple[np.ndarray, list[list[int]]]:
    """Each row's cell, that of its nearest center, and the later cells that may hold a row within ``distance``.

    What is nearer to another center lies beyond the plane halfway between the two.
    """
    unit, at = Points(raw).unit, Points(centers).unit
    square = np.maximum(0.0, 2.0 - 2.0 * (unit @ at.T))
    home = np.argmin(square, axis=1)
    between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (at @ at.T)))[home]
    beyond = square - np.take_along_axis(square, home[:, None], axis=1)
    visits = (beyond <= 2.0 * between * (distance + _SLACK) + _SLACK) & (np.arange(len(at))[None, :] > home[:, None])
    return home, [np.flatnonzero(x).tolist() for x in visits]


def _dealt(classes: DataFrame, chunk: int, cells: int, distance: float) -> DataFrame:
    """``classes`` with (chunk, lo, hi): every two that may link and are of one label meet in one group of a cell, lo and hi."""
    by = ["label", "size"]
    groups = classes.groupBy(*by).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_salts")).filter("_salts > 0")
    groups = materialize(groups, "labels").withColumn("_cells", F.least("_salts", F.lit(cells)))
    order = Window.partitionBy(*by).orderBy(F.xxhash64("class"), "class")
    centers = classes.withColumn("_cell", F.row_number().over(order) - 1).filter(F.col("_cell") < cells).join(groups, by).filter("_cell < _cells and _cells > 1")
    centers = centers.select(*[F.col(c).alias(c) for c in by], "_cell", F.col("vector").alias("center"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    # Dealt anew after the joins, as rows that one dealt by the label would all stay in one task.
    salted = classes.join(groups, by).withColumn("_salt", F.pmod(F.xxhash64("class", F.lit("salt")), F.col("_salts")).cast("int")).drop("_salts", "_cells").repartition(*by, "_salt")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            right = right.sort_by("_cell")
            home, visits = cells_of(_matrix(left.column("vector")), _matrix(right.column("center")), distance)
        else:
            home, visits = np.zeros(left.num_rows, np.int64), [[]] * left.num_rows
        return left.drop_columns(["_salt"]).append_column("cell", pa.array(home, pa.int32())).append_column("visits", pa.array(visits, pa.list_(pa.int32())))

    keys = [*by, "_salt"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", cell int, visits array<int>"
    placed = materialize(salted.groupBy(*keys).cogroup(centers.groupBy(*keys)).applyInArrow(place, schema), "cells")
    in_cell = placed.select(*classes.columns, "cell", F.lit(True).alias("home")).unionByName(placed.select(*classes.columns, F.explode("visits").alias("cell"), F.lit(False).alias("home")))
    count = F.ceil(F.count(F.when(F.col("home"), 1)) / chunk).cast("int"), F.ceil(F.count(F.when(~F.col("home"), 1)) / chunk).cast("int")
    sums = materialize(in_cell.groupBy(*by, "cell").agg(count[0].alias("_homes"), count[1].alias("_guests")), "cell-sizes")
    cut = in_cell.join(sums, [*by, "cell"])
    number = F.xxhash64("class", F.lit("chunk"))
    cut = cut.withColumn("chunk", F.when(F.col("home"), F.pmod(number, F.col("_homes"))).otherwise(F.col("_homes") + F.pmod(number, F.col("_guests"))).cast("int"))
    last = F.when(F.col("home"), F.col("_homes") + F.col("_guests")).otherwise(F.col("_homes")) - 1
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return cut.select(*classes.columns, "cell", "chunk", F.least("chunk", "_other").alias("lo"), F.greatest("chunk", "_other").alias("hi"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine in double
    precision is at least ``threshold``. Null, empty and zero vectors and those with null or non-finite components
    link with nothing. Equal vectors, by SHA-256, form a class and link with each other without being compared. Rows that share
    an id are vectors of their own under one id; rows without an id never name a component that has one. An empty table gives no rows.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    digest = F.unhex(F.sha2(F.concat_ws("|", F.col(label_col).cast("string"), v.cast("array<double>").cast("string")), 256))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, digest).alias("digest"), F.col(label_col).alias("label"), v.cast("array<double>").alias("vector"))
    one_each = rows.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    table = materialize(one_each.withColumn("size", F.size("vector")).withColumn("class", F.monotonically_increasing_id()), "vectors")
    members = materialize(rows.select("vec_id", "digest").join(table.select("digest", "class"), "digest", "left").select("vec_id", "class"), "vector-classes")
    classes = table.drop("digest")
    distance = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))

    def run(part: pa.Table) -> pa.Table:
        return _linked(part, threshold)

    group = ["label", "size", "cell", "lo", "hi"]
    met = _dealt(classes, CHUNK, MAX_CELLS, distance).repartition(*group).groupBy(*group)
    found = materialize(met.applyInArrow(run, "a long, b long, links long"), "links")
    joined = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    per_class = materialize(classes.select("class", "weight").join(links, "class", "left").select("class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "class-links")
    named = name_components(members, joined, "vec_id", "class").join(per_class, "class", "left")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Components by a recursive walk over links.
ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, coalesce(m.b >= vec_id, true) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id
"""
