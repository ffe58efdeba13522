"""Groups of any size in parts of bounded size, and the names of components."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.components import components
from linkspark.llm.storage import materialize

EDGES = "a long, b long"


def group_edges(rows: DataFrame, keys: list[str], id_col: str, weight: str, most: int, link: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(a, b): edges with the components of all pairs that ``link`` finds among rows of equal keys.

    ``link`` gets some rows of one group and returns edges (a long, b long) with the components of the pairs among
    them. A group is cut into chunks of about ``most`` of ``weight`` (an SQL expression). Each chunk meets its group's
    first one, which joins the copies of one text into one component at a cost that grows with the group only, not
    with its square. Rows outside a group's largest component then meet all chunks, so no pair that could join two
    components is left out; pairs inside one needn't be looked at. Groups of one row have no pairs.
    """
    sums = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(F.expr(weight)).alias("_sum")).filter("_rows > 1")
    # A written table, so that the join splits keys with many rows.
    sums = materialize(sums.select(*keys, F.ceil(F.col("_sum") / most).cast("int").alias("_chunks")), "groups")
    cut = rows.join(sums, keys).withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int"))
    meets = F.when(F.col("_chunk") == 0, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(F.array("_chunk"))
    # Dealt anew, as rows that the join dealt by the keys would all stay in one task.
    dealt = cut.withColumn("_at", F.explode(meets)).drop("_chunk", "_chunks").repartition(*keys, "_at")
    first = materialize(dealt.groupBy(*keys, "_at").applyInArrow(link, EDGES), "links")
    if sums.filter("_chunks > 1").isEmpty():
        return first
    cut = cut.filter("_chunks > 1")
    labels = components(first).withColumnRenamed("node", id_col)
    members = materialize(cut.select(*keys, id_col).join(labels, id_col, "left").withColumn("label", F.coalesce("label", id_col)), "members")
    sizes = members.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    main = materialize(sizes.groupBy(*keys).agg(F.max(F.struct("_n", "label")).alias("_main")), "main")
    rest = members.join(main, keys).filter("label <> _main.label").select(*keys, id_col)
    rest = materialize(cut.join(rest, [*keys, id_col], "left_semi"), "rest")
    parts = materialize(rest.groupBy(*keys).agg(F.ceil(F.sum(F.expr(weight)) / most).cast("int").alias("_parts")), "parts")
    left = rest.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(id_col, F.lit("part")), F.col("_parts")).cast("int")).withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    right = cut.join(parts, keys).withColumn("_at", F.col("_chunk")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = left.select(*rows.columns, "_at", "_part").unionByName(right.select(*rows.columns, "_at", "_part"))
    return first.unionByName(both.repartition(*keys, "_at", "_part").groupBy(*keys, "_at", "_part").applyInArrow(link, EDGES))


def name_components(members: DataFrame, joined: DataFrame, id_col: str, class_col: str) -> DataFrame:
    """``members`` with (component_id, kept, stays): the least id of the component, whether the row has it, and
    whether the row also is of that id's least class.

    ``joined`` (node, label) labels classes; a class without a label is a component, and so is a row without a class.
    Rows without an id take the least id of their component, and are kept only if there is none.
    """
    labels = joined.select(F.col("node").alias(class_col), "label")
    labelled = materialize(members.join(labels, class_col, "left").withColumn("label", F.coalesce("label", class_col)), "labelled")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(class_col).alias("class")))
    least = materialize(labelled.filter("label is not null").groupBy("label").agg(first.alias("_least")), "least")
    named = labelled.join(least, "label", "left").withColumn("component_id", F.coalesce("_least.id", id_col))
    kept = F.col(id_col).eqNullSafe(F.col("component_id"))
    stays = F.col("_least").isNull() | (kept & (F.col(class_col) == F.col("_least.class")))
    return named.withColumn("kept", kept).withColumn("stays", stays).drop("label", "_least")
