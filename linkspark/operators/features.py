"""Pair features, context features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import text
from linkspark.functions.batches import pair_similarities

#: The blocks whose finds are features.
FLAGGED_BLOCKS = ("b1_exact_core", "b2_rare_token", "b3_postal_minor", "b_sorted_neighborhood", "bgeo_address_token")
#: The columns that a model sees, 22 of a pair and three of its context.
FEATURES = (
    "name_full_ratio", "name_full_token_set_ratio", "name_full_partial_ratio", "name_full_jaro_winkler", "name_core_ratio", "name_core_token_set_ratio", "name_core_partial_ratio", "name_core_jaro_winkler",
    "address_ratio", "address_token_set_ratio", "digit_jaccard", "name_full_len_diff", "postal_equal", "postal_conflict", "postal_missing", "n_blocks",
    "block_b1_exact_core", "block_b2_rare_token", "block_b3_postal_minor", "block_b_sorted_neighborhood", "block_bgeo_address_token", "source_is_s2",
    "rank_by_s1", "gap_to_best_by_s1", "reverse_rank",
)
RECORD_COLUMNS = ("name_full", "name_core", "business_address", "postal_code")


def attach_records(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """Pairs with each column of both records, as a_<column> and b_<column>."""
    a = records.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = records.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "s1_id").join(b, "cand_id")


def postal_flags(a: Column, b: Column) -> list[Column]:
    both = a.isNotNull() & b.isNotNull()
    return [
        F.coalesce(both & (a == b), F.lit(False)).cast("float").alias("postal_equal"),
        F.coalesce(both & (a != b), F.lit(False)).cast("float").alias("postal_conflict"),
        (~both).cast("float").alias("postal_missing"),
    ]


def block_flags(blocks: Column, names: tuple[str, ...] = FLAGGED_BLOCKS) -> list[Column]:
    found = F.split(F.coalesce(blocks, F.lit("")), ",")
    return [F.array_contains(found, name).cast("float").alias(f"block_{name}") for name in names]


def digit_jaccard(a: Column, b: Column) -> Column:
    return text.jaccard(text.digit_tokens(a), text.digit_tokens(b))


def native_features(joined: DataFrame) -> list[Column]:
    """Of attached pairs, the features that need no Python."""
    return [
        digit_jaccard(F.col("a_business_address"), F.col("b_business_address")).cast("float").alias("digit_jaccard"),
        F.abs(F.length("a_name_full") - F.length("b_name_full")).cast("float").alias("name_full_len_diff"),
        *postal_flags(F.col("a_postal_code"), F.col("b_postal_code")),
        F.col("n_blocks").cast("float").alias("n_blocks"),
        *block_flags(F.col("blocks")),
        F.col("cand_id").startswith("S2-").cast("float").alias("source_is_s2"),
    ]


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1_id, cand_id) and 22 float features of capped pairs; one Arrow pass computes all similarities.

    Addresses are cleaned once a record, and pairs are dealt evenly before the pass, which costs more than the exchange:
    a join may leave them in the few partitions of a small side.
    """
    cleaned = records.withColumn("clean_address", text.basic_clean(F.col("business_address")))
    joined = attach_records(pairs.select("s1_id", "cand_id", "blocks", "n_blocks"), cleaned, (*RECORD_COLUMNS, "clean_address")).repartition("s1_id", "cand_id")
    scored = joined.withColumn("s", pair_similarities("a_name_full", "b_name_full", "a_name_core", "b_name_core", "a_clean_address", "b_clean_address"))
    renamed = {"full_ratio": "name_full_ratio", "full_set": "name_full_token_set_ratio", "full_partial": "name_full_partial_ratio", "full_jw": "name_full_jaro_winkler", "core_ratio": "name_core_ratio", "core_set": "name_core_token_set_ratio", "core_partial": "name_core_partial_ratio", "core_jw": "name_core_jaro_winkler", "address_ratio": "address_ratio", "address_set": "address_token_set_ratio"}
    return scored.select("s1_id", "cand_id", *[F.col(f"s.{k}").alias(v) for k, v in renamed.items()], *native_features(joined))


def context_features(features: DataFrame, score: str = "name_full_ratio") -> DataFrame:
    """Adds a pair's rank and gap to the best for its reference record, and its rank for its candidate. Ties by id."""
    s1, cand = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    return (
        features.withColumn("rank_by_s1", F.row_number().over(s1.orderBy(F.col(score).desc(), F.col("cand_id"))).cast("long"))
        .withColumn("gap_to_best_by_s1", F.max(score).over(s1) - F.col(score))
        .withColumn("reverse_rank", F.row_number().over(cand.orderBy(F.col(score).desc(), F.col("s1_id"))).cast("long"))
    )


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label 1 to true pairs, 0 to others."""
    marked = truth.select("s1_id", "cand_id").distinct().withColumn("_hit", F.lit(1))
    return pairs.join(marked, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0)).cast("long")).drop("_hit")
