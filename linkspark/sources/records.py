"""Source records, id lists, and a view of documents as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_SCHEMA = "source1_entity_id string, matched_entity_ids string"


def scan_tsv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Tab-separated text with a header; quotes and backslashes are plain characters, blank cells are null."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=schema)


def scan_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def register_catalog(spark: SparkSession, root: str) -> list[str]:
    """Views train_source1 to 3, test_source1 to 3 and train_ground_truth over TSV files below ``root``."""
    names = [f"{part}_source{k}" for part in ("train", "test") for k in (1, 2, 3)]
    for name in names:
        scan_tsv(spark, f"{root}/{name}.tsv").createOrReplaceTempView(name)
    scan_tsv(spark, f"{root}/train_ground_truth.tsv", TRUTH_SCHEMA).createOrReplaceTempView("train_ground_truth")
    return [*names, "train_ground_truth"]


def explode_ids(lists: DataFrame, id_col: str, list_col: str, as_id: str = "s1_id", as_item: str = "cand_id") -> DataFrame:
    """A row for each id of a comma list; ids aren't trimmed, null and empty lists give none."""
    cells = lists.filter(F.col(list_col).isNotNull() & (F.col(list_col) != ""))
    return cells.select(F.col(id_col).alias(as_id), F.explode(F.split(list_col, ",")).alias(as_item))


def load_id_list(spark: SparkSession, path: str, id_col: str, list_col: str) -> DataFrame:
    """(id, ids array) of every row of an id-list file; a blank cell is an empty list."""
    raw = scan_tsv(spark, path, f"{id_col} string, {list_col} string")
    return raw.select(id_col, F.when(F.col(list_col).isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.split(list_col, ",")).alias(list_col))


def surrogate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of three sources: the first words are a name, the last an address, the language a country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null and doc_id is not null")
    return docs.select(
        F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"),
        F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,5})", 1).alias("business_name"),
        # The last words are the first of the reversed text; a pattern that ends in $ would try every place before.
        F.reverse(F.regexp_extract(F.reverse("text"), r"^\s*(\S+(?:\s+\S+){0,7})", 1)).alias("business_address"),
        F.col("lang").alias("country"),
    )


def surrogate_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, cand_id, country): documents of unlike sources that agree in characters 200 to 239."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") > 240)
    keyed = docs.select(F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), F.col("lang").alias("country"), F.substring("text", 200, 40).alias("key"))
    s1 = keyed.filter(F.col("id").startswith("S1-")).withColumnRenamed("id", "s1_id")
    other = keyed.filter(~F.col("id").startswith("S1-")).withColumnRenamed("id", "cand_id")
    return s1.join(other, ["country", "key"]).select("s1_id", "cand_id", "country")
