"""Output files, their validator, archives and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.sources.storage import copy, write_text

MATCH_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def id_lists(pairs: DataFrame, required: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """A row for each required id: its distinct ids sorted and comma-joined, empty if it has none.

    ``pairs`` is (s1_id, cand_id), ``required`` has s1_id.
    """
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(list_col))
    return required.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias(id_col), F.coalesce(list_col, F.lit("")).alias(list_col))


def write_id_lists(pairs: DataFrame, required: DataFrame, header: tuple[str, str], path: str) -> None:
    """Id lists as UTF-8 text with a header, sorted by id over all part files."""
    lists = id_lists(pairs, required, *header).orderBy(header[0])
    lists.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", lineSep="\n")


def validate_lines(lines: DataFrame, header: tuple[str, str], name: str, required: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(severity, check, n): what is wrong with id-list files given as (line_no, value), line 0 of each the header.

    Checks: header (tabs, names in any case), rows without a tab, ids given twice, ids twice in a list, ids of the
    reference source in a list, ids of no known source, missing and extra ids; unknown ids only if ``known`` is given.
    Blank lines are passed over. A wrong header is fatal and hides the rest.
    """
    # The headers' verdict is one row, which goes along as a scalar so that no row count is taken on the driver.
    head = lines.filter("line_no = 0").select((F.lower(F.trim("value")) == "\t".join(header).lower()).alias("good"))
    bad_header = head.agg((F.count(F.when(F.col("good"), 1)) == 0).alias("none"), (F.count(F.when(~F.col("good"), 1)) > 0).alias("some")).select((F.col("none") | F.col("some")).alias("fatal"))
    rows = lines.filter("line_no > 0").filter(F.trim("value") != "").join(F.broadcast(bad_header)).filter("not fatal").drop("fatal")
    cells = rows.select("line_no", F.instr("value", "\t").alias("tab"), F.split("value", "\t", 2).alias("cell"))
    good = cells.filter("tab > 0").select("line_no", F.get("cell", F.lit(0)).alias("id"), F.filter(F.split(F.get("cell", F.lit(1)), ","), lambda x: x != "").alias("ids"))
    listed = good.select("id", F.explode("ids").alias("item"))
    found = [
        bad_header.filter("fatal").select(F.lit("fatal").alias("severity"), F.lit("header").alias("check"), F.lit(1).cast("long").alias("n")),
        _issue(cells.filter("tab = 0"), "error", "row without tab"),
        _issue(good.groupBy("id").count().filter("count > 1"), "error", "duplicate row"),
        _issue(good.filter(F.size("ids") > F.size(F.array_distinct("ids"))), "error", "duplicate in list"),
        _issue(listed.filter(F.col("item").startswith("S1-")), "error", "reference id in list"),
        _issue(listed.filter(~F.col("item").rlike("^S[123]-")), "error", "id of no source"),
    ]
    if required is not None:
        have = good.select("id").distinct()
        want = required.select(F.col("s1_id").alias("id")).distinct().join(F.broadcast(bad_header)).filter("not fatal").drop("fatal")
        found += [_issue(want.join(have, "id", "left_anti"), "error", "missing id"), _issue(have.join(want, "id", "left_anti"), "error", "extra id")]
    if known is not None:
        found.append(_issue(listed.select("item").distinct().join(known.select(F.col("id").alias("item")), "item", "left_anti"), "error", "unknown id"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(name).alias("file"), "severity", "check", "n")


def matches_outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """The warning for matched pairs that aren't among the candidates."""
    return _issue(matches.join(candidates, ["s1_id", "cand_id"], "left_anti"), "warning", "match outside candidates")


def _issue(rows: DataFrame, severity: str, check: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of the lines of a text file or of a folder's part files; a file's first line is 0.

    Lines of a small file are numbered on; those of a file that is read in several parts have any numbers above 0.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    first = lines.filter("_block = 0").groupBy("file").agg(F.min("_at").alias("_first"))
    number = F.when(F.col("_block") == 0, F.col("_at") - F.col("_first")).otherwise(F.col("_at") + 1)
    return lines.join(F.broadcast(first), "file").select("file", number.cast("long").alias("line_no"), "value")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as JSON, in any file system that Spark knows."""
    write_text(spark, json.dumps(report, ensure_ascii=False, indent=2, default=str), path)


def archive(spark: SparkSession, paths: Iterable[str], report: dict, root: str, stamp: str) -> str:
    """Copies finished outputs and their report to a folder of their own below ``root``."""
    to = f"{root}/{stamp}"
    for path in paths:
        copy(spark, path, f"{to}/{path.rstrip('/').rpartition('/')[2]}")
    write_report(spark, report, f"{to}/report.json")
    return to
