"""Allow and block lists for URLs: a broadcast trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

DEFAULT = "allow"
#: A trie is broadcast up to this many rules (about 300 bytes each); longer lists are joined.
MAX_BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class _Path:
    """below: by whole segment. tails: what the next segment must start with, and the rule that ends there."""

    below: dict[str, _Path] = field(default_factory=dict)
    tails: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class _Host:
    below: dict[str, _Host] = field(default_factory=dict)
    paths: _Path = field(default_factory=_Path)


class UrlTrie:
    """Longest match wins: by characters of host and path together, then by host, then block before allow."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.rules = [(verdict, host, path) for verdict, host, path in rules]
        self.root = _Host()
        for k, (_, host, path) in enumerate(self.rules):
            at = self.root
            for label in reversed(host.split(".")) if host else ():
                at = at.below.setdefault(label, _Host())
            *whole, tail = path.split("/")
            to = at.paths
            for segment in whole:
                to = to.below.setdefault(segment, _Path())
            to.tails.append((tail, k))

    def _rank(self, k: int) -> tuple[int, int, bool]:
        verdict, host, path = self.rules[k]
        return len(host) + len(path), len(host), verdict == "block"

    def match(self, host: str, path: str) -> int | None:
        """The index of the rule that decides, or None."""
        found: list[int] = []
        segments = path.split("/")

        def walk(at: _Path) -> None:
            for segment in segments:
                found.extend(k for tail, k in at.tails if segment.startswith(tail))
                if (at := at.below.get(segment)) is None:
                    return

        node = self.root
        walk(node.paths)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.below.get(label)) is None:
                break
            walk(node.paths)
        return max(found, key=self._rank, default=None)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or without ://, gives two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, url_col: str = "url", id_col: str = "page_id", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """(page id, host, path, rule, verdict) of every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's. Rules are given as a list in
    memory; up to ``max_broadcast`` of them go to the executors as a trie, longer lists are joined by host suffix.
    Both ways give the same rows. Null and odd URLs have an empty host and fit only rules with an empty host.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if len(rules) > max_broadcast:
        return _joined(parts, rules, default, id_col)
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(rules))
    id_type = parts.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie.value
        for b in batches:
            hits = [t.match(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rule = pa.array([None if k is None else t.rules[k][1] + t.rules[k][2] for k in hits], pa.string())
            verdict = pa.array([default if k is None else t.rules[k][0] for k in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


def _joined(parts: DataFrame, rules: Iterable[tuple[str, str, str]], default: str, id_col: str) -> DataFrame:
    """For lists too long to broadcast: each distinct (host, path) meets the rules of its host suffixes by a join."""
    listed = parts.sparkSession.createDataFrame([(v, h, p) for v, h, p in rules], "r_verdict string, r_host string, r_path string")
    distinct = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.array_union(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.array(F.lit("")))
    fits = distinct.withColumn("r_host", F.explode(suffixes)).join(listed, "r_host").filter(F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block", F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return parts.join(best, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = """
WITH rules(r_verdict, r_host, r_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), cut AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT p.page_id, p.n, p.host, p.path, r.*, row_number() OVER (PARTITION BY p.n ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
