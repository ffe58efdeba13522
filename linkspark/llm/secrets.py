"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a stored table of the (blob, rule
version) pairs that were scanned, each with its spans, none for a clean blob; a run scans only pairs that the ledger
lacks, adds them to it, and joins its spans back to all rows that hold the blob.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.storage import finished, materialize, spare
from linkspark.sources.storage import new_path


def _either(word: str) -> str:
    """ASCII letters in either case; (?i) would also fold other scripts in some engines."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


RULE_VERSION = "base-1"
#: (kind, pattern, group whose length counts, least length). Failing assign matches still use up their text, so its
#: length is checked after matching; for the others a shorter run holds no longer match and the pattern says it all.
RULES = (
    ("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", "([0-9a-f]{32,})", 1, 32),
)
SPAN = "struct<start:int,kind:int,end:int>"
LEDGER = f"blob binary, rule_version string, spans array<{SPAN}>"
Rule = tuple[str, str, int, int]


def blob_of(text: Column) -> Column:
    """32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans_of(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points.

    The texts between matches come from split() and the matches from regexp_extract_all(), so running sums of their
    lengths give the offsets. Texts without a match leave after one pass.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
    rows = F.arrays_zip(between.alias("gap"), found.alias("hit"), counted.alias("part"))

    def step(acc: Column, row: Column) -> Column:
        s = acc["at"] + F.length(row["gap"])
        e = s + F.coalesce(F.length(row["hit"]), F.lit(0))
        keep = F.coalesce(F.length(row["part"]) >= least, F.lit(False))
        one = F.array(F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end")))
        return F.struct(e.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(start["out"])


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of every (blob, text); spans are empty where there is no secret."""
    kinds = [spans_of(F.col("text"), k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*kinds)).alias("spans"))


class Ledger:
    """The scanned (blob, rule version) pairs and their spans, in a folder of Parquet tables, one of each run.

    A run's table counts once it is finished, so a run that fails leaves the ledger as it was. Runs at the same time may
    both scan a blob; a pair is read once however often it stands there. A changed set of rules needs a new version.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Sequence[Rule] = RULES, version: str = RULE_VERSION) -> None:
        self.spark, self.path, self.rules, self.version = spark, path, rules, version

    def pairs(self) -> DataFrame:
        """(blob, rule_version, spans) of every pair, of all versions."""
        runs = finished(self.spark, self.path)
        if not runs:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*runs).dropDuplicates(["blob", "rule_version"])

    def findings(self) -> DataFrame:
        """(blob, spans) of the blobs with secrets by this version's rules."""
        return self.pairs().filter((F.col("rule_version") == self.version) & (F.size("spans") > 0)).select("blob", "spans")

    def scan(self, versions: DataFrame, text_col: str = "text") -> None:
        """Scans the blobs of all rows that the ledger hasn't under this version, one copy of each.

        A third of all rows with one text cost one scan, and each map task sends a text once; texts that the ledger has aren't sent.
        """
        blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if finished(self.spark, self.path):
            blobs = blobs.join(self.pairs().filter(F.col("rule_version") == self.version).select("blob"), "blob", "left_anti")
        scanned = scan_blobs(blobs.dropDuplicates(["blob"]), self.rules)
        scanned.select("blob", F.lit(self.version).alias("rule_version"), "spans").write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def scan_versions(versions: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blob, spans) of every row, spans null where the text holds no secret, after a run over ``versions``.

    The ledger grows by what this run had to scan; without one a new ledger is kept as long as the application runs.
    Null texts count as empty, empty tables give no rows, rows that share an id each get a row, texts of any length are scanned whole.
    """
    ledger = ledger or Ledger(versions.sparkSession, new_path(versions.sparkSession, "ledger"))
    paths = materialize(versions.select(F.col(id_col), blob_of(F.col(text_col)).alias("blob")), "paths")
    ledger.scan(versions, text_col)
    return paths.join(ledger.findings(), "blob", "left").select(id_col, "blob", "spans")


def digest(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end of each span, in order, joined by commas."""
    names = F.array(*[F.lit(kind) for kind, *_ in rules])
    return F.coalesce(F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","), F.lit(""))


def count_kind(spans: Column, kind: int) -> Column:
    return F.coalesce(F.size(F.filter(spans, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_documents(docs: DataFrame, mask: str = "[SECRET]", ledger: Ledger | None = None) -> DataFrame:
    """``docs`` with secrets masked in text and n_chars brought up to date; a text without secrets stays as it is.

    Only texts that ``ledger`` doesn't know are scanned, and it grows by them; without one a new ledger is begun.
    """
    blob, spans, masked = (spare(docs, x) for x in ("_blob", "_spans", "_masked"))
    ledger = ledger or Ledger(docs.sparkSession, new_path(docs.sparkSession, "ledger"))
    ledger.scan(docs)
    found = ledger.findings().select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    clean = F.col(spans).isNull()
    joined = docs.withColumn(blob, blob_of(F.col("text"))).join(found, blob, "left")
    # In two steps: within one select, names in a lambda would mean the new columns.
    joined = joined.withColumn(masked, F.when(clean, F.col("text")).otherwise(redact(F.col("text"), F.col(spans), mask)))
    new = {"text": F.col(masked).alias("text"), "n_chars": F.when(clean, F.col("n_chars")).otherwise(F.length(masked).cast("long")).alias("n_chars")}
    return joined.select(*[new.get(c, F.col(c)) for c in docs.columns])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = scan_versions(docs)
    counts = [count_kind(F.col("spans"), k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(RULES)]
    base = digest(F.col("spans"))
    return paths.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), base.alias("spans"))


def _kind_sql(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """Offsets in SQL: running sums over the matches and the texts between them."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT n, {kind} AS kind, '{name}' AS name, pos AS s, pos + length(hit) AS e FROM (
    SELECT n, hit, part, (sum(length(gap) + length(hit)) OVER (PARTITION BY n ORDER BY k) - length(hit))::BIGINT AS pos FROM (
      SELECT n, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM (
        SELECT n, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {group}) AS parts, string_split_regex(text, '{quoted}') AS gaps FROM docs WHERE regexp_matches(text, '{quoted}'))))
  WHERE length(part) >= {least}"""


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(k, *rule) for k, rule in enumerate(RULES))}),
joined AS (
  SELECT n, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY n
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (n)
"""
