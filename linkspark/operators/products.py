"""For each reference record the candidates with the largest products of sparse vectors, by inverted lists in Arrow groups.

A country's reference records and candidates are dealt to chunks, and each chunk of the one meets each of the other in a task. There a
reference record's lists are added up in an array with a number for each candidate of the chunk, so that no pair of
records is a row before it is among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.sources.storage import written

#: Rows of a chunk on either side.
REFERENCES, CANDIDATES = 1 << 13, 1 << 16
#: Products are ranked as whole numbers of this unit, halves upward.
UNIT = 1e9


def numbered(terms: DataFrame, name: str) -> DataFrame:
    """``terms`` with a number for each row, which stands for the term in vectors."""
    return written(terms.withColumn("term", F.monotonically_increasing_id()), name)


def vectors(rows: DataFrame, record: str, weight: str) -> DataFrame:
    """(country, record, terms, weights) of rows (country, record, term, weight); repeated terms add up."""
    lists = rows.groupBy("country", record).agg(F.collect_list(F.struct("term", F.col(weight).alias("w"))).alias("x"))
    return lists.select("country", record, F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and the rows they are of; a null list has none."""
    lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def units(values: np.ndarray) -> np.ndarray:
    return np.floor(values * UNIT + 0.5).astype(np.int64)


class Lists:
    """Inverted lists of candidates, which are numbered by rising id."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int):
        self.terms, codes = np.unique(terms, return_inverse=True)
        keys, which = np.unique(codes * max(1, n) + rows, return_inverse=True)
        self.rows, self.weights = keys % max(1, n), np.bincount(which, weights, len(keys))
        self.starts = np.searchsorted(keys // max(1, n), np.arange(len(self.terms) + 1))
        self.n = n

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms among the lists, -1 where there is none."""
        at = np.searchsorted(self.terms, terms)
        return np.where((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms), at, -1) if len(self.terms) else np.full(len(terms), -1)

    def products(self, codes: np.ndarray, weights: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that share a term and whose products are above ``least``, in order, and those products."""
        lists = [slice(*self.starts[code : code + 2]) for code in codes.tolist()]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0)
        rows = np.concatenate([self.rows[x] for x in lists])
        values = np.concatenate([self.weights[x] * weight for x, weight in zip(lists, weights.tolist(), strict=True)])
        if len(rows) * 64 < self.n:
            at, which = np.unique(rows, return_inverse=True)
            sums = np.bincount(which, values)
            some = sums > least
            return at[some], sums[some]
        sums = np.bincount(rows, values, self.n)
        at = np.nonzero(sums > least)[0]
        return at, sums[at]


def best(at: np.ndarray, scores: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``cap`` best by falling score; equal ones by place, which rises in ``at``."""
    if len(at) > cap:
        least = np.partition(scores, len(at) - cap)[len(at) - cap]
        more, equal = np.nonzero(scores > least)[0], np.nonzero(scores == least)[0]
        some = np.sort(np.concatenate([more, equal[: cap - len(more)]]))
        at, scores = at[some], scores[some]
    order = np.argsort(-scores, kind="stable")
    return at[order], scores[order]


def by_id(table: pa.Table, column: str) -> pa.Table:
    return table.take(pc.sort_indices(table[column]))


def top_products(s1: DataFrame, cand: DataFrame, cap: int, least: float | None = None, bonus: float = 0.0) -> DataFrame:
    """(s1_id, cand_id, score): the ``cap`` candidates of each reference record with the largest products, ties by id.

    Rows are (country, s1_id or cand_id, terms, weights above 0, mark); a pair that shares a term and has one mark gets ``bonus`` more.
    Products are rounded to nine places before anything is compared.
    """

    def deal(rows: DataFrame, record: str, size: int, own: str) -> tuple[DataFrame, DataFrame]:
        rows = rows if "mark" in rows.columns else rows.withColumn("mark", F.lit(None).cast("string"))
        rows = written(rows.filter("country is not null").select("country", record, "terms", "weights", "mark"), f"{own}-vectors")
        return rows, rows.groupBy("country").agg(F.ceil(F.count("*") / size).cast("int").alias(own))

    a, n_a = deal(s1, "s1_id", REFERENCES, "_i")
    b, n_b = deal(cand, "cand_id", CANDIDATES, "_j")
    counts = F.broadcast(n_a.join(n_b, "country"))
    parts = int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(rows: DataFrame, record: str, own: str, other: str) -> DataFrame:
        dealt = rows.join(counts, "country").withColumn(own, F.pmod(F.xxhash64(record), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return dealt.repartition(parts, "country", "_i", "_j").groupBy("country", "_i", "_j")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = by_id(right, "cand_id")
        terms, rows = flat(right["terms"])
        lists = Lists(terms, rows, flat(right["weights"])[0], len(right))
        terms, rows = flat(left["terms"])
        codes, weights = lists.codes(terms), flat(left["weights"])[0]
        known = codes >= 0
        codes, weights = codes[known], weights[known]
        starts = np.searchsorted(rows[known], np.arange(len(left) + 1))
        marks = pa.chunked_array([*left["mark"].chunks, *right["mark"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        own, others = marks[: len(left)], marks[len(left) :]
        found, scores, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(left), np.int64)
        for k in np.nonzero(np.diff(starts))[0]:
            here = slice(starts[k], starts[k + 1])
            at, values = lists.products(codes[here], weights[here], 0.0 if least is None or bonus else max(0.0, least - 1 / UNIT))
            score = units(values)
            if bonus and own[k] >= 0:
                score = np.where(others[at] == own[k], units(score / UNIT + bonus), score)
            if least is not None:
                enough = score >= units(np.array(least))
                at, score = at[enough], score[enough]
            at, score = best(at, score, cap)
            found.append(at)
            scores.append(score)
            sizes[k] = len(at)
        ids = left["s1_id"].take(pa.array(np.repeat(np.arange(len(left)), sizes)))
        return pa.table({"s1_id": ids, "cand_id": right["cand_id"].take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})

    return meet(a, "s1_id", "_i", "_j").cogroup(meet(b, "cand_id", "_j", "_i")).applyInArrow(run, "s1_id string, cand_id string, score long")
