"""Substring de-duplication by Rabin-Karp hashes of every window of words.

Blocks of documents send the sorted hashes of their windows, each with the smallest document that holds it there, to
the hashes' buckets. A bucket sees every block that holds a hash and tells each block which of its windows start
earlier elsewhere, and in which block. A block then drops every word that such windows, or repeats inside the block,
cover: overlapping windows merge into maximal intervals.

Every window that goes is compared word by word with the earlier one: repeats where they are found, others in the block
that holds the earlier one, which gets each distinct stretch of such words once. If ever two different windows
turn out to have one hash, all is done again under another seed, so the result doesn't hang on the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import blocks
from linkspark.llm.hashing import WordHashes, words_of
from linkspark.llm.storage import materialize

WINDOW = 20
_LAST = np.iinfo(np.int64).max


class _Windows:
    """The windows of a block: its documents in order of id (null last), each text's words end to end."""

    def __init__(self, table: pa.Table, length: int, hashes: WordHashes) -> None:
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (_LAST if ids[k] is None else ids[k], k))
        self.length, self.ids = length, [ids[k] for k in order]
        texts = table.column("text").combine_chunks().cast(pa.binary())
        self.words: list[bytes] = []
        edges = [0]
        for k in order:
            self.words += words_of(texts[k].as_py())
            edges.append(len(self.words))
        self.edges = np.array(edges)
        doc = np.repeat(np.arange(len(ids)), np.diff(self.edges))
        values = hashes.windows(hashes.of(self.words), length)
        n = len(values)
        self.at = np.flatnonzero(doc[:n] == doc[length - 1 :][:n])  # first words of windows within one document
        values = values[self.at]
        by_hash = np.argsort(values, kind="stable")
        sorted_values = values[by_hash]
        fresh = np.ones(len(sorted_values), bool)
        fresh[1:] = sorted_values[1:] != sorted_values[:-1]
        self.hashes = sorted_values[fresh]
        self.first = self.at[by_hash[fresh]]  # where each hash comes first in this block
        self.repeats = self.at[by_hash[~fresh]]
        self.repeated = self.first[np.cumsum(fresh) - 1][~fresh]  # where the hash of each repeat comes first
        self.doc = doc


def _agree(words: list[bytes], here: np.ndarray, other: list[bytes], there: np.ndarray, length: int) -> bool:
    """Whether the windows of ``words`` at ``here`` are word by word those of ``other`` at ``there``; neighbours go together."""
    order = np.argsort(here, kind="stable")
    here, there = here[order], there[order]
    cut = (np.flatnonzero((np.diff(here) != 1) | (np.diff(there) != 1)) + 1).tolist()
    for a, b in zip([0, *cut], [*cut, len(here)], strict=True):
        if a < b:
            size, i, j = b - a + length - 1, int(here[a]), int(there[a])
            if words[i : i + size] != other[j : j + size]:
                return False
    return True


def _by_bucket(hashes: np.ndarray, n_buckets: int) -> dict[int, slice]:
    """Where each bucket lies in sorted hashes; a bucket is a range of hashes."""
    return blocks.runs(hashes >> np.uint64(65 - n_buckets.bit_length()))


def _losers(table: pa.Table) -> pa.Table:
    """One bucket. For each block, a bit per hash: an earlier document elsewhere, or in an earlier block, holds it.
    The blocks that hold the earliest follow."""
    blobs = [blocks.unpack_sorted(x.as_py()) for x in table.column("hashes")]
    docs = [blocks.unpack_numbers(x.as_py(), np.int64) for x in table.column("docs")]
    block = np.asarray(table.column("block"))
    sizes = [len(x) for x in blobs]
    h, d, b = np.concatenate(blobs), np.concatenate(docs), np.repeat(block, sizes)
    by_hash = np.argsort(h, kind="stable")
    sorted_h = h[by_hash]
    same = sorted_h[1:] == sorted_h[:-1]
    shared = np.zeros(len(h), bool)
    shared[1:] |= same
    shared[:-1] |= same
    rows = by_hash[shared]
    rows = rows[np.lexsort((b[rows], d[rows], h[rows]))]
    lose, winner = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    if len(rows):
        fresh = np.concatenate([[True], h[rows[1:]] != h[rows[:-1]]])
        lose[rows[~fresh]] = True
        winner[rows] = b[rows[fresh]][np.cumsum(fresh) - 1]
    out = [(k, x, w[x]) for k, (x, w) in enumerate(zip(np.split(lose, np.cumsum(sizes)[:-1]), np.split(winner, np.cumsum(sizes)[:-1]), strict=True)) if x.any()]
    keep = pa.array([k for k, _, _ in out], pa.int64())
    answers = []
    for _, x, w in out:
        bits = blocks.squeeze(np.packbits(x).tobytes())
        answers.append(len(bits).to_bytes(4, "little") + bits + blocks.pack_numbers(w))
    return pa.table([table.column("block").take(keep), table.column("bucket").take(keep), pa.array(answers, pa.binary())], ["block", "bucket", "answer"])


def _stretches(w: _Windows, lost: np.ndarray, winner: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(block, words) of the runs of windows at ``lost`` that one block holds earlier."""
    order = np.argsort(lost, kind="stable")
    lost, winner = lost[order], winner[order]
    cut = np.flatnonzero((np.diff(lost) != 1) | (np.diff(winner) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(lost)], strict=True):
        if a < b:
            at = int(lost[a])
            yield int(winner[a]), b" ".join(w.words[at : at + b - a + w.length - 1])


def removed_words(docs: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, hashes: type[WordHashes] = WordHashes) -> DataFrame:
    """(doc id, n_words, n_removed, kept_sha256), and with ``texts`` also (kept, intervals) of every row.

    A word goes if a window of ``length`` words over it occurs earlier: in a smaller id, or earlier in the same
    document. Null ids come last; rows that share an id, or have none, come in the order of their blocks. ``kept``
    joins the kept words with one space; ``intervals`` are the maximal runs of removed words, end exclusive. Null and
    empty texts have no words; a text of any length is judged whole, as a block of its own if it is longer than one.
    An empty table gives no rows, columns besides the two are passed over. Ids are integers. ``hashes`` makes the word hashes of a seed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        found, collisions = _judged(rows, length, texts, hashes(seed), blocks.buckets(docs))
        if collisions.isEmpty():
            return found
        seed += 1


def _judged(rows: DataFrame, length: int, texts: bool, hashes: WordHashes, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """The result under one seed, and a row for each block where two different windows had one hash."""
    packed = blocks.pack_rows(rows)

    def send(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        w = _Windows(table, length, hashes)
        ids = np.array([_LAST if x is None else x for x in w.ids], np.int64)
        first_docs = ids[w.doc[w.first]]
        cut = _by_bucket(w.hashes, n_buckets)
        sent = [blocks.pack_sorted(w.hashes[x]) for x in cut.values()]
        held = [blocks.pack_numbers(first_docs[x]) for x in cut.values()]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(cut), pa.int64()), pa.array(cut, pa.int32()), pa.array(sent, pa.binary()), pa.array(held, pa.binary())], ["block", "bucket", "hashes", "docs"])

    def drop(table: pa.Table, told: dict[int, bytes]) -> pa.Table:
        w = _Windows(table, length, hashes)
        cut = _by_bucket(w.hashes, n_buckets)
        lose, winner = np.zeros(len(w.hashes), bool), np.zeros(len(w.hashes), np.int64)
        for k, blob in told.items():
            size = int.from_bytes(blob[:4], "little")
            here = cut[k]
            lose[here] = np.unpackbits(np.frombuffer(blocks.expand(blob[4 : 4 + size]), np.uint8), count=here.stop - here.start)
            winner[here][lose[here]] = blocks.unpack_numbers(blob[4 + size :], np.int64)
        bad = np.zeros(len(w.words) + 1, np.int32)
        begin = np.concatenate([w.repeats, w.first[lose]])
        np.add.at(bad, begin, 1)
        np.add.at(bad, begin + length, -1)
        out = _result(w, np.cumsum(bad[:-1]) > 0, texts)
        asked = sorted(set(_stretches(w, w.first[lose], winner[lose])))
        if not _agree(w.words, w.repeats, w.words, w.repeated, length):
            asked.append((-1, b""))
        more = pa.table([pa.array([b for b, _ in asked], pa.int64()), pa.array([s for _, s in asked], pa.binary())], ["holder", "stretch"])
        return pa.concat_tables([out, more], promote_options="default")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        bad = left.num_rows == 0  # asked of no block: repeats inside one differ
        for data in left.column("data"):
            w = _Windows(blocks.unpack_rows(data.as_py()), length, hashes)
            for stretch in right.column("stretch"):
                words = stretch.as_py().split(b" ")
                values = hashes.windows(hashes.of(words), length)
                bad = bad or not len(w.hashes)
                at = np.minimum(np.searchsorted(w.hashes, values), max(0, len(w.hashes) - 1))
                bad = bad or bool((w.hashes[at] != values).any()) or not _agree(words, np.arange(len(values)), w.words, w.first[at], length)
        return pa.table([pa.array([-1] * bad, pa.int64())], ["block"])

    pieces = blocks.each_block(packed, send, "block long, bucket int, hashes binary, docs binary")
    answers = pieces.groupBy("bucket").applyInArrow(_losers, "block long, bucket int, answer binary")
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, intervals array<struct<start:long,end:long>>" if texts else "")
    made = materialize(blocks.with_answers(packed, answers, drop, f"{columns}, holder long, stretch binary"), "substrings")
    asked = made.filter("holder is not null").select(F.col("holder").alias("block"), "stretch").distinct()
    return made.filter("holder is null").drop("holder", "stretch"), blocks.of_asked(packed, asked, verify, "block long")


def _result(w: _Windows, gone: np.ndarray, texts: bool) -> pa.Table:
    running = np.concatenate([[0], np.cumsum(gone)])
    removed = (running[w.edges[1:]] - running[w.edges[:-1]]).tolist()
    keep = (~gone).tolist()
    digests, kept, intervals = [], [], []
    for k, (a, b) in enumerate(zip(w.edges[:-1].tolist(), w.edges[1:].tolist(), strict=True)):
        line = b" ".join(compress(w.words[a:b], keep[a:b]) if removed[k] else w.words[a:b])
        digests.append(hashlib.sha256(line).hexdigest())
        if texts:
            kept.append(line.decode())
            step = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
            intervals.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
    columns = [pa.array(w.ids, pa.int64()), pa.array(np.diff(w.edges), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if texts:
        columns += [pa.array(kept, pa.string()), pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        names += ["kept", "intervals"]
    return pa.table(columns, names)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), words AS (
  SELECT n, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM docs
), windows AS (
  SELECT n, unnest(range(1, len(words) - {WINDOW} + 2)) AS k, words FROM docs WHERE len(words) >= {WINDOW}
), hashed AS (
  SELECT n, k, sha256(list_aggregate(words[k:k + {WINDOW} - 1], 'string_agg', ' ')) AS h FROM windows
), judged AS (
  SELECT n, k, row_number() OVER (PARTITION BY h ORDER BY n, k) > 1 AS later FROM hashed
), covered AS (
  SELECT w.n, w.k, w.word, coalesce(bool_or(j.later) OVER (PARTITION BY w.n ORDER BY w.k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN judged j ON w.n = j.n AND w.k = j.k
), kept AS (
  SELECT n, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS line FROM covered GROUP BY n
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (n)
"""
