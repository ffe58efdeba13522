"""Near-duplicates by bottom-k sketches of word shingles.

One hash function orders the shingles, and the k least of a set are its sketch. Texts with the same words, by SHA-256,
form a class. Inverted lists lead from retained values to the classes that hold them. A list is keyed by RUN consecutive values of a
sketch rather than by one, since single shingles of two words are in ever more texts as the corpus grows; linked
sketches have such runs in common nearly always. Each list is joined under one class that stands for it, so classes
that share many lists meet once. Where they meet, the union sketch estimates similarity, and families of what passes
are compared exactly on their full sets of words, not of hashes.

Of a union of sketches with Jaccard similarity 0.8, K = 48 values in a row hold no three shared ones in turn with
probability 0.695**48 = 3e-8, 5e-7 for sets of SMALL = 40. The union sketch of a linked pair is under ESTIMATE with
probability 1e-6. Sets under SMALL get lists that no linked pair misses, and where the union fits a sketch it is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import blocks
from linkspark.llm.components import components, matrix_groups, tree_edges
from linkspark.llm.grouping import group_edges, name_components
from linkspark.llm.hashing import PRIME, WordHashes, mix, shingles_of, words_of
from linkspark.llm.storage import materialize, small_batches, spare

K = 48
RUN = 3
#: Sets of fewer shingles are their own sketches, and any two shingles of a prefix that linked sets share key a list.
SMALL = 40
#: Values of the K least of a union that are shared, at least.
ESTIMATE = 23
#: Members compared at once, and shingles compared at once, each text counted as some more: a task keeps a number for
#: each two texts. Larger groups are cut into chunks.
CHUNK = 512
CHUNK_SHINGLES = 128 << 10
TEXT_SHINGLES = 128
PERCENT = 80
#: Bytes of text hashed at once; each byte takes some eight-byte numbers meanwhile.
SLICE_BYTES = 1 << 20
_RUNS = WordHashes()


def digest_of(words: list[bytes]) -> bytes | None:
    """The class of a text: equal for the same words in the same order, null for none."""
    return hashlib.sha256(b" ".join(words)).digest() if words else None


def sketches(texts: list[list[bytes]], length: int, hashes: WordHashes) -> Iterator[bytes]:
    """The K least shingle hashes of each text, in order; a text of fewer words has one shingle, of all of them."""
    edges = np.cumsum([0, *map(len, texts)]).tolist()
    values = hashes.of(list(chain.from_iterable(texts)))
    grams = hashes.windows(values, length)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= length:
            yield np.unique(grams[a : b - length + 1])[:K].tobytes()
        else:
            yield mix(hashes.windows(values[a:b], b - a) + np.uint64(b - a)).tobytes() if a < b else b""


def _words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of a batch with the words of their texts."""
    for part in blocks.slices(batch, SLICE_BYTES):
        yield part, [words_of(x, lower=True) for x in part.column(column).cast(pa.binary()).to_pylist()]


def sketch_documents(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, digest, n, sketch) of each row; digest is null for texts without words, n the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in _words(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(digest_of, texts), pa.binary()), pa.array([len(shingles_of(w, length)) for w in texts], pa.int64()), pa.array(sketches(texts, length, hashes), pa.binary())],
                    ["doc_id", "digest", "n", "sketch"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary, n long, sketch binary")


def list_keys(sketch: np.ndarray, n: int) -> np.ndarray:
    """The distinct keys of the lists that a set of n shingles is in."""
    keys = []
    if n < 4:  # linked to equal sets only
        keys.append(mix(_RUNS.windows(sketch % np.uint64(PRIME), len(sketch)) + np.uint64(n)))
    elif n < SMALL:
        least = -(-n * PERCENT // 100)  # shared at least, so two of the first n - least + 2
        i, j = np.triu_indices(min(len(sketch), n - least + 2), 1)
        keys.append(mix(sketch[i] * np.uint64(3) + sketch[j]))
    if 100 * n >= PERCENT * SMALL:
        keys.append(_RUNS.windows(sketch % np.uint64(PRIME), RUN))
    return np.unique(np.concatenate(keys))


class _Lists:
    """The list keys of a block of classes, ordered by bucket and key."""

    def __init__(self, table: pa.Table, n_buckets: int) -> None:
        held = [list_keys(np.frombuffer(x.as_py(), np.uint64), n) for x, n in zip(table.column("sketch"), table.column("n").to_pylist(), strict=True)]
        keys = np.concatenate(held)
        owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        bucket = (keys & np.uint64(n_buckets - 1)).astype(np.int64)
        order = np.lexsort((keys, bucket))  # stable, so that the first owner of a key comes first
        self.keys, self.owner, bucket = keys[order], owner[order], bucket[order]
        fresh = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if len(keys) else np.empty(0, bool)
        self.first = np.flatnonzero(fresh)
        self.which = np.cumsum(fresh) - 1
        self.counts = np.diff(np.append(self.first, len(self.keys)))
        self.cut = blocks.runs(bucket[self.first])


def _join_lists(table: pa.Table) -> pa.Table:
    """One bucket: for each key of a block, whether other classes have it, and the block and place of the first one."""
    keys = [blocks.unpack_sorted(x.as_py()) for x in table.column("keys")]
    counts = [blocks.unpack_numbers(x.as_py(), np.uint32) for x in table.column("counts")]
    firsts = [blocks.unpack_numbers(x.as_py(), np.uint32) for x in table.column("firsts")]
    sizes = [len(x) for x in keys]
    v, c, f = np.concatenate(keys), np.concatenate(counts), np.concatenate(firsts)
    block = np.repeat(np.asarray(table.column("block")), sizes)
    order = np.lexsort((block, v))
    fresh = np.concatenate([[True], v[order][1:] != v[order][:-1]])
    group = np.empty(len(v), np.int64)
    group[order] = np.cumsum(fresh) - 1
    shared = (np.bincount(group, weights=c) > 1)[group]
    head = order[fresh]
    out = []
    for at, size in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True):
        here = slice(at, at + size)
        to = head[group[here][shared[here]]]
        bits = blocks.squeeze(np.packbits(shared[here]).tobytes())
        out.append(len(bits).to_bytes(4, "little") + bits + blocks.pack_numbers(np.concatenate([block[to], f[to].astype(np.int64)])))
    return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "answer"])


def meetings(classes: DataFrame) -> DataFrame:
    """(at_block, at, class, n, sketch): where classes meet, once for each class that stands for one of their lists."""
    packed = blocks.pack_rows(classes)
    n_buckets = blocks.buckets(classes)

    def send(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        s = _Lists(table, n_buckets)
        keys, firsts = s.keys[s.first], s.owner[s.first]
        cut = s.cut.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(cut), pa.int64()), pa.array(s.cut, pa.int32()), pa.array([blocks.pack_sorted(keys[x]) for x in cut], pa.binary()), pa.array([blocks.pack_numbers(s.counts[x].astype(np.uint32)) for x in cut], pa.binary()), pa.array([blocks.pack_numbers(firsts[x]) for x in cut], pa.binary())],
            ["block", "bucket", "keys", "counts", "firsts"],
        )

    def meet(table: pa.Table, told: dict[int, bytes]) -> pa.Table:
        s = _Lists(table, n_buckets)
        shared = np.zeros(len(s.first), bool)
        at = np.zeros((2, len(s.first)), np.int64)
        for k, blob in told.items():
            size = int.from_bytes(blob[:4], "little")
            cut = s.cut[k]
            shared[cut] = np.unpackbits(np.frombuffer(blocks.expand(blob[4 : 4 + size]), np.uint8), count=cut.stop - cut.start)
            at[:, cut][:, shared[cut]] = blocks.unpack_numbers(blob[4 + size :], np.int64).reshape(2, -1)
        use = shared[s.which]
        rows = np.unique(np.concatenate([at[:, s.which[use]], s.owner[use][None, :].astype(np.int64)]), axis=1)
        kept = table.take(pa.array(rows[2]))
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), kept.column("class"), kept.column("n"), kept.column("sketch")], ["at_block", "at", "class", "n", "sketch"])

    pieces = blocks.each_block(packed, send, "block long, bucket int, keys binary, counts binary, firsts binary")
    answers = pieces.groupBy("bucket").applyInArrow(_join_lists, "block long, bucket int, answer binary")
    return blocks.with_answers(packed, answers, meet, "at_block long, at long, class long, n long, sketch binary")


def _common(sets: list[np.ndarray], n_rows: int) -> np.ndarray:
    """How many values each two of the sets share."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n_rows), [len(s) for s in sets])
    _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    use = counts[which] > 1
    owner, column = owner[use], column[which[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n_rows, n_rows), np.float64)
    width = 4096
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, n_columns, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n_rows, min(width, n_columns - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def similar(common: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard similarity of at least PERCENT, exactly, from sizes and what is shared; whole numbers under 2**53 are exact as floats."""
    return (100.0 + PERCENT) * common >= float(PERCENT) * (n[:, None] + n[None, :])


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared values among the K least of each pair's union; rows are sketches of K values, filled up with the largest number."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~twice, axis=1)
    return (twice & (rank <= K)).sum(axis=1)


def _edge_table(linked: np.ndarray, ids: np.ndarray) -> pa.Table:
    np.fill_diagonal(linked, False)
    some = linked.any(axis=1)
    edges = list(tree_edges(matrix_groups(linked)[some], ids[some]))
    return pa.table([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


def _estimated(table: pa.Table) -> pa.Table:
    """Edges that stand for the pairs which the union sketch lets through."""
    ids, n = np.asarray(table.column("class")), np.asarray(table.column("n"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("sketch")]
    common = _common(sets, len(ids))
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    full = large <= K
    linked = (100 * small >= PERCENT * large) & np.where(full, similar(common, n), common >= ESTIMATE)
    i, j = np.nonzero(np.triu(linked & ~full, 1))
    filled = np.full((len(ids), K), np.iinfo(np.uint64).max, np.uint64)
    for k, s in enumerate(sets):
        filled[k, : len(s)] = s
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        bad = union_estimate(filled[x], filled[y]) < ESTIMATE
        linked[x[bad], y[bad]] = linked[y[bad], x[bad]] = False
    return _edge_table(linked, ids)


def _confirmed(table: pa.Table, length: int) -> pa.Table:
    """Edges that stand for the pairs of full sets with enough in common; shingles are compared by their words."""
    number: dict[tuple[bytes, ...], int] = {}
    sets = []
    for text in table.column("words"):
        shingles = shingles_of(text.as_py().split(b" "), length)
        sets.append(np.fromiter((number.setdefault(x, len(number)) for x in shingles), np.uint64, len(shingles)))
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    return _edge_table(similar(_common(sets, len(sets)), n), np.asarray(table.column("class")))


def _with_digest(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with the class of each row's text in the column ``own``."""
    names = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _words(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(digest_of, texts), pa.binary())], [*names, own])

    return docs.mapInArrow(run, f"{types}, `{own}` binary")


def _full_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, family, n, words): the words of one document of each wanted (doc_id, digest, class, family, n).

    A wanted class whose rows all have no id is found by its digest, one text of each.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = ["class", "family", "n", "digest", "text"]
    # The wanted rows are a share of the corpus: the join is dealt by id at any size, small corpora included.
    named = texts.join(wanted.filter("doc_id is not null").hint("merge"), "doc_id").select(*columns)
    # Copies go before the join, and within a map task before the exchange, so no task gets all of a large class.
    nameless = _with_digest(texts.filter("doc_id is null").select("text"), "digest").filter("digest is not null").dropDuplicates(["digest"])
    nameless = nameless.join(wanted.filter("doc_id is null").select("class", "family", "n", "digest").hint("merge"), "digest").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _words(batch, 4):
                own = [k for k, (d, w) in enumerate(zip(part.column(3).to_pylist(), found, strict=True)) if digest_of(w) == d]
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in range(3)], pa.array([b" ".join(found[k]) for k in own], pa.binary())], ["class", "family", "n", "words"])

    return named.unionByName(nameless).mapInArrow(run, "class long, family long, n long, words binary").dropDuplicates(["class"])


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept, stays) of every row of (doc_id, text).

    Shingles are runs of ``words`` words, A to Z lower-cased; links are Jaccard similarities of 0.8 or more, and a
    component is what links reach. Its id is the least doc_id, whose row is kept. Rows without words, null texts
    among them, are components of their own. Rows without an id never name a component that has one, and are kept
    only where none has; rows that share an id are kept together. ``stays`` is true for the rows of one id and class
    in each component only. An empty table gives no rows.
    """
    sketched = materialize(sketch_documents(docs, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    one_each = sketched.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("class"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(one_each.sortWithinPartitions("class"), "classes")
    members = sketched.select("doc_id", "digest", "n").join(classes.select("digest", "class"), "digest", "left")
    met = materialize(meetings(classes.select("class", "n", "sketch")), "meetings")
    families = components(group_edges(met, ["at_block", "at"], "class", "1", CHUNK, _estimated)).select(F.col("node").alias("class"), F.col("label").alias("family"))
    wanted = materialize(classes.select("class", "digest", "doc_id", "n").join(families, "class"), "wanted")
    texts = materialize(_full_texts(docs, wanted), "full-texts")

    def confirm(table: pa.Table) -> pa.Table:
        return _confirmed(table, words)

    joined = components(group_edges(texts, ["family"], "class", f"n + {TEXT_SHINGLES}", CHUNK_SHINGLES, confirm))
    return name_components(members, joined, "doc_id", "class").withColumnRenamed("n", "n_shingles").drop("class")


def keep_one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each component: its least id, and of rows that agree in id and words any one.

    Texts are dealt by a hash of id and class for the join; repeated rows then meet in one task.
    """
    judged = materialize(near_duplicates(docs, words).filter("stays").select("doc_id", "digest").distinct(), "stays")
    names, own, key, ident = docs.columns, spare(docs, "_class"), spare(docs, "_key"), spare(docs, "_id")
    # One key for the join and the repeats, so that texts are dealt once; that keys are of the same id and class is checked.
    classed = _with_digest(docs, own).withColumn(ident, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(ident, own))
    known = judged.select(F.xxhash64("doc_id", "digest").alias("_known"), F.col("doc_id").alias("_known_id"), F.col("digest").alias("_known_class"))
    same = (classed[key] == known["_known"]) & classed[ident].eqNullSafe(known["_known_id"]) & classed[own].eqNullSafe(known["_known_class"])
    return classed.join(known.hint("merge"), same, "left_semi").dropDuplicates([key, ident, own]).select(*names)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, counted; components by a recursive walk over links.
ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT n, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s FROM docs
), sizes AS (
  SELECT n, count(*) AS size FROM shingles GROUP BY n
), shared AS (
  SELECT a.n AS a, b.n AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.n < b.n GROUP BY ALL
), pairs AS (
  SELECT a, b FROM shared JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE 100 * n_both >= 80 * (x.size + y.size - n_both)
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS n, min(doc_id) AS least FROM reach JOIN docs ON docs.n = b GROUP BY a
)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, coalesce(least >= doc_id, true) AS kept
FROM docs LEFT JOIN sizes USING (n) LEFT JOIN least USING (n)
"""
