"""Language identification by rank-order profiles of character n-grams.

Training counts the n-grams of one to three letters of all labelled texts and keeps the most frequent of each language
in order. A text goes to the language from whose profile its own most frequent n-grams are least out of place.
Counting starts from distinct words, so a word's n-grams are cut once a text or once a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.llm.storage import materialize, small_batches, spare

#: N-grams in a profile, of a language or of a text.
PROFILE = 300
#: N-grams of all profiles that go to every task, some tens of MB; more are joined with those of the texts.
MAX_BROADCAST_RANKS = 2_000_000
UNKNOWN = "und"
HELD_OUT = 2
_FLUSH_WORDS, _CUT_WORDS = 200_000, 20_000
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def ngrams(words: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of some words and how often they occur, ordered by n-gram.

    An n-gram is a number of 21 bits a letter, 0 standing for a word's edge; what is no letter parts words.
    """
    text = " ".join(words) + " "
    points = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    weight = np.repeat(np.array(counts, np.int64), np.fromiter(map(len, words), np.int64, len(words)) + 1)
    letter = points > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as the edge of the word before
    points, weight = points[keep], weight[keep]
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.int64(0)
    before = np.concatenate([[edge], points[:-1]])
    here = points > 0
    later = np.concatenate([points[1:], [edge]])
    one = points[here]
    two = (before << _BITS | points)[(before > 0) | here]
    three = (before << 2 * _BITS | points << _BITS | later)[here]
    # Letters have at most 18 bits, so the two highest bits are free to tell the lengths apart.
    codes = np.concatenate([one | np.int64(1) << 61, two | np.int64(1) << 62, three])
    weights = np.concatenate([weight[here], weight[(before > 0) | here], weight[here]])
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(weights, first)


def most_frequent(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Codes by falling count, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def text_profile(text: str | None, profile: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams in order."""
    words = Counter((text or "").split())
    if not words:
        return np.empty(0, np.int64)
    return most_frequent(*ngrams(list(words), list(words.values())), profile)


class Profiles:
    """For each n-gram of any profile, the languages that rank it."""

    def __init__(self, ranked: dict[str, list[int]]) -> None:
        self.languages = sorted(ranked)
        codes = np.concatenate([np.array(ranked[x], np.int64) for x in self.languages]) if ranked else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.edges = np.append(first, len(codes))
        self.language = np.repeat(np.arange(len(ranked)), [len(ranked[x]) for x in self.languages])[order]
        self.rank = np.concatenate([np.arange(len(ranked[x])) for x in self.languages])[order] if ranked else codes

    def judge(self, text: str | None, profile: int = PROFILE) -> tuple[str, float]:
        """Language and score: 1 less the out-of-place distance as a share of the largest possible one.

        An n-gram is out of place by the difference of its ranks, or by ``profile`` where the language has it not.
        """
        top = text_profile(text, profile)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == top)
        at = at[place]
        sizes = self.edges[at + 1] - self.edges[at]
        entry = np.repeat(self.edges[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        saved = profile - np.abs(self.rank[entry] - np.repeat(place, sizes))
        total = np.bincount(self.language[entry], weights=saved, minlength=len(self.languages))
        best = int(np.argmax(total))
        return self.languages[best], float(total[best]) / (profile * len(top))


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees; a row without an id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(labelled: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, code, rank): the profiles of all languages, from all rows of (text, lang), as a written table.

    Null texts and languages are passed over; no rows give no profiles. Of equally frequent n-grams the lesser code comes first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in words.items():
                items = list(held.items())
                for at in range(0, len(items), _CUT_WORDS):
                    codes, counts = ngrams([w for w, _ in items[at : at + _CUT_WORDS]], [n for _, n in items[at : at + _CUT_WORDS]])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])
            words.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.as_py().split())
                if sum(map(len, words.values())) > _FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    small_batches(labelled.sparkSession)
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("code"))
    ranked = counts.withColumn("rank", F.row_number().over(top) - 1).filter(F.col("rank") < profile)
    return materialize(ranked.select("lang", "code", "rank"), "profiles")


def collected(ranks: DataFrame, most: int) -> Profiles | None:
    """The profiles as one value, or None if they have more than ``most`` n-grams."""
    if ranks.count() > most:
        return None
    found: dict[str, list[int]] = {}
    for r in ranks.orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append(r.code)
    return Profiles(found)


def identify(docs: DataFrame, ranks: DataFrame, profile: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Of languages at the same
    distance the first in code point order wins. The size of the profiles decides between a broadcast and a join;
    both give the same.
    """
    profiles = collected(ranks, MAX_BROADCAST_RANKS if most is None else most)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    if profiles is None:
        return _identify_by_join(rows, ranks, profile, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.judge
        for b in batches:
            seen = [judge(x.as_py(), profile) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.float64())], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def _identify_by_join(rows: DataFrame, ranks: DataFrame, profile: int, id_col: str) -> DataFrame:
    """The texts' n-grams, a row each, joined with the profiles'; what they save is summed by text and language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_profile(x.as_py(), profile) for x in b.column(1)], pa.list_(pa.int64()))], [id_col, "codes"])

    id_type = rows.schema[id_col].dataType.simpleString()
    texts = materialize(rows.mapInArrow(cut, f"`{id_col}` {id_type}, codes array<long>").withColumn("_row", F.monotonically_increasing_id()), "text-profiles")
    grams = texts.select("_row", F.posexplode("codes").alias("place", "code"))
    saved = grams.join(ranks, "code").groupBy("_row", "lang").agg(F.sum(profile - F.abs(F.col("rank") - F.col("place"))).alias("saved"))
    best = saved.groupBy("_row").agg(F.min(F.struct((-F.col("saved")).alias("lost"), "lang")).alias("best"))
    first = ranks.agg(F.min("lang").alias("_first"))
    joined = texts.join(best, "_row", "left").join(F.broadcast(first))
    lettered = F.size("codes") > 0
    lang = F.when(lettered, F.coalesce("best.lang", "_first", F.lit(UNKNOWN))).otherwise(F.lit(UNKNOWN))
    score = F.when(lettered, F.coalesce(-F.col("best.lost") / (profile * F.size("codes")), F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.select(id_col, lang.alias("lang_pred"), score.alias("score"))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def keep_identified(docs: DataFrame, most: int | None = None) -> DataFrame:
    """``docs`` without the rows that no language is found for: the text is null or has no letter, or none of its most
    frequent n-grams is in any profile, as in a script that no labelled text has.

    Profiles come from all labelled rows, as nothing is evaluated here. Where no row has a usable label nothing is
    learned; then every text with a letter stays.
    """
    ranks = learn(docs)
    profiles = collected(ranks, MAX_BROADCAST_RANKS if most is None else most)
    names, types = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    small_batches(docs.sparkSession)
    if profiles is None:  # the verdict hangs on the text alone, so each distinct text is judged and joined back
        key = spare(docs, "_text")
        keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
        found = identify(keyed.select(key, "text").dropDuplicates([key]), ranks, id_col=key, most=most).filter("score > 0")
        return keyed.join(found.select(key), key, "left_semi").select(*names)
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = shared.value.judge, bool(shared.value.languages)
        for b in batches:
            texts = (x.as_py() for x in b.column(at))
            yield b.filter(pa.array([judge(x)[1] > 0 if known else has_letter(x) for x in texts], pa.bool_()))

    return docs.mapInArrow(run, types)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"))
    return identify(docs, learn(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
