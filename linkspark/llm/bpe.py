"""Byte-level BPE over a global shuffle of distinct words.

Texts are cut into pre-tokens block by block. The distinct words of a block go to the words' buckets, each bucket
encodes each distinct word of the corpus once, and the ids return to the blocks, which put them back by position.
Decoding joins the ids with the token-byte table: its rows are those of the vocabulary, so it is broadcast, and as its
keys are 0 to n - 1 the join is a gather by position.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import blocks
from linkspark.llm.storage import small_batches

RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Ids that are written at once.
_AT_ONCE = 1 << 20
_NEVER = 1 << 60
#: Bytes of a word whose pairs are searched through for each merge; longer words keep them in a heap.
_LONG = 128


def merge(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The ids of one word: its bytes, with the neighbours of least rank merged, leftmost first, while any have one."""
    whole = known.get(word)
    if whole is not None:
        return [whole]
    if len(word) > _LONG:
        return _merge_long(word, known)
    rank = known.get
    parts = [word[k : k + 1] for k in range(len(word))]
    pairs = [rank(a + b, _NEVER) for a, b in pairwise(parts)]
    while pairs and (least := min(pairs)) < _NEVER:
        k = pairs.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k < len(pairs):
            pairs[k] = rank(parts[k] + parts[k + 1], _NEVER)
        if k:
            pairs[k - 1] = rank(parts[k - 1] + parts[k], _NEVER)
    return [known[x] for x in parts]


def _merge_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same in time that grows with n log n: a heap of pairs by rank and place, and links between what is left."""
    n = len(word)
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # a part begins where its key is, and goes to its end
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := known.get(word[k : k + 2])) is not None]
    heapify(heap)
    while heap:
        _, k, stop = heappop(heap)
        if end[k] < 0 or end[k] >= n or end[end[k]] != stop:
            continue  # one of the two has been merged since
        middle, end[k] = end[k], stop
        end[middle] = -1
        if stop < n:
            before[stop] = k
            if (r := known.get(word[k : end[stop]])) is not None:
                heappush(heap, (r, k, end[stop]))
        if k and (r := known.get(word[before[k] : stop])) is not None:
            heappush(heap, (r, before[k], stop))
    return [known[word[k : end[k]]] for k in range(n) if end[k] > 0]


def token_bytes(known: dict[bytes, int]) -> list[bytes | None]:
    """The token-byte table by id."""
    out: list[bytes | None] = [None] * (max(known.values(), default=-1) + 1)
    for token, k in known.items():
        out[k] = token
    return out


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Spelling:
    """Writes many id lists at once: each id stands for the bytes of its row in a table."""

    def __init__(self, rows: list[bytes | None]) -> None:
        self.sizes = np.fromiter((-1 if x is None else len(x) for x in rows), np.int64, len(rows))
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - self.sizes
        self.data = np.frombuffer(b"".join(x or b"" for x in rows), np.uint8)

    def write(self, ids: np.ndarray, counts: np.ndarray, drop: int = 0) -> list[bytes]:
        """The bytes of each list, without the last ``drop``; ``ids`` holds the lists end to end. An id without a row raises."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            raise ValueError("an id outside the vocabulary")
        made = []
        for first in range(0, len(ids), _AT_ONCE):
            some = ids[first : first + _AT_ONCE]
            sizes = self.sizes[some]
            if (sizes < 0).any():
                raise ValueError("an id outside the vocabulary")
            at = np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes)
            at += np.arange(len(at))
            made.append(self.data[at].tobytes())
        out, ends = b"".join(made), np.cumsum(self.sizes[ids])
        edges = np.concatenate([[0], ends])[np.cumsum(counts)].tolist()
        return [out[a : max(a, b - drop)] for a, b in zip([0, *edges[:-1]], edges, strict=True)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists end to end, and how many each list has; null counts as empty."""
    return np.asarray(column.flatten(), np.int64), np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)


#: The code points that Unicode calls white space.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pattern for the standard library, twice as fast: letters are what is alphanumeric and no digit.
_QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_BLANK}]|_)+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
#: A letter, a digit and a mark that no version of Unicode disputes, and that are in no contraction.
_LEADS = {"a": "é", "1": "7", ".": "§"}


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points that the tiktoken library takes for another class than the standard library does, and a character of that class.

    They are numbers other than digits, and what the two libraries' versions of Unicode differ on. The newest version at
    hand names the candidates; what the library takes them for shows in whether they join a letter, digit or mark before.
    """
    every = "".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)
    letters, numbers = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every))
    asked = [c for c in every if (c in letters) != (c.isalnum() and not c.isdecimal()) or (c in numbers) != c.isdecimal()]
    joined: dict[bytes, int] = {bytes([k]): k for k in range(256)}
    for lead in _LEADS:
        for c in asked:
            data = (lead + c).encode()
            for end in range(2, len(data) + 1):
                joined.setdefault(data[:end], len(joined))
    library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=joined, special_tokens={})
    return {ord(c): stand for c in asked for lead, stand in _LEADS.items() if len(library.encode_ordinary(lead + c)) == 1}


def pre_tokens(text: str | None, pattern: str, other: dict[int, str] | None = None) -> list[str]:
    """The matches of the pattern, for the public one as the tiktoken library finds them; none for null.

    ``other`` are the stand_ins(), for workers that get them sent. A text with such characters is cut where the same
    text with their stand-ins is.
    """
    if not text:
        return []
    if pattern != public_tokenizers.PATTERN:
        return _pattern(pattern).findall(text)
    if text.isascii():
        return _QUICK.findall(text)
    other = stand_ins() if other is None else other
    if other.keys().isdisjoint(map(ord, set(text))):
        return _QUICK.findall(text)
    ends = [m.end() for m in _QUICK.finditer(text.translate(other))]
    return [text[a:b] for a, b in pairwise([0, *ends])]


def _words_of(texts: Iterable[str | None], pattern: str, other: dict[int, str]) -> tuple[list[list[str]], dict[str, str]]:
    """The pre-tokens of each text, and the distinct ones; equal pre-tokens are one object."""
    distinct: dict[str, str] = {}
    found = []
    for text in texts:
        words = pre_tokens(text, pattern, other)
        found.append(list(map(distinct.setdefault, words, words)))
    return found, distinct


def _by_bucket(words: Iterable[str], n_buckets: int) -> dict[int, list[str]]:
    """Words sorted within each bucket; only buckets with words."""
    out: dict[int, list[str]] = {}
    mask, crc = n_buckets - 1, zlib.crc32
    for word in sorted(words):
        out.setdefault(crc(word.encode()) & mask, []).append(word)
    return out


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    lengths = np.fromiter(map(len, data), np.uint32, len(data))
    return len(data).to_bytes(4, "little") + blocks.squeeze(lengths.tobytes() + b"".join(data))


def _unpack_words(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:4], "little")
    raw = blocks.expand(blob[4:])
    ends = np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32), dtype=np.int64).tolist()
    body = raw[4 * n :]
    return [body[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row.

    Every whole text is encoded as the tiktoken library does, without special tokens; null counts as empty and gives
    no ids. Rows that share an id each give a row. A word of any length is one word; a word that a third of all
    texts hold is sent once by each block. An empty table gives no rows; other columns are passed over.
    """
    path = path or public_tokenizers.path(RANKS)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    packed = blocks.pack_rows(rows)
    n_buckets = blocks.buckets(docs)
    id_type = rows.schema[id_col].dataType.simpleString()
    other = docs.sparkSession.sparkContext.broadcast(stand_ins())

    def send(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        for text in table.column("text"):
            words.update(pre_tokens(text.as_py(), pattern, other.value))
        lists = _by_bucket(words, n_buckets)
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(lists), pa.int64()), pa.array(lists, pa.int32()), pa.array(map(_pack_words, lists.values()), pa.binary())], ["block", "bucket", "words"])

    def encode(table: pa.Table) -> pa.Table:
        """One bucket: its words from all blocks, each encoded once."""
        ranked, known = ranks(path), {}
        answers = []
        for blob in table.column("words"):
            words = _unpack_words(blob.as_py())
            for w in words:
                if w not in known:
                    known[w] = merge(w.encode(), ranked)
            ids = [known[w] for w in words]
            counts = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
            answers.append(blocks.pack_numbers(np.concatenate([counts, flat])))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(answers, pa.binary())], ["block", "bucket", "answer"])

    def reassemble(table: pa.Table, told: dict[int, bytes]) -> pa.Table:
        found, distinct = _words_of((t.as_py() for t in table.column("text")), pattern, other.value)
        words, counts, ids = [], [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for k, held in _by_bucket(distinct, n_buckets).items():
            numbers = blocks.unpack_numbers(told[k], np.uint32)
            words += held
            counts.append(numbers[: len(held)])
            ids.append(numbers[len(held) :])
        n_ids, flat = np.concatenate(counts).astype(np.int64), np.concatenate(ids).astype(np.int32)
        place = {w: k for k, w in enumerate(words)}.__getitem__
        at = np.fromiter(map(place, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        sizes = n_ids[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(n_ids) - n_ids)[at] - ends[:-1], sizes)]
        offsets = ends[np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)]
        return pa.table([table.column(id_col), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))], [id_col, "ids"])

    pieces = blocks.each_block(packed, send, "block long, bucket int, words binary")
    answers = pieces.groupBy("bucket").applyInArrow(encode, "block long, bucket int, answer binary")
    return blocks.with_answers(packed, answers, reassemble, f"`{id_col}` {id_type}, ids array<int>")


def _spelling(encoded: DataFrame, path: str):
    """The token-byte table, broadcast."""
    return encoded.sparkSession.sparkContext.broadcast(Spelling(token_bytes(ranks(path))))


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes of each id list; null gives no bytes, an id outside the vocabulary raises."""
    rows, table = encoded.select(F.col(id_col), F.col(ids_col)), _spelling(encoded, path or public_tokenizers.path(RANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(table.value.write(*_lists(b.column(1))), pa.binary())], [id_col, "text"])

    small_batches(encoded.sparkSession)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text binary")


def digest_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of id lists: of the ids in print, and of the bytes that they decode to."""
    rows, table = encoded.select(F.col(id_col), F.col(ids_col)), _spelling(encoded, path or public_tokenizers.path(RANKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printing = Spelling([b"%d " % k for k in range(len(table.value.sizes))])
        for b in batches:
            ids, counts = _lists(b.column(1))
            made = [[hashlib.sha256(x).hexdigest() for x in lines] for lines in (printing.write(ids, counts, drop=1), table.value.write(ids, counts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), *[pa.array(x, pa.string()) for x in made]], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(encoded.sparkSession)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
