"""The string similarities of many pairs at once, on numpy arrays; values are those of ``similarity``.

A text of up to 64 characters is one 64-bit number of places, so a step of a kernel is some operations on an array with
a number for each pair. Pairs of longer texts go to the kernels one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from linkspark.functions import similarity

Pair = tuple[str, str]
WORD = 64
#: Numbers in an array of one step, so that a step's arrays stay in a processor's cache.
_CELLS = 1 << 16
_ALL, _ONE = np.uint64(2**64 - 1), np.uint64(1)


def _codes(texts: Sequence[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each text filled up with ``blank``, and lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(sizes.max(initial=0))), blank, np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _places(of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each character of ``at`` the places where the same row of ``of`` has it, a bit each."""
    out = np.zeros(at.shape, np.uint64)
    for k in range(of.shape[1]):
        out |= (of[:, k : k + 1] == at).astype(np.uint64) << np.uint64(k)
    return out


def _first_bits(n: np.ndarray) -> np.ndarray:
    """The ``n`` lowest bits set."""
    n = np.clip(n, 0, WORD)
    return np.where(n >= WORD, _ALL, (_ONE << np.minimum(n, WORD - 1).astype(np.uint64)) - _ONE)


def _parts(pairs: Sequence[Pair], cells: Callable[[int, int], int]) -> Iterator[tuple[list[int], list[Pair]]]:
    """Places and pairs of like lengths, as many as make _CELLS numbers."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        a, b = pairs[order[-1]]
        take = max(1, _CELLS // max(1, cells(len(a), len(b))))
        yield order[-take:], [pairs[k] for k in order[-take:]]
        del order[-take:]


def _lengths(pairs: Sequence[Pair]) -> np.ndarray:
    return np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))


def lcs_lengths(pairs: Sequence[Pair]) -> np.ndarray:
    """Lengths of longest common subsequences."""
    out = np.zeros(len(pairs), np.int64)
    turned = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short = [k for k, (a, _) in enumerate(turned) if 0 < len(a) <= WORD]
    for k, (a, b) in enumerate(turned):
        if len(a) > WORD:
            out[k] = similarity.lcs_length(a, b)
    for at, part in _parts([turned[k] for k in short], lambda n, m: max(n, m)):
        a, n = _codes([x for x, _ in part], 0xFFFFFFFF)
        b, _ = _codes([y for _, y in part], 0xFFFFFFFE)
        row = np.full(len(part), _ALL)
        for hits in np.ascontiguousarray(_places(a, b).T):
            hits = row & hits
            row = (row + hits) | (row - hits)
        out[[short[k] for k in at]] = n - np.bitwise_count(row & _first_bits(n))
    return out


def ratios(pairs: Sequence[Pair]) -> np.ndarray:
    total = _lengths(pairs)
    return np.where(total > 0, 200.0 * lcs_lengths(pairs) / np.maximum(total, 1), 100.0)


def token_set_ratios(pairs: Sequence[Pair]) -> np.ndarray:
    """Both sorted texts begin with the shared tokens, which are in any longest common subsequence."""
    out = np.zeros(len(pairs))
    rest, at, shared = [], [], []
    for k, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both, left, right = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if both and not (left and right):
            out[k] = 100.0
            continue
        rest.append((left, right))
        at.append(k)
        shared.append(sum(map(len, both)) + len(both) - 1 if both else -1)
    if rest:
        joined = np.array(shared)
        n, m = (np.fromiter((len(p[k]) for p in rest), np.int64, len(rest)) + joined + 1 for k in (0, 1))
        best = 200.0 * (lcs_lengths(rest) + joined + 1) / (n + m)
        some = joined >= 0
        for size in (n, m):
            best = np.where(some, np.maximum(best, 200.0 * joined / np.maximum(joined + size, 1)), best)
        out[at] = best
    return out


def partial_ratios(pairs: Sequence[Pair]) -> np.ndarray:
    out = np.zeros(len(pairs))
    todo: list[Pair] = []
    where: list[int] = []
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short or short in long:
            out[k] = 100.0 if short or not long else 0.0
        elif len(short) > WORD:
            out[k] = similarity.partial_ratio(a, b)
        else:
            for p in [(short, long)] + [(long, short)] * (len(short) == len(long)):
                todo.append(p)
                where.append(k)
    for at, part in _parts(todo, lambda n, m: n + m):
        np.maximum.at(out, [where[k] for k in at], _best_windows(part))
    return out


def _best_windows(part: Sequence[Pair]) -> np.ndarray:
    """The best ratio of each first text with any window of the second that is as long, or cut off at an end."""
    a, n = _codes([x for x, _ in part], 0xFFFFFFFF)
    b, m = _codes([y for _, y in part], 0xFFFFFFFE)
    hits = np.concatenate([_places(a, b), np.zeros((len(part), 1), np.uint64)], axis=1)
    nowhere = b.shape[1]
    k = np.arange(1, a.shape[1] + b.shape[1])[None, :]
    start, end = np.maximum(0, k - n[:, None]), np.minimum(k, m[:, None])
    base = (np.arange(len(part)) * hits.shape[1])[:, None]
    row, flat = np.full(start.shape, _ALL), hits.reshape(-1)
    for step in range(a.shape[1]):
        at = start + step
        found = row & flat[base + np.where(at < end, at, nowhere)]
        row = (row + found) | (row - found)
    common = n[:, None] - np.bitwise_count(row & _first_bits(n)[:, None])
    size = end - start
    return np.where(size > 0, 200.0 * common / (n[:, None] + np.maximum(size, 1)), 0.0).max(axis=1)


def jaro_winklers(pairs: Sequence[Pair]) -> np.ndarray:
    out = np.zeros(len(pairs))
    some = []
    for k, (a, b) in enumerate(pairs):
        if a and b and len(b) <= WORD and len(a) <= 4 * WORD:
            some.append(k)
        else:
            out[k] = similarity.jaro_winkler(a, b)
    for at, part in _parts([pairs[k] for k in some], lambda n, m: max(n, m)):
        out[[some[k] for k in at]] = _jaro_winklers(part)
    return out


def _jaro_winklers(part: Sequence[Pair]) -> np.ndarray:
    a, n = _codes([x for x, _ in part], 0xFFFFFFFF)
    b, m = _codes([y for _, y in part], 0xFFFFFFFE)
    hits = np.ascontiguousarray(_places(b, a).T)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    used, matched = np.zeros(len(part), np.uint64), np.zeros(a.shape, bool)
    for k in range(a.shape[1]):
        free = hits[k] & _first_bits(k + reach + 1) & ~_first_bits(k - reach) & ~used
        used |= free & (~free + _ONE)
        matched[:, k] = free != 0
    taken = (used[:, None] >> np.arange(b.shape[1], dtype=np.uint64)[None, :] & _ONE).astype(bool)
    count = np.bitwise_count(used).astype(np.int64)
    most = int(count.max(initial=0))
    first = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), axis=1)[:, :most]
    second = np.take_along_axis(b, np.argsort(~taken, axis=1, kind="stable"), axis=1)[:, :most]
    swaps = ((first != second) & (np.arange(most)[None, :] < count[:, None])).sum(axis=1) // 2
    jaro = (count / n + count / m + (count - swaps) / np.maximum(count, 1)) / 3
    width = min(4, a.shape[1], b.shape[1])
    prefix = np.cumprod(a[:, :width] == b[:, :width], axis=1).sum(axis=1)
    return np.where(count > 0, 100.0 * np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro), 0.0)


KERNELS = {"ratio": ratios, "set": token_set_ratios, "partial": partial_ratios, "jw": jaro_winklers}


def scores(kernels: Iterable[str], *columns: tuple[Sequence[str | None], Sequence[str | None]]) -> list[list[np.ndarray]]:
    """For each column of pairs the values of each kernel; a pair is scored once, however many rows and columns have it."""
    number: dict[Pair, int] = {}
    rows = [np.fromiter((number.setdefault((x or "", y or ""), len(number)) for x, y in zip(a, b, strict=True)), np.int64, len(a)) for a, b in columns]
    pairs = list(number)
    values = [KERNELS[k](pairs) for k in kernels]
    return [[v[at] for v in values] for at in rows]


def _column_udf(kernel: str):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scores([kernel], (a.tolist(), b.tolist()))[0][0])

    return run


SIMILARITIES = [f"{x}_{k}" for x in ("full", "core") for k in KERNELS] + ["address_ratio", "address_set"]


@F.pandas_udf(StructType([StructField(name, FloatType()) for name in SIMILARITIES]))
def pair_similarities(full_a: pd.Series, full_b: pd.Series, core_a: pd.Series, core_b: pd.Series, address_a: pd.Series, address_b: pd.Series) -> pd.DataFrame:
    full, core = scores(KERNELS, (full_a.tolist(), full_b.tolist()), (core_a.tolist(), core_b.tolist()))
    (address,) = scores(("ratio", "set"), (address_a.tolist(), address_b.tolist()))
    return pd.DataFrame({n: v.astype("float32") for n, v in zip(SIMILARITIES, [*full, *core, *address], strict=True)})


ratio_of, token_set_ratio_of, partial_ratio_of, jaro_winkler_of = map(_column_udf, KERNELS)
