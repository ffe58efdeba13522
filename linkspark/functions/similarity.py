"""String similarities from 0 to 100 of one pair: the definitions. ``batches`` has them for many pairs at once."""

from __future__ import annotations

from functools import lru_cache


def _places(a: str) -> dict[str, int]:
    """A bit for each place of each character."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    return places


def _lcs(n: int, places: dict[str, int], b: str) -> int:
    """Longest common subsequence of ``b`` with a text of length ``n``, all its characters at a time."""
    row = full = (1 << n) - 1
    for c in b:
        if hit := row & places.get(c, 0):
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(len(a), _places(a), b)


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are equal."""
    if not a and not b:
        return 100.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b))


@lru_cache(maxsize=1 << 16)
def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared tokens and each side's tokens, as sorted sets. 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_x and only_y):
        return 100.0
    joined, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    best = ratio(left, right)
    return max(best, ratio(joined, left), ratio(joined, right)) if both else best


@lru_cache(maxsize=1 << 16)
def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer, windows cut off at either end included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0

    def best(short: str, long: str) -> float:
        """Windows by falling bound: no window shares more characters with ``short`` than both hold of each."""
        n, m = len(short), len(long)
        left: dict[str, int] = {}
        for c in short:
            left[c] = left.get(c, 0) + 1
        common, bounds = 0, []
        for k in range(1, m + n):
            if k <= m:
                c = long[k - 1]
                common += left.get(c, 0) > 0
                left[c] = left.get(c, 0) - 1
            if k > n:
                c = long[k - n - 1]
                left[c] += 1
                common -= left[c] > 0
            size = min(m, k) - max(0, k - n)
            bounds.append((common / (n + size), k))
        bounds.sort(reverse=True)
        top, places = 0.0, _places(short)
        for bound, k in bounds:
            if 200 * bound <= top:
                break
            window = long[max(0, k - n) : k]
            top = max(top, 200.0 * _lcs(n, places, window) / (n + len(window)))
        return top

    found = best(short, long)
    return max(found, best(long, short)) if len(short) == len(long) else found


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four where it is over 0.7. Two empty texts are equal."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    n = len(hits)
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return 100.0 * (jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro)
