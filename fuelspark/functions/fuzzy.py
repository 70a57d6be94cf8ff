"""String similarity: the one place where Python code runs inside tasks.

The base ratio is the normalised Indel similarity 200 * lcs(a, b) / (len(a) + len(b)). Spark does the
blocking and the distribution; these helpers see Arrow batches and work on the distinct pairs of each.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fuelspark.functions.lookups import BRAND_ALIASES, BRANDS

# the helpers travel with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _places(a: str) -> dict[str, int]:
    """Where each character stands in the text, as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def _lcs(size: int, where: dict[str, int], b: str) -> int:
    """Longest common subsequence with a text given by its places, one big-integer step per character of ``b``."""
    full = (1 << size) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return _lcs(len(a), _places(a), b) if a and b else 0


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text against any window of the longer one (shorter at the edges), or ``least`` if that is
    more."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return max(least, 100.0 if not long else 0.0)
    best = _best_window(short, long, least)
    if len(short) == len(long) and best < 100.0:
        best = _best_window(long, short, best)
    return best


def _best_window(short: str, long: str, best: float) -> float:
    """The best ratio of a window, if over ``best``. Only windows that could be over it are compared: by their characters in
    any order, and by the last one compared, as a step to the right adds one common character at most."""
    width, size = len(short), len(long)
    if best >= 100.0 or short in long:
        return 100.0
    where = _places(short)
    left = {ch: bits.bit_count() for ch, bits in where.items()}  # of each character, those the window leaves unmatched
    common = cap = 0
    for end in range(1, size + width):
        if end <= size and long[end - 1] in left:
            ch = long[end - 1]
            left[ch] -= 1
            common += left[ch] >= 0
        if end > width and long[end - width - 1] in left:
            ch = long[end - width - 1]
            common -= left[ch] >= 0
            left[ch] += 1
        start, stop = max(0, end - width), min(end, size)
        cap += 1
        # a window whose open edge holds a foreign character is never better than the one without it
        edge = long[stop - 1] if end <= size else long[start]
        if edge in left and 100.0 * 2 * min(common, cap) / (width + stop - start) > best:
            cap = _lcs(width, where, long[start:stop])
            best = max(best, 100.0 * 2 * cap / (width + stop - start))
    return best


def token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common = " ".join(sorted(ta & tb))
    rest_a, rest_b = " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if common and (not rest_a or not rest_b):
        return 100.0
    full_a, full_b = " ".join(filter(None, (common, rest_a))), " ".join(filter(None, (common, rest_b)))
    shared = len(full_a) - len(rest_a) + lcs_length(rest_a, rest_b)
    best = 100.0 * 2 * shared / (len(full_a) + len(full_b))
    if common:
        best = max(best, *(200.0 * len(common) / (len(common) + len(x)) for x in (full_a, full_b)))
    return best


def _by_tokens(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def name_similarity(a: str, b: str) -> float:
    return partial_ratio(a, b, _by_tokens(a, b))


def address_similarity(a: str, b: str) -> float:
    return partial_ratio(a, b, token_sort_ratio(a, b))


_LONGEST = 256  # characters of a shorter text that is compared side by side with others
_WINDOWS = 32_768  # of one round, about: what stays in a core's cache


def _tokens(texts) -> dict[str, list[str]]:
    return {t: sorted(t.split()) for t in texts}


def _indel_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """``indel_ratio`` of many pairs."""
    return [200.0 * n / total if (total := len(a) + len(b)) else 100.0 for (a, b), n in zip(pairs, lcs_lengths(pairs))]


def _sort_ratios(pairs: list[tuple[str, str]], tokens: dict[str, list[str]]) -> list[float]:
    """``token_sort_ratio`` of many pairs."""
    joined = {t: " ".join(words) for t, words in tokens.items()}
    return _indel_ratios([(joined[a], joined[b]) for a, b in pairs])


def _set_ratios(pairs: list[tuple[str, str]], tokens: dict[str, list[str]]) -> list[float]:
    """``token_set_ratio`` of many pairs."""
    sets = {t: frozenset(words) for t, words in tokens.items()}
    out: list[float] = [0.0] * len(pairs)
    todo: list[tuple[int, str, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        ta, tb = sets[a], sets[b]
        if ta and tb:
            shared = ta & tb
            if shared and (len(shared) == len(ta) or len(shared) == len(tb)):
                out[k] = 100.0
            else:
                todo.append((k, " ".join(sorted(shared)), " ".join(sorted(ta - shared)), " ".join(sorted(tb - shared))))
    for (k, common, rest_a, rest_b), n in zip(todo, lcs_lengths([t[2:] for t in todo])):
        begun = len(common) + 1 if common else 0  # both texts begin with the common words and a blank
        total = 2 * begun + len(rest_a) + len(rest_b)
        out[k] = 200.0 * (begun + n) / total
        if common:
            out[k] = max(out[k], *(200.0 * len(common) / (len(common) + begun + len(x)) for x in (rest_a, rest_b)))
    return out


def _least(similarity, pairs: list[tuple[str, str]]) -> list[float]:
    """What a similarity compares with the best window: ratios of the words in order."""
    tokens = _tokens({t for pair in pairs for t in pair})
    ratios = _sort_ratios(pairs, tokens)
    return [max(x) for x in zip(ratios, _set_ratios(pairs, tokens))] if similarity is name_similarity else ratios


def partial_ratios(pairs: list[tuple[str, str]], least: list[float]) -> list[float]:
    """``partial_ratio`` of many pairs, their windows compared side by side."""
    out = list(least)
    todo: list[tuple[int, int, int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        m, n = len(a), len(b)
        m, n, short, long = (m, n, a, b) if m <= n else (n, m, b, a)
        if not 0 < m <= _LONGEST or n > _WINDOWS or out[k] >= 100.0 or short in long:
            out[k] = partial_ratio(a, b, out[k])
        else:
            todo.append((m, n, k, short, long))
            if m == n:
                todo.append((m, n, k, long, short))
    todo.sort()  # like lengths together
    for some in _rounds(todo, lambda m, n: (m + n) * (m + 63 >> 6), _WINDOWS):
        for (_, _, k, _, _), best in zip(some, _best_windows([(x, y) for *_, x, y in some])):
            if best > out[k]:
                out[k] = best
    return out


def lcs_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """``lcs_length`` of many pairs, side by side."""
    out = [0] * len(pairs)
    todo: list[tuple[int, int, int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        m, n = len(a), len(b)
        m, n, short, long = (m, n, a, b) if m <= n else (n, m, b, a)
        if a == b:
            out[k] = m
        elif m > _LONGEST or n > _WINDOWS:
            out[k] = lcs_length(a, b)
        elif m:
            todo.append((n, m, k, short, long))
    todo.sort()
    for some in _rounds(todo, lambda n, m: n * (m + 63 >> 6), 16 * _WINDOWS):
        short, long = [t[3] for t in some], [t[4] for t in some]
        steps = np.array([t[0] for t in some])
        places = _places_of(short, long, np.zeros(len(some), dtype=np.int64), int(steps[-1]))
        for (_, _, k, _, _), n in zip(some, _common(short, places, steps, 1)[0].tolist()):
            out[k] = n
    return out


def _rounds(todo: list[tuple], size, most: int) -> Iterator[list[tuple]]:
    """Pairs in order, as many at a time as hold about ``most`` words, each as large as the largest of its round."""
    begin = wide = 0
    for end, (x, y, *_) in enumerate(todo):
        wide = max(wide, size(x, y))
        if end > begin and (end + 1 - begin) * wide > most:
            yield todo[begin:end]
            begin, wide = end, size(x, y)
    if todo:
        yield todo[begin:]


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts, one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character of texts of these sizes, one after the other, the text and the place in it."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _places_of(short: list[str], long: list[str], offset: np.ndarray, wide: int) -> np.ndarray:
    """Of each character of the longer texts, which begin at ``offset``, its places in the shorter one as bits of words: an
    array by word, place and pair. Elsewhere there are none, as blanks that match nothing."""
    m, n = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    a, b = _codes(short), _codes(long)
    kind = np.zeros(int(max(a.max(), b.max())) + 1, dtype=np.int64)
    kind[a] = 1
    kind = np.cumsum(kind) * kind  # characters of shorter texts count from 1, all others are 0
    kinds, words = int(kind.max()) + 1, int(m.max()) + 63 >> 6
    where = np.zeros((words, len(short) * kinds), dtype=np.uint64)
    pair, place = _spread(m)
    np.bitwise_or.at(where, (place >> 6, pair * kinds + kind[a]), np.uint64(1) << (place & 63).astype(np.uint64))
    where[:, ::kinds] = 0
    pair, place = _spread(n)
    out = np.zeros((words, wide, len(long)), dtype=np.uint64)
    out[:, place + offset[pair], pair] = where[:, pair * kinds + kind[b]]
    return out


def _common(short: list[str], places: np.ndarray, steps: np.ndarray, count: int) -> np.ndarray:
    """Lengths of the longest common subsequences of each shorter text and the ``count`` windows of its longer one that begin
    at the first places, of as many characters as ``steps`` tells, which ascend. One step of all windows at a time: what
    ``_lcs`` does on whole numbers is done on words with carry."""
    words, _, pairs = places.shape
    rows = np.full((words, count, pairs), ~np.uint64(0))
    first = np.searchsorted(steps, np.arange(steps[-1]), "right")  # of the pairs with a character left
    for step, at in enumerate(first):
        carry = None
        for row, place in zip(rows[:, :, at:], places[:, step:step + count, at:]):
            hit = row & place
            total = row + hit
            if words > 1:
                over = total < hit
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            np.subtract(row, hit, out=row)
            np.bitwise_or(row, total, out=row)
    size = np.array([len(t) for t in short])
    left = np.zeros((count, pairs), dtype=np.int64)
    for word, row in enumerate(rows):
        bits = np.clip(size - 64 * word, 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        left += np.bitwise_count(row & mask)
    return size - left


def _best_windows(some: list[tuple[str, str]]) -> list[float]:
    """The best ratio of each shorter text against all windows of the longer one; like ``_best_window``. Pairs come by the
    length of the shorter text."""
    short, long = [t[0] for t in some], [t[1] for t in some]
    m, n = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    count = int((n + m).max()) - 1
    common = _common(short, _places_of(short, long, m - 1, count + int(m[-1])), m, count)
    start = np.arange(count)[:, None]
    size = np.minimum(start + 1, n) - np.maximum(0, start + 1 - m)
    # windows beyond the longer text have no common character
    return (100.0 * 2 * common / (m + np.maximum(size, 1))).max(axis=0).tolist()


SEEN_MOST = 50_000
_SEEN: dict[str, dict[tuple[str, str], float]] = {}  # scores of a task's last batches, per similarity


def _score_batch(a: pd.Series, b: pd.Series, similarity) -> pd.Series:
    """Scores of a batch, each distinct pair of the last batches computed once; null when a side is null."""
    pairs = pd.MultiIndex.from_arrays([a, b])
    codes, distinct = pd.factorize(pairs)
    seen = _SEEN.setdefault(similarity.__name__, {})
    if len(seen) > SEEN_MOST:
        seen.clear()

    whole = [isinstance(x, str) and isinstance(y, str) for x, y in distinct]
    new = [pair for pair, both in zip(distinct, whole) if both and pair not in seen]
    ratios = partial_ratios(new, _least(similarity, new))
    seen.update((pair, ratio / 100.0) for pair, ratio in zip(new, ratios))
    scores = pd.Series([seen[pair] if both else None for pair, both in zip(distinct, whole)], dtype="float64")
    return pd.Series(scores.to_numpy()[codes], index=a.index)


@F.pandas_udf(T.DoubleType())
def name_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _score_batch(a, b, name_similarity)


@F.pandas_udf(T.DoubleType())
def address_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _score_batch(a, b, address_similarity)


def nearest_brand(text: str) -> str | None:
    """Canonical brand at 80 or more, else the alias at 82 or more; ties go to the first listed."""
    score, brand = max(((token_sort_ratio(text, b), b) for b in BRANDS), key=lambda x: x[0])
    if score >= 80:
        return brand
    score, alias = max(((token_sort_ratio(text, a), a) for a in BRAND_ALIASES), key=lambda x: x[0])
    return BRAND_ALIASES[alias] if score >= 82 else None


@F.pandas_udf(T.StringType())
def nearest_brand_udf(text: pd.Series) -> pd.Series:
    found = {t: nearest_brand(t) for t in text.dropna().unique()}
    # plain objects: a series of pandas' own string type can reach Arrow in chunks, which a batch cannot hold
    return pd.Series([found.get(t) if isinstance(t, str) else None for t in text], index=text.index, dtype=object)
