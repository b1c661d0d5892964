"""Periodic runs of words by maximal pairs.

Suffixes sharing enough words are sorted, and their tree of common-prefix intervals is built from the
leaves up. Every interval carries the positions of its suffixes in lists by the word to their left. Where
two children of an interval of ``l`` common words meet, two positions in lists of different left words are
a maximal pair: equal over exactly ``l`` words and not beyond on either side. If their distance ``q`` is
small enough, the stretch from the first one over ``l + q`` words is a run of period ``q``; nothing has to
be extended.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, insort
from collections.abc import Callable
from heapq import merge
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A run is at least so many words long, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words of the documents looked through together; a longer document is a group of its own.
WORDS = 1_000_000
#: From so many left words on, an interval also keeps all its positions in one order.
FEW = 6


class Interval:
    """Positions of one interval: sorted lists by left word, and all of them in order once left words are many.

    The first and second of the shortest period's positions are neighbours among all positions of an interval,
    as a position between them would give a shorter period. So the nearest position on each side is enough.
    """

    __slots__ = ("by_left", "order", "size")

    def __init__(self, left: int, position: int):
        self.by_left, self.order, self.size = {left: [position]}, None, 1

    def near(self, left: int, position: int) -> list[int]:
        """The nearest positions on both sides with another left word; all or none of them per list."""
        out = []
        if self.order is not None:
            at = bisect_left(self.order, position)
            return self.order[max(at - 1, 0) : at + 1]
        for other, held in self.by_left.items():
            if other != left:
                at = bisect_left(held, position)
                out += held[max(at - 1, 0) : at + 1]
        return out

    def take(self, small: Interval) -> None:
        for left, new in small.by_left.items():
            held = self.by_left.get(left)
            if held is None:
                self.by_left[left] = new
            elif len(new) == 1:
                insort(held, new[0])
            else:
                self.by_left[left] = list(merge(held, new))
        self.size += small.size
        if self.order is None:
            if len(self.by_left) > FEW:
                self.order = sorted(x for held in self.by_left.values() for x in held)
        elif small.size == 1:
            for held in small.by_left.values():
                insort(self.order, held[0])
        else:
            self.order = list(merge(self.order, sorted(x for held in small.by_left.values() for x in held)))


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the words each shares with the one before it (0 for the first)."""
    n, width, levels = len(ids), 1, [np.unique(ids, return_inverse=True)[1]]
    while levels[-1].max(initial=0) < n - 1:
        rank, behind = levels[-1], np.zeros(n, np.int64)
        behind[: max(n - width, 0)] = rank[width:] + 1
        levels.append(np.unique(rank * (n + 1) + behind, return_inverse=True)[1])
        width *= 2
    order = np.argsort(levels[-1])
    shared, a, b = np.zeros(n, np.int64), order[1:], order[:-1]
    for i in reversed(range(len(levels))):
        # Grams cut off by the end are equal to no other, so equal ranks are equal words.
        rank = np.append(levels[i], -1)
        shared[1:] += (rank[np.minimum(a + shared[1:], n)] == rank[np.minimum(b + shared[1:], n)]) << i
    return order, shared


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period."""
    if len(ids) < min_length:
        return []
    least = math.ceil(min_length * (min_exponent - 1) / min_exponent)
    order, shared = sorted_suffixes(np.asarray(ids))
    left_of = np.append(np.asarray(ids, np.int64), -1)[np.arange(len(ids)) - 1].tolist()
    shared = np.append(shared, 0)
    runs: dict[tuple[int, int], int] = {}

    def join(a: Interval, b: Interval, words: int) -> Interval:
        big, small = (a, b) if a.size >= b.size else (b, a)
        reach = words // (min_exponent - 1)
        for left, held in small.by_left.items():
            for x in held:
                for y in big.near(left, x):
                    period = x - y if x > y else y - x
                    if period <= reach and words + period >= min_length and left_of[y] != left:
                        start = y if x > y else x
                        key = start, words + period
                        if period < runs.get(key, period + 1):
                            runs[key] = period
        big.take(small)
        return big

    # Only where neighbours share enough words can a run begin.
    close = shared >= least
    inside = np.flatnonzero(close | np.append(close[1:], False))
    open_: list[tuple[int, Interval]] = []
    for at, position, words in zip(inside.tolist(), order[inside[inside < len(ids)]].tolist(), shared[inside + 1].tolist()):
        node = Interval(left_of[position], position)
        while open_ and open_[-1][0] > words:
            depth, held = open_.pop()
            node = join(held, node, depth)
        if words < least:
            continue
        if open_ and open_[-1][0] == words:
            open_[-1] = words, join(open_[-1][1], node, words)
        else:
            open_.append((words, node))
    return sorted((start, length, period) for (start, length), period in runs.items())


_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def with_repeats(ids: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """Which of the sequences laid end to end hold some ``words`` words twice.

    Equal words have equal hashes, so none is missed; a chance hit only costs time.
    """
    width, hashes = 1, ids.astype(np.uint64) * _MIX[0]
    hashes ^= hashes >> np.uint64(29)
    target = 1 << (words.bit_length() - 1)
    for mix in _MIX[1:] * 16:
        if width >= target:
            break
        hashes = hashes[:-width] * mix + hashes[width:] if len(hashes) > width else hashes[:0]
        hashes ^= hashes >> np.uint64(31)
        width *= 2
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :][: len(hashes)])
    keys = hashes[whole] + owner[whole].astype(np.uint64) * _MIX[1]
    order = np.argsort(keys)
    twice = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(sizes), bool)
    out[owner[whole[order[1:][twice]]]] = True
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
_FOUND = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(turns).tolist()) if not gone]


def _row(words: list[bytes], runs: list[tuple[int, int, int]], with_text: bool) -> tuple:
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    for run in runs:  # Ratios of long runs may be nearer to each other than floats tell.
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    text = b" ".join(collapsed(words, runs))
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *top, _sha(told), _sha(text), *((text.decode(),) if with_text else ()))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, with its later words made periodic; a null id is never."""
    if doc_id is None or not words:
        return words
    group, tenth = divmod(crc32(b"%d" % doc_id), 10)
    if tenth:
        return words
    start = group % len(words)
    period = 1 + (len(words) - start) // (3 + group % 8)
    repeated = words[start : start + period]
    times = -(-(len(words) - start) // period)
    return words[:start] + (repeated * times)[: len(words) - start]


def run_rows(ids: list[int | None], texts: list[str], prepared: Callable | None, with_text: bool, **how: int) -> list[tuple]:
    """Rows of a group of documents."""
    documents = [text.encode("utf-8", "surrogatepass").split() for text in texts]
    if prepared is not None:
        documents = [prepared(i, words) for i, words in zip(ids, documents)]
    numbers = _Numbers()
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    flat = np.fromiter((numbers[w] for words in documents for w in words), np.int64, int(sizes.sum()))
    least = math.ceil(how.get("min_length", MIN_LENGTH) * (1 - 1 / how.get("min_exponent", MIN_EXPONENT)))
    maybe, ends = with_repeats(flat, sizes, least).tolist(), np.cumsum(sizes).tolist()
    return [
        _row(words, find_runs(flat[end - len(words) : end], **how) if look else [], with_text)
        for words, end, look in zip(documents, ends, maybe)
    ]


def word_runs(docs: DataFrame, prepared: Callable | None = None, with_text: bool = False, **how: int) -> DataFrame:
    """Per document: number of runs, the run of greatest exponent, hashes of all runs and of the collapsed text.

    Words lie between spaces and the control characters 9 to 13. ``prepared(doc_id, words)`` may change the
    words first; ``min_length`` and ``min_exponent`` (at least 3) say what a run is; ``with_text`` adds
    ``collapsed``. A null text counts as empty: no runs, four nulls, hashes of nothing. Repeated rows and
    null ids give a row each; an empty table gives none.
    """
    if how.get("min_exponent", MIN_EXPONENT) < 3:
        raise ValueError("the nearest positions decide only from three periods on")
    names, kinds = (*_FIELDS, "collapsed") if with_text else _FIELDS, _FOUND + (", collapsed string" if with_text else "")

    def look(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows, group, size = [], [], 0
        known = [None if pd.isna(i) else int(i) for i in ids]
        for pair in zip(known, texts.tolist()):
            words = len(pair[1]) // 5
            if group and size + words > WORDS:
                rows += run_rows(*map(list, zip(*group)), prepared, with_text, **how)
                group, size = [], 0
            group.append(pair)
            size += words
        if group:
            rows += run_rows(*map(list, zip(*group)), prepared, with_text, **how)
        out = pd.DataFrame(rows, columns=list(names))
        return out.astype({n: "Int64" for n in names[1:5]})

    # Ids travel as text, as a null among numbers would turn them into floats.
    found = F.pandas_udf(look, kinds)(F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", found.alias("r")).select("doc_id", "r.*")
