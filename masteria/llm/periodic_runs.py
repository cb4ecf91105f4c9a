"""Runs of words that repeat with a period: found by minimizers on several scales, and collapsed to one period.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least ``least`` words and three
periods long and that no neighbouring word extends.

Periods from W to ``m = W + W/2`` form a scale. All stretches of m words get a name, equal ones the same; in every window of
``2W + 1 - m`` neighbouring stretches the one with the smallest shuffled name, the first of several, is a minimizer. In a run
of period q the first window and the one q words later both lie inside and hold the same, so their minimizers are q
words apart; and as a stretch of at least q words recurs in a run only after whole periods, they are neighbours
among the equal minimizers of the scale. Neighbouring equal minimizers at a distance of the scale therefore reach
every run. Each such pair is a seed: it is extended to both sides as far as words q apart agree, and kept if that is long enough
and has no smaller period. Periods below the first scale are found by scanning each distance directly.

Names are exact: a stretch of 2^k words is named by the names of its halves, so no two different stretches are taken
for equal. A text without two equal stretches of two thirds of ``least`` words has no run and needs no scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from masteria.llm.rows import map_rows, texts_of

LEAST = 24
#: Periods below this are scanned directly.
FIRST = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").split()  # bytes split at exactly \x20, \x09-\x0D


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


class Names:
    """Names of all stretches of a length: equal numbers for equal stretches."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(_dense(_paired(last[:len(last) - half], last[half:])))
        return self.levels[k]

    def of(self, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        half = self._level(k)
        if (rest := length - (1 << k)) == 0:
            return half
        return _paired(half[:len(half) - rest], half[rest:])


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def _dense(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes, return_inverse=True)[1].astype(np.int64, copy=False)


def minimizers(names: np.ndarray, window: int) -> np.ndarray:
    """``rank * len(names) + position`` of the smallest shuffled name of every window, ascending, each once."""
    n = len(names)
    mixed = names.astype(np.uint64) * _MIX
    codes = _dense(mixed ^ mixed >> np.uint64(29)) * n + np.arange(n)
    # Smallest of a window: from its start to the end of its block, and from that block's end to its own.
    blocks = np.full(-(-n // window) * window, np.iinfo(np.int64).max)
    blocks[:n] = codes
    blocks = blocks.reshape(-1, window)
    to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.unique(np.minimum(to_end[:n - window + 1], from_start[window - 1:n]))


def seeds(names: np.ndarray, window: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """``period, position`` of neighbouring equal minimizers that are ``low`` to ``high`` apart, sorted."""
    codes, n = minimizers(names, window), len(names)
    gap = np.diff(codes)
    at = np.flatnonzero((codes[1:] // n == codes[:-1] // n) & (gap >= low) & (gap <= high))
    order = np.lexsort((codes[at] % n, gap[at]))
    return zip(gap[at][order].tolist(), (codes[at][order] % n).tolist())


def _agreeing(words: np.ndarray, period: int, at: int) -> tuple[int, int]:
    """The stretch around ``at`` of places whose word equals the one a period later."""
    first, end, top = at, at + 1, len(words) - period
    step = 64
    while end < top:
        to = min(top, end + step)
        differ = np.flatnonzero(words[end:to] != words[end + period:to + period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = to, 2 * step
    step = 64
    while first > 0:
        to = max(0, first - step)
        differ = np.flatnonzero(words[to:first] != words[to + period:first + period])
        if len(differ):
            first = to + int(differ[-1]) + 1
            break
        first, step = to, 2 * step
    return first, end


def _scan(words: np.ndarray, period: int, least: int) -> Iterator[tuple[int, int]]:
    """All stretches, of the length of a run, of places whose word equals the one a period later."""
    same = np.zeros(len(words) - period + 2, dtype=np.int8)
    same[1:-1] = words[:-period] == words[period:]
    turns = np.diff(same)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    long = ends - starts >= least - period
    return zip(starts[long].tolist(), ends[long].tolist())


def _prime_parts(n: int) -> Iterator[int]:
    """``n`` divided by each of its prime factors."""
    rest, p = n, 2
    while p * p <= rest:
        if rest % p == 0:
            yield n // p
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        yield n // rest


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a stretch of two or more periods has no smaller one: that would divide the period."""
    stretch = words[start:end]
    return not any((stretch[p:] == stretch[:-p]).all() for p in _prime_parts(period))


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of numbered words, by start, then period."""
    n, out = len(words), []
    if n < max(least, 3):
        return out
    names = Names(words)
    # Words agree over two periods and ``least - period`` words of a run, so over two thirds of ``least``.
    repeated = 1 << ((2 * least // 3).bit_length() - 1) if least > 1 else 1
    stretches = names.of(repeated)
    if len(np.unique(stretches)) == len(stretches):
        return out

    def add(start: int, end: int, period: int) -> None:
        length = end - start + period
        if length >= max(least, 3 * period) and _smallest(words, start, end + period, period):
            out.append((start, length, period))

    for period in range(1, min(FIRST, n // 3 + 1)):
        for start, end in _scan(words, period, max(least, 3 * period)):
            add(start, end, period)
    low = FIRST
    while 3 * low <= n:
        high = low + low // 2
        last = (0, 0)
        if n - high + 1 >= (window := 2 * low + 1 - high):
            for period, at in seeds(names.of(high), window, low, high):
                if last[0] != period or at >= last[1]:
                    start, end = _agreeing(words, period, at)
                    add(start, end, period)
                    last = period, end
        low = high + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by spaces, without those that any run contains after its first period."""
    if not runs:
        return b" ".join(words).decode("utf-8")
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()
    return b" ".join(map(words.__getitem__, keep)).decode("utf-8")


def periodic_runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of every text, and the text without their repetitions: ``doc_id, n_words, runs, collapsed``.

    One row per input row, in one pass without a shuffle; whole texts, of any length, in memory in proportion to the
    longest one. ``runs`` are by start, then period. A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Words are joined by single spaces whether or not there are runs. A null id stays null, repeated rows give
    repeated rows, an empty table gives none; other columns are not read.
    """
    def run(rows):
        for row_id, value in rows:
            words = words_of(value)
            runs = find_runs(numbered(words), least)
            yield (row_id, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs))

    return map_rows(texts_of(docs, doc_id, text), run, _RUNS)
