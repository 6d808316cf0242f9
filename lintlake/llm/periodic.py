"""Periodic runs of words: stretches that repeat themselves with a small period, and texts without the repeats.

A run is a maximal stretch of words with smallest period q and at least ``exponent * q`` words (and ``least``). Lags
are screened by the number of words that equal the word one lag behind them, counted exactly for all lags of a text at
once: for frequent words by the autocorrelation of their places (one inverse FFT for the sum of their spectra; counts
are whole numbers far below the precision of doubles, so rounding is exact), for the others by the differences of all
pairs of their places. A run of period q has at least ``max(least - q, (exponent - 1) * q)`` matches at lag q, so only
lags with that many are scanned for islands of matches. Matches at lag q that lie in a run of a shorter period d
dividing q can be in no run of period q (q consecutive words of period d make the whole stretch one of period d), and
no match lies in two such runs; they are taken off before a lag is scanned. A text of one word over and over thus
costs one scan and not a quarter of its length. Texts of few words in random order do cost one scan for each lag whose
matches reach the bound.

Words are told apart exactly (by a dictionary of their bytes). A text is handled by the task that reads it; nothing
is shuffled.

Cases: a null, empty or blank text has no words and no runs, and an empty text is left; texts of any length are
handled whole; equal rows get equal results; a null seed leaves the words alone; an empty table gives an empty
table; columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.bytesets import SPACE, column, slices, words
from lintlake.llm.storage import bounded

#: Pairs of places counted at once, and elements of spectra made at once.
CHUNK = 1 << 20
#: start, length, period of a run.
Run = tuple[int, int, int]


def word_numbers(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of each word, the words by number, and where each row's words begin."""
    begin, end, row = words(buf, starts)
    return *numbered(buf[~SPACE[buf]], end - begin), np.searchsorted(row, np.arange(len(starts)))


def numbered(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each of the strings that lie end to end in ``data``, and the strings by number."""
    offsets = np.r_[0, np.cumsum(sizes)]
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return every.indices.to_numpy().astype(np.int64), every.dictionary.to_pylist()


def repeat_tail(codes: np.ndarray, seed: int) -> None:
    """From place ``seed % n`` on, put the words there over and over, a share of the rest that the seed tells."""
    n = len(codes)
    if n:
        a = seed % n
        period = 1 + (n - a) // (3 + seed % 8)
        codes[a:] = codes[a + np.arange(n - a) % period]


def frequent(n: np.ndarray) -> np.ndarray:
    """The count of a word from which its autocorrelation costs less than the pairs of its places."""
    points = 2.0 * np.maximum(n, 2)
    return np.sqrt(points * np.log2(points)) / 2 + 8


def lag_counts(codes: np.ndarray, first: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches of every row at each lag from 0 (not counted) to its words over ``exponent``; where a row's lags begin."""
    n = np.diff(first)
    most = n // exponent
    at = np.r_[0, np.cumsum(most + 1)]
    out = np.zeros(at[-1], np.int64)
    if not len(codes):
        return out, at
    row = np.repeat(np.arange(len(n)), n)
    key = row * (int(codes.max()) + 1) + codes
    place = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(key[place]) != 0])
    times = np.diff(np.r_[edge, len(place)])
    heavy = times > frequent(n)[row[place[edge]]]
    # frequent words: spectra of a row's words are summed before the way back
    owner = row[place[edge[heavy]]]
    for r in np.unique(owner):
        mine = np.flatnonzero(heavy)[owner == r]
        points = 1 << int(n[r] + most[r]).bit_length()
        power = np.zeros(points // 2 + 1)
        step = max(1, CHUNK // points)
        for k in range(0, len(mine), step):
            some = mine[k : k + step]
            seen = np.zeros((len(some), points))
            for line, g in zip(seen, some, strict=True):
                line[place[edge[g] : edge[g] + times[g]] - first[r]] = 1
            power += (np.abs(np.fft.rfft(seen, axis=1)) ** 2).sum(0)
        out[at[r] : at[r + 1]] += np.rint(np.fft.irfft(power, points)[: most[r] + 1]).astype(np.int64)
    # rare words: differences of the k-th next place
    light = np.repeat(~heavy & (times > 1), times)
    spot, group, size = place[light], np.repeat(np.arange(len(edge)), times)[light], np.repeat(times, times)[light]
    found, held = [], 0
    k = 1
    while len(spot) > k:
        same = group[k:] == group[:-k]
        gap, who = (spot[k:] - spot[:-k])[same], row[spot[k:][same]]
        near = gap <= most[who]
        found.append(at[who[near]] + gap[near])
        held += len(found[-1])
        k += 1
        if held >= CHUNK:
            out += np.bincount(np.concatenate(found), minlength=len(out))
            found, held = [], 0
        left = size > k
        if 2 * int(left.sum()) <= len(left):
            spot, group, size = spot[left], group[left], size[left]
    if found:
        out += np.bincount(np.concatenate(found), minlength=len(out))
    return out, at


def divisors(q: int) -> list[int]:
    """q over each of its prime factors: a stretch of period q has a smaller one that divides q if one of these is."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def islands(codes: np.ndarray, q: int, need: int) -> list[Run]:
    """Runs of smallest period q with ``need`` matches at least, by place."""
    edges = np.flatnonzero(np.diff(np.r_[False, codes[q:] == codes[:-q], False]))
    begin, end = edges[::2], edges[1::2]
    out = []
    for a, b in zip(begin[end - begin >= need].tolist(), end[end - begin >= need].tolist(), strict=True):
        part = codes[a : b + q]
        if not any((part[d:] == part[:-d]).all() for d in divisors(q)):
            out.append((a, b - a + q, q))
    return out


def runs(codes: np.ndarray, matches: np.ndarray, exponent: int, least: int) -> list[Run]:
    """The runs of one row, by start and period; ``matches`` (by lag) is used up."""
    lags = np.arange(len(matches))
    need = np.maximum(np.maximum(least - lags, (exponent - 1) * lags), 1)
    out: list[Run] = []
    for q in np.flatnonzero(matches[1:] >= need[1:]) + 1:
        if matches[q] < need[q]:
            continue
        found = islands(codes, int(q), int(need[q]))
        for _, length, _ in found:
            last = min(length, len(matches))
            matches[2 * q : last : q] -= length - lags[2 * q : last : q]
        out += found
    return sorted(out, key=lambda r: (r[0], r[2]))


def first_periods(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run has behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] == 0


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse_runs(df: DataFrame, exponent: int = 4, least: int = 6, seed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs array<struct<start, length, period>>, collapsed`` of every row.

    ``collapsed``: the words that stay, joined by one space. ``seed``: rows in which it is not null have the end of
    their words put over and over first (``repeat_tail``), for tests with known runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts = column(batch["text"])
            for a, b in slices(starts):
                codes, names, first = word_numbers(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                for r, s in enumerate(batch["seed"].slice(a, b - a).to_pylist()):
                    if s is not None:
                        repeat_tail(codes[first[r] : first[r + 1]], s)
                matches, at = lag_counts(codes, first, exponent)
                found, kept = [], []
                for r in range(b - a):
                    mine = codes[first[r] : first[r + 1]]
                    found.append(runs(mine, matches[at[r] : at[r + 1]], exponent, least))
                    stay = mine[first_periods(len(mine), found[-1])] if found[-1] else mine
                    kept.append(b" ".join([names[c] for c in stay.tolist()]).decode())
                spans = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found], SPAN)
                yield pa.RecordBatch.from_arrays([batch[id_col].slice(a, b - a), pa.array(np.diff(first)), spans, pa.array(kept, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    source = bounded(df).select(F.col(id_col), F.col(text_col).alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
