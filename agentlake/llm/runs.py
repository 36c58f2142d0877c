"""Periodic runs of words: stretches that repeat one short sequence of words four times or more.

A run with smallest period q is a stretch of words in which words q apart are identical, which no neighbouring word extends
and which has max(6, 4q) words or more. So position i equals position i + q over at least max(6, 4q) - q positions in a
row, and a grid of that step has a point inside. The grids of all periods of all documents of a block (their sizes form a
harmonic sum, n log n points in all) are built as one array of (period, point); how far equality reaches from each point
to either side is found by binary search on prefix hashes, for all of them at once. Stretches that several periods found
are one run of the smallest. Runs are then verified word by word; where hashes lied, the block is done again with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.llm.words import text_blocks, tidy

#: Fewest words of a run, and fewest repetitions of its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Two primes below 2**31, so products of residues fit 64 bits; together they tell words apart as 62 bits do.
PRIMES = (2_147_483_647, 2_147_483_629)
#: (period, point) pairs that are searched at once (bounds memory; a single period's points may be more).
PAIRS_AT_ONCE = 1 << 20


class PrefixHashes:
    """Polynomial hashes of all prefixes of an array of word numbers; equal stretches are equal once shifted."""

    def __init__(self, codes: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        self.prefix, self.power = [], []
        for prime in PRIMES:
            base, value = (int(x) for x in r.integers(1 << 20, prime - 1, 2))
            power = np.ones(1, dtype=np.uint64)
            while len(power) <= len(codes):  # doubles in length
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), prime)) % np.uint64(prime)])
            term = (codes.astype(np.uint64) + np.uint64(value)) % np.uint64(prime) * power[: len(codes)] % np.uint64(prime)
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(term, out=sums[1:])
            self.prefix.append(sums % np.uint64(prime))
            self.power.append(power)

    def same(self, at: np.ndarray, period: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from ``at`` on equal those ``period`` further."""
        equal = np.ones(len(at), dtype=bool)
        for prime, h, power in zip(PRIMES, self.prefix, self.power, strict=True):
            p = np.uint64(prime)
            near = (h[at + n] + p - h[at]) % p * power[period] % p
            equal &= near == (h[at + period + n] + p - h[at + period]) % p
        return equal


def _furthest(holds, most: np.ndarray) -> np.ndarray:
    """For each element the greatest m <= most with holds(m), where holds(0) is true and stays false once false."""
    low, high = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _stretches(codes: np.ndarray, first: np.ndarray, size: np.ndarray, hashes: PrefixHashes) -> np.ndarray:
    """(document, start, end, period) of every stretch of a period that is long enough, starts and ends in ``codes``."""
    periods = np.maximum(0, np.where(size >= LEAST_WORDS, size // LEAST_TIMES, 0))
    document = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(document)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(LEAST_WORDS, LEAST_TIMES * period) - period  # fewest equal positions in a row
    points = (size[document] - period) // step
    upto = np.cumsum(points)
    out, a = [np.empty((0, 4), dtype=np.int64)], 0
    while a < len(document):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        times = points[a:b]
        which = np.repeat(np.arange(a, b), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        d, p = document[which], period[which]
        at = first[d] + (nth + 1) * step[which] - 1
        hit = codes[at] == codes[at + p]
        d, p, at, which = d[hit], p[hit], at[hit], which[hit]
        begin, end = first[d], first[d] + size[d]
        onward = _furthest(lambda m, at=at, p=p: hashes.same(at, p, m), end - p - at)
        back = _furthest(lambda m, at=at, p=p: hashes.same(at - m, p, m), at - begin)
        long = onward + back >= step[which]
        out.append(np.unique(np.stack([d, at - back, at + onward + p, p], axis=1)[long], axis=0))
        a = b
    return np.concatenate(out)


def _verified(codes: np.ndarray, first: np.ndarray, size: np.ndarray, runs: np.ndarray) -> bool:
    """Whether each run's words are equal a period apart, and those next to it aren't."""
    document, start, end, period = runs.T
    n = end - start - period
    for a in range(0, len(runs), 4096):
        times = n[a : a + 4096]
        at = np.arange(int(times.sum())) + np.repeat(start[a : a + 4096] - (np.cumsum(times) - times), times)
        if not (codes[at] == codes[at + np.repeat(period[a : a + 4096], times)]).all():
            return False
    inside = start > first[document]
    before = codes[start[inside] - 1] == codes[start[inside] - 1 + period[inside]]
    ahead = end < (first + size)[document]
    after = codes[end[ahead]] == codes[end[ahead] - period[ahead]]
    return not (before.any() or after.any())


def find_runs(codes: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """(document, start, length, period) of all runs of documents whose word numbers stand one after the other in
    ``codes``, ``size`` words each; sorted, starts counted from the document's first word."""
    first = np.cumsum(size) - size
    while True:
        found = _stretches(codes, first, size, PrefixHashes(codes, seed))
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        again = np.zeros(len(found), dtype=bool)  # a stretch of a multiple of the smallest period
        again[1:] = (found[1:, :3] == found[:-1, :3]).all(axis=1)
        runs = found[~again]
        if _verified(codes, first, size, runs):
            break
        seed += 1
    runs = np.stack([runs[:, 0], runs[:, 1] - first[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3]], axis=1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    held = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    edges = lists.offsets.to_numpy()
    return flat.filter(there), np.diff(held[edges - edges[0]])


def _lists(values: pa.Array, edges: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(edges.astype(np.int64)), values)


@tidy
def _found(batches: Iterator[pa.RecordBatch], repeats: bool) -> Iterator[pa.RecordBatch]:
    """(row, n_words, runs, collapsed) for batches (row, text, repeat from, repeat period)."""
    for batch in batches:
        place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["at", "text"])
        for at, texts in text_blocks(place):
            words, size = words_of(texts)
            if repeats:
                words = _repeated(words, size, *(batch.column(k).take(at).to_numpy(zero_copy_only=False) for k in (2, 3)))
            runs = find_runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), size)
            first = np.cumsum(size) - size
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
            np.add.at(change, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
            keep = np.cumsum(change)[:-1] == 0
            held = np.concatenate([[0], np.cumsum(keep)])
            kept = _lists(words.filter(pa.array(keep)).cast(pa.large_string()), held[np.concatenate([first, [len(words)]])])
            collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
            edges = np.searchsorted(runs[:, 0], np.arange(len(size) + 1)).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(size), pa.ListArray.from_arrays(pa.array(edges), parts), collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _repeated(words: pa.Array, size: np.ndarray, start: np.ndarray, period: np.ndarray) -> pa.Array:
    """Each text's words from its ``start`` on replaced by its first ``period`` words from there, over and over."""
    place = np.arange(len(words))
    first = np.cumsum(size) - size
    for k in np.flatnonzero(~np.isnan(period.astype(float)) & (size > 0)):
        a, n = int(start[k]), int(size[k])
        place[first[k] + a : first[k] + n] = first[k] + a + np.arange(n - a) % int(period[k])
    return words.take(pa.array(place))


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_runs(docs: DataFrame, repeat: tuple[Column, Column] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed for each row of ``docs``.

    ``collapsed`` is the words that are left, one space between, once every run keeps only its first period. With
    ``repeat`` = (start, period), two integer columns, a text's words from number ``start`` on are first replaced by the
    ``period`` words from there over and over (as they are where ``period`` is null); it makes texts with known runs.

    Words are ``[^\\x20\\x09-\\x0D]+``; case counts. A null, empty or blank text has no words, no runs and an empty
    ``collapsed``. Texts are read whole in blocks of a few MB, a longer one alone: memory grows with the longest text.
    Repeated rows and ids give a row each, a null doc_id stays null, an empty table gives no rows, and other columns are
    ignored, whatever their names. Ties: runs of equal start and length can't differ in period.
    """
    start, period = repeat or (F.lit(None), F.lit(None))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), start.cast("long").alias("a"), period.cast("long").alias("p"))
    return given.mapInArrow(partial(_found, repeats=repeat is not None), RUNS)
