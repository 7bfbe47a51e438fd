"""Periodic runs of words by recursive frequency splitting.

A run holds at least four periods, so each of its words occurs four times in any segment around it. Words that are
rarer split a segment, their loss makes others rare, and so on until no segment changes; runs lie within what is left.
Lags are then scanned over the surviving segments: a run of at least four periods covers three blocks of the period's
length that lie at multiples of it, so a lag looks at the segment's block hashes alone, and the number of blocks over
all lags is the segment's length times a logarithm.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, table

#: Periods that a run holds at least, and words.
PERIODS, SHORTEST = 4, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_DDL = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def surviving(words: np.ndarray) -> list[tuple[int, int]]:
    """Segments [low, high) of numbered words in which every word occurs PERIODS times and that hold SHORTEST words. All
    others were split at the words that occur too rarely in them, until that changed nothing. A word moves to a count of
    its own at most as often as its segment halves."""
    counts = np.bincount(words)
    cuts = np.flatnonzero(counts[words] < PERIODS)
    edges = np.concatenate(([-1], cuts, [len(words)]))
    wide = np.flatnonzero(np.diff(edges) > SHORTEST)
    todo: list = [(int(edges[i]) + 1, int(edges[i + 1]), None, None) for i in wide]
    w, places, found = words.tolist() if todo else [], None, []
    while todo:
        low, high, held, rare = todo.pop()
        if held is None:
            held = Counter(w[low:high])
            rare = {x for x, n in held.items() if n < PERIODS}
            at = [i for i in range(low, high) if w[i] in rare] if rare else []
        else:
            if places is None:
                order = np.argsort(words, kind="stable")
                places = order, np.searchsorted(words[order], np.arange(len(counts) + 1)).tolist()
            order, first = places
            at = []
            for x in rare:
                of = order[first[x] : first[x + 1]]
                at += of[bisect_left(of, low) : bisect_left(of, high)].tolist()
            at.sort()
        if not at:
            found.append((low, high))
            continue
        edges = [low - 1, *at, high]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > SHORTEST]
        largest = max(parts, key=lambda p: p[1] - p[0], default=(0, 0))
        if 2 * (largest[1] - largest[0]) > high - low:
            # The largest part keeps the counts, less what lies outside it.
            parts.remove(largest)
            gone = Counter(w[low : largest[0]] + w[largest[1] : high])
            held.subtract(gone)
            todo.append((*largest, held, [x for x in gone if 0 < held[x] < PERIODS]))
        todo += [(*p, None, None) for p in parts]
    return sorted(found)


def _agree(w: np.ndarray, i: int, j: int, step: int, most: int) -> int:
    """How many words from i and from j on, forward (1) or backward (-1), are the same, at most so many."""
    n, size = 0, 32
    while n < most:
        k = min(size, most - n)
        a, b = (w[i + n : i + n + k], w[j + n : j + n + k]) if step > 0 else (w[i - n - k + 1 : i - n + 1][::-1], w[j - n - k + 1 : j - n + 1][::-1])
        other = np.flatnonzero(a != b)
        if len(other):
            return n + int(other[0])
        n, size = n + k, size * 2
    return n


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a segment of numbered words."""
    n, runs = len(w), []
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    # Block hashes: sums of word hashes times powers of the place, in 64 bits; equal ones are compared word by word.
    mixed = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * powers[:n], out=prefix[1:])
    #: By place the furthest end of a run found that starts there or before: a stretch inside one has a smaller period.
    covered = np.zeros(n + 1, np.int64)
    for q in range(1, n // PERIODS + 1):
        block = np.diff(prefix[::q])
        same = block[:-1] * powers[q] == block[1:]
        if not (same[:-1] & same[1:]).any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
        for a, b in zip((edges[::2] * q).tolist(), (edges[1::2] * q).tolist(), strict=True):
            # Words of [a, b) equal those q further on, as their blocks do.
            if b - a < 2 * q or covered[a] >= b + q:
                continue
            if _agree(w, a, a + q, 1, b - a) < b - a:
                # A hash that isn't the words': each block by itself.
                spans = [(int(s), int(e)) for s, e in _equal_spans(w, q, a, b)]
            else:
                spans = [(a, b)]
            for s, e in spans:
                s -= _agree(w, s - 1, s + q - 1, -1, s)
                e += _agree(w, e, e + q, 1, n - q - e)
                length = e + q - s
                if length >= max(SHORTEST, PERIODS * q) and covered[s] < e + q:
                    runs.append((s, length, q))
                    np.maximum(covered[s : e + q], e + q, out=covered[s : e + q])
    return runs


def _equal_spans(w: np.ndarray, q: int, a: int, b: int) -> np.ndarray:
    same = np.concatenate(([False], w[a:b] == w[a + q : b + q], [False])).view(np.int8)
    return (a + np.flatnonzero(np.diff(same))).reshape(-1, 2)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    return sorted((low + s, length, q) for low, high in surviving(ids) for s, length, q in lag_scan(ids[low:high])) if len(words) >= SHORTEST else []


def with_tail(words: list, doc_id: int | None) -> list:
    """The contract's words: of every tenth document, by the id's crc32, the words from some place on repeat with a period
    that follows from it as well. Documents without an id stay as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[: a + p] + [words[a + (i - a) % p] for i in range(a + p, n)]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    return list(compress(words, keep.tolist()))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _rows(batches: Iterator[pa.RecordBatch], change) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _OUT]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            # Bytes split at the six characters of white space alone.
            words = change((text.as_py() or "").encode("utf-8", "surrogatepass").split(), doc_id)
            runs = runs_of(words)
            s, length, q = strongest(runs) or (None, None, None)
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
            values = (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """Per document (repeated rows and null ids each keep a row) the periodic runs of its words: doc_id, n_runs; start,
    length, period, exponent_milli of the strongest (nulls without a run); digests of the list of runs and of the
    collapsed text. change(words, doc_id) may replace the words first. Null and empty texts have no words; texts of any
    length are read whole, one at a time; an empty table gives no rows; other columns aren't read."""
    importable(docs.sparkSession)
    change = change or (lambda words, doc_id: words)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda batches: _rows(batches, change), _DDL)


def without_runs(docs: DataFrame) -> DataFrame:
    """docs with each text's words outside runs and of their first periods, joined by single spaces; a text without runs
    and a null text stay as they are. Columns and rows stay."""
    importable(docs.sparkSession)

    @F.pandas_udf("string")
    def short(texts):
        def one(text):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            runs = runs_of(words)
            return b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", short("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document after with_tail(). Edge cases are those of periodic_runs()."""
    return periodic_runs(table(spark, sf_dir, "documents"), with_tail)
