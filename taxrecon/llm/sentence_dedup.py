"""Substring deduplication over sliding sentence spans.

A span is a run of consecutive sentences: from each sentence the shortest run forwards, and the shortest
run backwards, that has enough sentences and words. Where a span begins and ends follows from its own
words alone, so a passage yields the same spans in every document that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table


def _marks() -> str:
    """All characters that end a sentence, by their Unicode property, the ellipsis and line ends."""
    every = "".join(map(chr, range(0x110000))).encode("utf-8", "ignore").decode()
    return "".join(regex.findall(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]", every)) + "\u2026\n"


def _sentence(marks: str) -> re.Pattern:
    end = re.escape(marks)
    return re.compile(rf"[^{end}]*(?:[{end}]+[\"')\]»”’」』）]*|$)")


_MARKS = _marks()
#: Most texts have none of the rare marks, and few marks are found faster.
_COMMON, _RARE = _sentence(".!?\n"), frozenset(_MARKS) - frozenset(".!?\n")
_SENTENCE = _sentence(_MARKS)
#: Scripts written without spaces, of which every character counts as a word.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_PACKED = np.dtype([("k", "<i8"), ("h", "<i8"), ("h1", "<u8"), ("h2", "<u4"), ("first", "<i4"), ("last", "<i4")])
#: Parameters: a span has this many sentences and words, or is one sentence of so many words.
SENTENCES, WORDS, ALONE = 2, 20, 50
#: Characters of text per shard of the global join, those of texts whose spans are dealt together, and partitions at most:
#: beyond them a task takes several shards, one after the other.
SHARD_CHARS, BATCH_CHARS, PARTITIONS = 8 << 20, 16 << 20, 20_000


def sentences(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, words in lower case) of each sentence that has words; end is past its last mark."""
    out = []
    common = text.isascii() or _RARE.isdisjoint(text)
    for m in (_COMMON if common else _SENTENCE).finditer(text):
        low = m[0].lower()
        if words := (low if low.isascii() else _WIDE.sub(r" \g<0> ", low)).split():
            out.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip()), tuple(words)))
    return out


def spans(sizes: list[int], few: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> list[tuple[int, int]]:
    """First and last sentence of every span, in order, for sentences of these sizes in words."""
    n, out = len(sizes), set()
    for step in (1, -1):
        at = range(n) if step > 0 else range(n - 1, -1, -1)
        end, total = (0 if step > 0 else n - 1), 0
        for i in at:
            # The window [i, end) grows until it is a span; then its first sentence leaves.
            while 0 <= end < n and not ((total >= words and abs(end - i) >= few) or (abs(end - i) == 1 and total >= alone)):
                total += sizes[end]
                end += step
            if (total >= words and abs(end - i) >= few) or (abs(end - i) == 1 and total >= alone):
                out.add((i, end - 1) if step > 0 else (end + 1, i))
            if end == i:
                end += step
            else:
                total -= sizes[i]
    return sorted(out)


def text_spans(text: str, **kind: int) -> list[tuple[int, int, int, int]]:
    """(first character, end, 64-bit hash, further 32 bits) of each span of text."""
    cut = sentences(text)
    out = []
    for a, b in spans([len(s[2]) for s in cut], **kind):
        d = xxhash.xxh3_128_intdigest(" ".join(w for s in cut[a : b + 1] for w in s[2]))
        out.append((cut[a][0], cut[b][1], d & 0xFFFFFFFFFFFFFFFF, d >> 64 & 0xFFFFFFFF))
    return out


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """rows in the order of their hashes, then of documents and places; and which of them come first."""
    rows = rows[np.lexsort((rows["first"], rows["h"], rows["k"], rows["h2"], rows["h1"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
    # Rows that are one document twice over share the first place.
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    same = (rows["k"] == rows["k"][head]) & (rows["h"] == rows["h"][head]) & (rows["first"] == rows["first"][head])
    return rows, new, ~same


def _deal(shards: int, kind: dict[str, int]):
    schema = pa.schema([("shard", pa.int64()), ("later", pa.bool_()), ("rows", pa.binary())])

    def pack(buffer: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, new, later = _first_of_each(np.array(buffer, _PACKED))
        out = []
        # What is later here is later anywhere; only the first of each span meets the other batches.
        for flag, part, key in ((False, rows[new], rows[new]["h1"]), (True, rows[later], rows[later]["h"].view("<u8"))):
            to = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, part = to[order], part[order]
            for s, a, b in zip(*(x.tolist() for x in _runs(to)), strict=True):
                out.append((s, flag, part[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.field(i).type) for i in range(3)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, chars = [], 0
        for b in batches:
            for k, h, text in zip(b.column("k").to_pylist(), b.column("h").to_pylist(), b.column("t").to_pylist(), strict=True):
                buffer += [(k, h, h1, h2, a, e) for a, e, h1, h2 in text_spans(text, **kind)]
                chars += len(text)
                if chars > BATCH_CHARS and buffer:
                    yield from pack(buffer)
                    buffer, chars = [], 0
        if buffer:
            yield from pack(buffer)

    return run


def _runs(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.array([], int)
    return to[starts], starts, np.r_[starts[1:], len(to)] if len(to) else starts


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: every span that isn't the first of its hash."""
    parts = []
    for flag in (False, True):
        got = [np.frombuffer(x, _PACKED) for x in pdf["rows"][pdf["later"] == flag]]
        if got and flag:
            parts.append(np.concatenate(got))
        elif got:
            rows, _, later = _first_of_each(np.concatenate(got))
            parts.append(rows[later])
    rows = np.concatenate(parts) if parts else np.empty(0, _PACKED)
    rows = rows[np.lexsort((rows["first"], rows["h"], rows["k"]))]
    # Spans of one document that meet are joined here already.
    # One running maximum serves all documents: each is lifted above the one before it.
    doc = np.cumsum(np.r_[False, (rows["k"][1:] != rows["k"][:-1]) | (rows["h"][1:] != rows["h"][:-1])]) if len(rows) else np.empty(0, np.int64)
    lift = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(rows["last"] + lift) if len(rows) else lift
    new = np.r_[True, rows["first"][1:] + lift[1:] > reach[:-1]] if len(rows) else np.empty(0, bool)
    reach = (reach - lift).astype(np.int32)
    ends = np.r_[np.flatnonzero(new)[1:], len(rows)] - 1 if len(rows) else np.empty(0, int)
    heads = rows[new]
    return pd.DataFrame({"k": heads["k"], "h": heads["h"], "first": heads["first"], "last": reach[ends] if len(rows) else heads["last"]})


def later_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", **kind: int) -> DataFrame:
    """k, h (key and hash of the text), first, last (characters, end exclusive) of the stretches that any
    non-first repeated span covers; stretches of one document can overlap. A shard holds the spans of about
    SHARD_CHARS of text however large the table is, and a span that is everywhere reaches it once a batch."""
    source = docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).filter("k is not null and t is not null")
    shards = max(8, -(-(docs.agg(F.sum(F.length(text))).first()[0] or 0) // SHARD_CHARS))
    dealt = source.mapInArrow(_deal(shards, kind), "shard bigint, later boolean, rows binary")
    # As many tasks as shards, so that what a task reads doesn't grow with the table, up to the number that the driver can
    # keep track of; a task still holds one shard at a time.
    return dealt.repartition(min(shards, PARTITIONS), "shard").groupBy("shard").applyInPandas(_later, "k bigint, h bigint, first int, last int")


def sentence_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **kind: int) -> DataFrame:
    """docs, every row and column kept, with text shortened and n_spans, n_chars_removed (bigint) added.

    The occurrence that comes first by (key, place) stays; sentences that a later one covers go, with the
    white space behind them. Null texts, null keys and texts without spans stay as they are. Rows equal in
    key and text count as one document and keep the same sentences. Texts of any length are read whole; an empty table
    gives an empty one; a column of docs named n_spans or n_chars_removed stays, and the new one is n_spans_ and so on."""
    n_spans, n_removed, k2, h2, gone = (fresh(docs, c) for c in ("n_spans", "n_chars_removed", "__k", "__h", "__gone"))
    by_doc = Window.partitionBy("k", "h").orderBy("first", "last")
    reach = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later_spans(docs, text, key, **kind).withColumn("new", (reach.isNull() | (F.col("first") > reach + 1)).cast("int")).withColumn("island", F.sum("new").over(by_doc))
    merged = islands.groupBy("k", "h", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    covered = merged.groupBy(F.col("k").alias(k2), F.col("h").alias(h2)).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias(gone))
    out = docs.join(covered, (F.col(key) == F.col(k2)) & (F.xxhash64(docs[text]) == F.col(h2)), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["last"]))
    ends = F.concat(F.transform(gone, lambda s: s["first"]), F.array(F.length(text)))
    kept = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pieces = F.transform(kept, lambda s: F.when(s["a"] == 0, F.substring(F.col(text), F.lit(1), s["b"])).otherwise(F.regexp_replace(F.substring(F.col(text), s["a"] + 1, s["b"] - s["a"]), r"^\s+", "")))
    removed = F.length(text) - F.length(F.array_join(pieces, ""))
    out = out.withColumn(n_spans, F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("bigint"))
    out = out.withColumn(n_removed, F.when(F.col(gone).isNull(), F.lit(0)).otherwise(removed).cast("bigint"))
    return out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))).select(*docs.columns, n_spans, n_removed)


def op9_sentence_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text without repeated passages: doc_id, text, n_spans, n_chars_removed. Edge cases are
    those of sentence_dedup()."""
    return sentence_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
