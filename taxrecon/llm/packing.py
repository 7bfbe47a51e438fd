"""Packing by power-of-two decomposition.

Every document's tokens are cut into pieces of binary length, and each piece is a training sequence of
its own: no sequence crosses documents and none is padded. Sequences of one length are one bucket: their
sequence_ids follow one another, so batches draw from a range of ids. The tokens don't move for that: a task counts
its pieces by length, and sums of these counts give the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written
from .tokens import encoded, tokenizer_path


def binary_lengths(n: int, most: int) -> list[int]:
    """n as whole sequences of the longest length, then its remaining bits from high to low."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if (n % most) >> k & 1]


def decompose(docs: DataFrame, path: str, end_id: int = 1, max_tokens: int = 2048) -> DataFrame:
    """Pieces of every document: doc_id, piece (from 0), start, length, ids (binary, little-endian unsigned
    32 bit), doc_tokens; and part (the task's number) and place (from 0, among the task's pieces of that length).
    Null or empty text has the end id alone: one piece of length 1. Repeated rows are cut again each; null doc_ids
    stay null; a text of any length is encoded whole; an empty table gives no pieces. Other columns aren't read.
    max_tokens is a power of two."""
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    run = encoded(docs, path, end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        for doc_ids, all_ids in run(batches):
            row, piece, start, length, ids, total, place = [], [], [], [], [], [], []
            for i, b in enumerate(all_ids):
                at, n = 0, len(b) // 4
                for k, size in enumerate(binary_lengths(n, max_tokens)):
                    row.append(i), piece.append(k), start.append(at), length.append(size), total.append(n)
                    ids.append(b[4 * at : 4 * (at + size)]), place.append(counts.get(size, 0))
                    counts[size] = place[-1] + 1
                    at += size
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(np.asarray(row, "int64"))), pa.array(piece, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([part] * len(row), pa.int64()), pa.array(place, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pieces, "doc_id bigint, piece bigint, start bigint, length bigint, ids binary, doc_tokens bigint, part bigint, place bigint")


#: Parameter: rows of (length, task) up to which their first ids are sent to every task, at 24 bytes each.
SENT = 500_000


def bucket(pieces: DataFrame) -> DataFrame:
    """pieces of decompose() (further columns stay, part and place go) with sequence_id, dense from 0 and by length from
    the shortest, and offset 0. Pieces are written first, so that their parts and places stay as they are; then only
    the counts by part and length are summed, and meet the pieces where these lie unless they are too many to send. No
    pieces: no sequences."""
    kept = written(pieces)
    held = kept.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # One row per length, of which there are as many as bits.
    each = held.groupBy("length").agg(F.sum("n").alias("all"))
    base = each.select(F.col("length").alias("at"), (F.sum("all").over(Window.orderBy("length")) - F.col("all")).alias("base"))
    first = written(held.withColumn("before", before).join(F.broadcast(base), F.col("length") == F.col("at")).select(F.col("length").alias("__length"), F.col("part").alias("__part"), (F.col("base") + F.col("before")).alias("__first")))
    out = kept.join(F.broadcast(first) if first.count() <= SENT else first, (F.col("length") == F.col("__length")) & (F.col("part") == F.col("__part")))
    return out.withColumn("sequence_id", F.col("__first") + F.col("place")).withColumn("offset", F.lit(0).cast("bigint")).drop("part", "place", "__length", "__part", "__first")


def pack(docs: DataFrame, path: str, end_id: int = 1, max_tokens: int = 2048) -> DataFrame:
    """Sequences with their token ids: the pieces of decompose() in the buckets of bucket(). Edge cases are theirs."""
    return bucket(decompose(docs, path, end_id, max_tokens))


def op1_pack_power_of_two(spark, sf_dir: str) -> DataFrame:
    """One row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Edge
    cases are those of decompose()."""
    pieces = decompose(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "piece")
    return bucket(digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
