"""Order statistics of columns of any size, exactly, without a task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import written

#: Parameters: rows of a range up to which its distinct values are fetched, and the accuracy of the sketch.
FETCHED, ACCURACY = 10_000, 1000


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some ranks (from 0) of the column's non-null values in order. A sketch gives bounds around a rank,
    one count says how many values are below them and within, and only the range that holds the rank is looked at again.
    Ties take no more room than one value."""
    held, out = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null"), {}
    for rank in sorted(set(ranks)):
        part, before = held, 0
        while True:
            n, low, high = part.agg(F.count("x"), F.min("x"), F.max("x")).first()
            if not n or not 0 <= rank - before < n:
                raise ValueError(f"no rank {rank}")
            if low == high:
                out[rank] = low
                break
            if n <= FETCHED:
                counts = sorted((r["x"], r["n"]) for r in part.groupBy("x").agg(F.count("*").alias("n")).collect())
                for x, k in counts:
                    before += k
                    if before > rank:
                        out[rank] = x
                        break
                break
            # Bounds a few steps of the sketch's accuracy around the rank; values of the column, or open.
            at, step = (rank - before + 0.5) / n, 3.0 / ACCURACY
            a, b = part.agg(F.percentile_approx("x", [max(0.0, at - step), min(1.0, at + step)], ACCURACY)).first()[0]
            below, within = part.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))).first()
            if rank - before < below:
                part = part.filter(F.col("x") < a)
            elif rank - before < below + within:
                part, before = part.filter(F.col("x").between(a, b)), before + below
            else:
                part, before = part.filter(F.col("x") > b), before + below + within
    return out


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The interpolated quantile of a column, as percentile() has it; None without values. Rows are read several times, so
    they should be stored."""
    n = rows.filter(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = (n - 1) * q
    low, high = math.floor(at), math.ceil(at)
    found = order_statistics(rows, column, [low, high])
    return found[low] if low == high or found[low] == found[high] else (high - at) * found[low] + (at - low) * found[high]


def running(rows: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows before in a stated order; rows that are equal in it lie together. Sums of
    ranges, of which there are as many as partitions, are carried over, so no task has all rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sums = spread.groupBy(part.alias("__p")).agg(F.sum(value).alias("__s"))
    starts = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__start"))
    within = F.sum(value).over(Window.partitionBy("__p").orderBy("__m")) - F.col(value)
    return spread.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + within).drop("__p", "__m", "__start")


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives, auc, from ranks: the share of pairs of a positive and a negative row in which the
    positive's score is higher, ties counted half. Null scores and labels take no part; null without either kind."""
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    ties = known.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))
    below = running(ties, F.col("s"), "neg", "below")
    out = below.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("w"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select("positives", "negatives", F.when(pairs > 0, F.col("w").cast("double") / 2 / pairs).alias("auc"))
