"""Substring search from an index instead of a scan.

A text's runs of one to three characters name it. A term looks at what its rarest run names, and that is compared with
the whole term there and then: no text is missed, none is found wrongly, and a term of one or two characters has a run of
its own. Texts are stored once, in blocks of consecutive rows, and a run names the blocks that have it, so the index
takes a fraction of the rows, however many runs a text has. Postings lie in buckets by their run's hash, sorted by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..sources.storage import written

#: Parameters: characters of the longest run, buckets, and matches up to which rows are read by their numbers.
RUN, BUCKETS, FEW = 3, 64, 1000
#: Bits of the rows of a block and of a part, the folder in which blocks lie.
BLOCK, PART = 12, 18


def runs(text: Column, longest: int = RUN) -> Column:
    """The distinct runs of a text's characters in lower case."""
    low = F.lower(text)

    def of(n: int) -> Column:
        return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(n) for n in range(1, longest + 1))))


def bucket(run: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """run, text and keys of every row, and the bucket; rows without a text or with an empty one are in none."""
    out = rows.select(F.col(text).alias("text"), *keys, F.explode(runs(F.col(text))).alias("run"))
    return out.withColumn("bucket", bucket(F.col("run")))


def blocks(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """text, keys, part and block of every row with a text. Rows that lie together are one block, so nothing moves; to be
    stored before its postings are made, as the numbers follow the order of reading."""
    at = F.monotonically_increasing_id()
    known = rows.select(F.col(text).alias("text"), *keys).filter(F.length("text") > 0)
    return known.withColumns({"block": F.shiftright(at, BLOCK), "part": F.shiftright(at, PART)})


def block_postings(texts: DataFrame) -> DataFrame:
    """run, part, block and bucket, and in how many texts of the block the run is."""
    low, i = F.col("low"), F.col("i")
    rows = texts.select("part", "block", F.lower("text").alias("low")).filter(F.length("low") > 0)
    # What runs() names, a place at a time, so that no arrays of a text's runs are made; a run counts at its first place.
    places = rows.select("part", "block", "low", F.explode(F.sequence(F.lit(1), F.length("low"))).alias("i"))
    first = (F.when((i <= F.length(low) - (n - 1)) & (F.position(F.substring(low, i, F.lit(n)), low) == i), F.substring(low, i, F.lit(n))) for n in range(1, RUN + 1))
    found = places.select("part", "block", F.explode(F.array(*first)).alias("run")).filter("run is not null")
    return found.groupBy("part", "block", "run").agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("run")))


def blocked(texts: DataFrame, found: DataFrame) -> DataFrame:
    """An index as postings() gives it, with every text of a block under each run of the block, for matches() to compare.
    Of the postings those of one run are sent, at most a row per block."""
    return texts.join(F.broadcast(found.drop("n")), ["part", "block"]).drop("part", "block")


def block_frequencies(found: DataFrame) -> DataFrame:
    """run, n of block_postings(), as frequencies() of all texts gives them."""
    return found.groupBy("run", "bucket").agg(F.sum("n").alias("n"))


def frequencies(index: DataFrame) -> DataFrame:
    """run, n of an index: as many rows as there are runs."""
    return index.groupBy("run", "bucket").agg(F.count("*").alias("n"))


def rarest(counts: DataFrame, term: str) -> str | None:
    """Of a term's longest runs the one with the fewest postings; None where one of them has none, as nothing matches."""
    low = term.lower()
    n = min(RUN, len(low))
    own = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
    buckets = [r[0] for r in counts.sparkSession.createDataFrame([(x,) for x in own], "run string").select(bucket(F.col("run"))).distinct().collect()]
    found = {r["run"]: r["n"] for r in counts.filter(F.col("bucket").isin(buckets) & F.col("run").isin(own)).collect()}  # a row a run
    return min(own, key=lambda x: (found[x], x)) if len(found) == len(own) else None


def matches(index: DataFrame, counts: DataFrame, term: str) -> DataFrame:
    """text and keys of the rows whose text contains term, whatever the case. term isn't empty."""
    keys = [c for c in index.columns if c not in ("run", "bucket")]
    run = rarest(counts, term)
    if run is None:
        return index.select(*keys).limit(0)
    number = index.sparkSession.range(1).select(bucket(F.lit(run))).first()[0]
    return index.filter((F.col("bucket") == number) & (F.col("run") == run) & texts.contains_fold(F.col("text"), term)).select(*keys)


def found(invoices: DataFrame, by_id: tuple[DataFrame, DataFrame], by_name: tuple[DataFrame, DataFrame], term: str) -> DataFrame:
    """invoices whose number or whose vendor's name contains term; by_id and by_name are an index and its frequencies, the
    latter with key gstin. Few numbers are looked up in the stored invoices; many are found by a look at all."""
    if not term:
        return invoices
    few = matches(*by_id, term).select("text").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        # A number may be several suppliers'; it matches for each.
        named = F.col("invoice_id").isin([r[0] for r in few]) if few else F.lit(False)
    else:
        # A share of all invoices: they are read once and compared, where a join would move all of them.
        named = texts.contains_fold(F.col("invoice_id"), term)
    parts = [invoices.filter(named)] if few else []
    names = written(matches(*by_name, term).select(F.col("gstin").alias("supplier_gstin")))
    if not names.isEmpty():
        parts.append(invoices.filter(~F.coalesce(named, F.lit(False))).join(names, "supplier_gstin", "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else invoices.limit(0)
