"""Clusters of vendors by label propagation between vendors and the groups that they share.

Vendors share a group when they bill the same HSN code in the same period. A group tells each of its vendors the label
that most of its other vendors have, and a vendor takes the label that its groups say with the most weight, less what
a label of that size would get by chance. The (vendor, group) rows lie by group for all rounds, in memory or on the
executors' disks, and labels, a row per vendor, come to them; what moves in a round are the sums of what the groups of a
task say to a vendor. No pairs of vendors are made. Vendors are numbers in the order of their ids and groups two digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import ranked
from ..sources.storage import written

#: Parameters: rounds, and the weight of a group of two; larger ones weigh it over their other vendors.
ROUNDS, WEIGHT = 6, 1000
#: Parameter: invoices, and so at most as many (vendor, group) rows, of a task. All rows of a group are in one task, at most
#: one per vendor.
ROWS = 1_000_000


#: A group is named by two digests, 128 bits; its rows lie by the first.
GROUP = ("g", "g2")


def memberships(invoices: DataFrame, by: tuple[str, ...] = ("hsn", "period"), weight: int = WEIGHT) -> DataFrame:
    """vendor_id, g, g2, w: the groups of each vendor that it shares with others; a rare group weighs more."""
    named = invoices.filter(F.col("vendor_id").isNotNull())
    for c in by:
        named = named.filter(F.col(c).isNotNull())
    # Rows move once, to their group.
    parts = max(int(invoices.sparkSession.conf.get("spark.sql.shuffle.partitions")), invoices.count() // ROWS)
    member = named.select("vendor_id", F.xxhash64(*by).alias("g"), F.xxhash64(F.lit(1), *by).alias("g2")).repartition(parts, "g").distinct()
    n = F.count("*").over(Window.partitionBy(*GROUP))
    return member.withColumn("n", n).filter("n > 1").select("vendor_id", *GROUP, F.greatest(F.lit(1), F.expr(f"{weight} div (n - 1)")).cast("bigint").alias("w"))


def moves_in(vendor_id: Column, turn: int) -> Column:
    """Whether a vendor may move in a round: half of them do, by a digest of their id, as neighbours that move at once
    would only swap."""
    low = F.md5(vendor_id.cast("binary")) < "8"
    return low if turn % 2 else ~low


def _first(n: Column, label: Column) -> Column:
    """For min: the most, then the smallest label."""
    return F.struct((-n).alias("n"), label.alias("label"))


def _heard(labels: DataFrame, member: DataFrame, low: bool | None = None) -> DataFrame:
    """vendor_id, label, s: what each group of a vendor says, the label that most of its others have, and its weight. low:
    of the vendors with this value of the labels' low alone."""
    own = member.join(labels.select("vendor_id", "label", *([] if low is None else ["low"])), "vendor_id")
    # All windows are over rows of a group, which lie together.
    group = [c for c in GROUP if c in member.columns]
    counted = own.withColumn("n", F.count("*").over(Window.partitionBy(*group, "label")))
    over = Window.partitionBy(*group)
    first = counted.withColumn("a", F.min(_first(F.col("n"), F.col("label"))).over(over))
    first = first.withColumn("b", F.min(F.when(F.col("label") != F.col("a.label"), _first(F.col("n"), F.col("label")))).over(over))
    l1, n1, l2, n2 = F.col("a.label"), -F.col("a.n"), F.col("b.label"), -F.coalesce("b.n", F.lit(0))
    rest = n1 - 1
    ahead = (rest > n2) | ((rest == n2) & (rest > 0) & (l1 < l2))
    heard = F.when((F.col("label") != l1) | ahead, l1).otherwise(l2)
    told = first if low is None else first.filter(F.col("low") == F.lit(low))
    return told.select("vendor_id", heard.alias("label"), F.col("w").alias("s")).filter("label is not null")


def _summed(heard: DataFrame) -> DataFrame:
    return heard.groupBy("vendor_id", "label").agg(F.sum("s").alias("s"))


def _said(labels: DataFrame, member: DataFrame) -> DataFrame:
    """vendor_id, label, s: the weight with which the groups of a vendor say a label."""
    return _summed(_heard(labels, member))


def propagated(member: DataFrame, vendors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vendor_id, community (the smallest vendor of its cluster) of vendors (vendor_id, and if that isn't the id itself but
    its number, low: whether it moves in odd rounds) after so many rounds. A vendor weighs a label by what its groups say,
    times the weight of all, less its own weight times that of the label's other vendors; ties go to the smallest label.
    Exact whole numbers; a vendor without shared groups keeps its own label."""
    low = vendors.select("vendor_id", "low") if "low" in vendors.columns else None
    member = member.persist()
    try:
        member.count()  # held before it is used: plans know then that rows lie by group
        own = member.groupBy("vendor_id").agg(F.sum("w").alias("k")).withColumn("label", F.col("vendor_id"))
        labels = written(own.join(low, "vendor_id") if low else own.withColumn("low", moves_in(F.col("vendor_id"), 1)))
        most, everything = labels.agg(F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.sum(F.col("k").cast("decimal(38,0)")), F.lit(0))).first()
        # No score exceeds the product of a vendor's weight and that of all.
        kind = "bigint" if int(most) * int(everything) < 2**62 else "decimal(38,0)"
        for turn in range(rounds):
            # A row per vendor, stored, so plans know how small it is: where it is, it is sent to the rest.
            size = labels.groupBy("label").agg(F.sum(F.col("k").cast(kind)).cast(kind).alias("size"))
            moves, stays = (labels.filter(F.col("low") == F.lit(x)) for x in (turn % 2 == 1, turn % 2 == 0))
            # A vendor may keep its own label though nobody says it.
            said = _summed(_heard(labels, member, turn % 2 == 1).unionByName(moves.select("vendor_id", "label", F.lit(0).cast("bigint").alias("s"))))
            rows = said.join(size, "label").join(moves.select("vendor_id", F.col("label").alias("was"), "k"), "vendor_id")
            k = F.col("k").cast(kind)
            others = F.col("size") - F.when(F.col("label") == F.col("was"), k).otherwise(F.lit(0).cast(kind))
            score = (F.col("s").cast(kind) * F.lit(int(everything)).cast(kind) - k * others).cast(kind)
            best = rows.groupBy("vendor_id").agg(F.min(F.struct((-score).alias("score"), F.col("label").alias("label"))).alias("b"), F.first("k").alias("k"))
            moved = best.select("vendor_id", "k", F.col("b.label").alias("label"), F.lit(turn % 2 == 1).alias("low"))
            labels = written(moved.unionByName(stays.select(moved.columns)))
    finally:
        member.unpersist()
    names = labels.groupBy("label").agg(F.min("vendor_id").alias("community"))
    found = labels.join(names, "label").select("vendor_id", "community")
    return vendors.select("vendor_id").join(found, "vendor_id", "left").select("vendor_id", F.coalesce("community", "vendor_id").alias("community"))


def clusters(invoices: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vendor_id, community of the vendors of invoices. Invoices without a vendor, code or period link nothing."""
    known = invoices.filter("vendor_id is not null").select("vendor_id").distinct()
    # In the order of the ids, so the smallest number is that of the smallest id.
    numbers = written(ranked(known, "number", [F.col("vendor_id")]).select("vendor_id", F.col("number").cast("int").alias("number"), moves_in(F.col("vendor_id"), 1).alias("low")))
    numbered = invoices.select("vendor_id", "hsn", "period").join(numbers, "vendor_id").select(F.col("number").alias("vendor_id"), "hsn", "period")
    found = propagated(memberships(numbered), numbers.select(F.col("number").alias("vendor_id"), "low"), rounds)
    name, of = numbers.select("number", "vendor_id"), numbers.select(F.col("number").alias("smallest"), F.col("vendor_id").alias("community"))
    found = found.select(F.col("vendor_id").alias("number"), F.col("community").alias("smallest"))
    return found.join(name, "number").join(of, "smallest").select("vendor_id", "community")


def profile(found: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per community: vendors, invoices, the share of its invoices that are mismatched, and the tax at risk."""
    bad = ~F.col("match_status").eqNullSafe(F.lit("Matched"))
    per = invoices.filter("vendor_id is not null").groupBy("vendor_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.sum(F.when(bad, F.col("total_tax")).otherwise(0)).alias("tax"))
    out = found.join(per, "vendor_id").groupBy("community").agg(F.count("*").alias("vendors"), F.sum("n").alias("invoices"), F.sum("bad").alias("bad"), F.sum("tax").alias("at_risk_tax"))
    return out.select("community", "vendors", "invoices", (F.col("bad").cast("double") / F.col("invoices")).alias("mismatch_share"), "at_risk_tax")
