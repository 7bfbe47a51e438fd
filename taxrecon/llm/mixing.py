"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

Each source is a stream of its documents in hash order, cut into blocks of equal word counts. Slot t of
the schedule has the golden-ratio point t * phi (mod 1), held exactly in 32 bits; mapped through the
cumulative slot counts it names a source, and the slot's rank among its source's slots names the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, table, written

#: floor(2^32 / golden ratio) + 1, odd: multiples of it mod 2^32 are the golden-ratio points.
GOLDEN = 2654435769
#: Parameters: slots that the whole mix has about, fewest blocks a source is cut into, most repeats; slots of a stretch
#: in which a point looks for its source; documents of a source that are put in order together, about.
SLOTS, MIN_BLOCKS, REPEATS, WIDTH, GROUP_DOCS = 200_000, 64, 3, 64, 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, repeats: int = REPEATS, slots: int = SLOTS) -> DataFrame:
    """One row per source of sized (source, size): source_no, weight, source_size, target, blocks, n_slots,
    slot_to. Sources by code point, null last, weigh 1, 2, 3, repeating; targets share the total size and
    stop at repeats times the source, the rest reshared by weight. The windows here run over one row per source,
    which the order of all sources needs; nothing else is in one task."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    # Water filling: sources reach their bound in order of bound / weight.
    order = Window.orderBy((F.lit(repeats) * F.col("source_size")).cast("double") / F.col("weight"), "source_no")
    whole = Window.partitionBy()
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(upto), F.lit(0)))
    level = level.withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    level = level.withColumn("rate", F.col("left").cast("double") / F.col("weights").cast("double"))
    level = level.withColumn("open", F.col("rate") * F.col("weight") <= F.lit(repeats) * F.col("source_size"))
    level = level.withColumn("share", F.first(F.when(F.col("open"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    filled = level.withColumn("target", F.least((F.lit(repeats) * F.col("source_size")).cast("double"), F.coalesce(F.col("share") * F.col("weight"), (F.lit(repeats) * F.col("source_size")).cast("double"))))
    block = F.greatest(F.lit(1), F.expr(f"(sum(source_size) over ()) div {slots}"))
    cutted = filled.withColumn("block", block).withColumn("blocks", F.least("source_size", F.greatest(F.lit(MIN_BLOCKS), F.expr("(source_size + block - 1) div block"))).cast("bigint"))
    n = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).cast("bigint")
    return cutted.withColumn("n_slots", n).withColumn("slot_to", F.sum("n_slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0))).select("source", "source_no", "weight", "source_size", "target", "blocks", "n_slots", "slot_to")


def schedule(targets: DataFrame, repeats: int = REPEATS, chunk: int = 4096) -> DataFrame:
    """The mix in order: slot, source_no, rank (of the slot in its source, from 0), block. The number of
    slots follows from SLOTS and the sources, not from the rows. Ranks come from counts per chunk of
    consecutive slots, so a source with many slots is never one task's."""
    spark = targets.sparkSession
    total = targets.agg(F.coalesce(F.max("slot_to"), F.lit(0))).first()[0]
    # A point's stretch of WIDTH slots names the few sources that have slots there.
    held = targets.filter("n_slots > 0").select("source_no", (F.col("slot_to") - F.col("n_slots")).alias("slot_from"), "slot_to")
    held = held.withColumn("w", F.explode(F.expr(f"sequence(slot_from div {WIDTH}, (slot_to - 1) div {WIDTH})")))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"shiftright((id * {GOLDEN}L & 4294967295L) * {total}L, 32)").alias("p")).withColumn("w", F.expr(f"p div {WIDTH}"))
    named = slots.join(held, "w").filter("p >= slot_from and p < slot_to").select("slot", "source_no", F.expr(f"slot div {chunk}").alias("c"))
    counts = named.groupBy("source_no", "c").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("c")) - F.col("n")).drop("n")
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("source_no", "c").orderBy("slot")) - 1).join(before, ["source_no", "c"])
    ranked = ranked.select("slot", "source_no", (F.col("before") + F.col("r")).alias("rank"))
    return ranked.join(targets.select("source_no", "blocks"), "source_no").filter(F.col("rank") < F.lit(repeats) * F.col("blocks")).select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def placed(sized: DataFrame, targets: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents with a size at their place in their source's shuffled stream: doc_id, size, source_no, start, carry.
    The order is that of the md5 of the doc_id (of the text's hash where it is null); running sums go by its first
    digits, as many as the number of documents asks for, then inside these."""
    digits = max(3, math.ceil(math.log(max(1, sized.count() / GROUP_DOCS), 16)))
    shuffled = sized.filter("size > 0").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", *carry, "source_no", "source_size", "blocks", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("h").cast("string"))).cast("binary")).alias("o"))
    shuffled = shuffled.withColumn("c", F.substring("o", 1, digits))
    sums = shuffled.groupBy("source_no", "c").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("c")) - F.col("n")).drop("n")
    inner = Window.partitionBy("source_no", "c").orderBy("o", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    return shuffled.withColumn("inside", F.sum("size").over(inner) - F.col("size")).join(before, ["source_no", "c"]).select("doc_id", "size", *carry, "source_no", "source_size", "blocks", (F.col("before") + F.col("inside")).alias("start"))


def mixed(docs: DataFrame, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size (words; null text: 0), source_size, target (its source's), taken (words the
    mix takes, repeats counted), and the columns of docs to carry along, such as a key of the rows. No word is taken more than repeats times. Empty documents take 0; repeated
    rows count one by one; null sources are a source of their own, last; null doc_ids order by their text's hash. A text
    longer than a block lies in several; an empty table gives no rows; other columns aren't read."""
    sized = written(docs.select(F.col("doc_id"), F.col("source"), *carry, words(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("h")))
    targets = written(source_targets(sized, repeats))
    times = schedule(targets, repeats).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    at = placed(sized, targets, carry)
    # Block k holds words floor(k * source_size / blocks) to floor((k + 1) * source_size / blocks).
    first = F.expr("((start + 1) * blocks - 1) div source_size")
    last = F.expr("((start + size) * blocks - 1) div source_size")
    parts = at.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.expr("(block * source_size) div blocks"), F.expr("((block + 1) * source_size) div blocks")
    overlap = F.least(F.col("start") + F.col("size"), hi) - F.greatest(F.col("start"), lo)
    taken = parts.withColumn("w", overlap).join(times, ["source_no", "block"], "left").groupBy("source_no", "start", "doc_id", "size", *carry).agg(F.sum(F.col("w") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = sized.filter("size = 0").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source_no", F.lit(0).cast("bigint").alias("start"), "doc_id", "size", *carry, F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(empty).join(targets.select("source_no", "source_size", "target"), "source_no").select("doc_id", "size", "source_size", "target", "taken", *carry)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. Edge cases are those of mixed()."""
    return mixed(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM per),
weighed AS (SELECT *, (source_no - 1) % 3 + 1 AS weight FROM ranked),
level AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighed) AS BIGINT) AS total,
         CAST((SELECT sum(source_size) FROM weighed) - coalesce(sum({REPEATS} * source_size) OVER b, 0) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS rate,
         CAST({REPEATS} * source_size AS DOUBLE) / weight AS bound
  FROM weighed
  WINDOW b AS (ORDER BY CAST({REPEATS} * source_size AS DOUBLE) / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(rate, (bound, source_no)) AS share FROM level WHERE rate * weight <= {REPEATS} * source_size),
filled AS (
  SELECT l.*, least(CAST({REPEATS} * source_size AS DOUBLE), coalesce(s.share * weight, CAST({REPEATS} * source_size AS DOUBLE))) AS target,
         greatest(1, total // {SLOTS}) AS block FROM level l, share s),
cutted AS (
  SELECT *, CAST(least(source_size, greatest({MIN_BLOCKS}, (source_size + block - 1) // block)) AS BIGINT) AS blocks FROM filled),
slotted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target * blocks / source_size + 0.5) AS BIGINT) END AS n_slots FROM cutted),
targets AS (
  SELECT *, CAST(sum(n_slots) OVER (ORDER BY source_no) AS BIGINT) AS slot_to FROM slotted),
slots AS (
  SELECT t AS slot, (((t * {GOLDEN}) & 4294967295) * (SELECT max(slot_to) FROM targets)) >> 32 AS p
  FROM range((SELECT max(slot_to) FROM targets)) AS r(t)),
named AS (
  SELECT s.slot, g.source_no, g.blocks, row_number() OVER (PARTITION BY g.source_no ORDER BY s.slot) - 1 AS rank
  FROM slots s JOIN targets g ON s.p >= g.slot_to - g.n_slots AND s.p < g.slot_to),
times AS (SELECT source_no, rank % blocks AS block, count(*) AS times FROM named WHERE rank < {REPEATS} * blocks GROUP BY 1, 2),
placed AS (
  SELECT s.doc_id, s.size, t.source_no, t.source_size, t.blocks,
         CAST(sum(s.size) OVER (PARTITION BY t.source_no ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id) - s.size AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0),
parts AS (
  SELECT p.*, u.block,
         least(start + size, ((u.block + 1) * source_size) // blocks) - greatest(start, (u.block * source_size) // blocks) AS w
  FROM placed p, unnest(range(((start + 1) * blocks - 1) // source_size, ((start + size) * blocks - 1) // source_size + 1)) AS u(block)),
taken AS (
  SELECT p.doc_id, sum(w * coalesce(t.times, 0)) AS taken FROM parts p LEFT JOIN times t USING (source_no, block) GROUP BY 1)
SELECT s.doc_id, s.size, g.source_size, g.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM sized s JOIN targets g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN taken k USING (doc_id)
"""
