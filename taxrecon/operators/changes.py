"""Figures that follow changes of the books: a corrected invoice moves its own figures and nothing else.

A change upserts or deletes an invoice of one book. Of the invoices that a batch of changes names, the reconciled rows
before and after it are worked out, the former with sign -1 and the latter with +1, and summed to the figures' own
grain. Figures are sums of such signed sums, so a batch is added, never recomputed: it reads the invoices that it names
and writes a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import written
from . import reconcile, vendors
from .reconcile import KEYS

BOOKS = {"gstr1": [*KEYS, "invoice_date", "taxable", "cgst", "sgst", "igst", "hsn", "filed_date", "due_date"], "gstr2b": [*KEYS, "invoice_date", "taxable", "cgst", "sgst", "igst", "hsn", "itc_available"]}
#: seq orders the changes of an invoice; op is upsert or delete; a deletion has nothing but the keys.
CHANGES = "seq bigint, book string, op string, supplier_gstin string, invoice_no string, period string, invoice_date date, taxable bigint, cgst bigint, sgst bigint, igst bigint, hsn string, filed_date date, due_date date, itc_available string"
#: Grain and sums of the figures that are kept.
FIGURES = {"status": (["period", "match_status"], ["n", "tax"]), "vendor_month": (["supplier_gstin", "month_idx"], ["n", "missing", "days", "reported"])}

#: Parameters: bits a value of the bitmaps that are sent, and at most so many; and changes of a task.
BITS, MOST, ROWS = 16, 1 << 29, 500_000
#: What they are made from.
READ = ["period", "match_status", "total_tax", "supplier_gstin", "invoice_date", "in_gstr1", "filed_date", "due_date", "sign"]


def change(book: DataFrame, name: str, op: str, seq: int) -> DataFrame:
    """Rows of a book as changes of it."""
    known = {c.split()[0]: c.split()[1] for c in CHANGES.split(", ")}
    own = KEYS if op == "delete" else BOOKS[name]
    return book.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(name).alias("book"), F.lit(op).alias("op"), *(F.col(c).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in known.items() if c not in ("seq", "book", "op")))


def last_changes(changes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Of each invoice of a book its last change; of changes with one seq a deletion comes last, then the highest row. also:
    columns that follow from the keys, by which changes may lie together."""
    own = ["book", *KEYS, *also]
    whole = F.struct("seq", (F.col("op") == "delete").alias("gone"), *(c for c in changes.columns if c not in ("seq", *own)))
    return changes.groupBy(*own).agg(F.max(whole).alias("x")).select(*(c if c in own else f"x.{c}" for c in changes.columns))


def overlaid(book: DataFrame, name: str, last: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A book after changes (one of each invoice)."""
    of, keys, columns = last.filter(F.col("book") == name), [*KEYS, *also], [*BOOKS[name], *also]
    return book.select(*columns).join(of.select(*keys), keys, "left_anti").unionByName(of.filter("op = 'upsert'").select(*columns))


def likely(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose column (a digest) is one of the values (distinct), and few others: bitmaps of the values' low bits are
    sent, of BITS bits a value and MOST bits at most, so what surely isn't named needn't move."""
    size, most = 1 << 15, min(BITS * values.count(), MOST)
    while size < most:
        size *= 2
    at = F.pmod(F.col(column), F.lit(size).cast("bigint"))
    maps = values.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__map"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__map", F.expr(f"cast(bitmap_bit_position(pmod({column}, {size}L)) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("__at", F.bitmap_bucket_number(at)).withColumn("__bit", (bit % 8).cast("int"))
    found = told.join(F.broadcast(maps.withColumnRenamed("__bucket", "__at")), "__at").filter(byte.bitwiseAND(F.expr("shiftleft(1, __bit)")) != 0)
    return found.select(*rows.columns)


def named_by(changes: DataFrame) -> DataFrame:
    """The invoices that changes name, each once."""
    return changes.select(*KEYS).distinct()


def signed(gstr1: DataFrame, gstr2b: DataFrame, einvoices: DataFrame, eway_bills: DataFrame, changes: DataFrame, before: DataFrame | None = None, near: bool = False, held: list[DataFrame] | None = None) -> DataFrame:
    """Reconciled rows of the invoices that changes name: as they were, before (earlier changes, already made) included,
    with sign -1, and as they are now with sign 1. Everything is restricted to these invoices before it is joined, unless
    the tables are near already: they hold all of these, and what else they hold is the same with either sign. held: takes
    what is held on the executors and to be released, where near tables and changes are to move once, to their digests."""
    if near and held is not None and all(reconcile.document_keys(df) == KEYS for df in (einvoices, eway_bills)):
        return _signed_once((gstr1, gstr2b, einvoices, eway_bills), changes, before, held)
    last = last_changes(changes)
    named = named_by(changes)

    def of(df: DataFrame) -> DataFrame:
        return df.join(named, reconcile.document_keys(df), "left_semi")

    books = {"gstr1": gstr1, "gstr2b": gstr2b} if near else {"gstr1": of(gstr1), "gstr2b": of(gstr2b)}
    if before is not None:
        earlier = last_changes(of(before))
        books = {name: overlaid(book, name, earlier) for name, book in books.items()}
    papers = (einvoices, eway_bills) if near else (of(einvoices), of(eway_bills))
    was = reconcile.unified(books["gstr1"], books["gstr2b"], *papers)
    now = reconcile.unified(*(overlaid(book, name, last) for name, book in books.items()), *papers)
    return was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1)))


def _signed_once(tables: tuple[DataFrame, ...], changes: DataFrame, before: DataFrame | None, held: list[DataFrame]) -> DataFrame:
    """signed() of near tables: they and the changes lie by digest for all joins, before and after."""
    also = ("digest",)
    parts = max(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), changes.count() // ROWS)

    def laid(df: DataFrame) -> DataFrame:
        return df.withColumn("digest", F.xxhash64(*KEYS)).repartition(parts, "digest")

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        held[-1].count()  # held before it is used: plans know then that rows lie by digest
        return held[-1]

    last = kept(last_changes(laid(changes), also))
    books, papers = {"gstr1": laid(tables[0]), "gstr2b": laid(tables[1])}, tuple(laid(t) for t in tables[2:])
    if before is not None:
        keys = [*KEYS, *also]
        earlier = laid(likely(before.withColumn("digest", F.xxhash64(*KEYS)), last.select("digest").distinct(), "digest"))
        earlier = kept(last_changes(earlier.join(last.select(*keys).distinct(), keys, "left_semi"), also))
        books = {name: overlaid(book, name, earlier, also) for name, book in books.items()}
    was = reconcile.unified(books["gstr1"], books["gstr2b"], *papers, also=also)
    now = reconcile.unified(*(overlaid(book, name, last, also) for name, book in books.items()), *papers, also=also)
    return was.withColumn("sign", F.lit(-1)).unionByName(now.withColumn("sign", F.lit(1))).drop(*also)


def figures(rows: DataFrame, name: str) -> DataFrame:
    """Signed sums of reconciled rows (a sign of 1 where they have none) at the grain of FIGURES[name]."""
    rows = rows if "sign" in rows.columns else rows.withColumn("sign", F.lit(1))
    keys, _ = FIGURES[name]
    sign = F.col("sign")
    if name == "status":
        sums = {"n": sign, "tax": sign * F.col("total_tax")}
    else:
        rows = rows.withColumn("month_idx", vendors.month_index().cast("bigint"))
        late = F.when(F.col("in_gstr1"), text.days_late(F.col("filed_date"), F.col("due_date")))
        sums = {"n": sign, "missing": sign * (~F.col("in_gstr1")).cast("int"), "days": sign * F.coalesce(late, F.lit(0)), "reported": sign * late.isNotNull().cast("int")}
    out = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(k) for k, v in sums.items()))
    # What a batch leaves as it was isn't written.
    return out.filter(" or ".join(f"{k} <> 0" for k in sums))


def summed(parts: DataFrame, name: str) -> DataFrame:
    """Figures from signed sums; groups that nothing is left of are gone."""
    keys, sums = FIGURES[name]
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).filter("n <> 0")


def metrics(months: DataFrame, window: int = 12) -> DataFrame:
    """The vendors' metrics, as vendors.compliance() has them, from the vendor_month figures."""
    latest = months.agg(F.max("month_idx").alias("latest"))  # one row
    recent = months.join(F.broadcast(latest), F.col("month_idx") > F.col("latest") - window)
    return recent.groupBy("supplier_gstin").agg(F.sum("n").alias("total_transactions"), F.count_if(F.col("missing") > 0).alias("missed_filings"), F.coalesce(F.sum("days").cast("double") / F.when(F.sum("reported") > 0, F.sum("reported")), F.lit(0.0)).alias("avg_days_late"))


def maintained(gstr1: DataFrame, gstr2b: DataFrame, einvoices: DataFrame, eway_bills: DataFrame, path: str, near: Callable[[DataFrame], tuple[DataFrame, ...]] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the signed sums of a batch of changes under its number below path, and the batch itself, from
    which later batches know the books' state. A batch that comes again replaces its own. The books are as they were
    before the first batch. near: gives the four tables with the invoices that it is given (by KEYS), and few others,
    for where that takes less than four joins."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(*(c.split()[0] for c in CHANGES.split(", "))).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        made, held = stored_changes(spark, path).persist(), []
        # Rows of a digest meet where they lie, though the joins are by more columns than that. The tables' session may be another.
        conf, name = gstr1.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        together = conf.get(name)
        conf.set(name, "false")
        try:
            new, earlier = made.filter(F.col("batch") == number).drop("batch"), made.filter(F.col("batch") < number).drop("batch") if number else None
            tables = near(named_by(new)) if near else (gstr1, gstr2b, einvoices, eway_bills)
            rows = written(signed(*tables, new, earlier, near is not None, held).select(*READ))
            for figure in FIGURES:
                figures(rows, figure).write.mode("overwrite").parquet(f"{path}/{figure}/batch={number}")
        finally:
            conf.set(name, together)
            for df in (made, *held):
                df.unpersist()

    return apply


def stored_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGES}, batch int").parquet(f"{path}/changes")


def current(spark: SparkSession, path: str, name: str, first: DataFrame) -> DataFrame:
    """Figures now: those of the books before any change (first, from figures()) and all batches' signed sums."""
    keys, sums = FIGURES[name]
    parts = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)).parquet(f"{path}/{name}/batch=*")
    return summed(first.unionByName(parts), name)
