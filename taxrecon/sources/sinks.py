"""Writers: upserts by key, appended tables, files of return documents and CSV views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: Parameter: invoices of a return document, about so many at most.
DOCUMENT = 10_000


def last_write_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes first in order (newest first)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(path: str, existing: DataFrame, changes: DataFrame, keys: list[str], stamp: str, partition: str = "period") -> None:
    """Rewrites only the partitions that changes touch. existing must not be read from path itself."""
    touched = changes.select(partition).distinct()
    merged = last_write_wins(existing.join(touched, partition, "left_semi").unionByName(changes), keys, [F.desc(stamp)])
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def first_name(rows: DataFrame, key: str, name: str, stamp: str) -> DataFrame:
    """Of each key the first non-empty name ever given."""
    named = rows.filter(F.coalesce(name, F.lit("")) != "")
    return rows.select(key).distinct().join(named.groupBy(key).agg(F.min_by(name, F.struct(stamp, name)).alias(name)), key, "left")


def links(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Each pair once."""
    return rows.select(source, target).dropDuplicates()


def orphans(einvoices: DataFrame, invoices: DataFrame) -> DataFrame:
    """e-Invoices whose invoice is unknown, by all the keys that both sides carry."""
    by = [k for k in ("supplier_gstin", "invoice_no", "period") if k in einvoices.columns and k in invoices.columns]
    return einvoices.join(invoices.select(*by), by, "left_anti")


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def to_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def ranked(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """rows with their place from 0 in a stated order. Places come from counts per range partition, so no task has all
    rows; the rows are written first, so that a task that runs again can't move them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = {r[0]: r[1] for r in spread.groupBy(part.alias("p")).count().collect()}  # one count per partition
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    number = F.get(F.lit(starts or [0]).cast("array<bigint>"), part.cast("int")) + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.withColumn(name, number).drop("__m")


def numbered_ids(rows: DataFrame, prefix: str, order: list[Column], existing: int, width: int = 3, name: str = "id") -> DataFrame:
    """prefix and a zero-padded number after existing, in a stated order."""
    text = (F.col("__place") + existing + 1).cast("string")
    return ranked(rows, "__place", order).withColumn(name, F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))).drop("__place")


def _dealt(book: DataFrame, inv: Column, most: int, *names: Column) -> DataFrame:
    """period, b2b: a period's invoices dealt by a hash of supplier and number to documents of about most at most, in
    each the suppliers with their invoices. A supplier's may be in several; readers put them together."""
    key, n, bucket = "__period", "__n", "__bucket"
    # One row per period.
    counts = book.groupBy(F.col("period").alias(key)).agg(F.count("*").alias(n))
    spread = F.pmod(F.xxhash64("supplier_gstin", "invoice_no"), F.ceil(F.col(n) / most))
    dealt = book.join(F.broadcast(counts), F.col("period").eqNullSafe(F.col(key))).withColumn(bucket, spread)
    per = dealt.groupBy("period", bucket, "supplier_gstin").agg(F.collect_list(inv).alias("inv"))
    return per.groupBy("period", bucket).agg(F.collect_list(F.struct(F.col("supplier_gstin").alias("ctin"), *names, "inv")).alias("b2b")).drop(bucket)


def gstr1_documents(book: DataFrame, most: int = DOCUMENT) -> DataFrame:
    """JSON documents of one period each in the layout that the reader takes, amounts in rupees."""
    inv = F.struct(F.col("invoice_no").alias("inum"), F.col("invoice_date").cast("string").alias("idt"), (F.col("taxable") / 100).alias("val"), F.lit(0.0).alias("rt"), (F.col("igst") / 100).alias("iamt"), (F.col("cgst") / 100).alias("camt"), (F.col("sgst") / 100).alias("samt"), "hsn")
    return _dealt(book, inv, most).select("period", "b2b")


def gstr2b_documents(book: DataFrame, most: int = DOCUMENT) -> DataFrame:
    inv = F.struct(F.col("invoice_no").alias("inum"), F.col("invoice_date").cast("string").alias("dt"), (F.col("taxable") / 100).alias("val"), (F.col("igst") / 100).alias("iamt"), (F.col("cgst") / 100).alias("camt"), (F.col("sgst") / 100).alias("samt"), F.col("itc_available").alias("itcavl"), "hsn")
    return _dealt(book, inv, most, F.lit("").alias("trdnm")).select("period", F.struct("b2b").alias("docdata"))


def einvoice_documents(rows: DataFrame, most: int = DOCUMENT) -> DataFrame:
    """Texts of JSON arrays of e-invoices in the layout that the reader takes, of about most each."""
    one = F.struct(F.col("irn").alias("Irn"), F.struct(F.col("invoice_no").alias("No")).alias("DocDtls"), F.lit("").alias("AckDt"), F.col("status").alias("Status"))
    parts = max(1, -(-rows.count() // most))
    return rows.groupBy(F.pmod(F.xxhash64("irn"), F.lit(parts)).alias("__part")).agg(F.to_json(F.collect_list(one)).alias("value")).select("value")
