"""Vendor analytics over the unified invoices and the vendor master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from .reconcile import mismatched


def month_index(date: str = "invoice_date"):
    return F.year(date) * 12 + F.month(date)


def compliance(unified: DataFrame, months: int = 12) -> DataFrame:
    """Per supplier over the months up to the latest invoice month: invoices, distinct months with an
    invoice missing in GSTR-1, average days late of the invoices it reported."""
    rows = unified.withColumn("mi", month_index()).withColumn("days", F.when(F.col("in_gstr1"), text.days_late(F.col("filed_date"), F.col("due_date"))))
    latest = rows.agg(F.max("mi").alias("latest"))
    recent = rows.join(F.broadcast(latest), F.col("mi") > F.col("latest") - months)  # latest is one row
    missing = F.when(~F.col("in_gstr1"), F.col("mi"))
    return recent.groupBy("supplier_gstin").agg(F.count("*").alias("total_transactions"), F.count_distinct(missing).alias("missed_filings"), F.coalesce(F.sum("days").cast("double") / F.count("days"), F.lit(0.0)).alias("avg_days_late"))


def scored(master: DataFrame, metrics: DataFrame) -> DataFrame:
    """Vendors with metrics (0 where they have none in the window), score and status. The status follows
    from the unrounded score; risk_score has two decimals."""
    zero = {"total_transactions": 0, "missed_filings": 0, "avg_days_late": 0.0}
    joined = master.join(metrics, master["gstin"] == metrics["supplier_gstin"], "left").fillna(zero)
    raw = scoring.predict_risk(F.col("missed_filings"), F.col("avg_days_late"), F.col("total_transactions"))
    out = joined.withColumn("raw_score", raw).withColumn("status", scoring.classify_risk(F.col("raw_score"))).withColumn("risk_score", scoring.round_half_up(F.col("raw_score"), 2))
    return out.select("vendor_id", "name", "gstin", "state", "total_transactions", "missed_filings", "avg_days_late", "risk_score", "status", "raw_score")


def histogram(vendors: DataFrame, edges: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Vendors per [low, high) bucket of the score, empty buckets included; 1.0 is in none."""
    buckets = F.array(*(F.struct(F.lit(i).alias("bucket"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    inside = vendors.select(F.explode(F.filter(buckets, lambda b: (F.col("risk_score") >= b["low"]) & (F.col("risk_score") < b["high"]))).alias("b")).select("b.bucket")
    counts = inside.groupBy("bucket").agg(F.count("*").alias("n"))
    every = vendors.sparkSession.range(1).select(F.explode(buckets).alias("b")).select("b.*")
    return every.join(counts, "bucket", "left").select(F.col("bucket").cast("int"), "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def at_risk(invoices: DataFrame) -> DataFrame:
    return invoices.filter(mismatched()).groupBy("vendor_id").agg(F.sum("total_tax").alias("at_risk_tax"), F.count("*").alias("mismatches"))


def top_at_risk(vendors: DataFrame, invoices: DataFrame, n: int = 10, above: float = 0.3) -> DataFrame:
    """The n vendors of highest score above the limit with their tax at risk."""
    top = vendors.filter(F.col("risk_score") > above).orderBy(F.desc("risk_score"), "vendor_id").limit(n)
    return top.join(at_risk(invoices), "vendor_id", "left").select("vendor_id", "name", "risk_score", F.coalesce("at_risk_tax", F.lit(0)).alias("at_risk_tax"))


def scorecard(vendors: DataFrame, invoices: DataFrame) -> DataFrame:
    rows = vendors.join(at_risk(invoices), "vendor_id", "left")
    return rows.select("vendor_id", "name", "state", "status", "risk_score", scoring.risk_band(F.col("risk_score")).alias("band"), scoring.trend(F.col("risk_score")).alias("trend"), scoring.prediction_text(F.col("risk_score")).alias("prediction"), F.coalesce("at_risk_tax", F.lit(0)).alias("at_risk_tax"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"))


def by_score(cards: DataFrame) -> DataFrame:
    """Score cards, the highest score first."""
    return cards.orderBy(F.desc("risk_score"), "vendor_id")


def with_status(vendors: DataFrame, status: str) -> DataFrame:
    return vendors.filter(F.col("status") == status)


def average_score(vendors: DataFrame) -> DataFrame:
    """One row: vendors and their mean score, from whole percents so that the order of rows can't matter."""
    percent = F.sum((F.col("risk_score") * 100 + 0.5).cast("bigint")).cast("double")
    return vendors.agg(F.count("*").alias("vendors"), (percent / F.lit(100.0) / F.count("*")).alias("avg_risk_score"))


def radar(vendors: DataFrame) -> DataFrame:
    dims = scoring.radar(F.col("missed_filings"), F.col("avg_days_late"), F.col("total_transactions"), F.col("risk_score"))
    return vendors.select("vendor_id", *(v.alias(k) for k, v in dims.items()))


def feature_contributions(vendors: DataFrame) -> DataFrame:
    return vendors.select("vendor_id", F.explode(scoring.contributions(F.col("missed_filings"), F.col("avg_days_late"), F.col("total_transactions"))).alias("c")).select("vendor_id", "c.*")


def history(invoices: DataFrame) -> DataFrame:
    """Per vendor, period and status: invoices, tax, and how many of them it filed late."""
    return invoices.groupBy("vendor_id", "period", "match_status").agg(F.count("*").alias("n"), F.sum("total_tax").alias("tax"), F.count_if(F.col("filed_date") > F.col("due_date")).alias("late"))


def past_mismatches(invoices: DataFrame) -> DataFrame:
    """Mismatches of the invoice's vendor on earlier days, and the severity that follows."""
    days = F.datediff("invoice_date", F.lit("1970-01-01").cast("date"))
    # Counts per vendor and day first: the window then runs over days, not over all invoices of a vendor.
    daily = invoices.groupBy("vendor_id", "invoice_date").agg(F.sum(mismatched().cast("bigint")).alias("n")).withColumn("day", days)
    before = Window.partitionBy("vendor_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    counts = daily.select("vendor_id", "invoice_date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past_mismatches"))
    rows = invoices.filter(mismatched()).join(counts, ["vendor_id", "invoice_date"])
    return rows.select("invoice_id", "vendor_id", "total_tax", "past_mismatches", scoring.classify_mismatch(F.col("total_tax"), F.col("past_mismatches")).alias("severity"))


def top_contributors(invoices: DataFrame, k: int = 3) -> DataFrame:
    """Per period the k vendors with the most tax at risk."""
    sums = invoices.filter(mismatched()).groupBy("period", "vendor_id", "vendor_name").agg(F.sum("total_tax").alias("tax"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("tax"), "vendor_id"))
    return sums.withColumn("rank", place).filter(F.col("rank") <= k)


def trailing(invoices: DataFrame, months: int = 12) -> DataFrame:
    """Per vendor and month: its own and the trailing months' invoices and mismatches."""
    monthly = invoices.withColumn("month_idx", month_index()).groupBy("vendor_id", "month_idx").agg(F.count("*").alias("n"), F.count_if(mismatched()).alias("bad"))
    w = Window.partitionBy("vendor_id").orderBy("month_idx").rangeBetween(-(months - 1), 0)
    return monthly.select("vendor_id", F.col("month_idx").cast("bigint").alias("month_idx"), "n", "bad", F.sum("n").over(w).alias("n_trailing"), F.sum("bad").over(w).alias("bad_trailing"))


def state_risk(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("vendor_state").agg(F.count("*").alias("n"), (F.count_if(mismatched()).cast("double") / F.count("*")).alias("state_risk_factor"))


def einvoice_rate(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("vendor_id").agg(F.count("*").alias("n"), (F.count_if("valid_einvoice").cast("double") / F.count("*")).alias("einvoice_compliance_rate"))


def flag(vendors: DataFrame, percent: float = 60.0) -> DataFrame:
    """Vendors above a threshold in percent."""
    return vendors.filter(F.col("risk_score") * 100 > percent)
