"""Dashboard figures over the flat invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from .reconcile import mismatched

RANK = {"Low": 0, "Medium": 1, "High": 2}


def _tax_if(cond):
    return F.coalesce(F.sum(F.when(cond, F.col("total_tax"))), F.lit(0))


def dashboard(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row; the match rate is 0 without invoices. Both sides of the join are one row."""
    a = invoices.agg(F.count("*").alias("total_invoices"), F.count_if(mismatched()).alias("total_mismatches"), _tax_if(mismatched()).alias("at_risk_itc"))
    b = vendors.agg(F.count("*").alias("vendors_monitored"), F.count_if(F.col("status") == "High Risk").alias("high_risk_vendors"))
    rate = scoring.percent(F.col("total_invoices") - F.col("total_mismatches"), F.col("total_invoices"))
    return a.crossJoin(b).withColumn("match_rate", rate).withColumn("pending", F.col("total_mismatches"))


def breakdown(invoices: DataFrame) -> DataFrame:
    return invoices.filter(mismatched()).groupBy("match_status").agg(F.count("*").alias("n"), F.sum("total_tax").alias("total_tax"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum("total_tax"), F.lit(0)).alias("total_tax"), F.count_if(F.col("risk_level") == "High").alias("high_count"))


def monthly_itc(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("period").agg(F.count("*").alias("invoices"), F.count_if(mismatched()).alias("mismatches"), _tax_if(mismatched()).alias("at_risk"), F.sum("total_tax").alias("total"))


def period_change(invoices: DataFrame) -> DataFrame:
    """At-risk tax against the period before; the window runs over one row per period."""
    w = Window.orderBy("period")
    rows = monthly_itc(invoices).withColumn("before", F.lag("at_risk").over(w))
    return rows.select("period", "at_risk", "before", F.when(F.col("before") > 0, (F.col("at_risk") - F.col("before")).cast("double") / F.col("before")).alias("change"))


def compliance_mix(invoices: DataFrame) -> DataFrame:
    """Per period the share of vendors by class, scored on that period's own invoices."""
    days = F.when(F.col("in_gstr1"), F.greatest(F.lit(0), F.datediff("filed_date", "due_date")))
    per = invoices.groupBy("period", "vendor_id").agg(F.count("*").alias("tx"), F.count_if(~F.col("in_gstr1")).alias("missed"), F.coalesce(F.sum(days).cast("double") / F.count(days), F.lit(0.0)).alias("late"))
    status = scoring.classify_risk(scoring.predict_risk(F.col("missed"), F.col("late"), F.col("tx")))
    out = per.withColumn("status", status).groupBy("period").agg(F.count("*").alias("vendors"), *(F.count_if(F.col("status") == s).alias(c) for c, s in (("compliant", "Compliant"), ("review", "Review"), ("high_risk", "High Risk"))))
    return out.select("period", "vendors", *((F.col(c).cast("double") * F.lit(100.0) / F.col("vendors")).alias(f"{c}_pct") for c in ("compliant", "review", "high_risk")))


def weekly_digest(invoices: DataFrame) -> DataFrame:
    """Weeks from Monday."""
    return invoices.groupBy(F.date_trunc("week", "invoice_date").cast("date").alias("week")).agg(F.count("*").alias("invoices"), F.count_if(mismatched()).alias("mismatches"), _tax_if(mismatched()).alias("at_risk"))


def filings_register(gstr1: DataFrame, gstr2b: DataFrame) -> DataFrame:
    cols = ["period", "taxable", "cgst", "sgst", "igst"]
    rows = gstr1.select(F.lit("GSTR-1").alias("type"), *cols).unionByName(gstr2b.select(F.lit("GSTR-2B").alias("type"), *cols))
    return rows.groupBy("type", "period").agg(F.count("*").alias("total_invoices"), F.sum("taxable").alias("total_taxable"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("total_tax"))


def by_vendor(invoices: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("risk_level") == "High", 2).when(F.col("risk_level") == "Medium", 1).otherwise(0))
    return invoices.filter(mismatched()).groupBy("vendor_id", "vendor_name").agg(F.count("*").alias("n"), F.sum("total_tax").alias("total_tax"), rank.alias("worst_level"))
