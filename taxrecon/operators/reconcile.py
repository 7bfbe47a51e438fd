"""Reconciliation of the suppliers' book (gstr1) with the buyer's (gstr2b).

Books have supplier_gstin, invoice_no, period, invoice_date, taxable, cgst, sgst, igst, hsn; gstr1 also
filed_date and due_date. An invoice is (supplier_gstin, invoice_no, period). Joins are on that key, never on
the supplier alone, so a supplier with a third of all invoices still spreads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text

KEYS = ["supplier_gstin", "invoice_no", "period"]
EWAY_LIMIT = 50_000 * scoring.RUPEE
STATUSES = ["Missing in GSTR-1", "Missing in GSTR-2B", "Tax Amount Mismatch", "HSN Mismatch", "Late Filing", "E-Way Bill Missing", scoring.MATCHED]


def in_period(df: DataFrame, period: str | None) -> DataFrame:
    return df if period is None else df.filter(F.col("period") == period)


def _tax() -> Column:
    return F.col("cgst") + F.col("sgst") + F.col("igst")


def document_keys(documents: DataFrame, keys: list[str] = KEYS) -> list[str]:
    """The keys of an invoice that its documents carry: all of them, or its number alone in files that have no more."""
    return [k for k in keys if k in documents.columns]


def _named(df: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor name by gstin; invoices without a known vendor stay."""
    return df.join(vendors.select(F.col("gstin").alias("supplier_gstin"), F.col("name").alias("vendor_name")), "supplier_gstin", "left")


def missing_in(book: DataFrame, other: DataFrame, vendors: DataFrame, issue: str, period: str | None = None) -> DataFrame:
    """Invoices of book that other lacks."""
    left = in_period(book, period).join(in_period(other, period).select(*KEYS), KEYS, "left_anti")
    return _named(left, vendors).select(F.col("invoice_no").alias("invoice_id"), "period", F.col("taxable").alias("amount"), _tax().alias("tax"), "vendor_name", F.col("supplier_gstin").alias("vendor_gstin"), F.lit(issue).alias("issue_type"))


def missing_in_gstr1(gstr1, gstr2b, vendors, period=None) -> DataFrame:
    return missing_in(gstr2b, gstr1, vendors, "Missing in GSTR-1", period)


def missing_in_gstr2b(gstr1, gstr2b, vendors, period=None) -> DataFrame:
    return missing_in(gstr1, gstr2b, vendors, "Missing in GSTR-2B", period)


def _both(gstr1: DataFrame, gstr2b: DataFrame, period: str | None) -> DataFrame:
    a = in_period(gstr1, period).select(*KEYS, *(F.col(c).alias(f"{c}_1") for c in ("cgst", "sgst", "igst", "hsn", "filed_date", "due_date")))
    return in_period(gstr2b, period).join(a, KEYS)


def tax_mismatch(gstr1, gstr2b, vendors, period=None, include_igst: bool = False) -> DataFrame:
    """Invoices whose CGST or SGST (or IGST) differ. A null on one side makes the difference null."""
    parts = ["cgst", "sgst", *(["igst"] if include_igst else [])]
    differ = reduce(lambda a, b: a | b, (F.col(f"{c}_1") != F.col(c) for c in parts))
    amount = reduce(lambda a, b: a + b, (F.abs(F.col(c) - F.col(f"{c}_1")) for c in parts))
    return _named(_both(gstr1, gstr2b, period).filter(differ), vendors).select(F.col("invoice_no").alias("invoice_id"), "period", amount.alias("tax_difference"), "vendor_name", F.lit("Tax Amount Mismatch").alias("issue_type"))


def hsn_mismatch(gstr1, gstr2b, period=None) -> DataFrame:
    return _both(gstr1, gstr2b, period).filter("hsn_1 <> hsn").select(F.col("invoice_no").alias("invoice_id"), "period", F.col("hsn").alias("hsn_2b"), "hsn_1", F.lit("HSN Mismatch").alias("issue_type"))


def eway_bill_missing(gstr1, gstr2b, eway_bills, period=None, per_return: bool = False) -> DataFrame:
    """Reported invoices above the limit without an e-way bill; per_return counts one in both books twice."""
    cols = [*KEYS, "taxable"]
    reported = in_period(gstr1, period).select(*cols).unionByName(in_period(gstr2b, period).select(*cols)).filter(F.col("taxable") > EWAY_LIMIT)
    reported = reported if per_return else reported.dropDuplicates(KEYS)
    by = document_keys(eway_bills)
    return reported.join(eway_bills.select(*by), by, "left_anti").select(F.col("invoice_no").alias("invoice_id"), "period", F.col("taxable").alias("amount"), F.lit("E-Way Bill Missing").alias("issue_type"))


def einvoice_missing(gstr1, gstr2b, einvoices, period=None) -> DataFrame:
    reported = in_period(gstr1, period).select(*KEYS).unionByName(in_period(gstr2b, period).select(*KEYS)).dropDuplicates(KEYS)
    by = document_keys(einvoices)
    return reported.join(einvoices.select(*by), by, "left_anti").select(F.col("invoice_no").alias("invoice_id"), "period", "supplier_gstin")


def late_filing(gstr1, period=None) -> DataFrame:
    late = in_period(gstr1, period).filter("filed_date > due_date")
    return late.select(F.col("invoice_no").alias("invoice_id"), "period", "filed_date", "due_date", text.days_late(F.col("filed_date"), F.col("due_date")).alias("days_late"))


def presence_match(gstr1, gstr2b, period=None) -> DataFrame:
    """Invoices that both books report, whatever their amounts."""
    return in_period(gstr2b, period).join(in_period(gstr1, period).select(*KEYS), KEYS, "left_semi").select(*KEYS)


def full_list(gstr1, gstr2b, eway_bills, vendors, period=None) -> DataFrame:
    """The four checks as one list; impact is the tax, else the amount, else 0. One pass over both books has the facts
    of every check; an invoice gives a row for each that it fails."""
    own = ["taxable", "cgst", "sgst", "igst", "hsn"]
    a = in_period(gstr1, period).select(*KEYS, *(F.col(c).alias(f"{c}_1") for c in own), F.lit(True).alias("in_1"))
    b = in_period(gstr2b, period).select(*KEYS, *(F.col(c).alias(f"{c}_2") for c in own), F.lit(True).alias("in_2"))
    by = document_keys(eway_bills)
    both = a.join(b, KEYS, "full_outer").join(eway_bills.select(*by).distinct().withColumn("has_ewb", F.lit(True)), by, "left")
    text_, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    col = F.col
    differ = (col("cgst_1") != col("cgst_2")) | (col("sgst_1") != col("sgst_2"))
    amount = F.coalesce("taxable_2", "taxable_1")
    # check, condition, impact, tax difference, HSN codes, whether it names the vendor
    checks = [
        ("Missing in GSTR-1", col("in_1").isNull(), F.coalesce(col("cgst_2") + col("sgst_2") + col("igst_2"), col("taxable_2"), F.lit(0)), number, text_, text_, True),
        ("Tax Amount Mismatch", differ, F.lit(0), F.abs(col("cgst_2") - col("cgst_1")) + F.abs(col("sgst_2") - col("sgst_1")), text_, text_, True),
        ("HSN Mismatch", col("hsn_1") != col("hsn_2"), F.lit(0), number, col("hsn_2"), col("hsn_1"), False),
        ("E-Way Bill Missing", (amount > EWAY_LIMIT) & col("has_ewb").isNull(), amount, number, text_, text_, False),
    ]
    found = [F.when(cond, F.struct(F.lit(name).alias("issue_type"), F.lit(i).alias("check_order"), impact.cast("bigint").alias("impact"), diff.cast("bigint").alias("tax_difference"), h2.alias("hsn_2b"), h1.alias("hsn_1"), F.lit(vendor).alias("named"))) for i, (name, cond, impact, diff, h2, h1, vendor) in enumerate(checks, 1)]
    rows = both.select(*KEYS, F.explode(F.array_compact(F.array(*found))).alias("x")).select(*KEYS, "x.*")
    return _named(rows, vendors).select(col("invoice_no").alias("invoice_id"), "period", "issue_type", "check_order", "impact", "tax_difference", "hsn_2b", "hsn_1", F.when(col("named"), col("vendor_name")).alias("vendor_name"))


def by_tax(rows: DataFrame) -> DataFrame:
    """Missing invoices by tax, the largest first; a tax that isn't known comes before all."""
    return rows.orderBy(F.desc_nulls_first("tax"), "invoice_id")


def by_difference(rows: DataFrame) -> DataFrame:
    """Tax mismatches by difference, the largest first, unknown before all."""
    return rows.orderBy(F.desc_nulls_first("tax_difference"), "invoice_id")


def by_impact(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("impact"), "check_order", "invoice_id")


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("issue_type").agg(F.count("*").alias("n"))


def period_report(rows: DataFrame) -> DataFrame:
    """One row per period: the four counts and their total."""
    names = {"missing_in_gstr1": "Missing in GSTR-1", "tax_amount_mismatch": "Tax Amount Mismatch", "hsn_mismatch": "HSN Mismatch", "eway_bill_missing": "E-Way Bill Missing"}
    return rows.groupBy("period").agg(*(F.count_if(F.col("issue_type") == v).alias(k) for k, v in names.items()), F.count("*").alias("total_mismatches"))


def unified(gstr1, gstr2b, einvoices, eway_bills, also: tuple[str, ...] = ()) -> DataFrame:
    """One pass over both books: a row per invoice in either, with flags, deltas and the final status. also: columns that
    follow from the keys in all four tables, by which these may lie together; they are kept."""
    own, keys = ["invoice_date", "taxable", "cgst", "sgst", "igst", "hsn"], [*KEYS, *also]
    bill, irn = document_keys(eway_bills, keys), document_keys(einvoices, keys)
    bills = eway_bills.select(*bill).distinct().withColumn("has_ewb", F.lit(True))
    irns = einvoices.groupBy(*irn).agg(F.max(F.col("status") == "ACT").alias("valid_irn"))

    def documented(book: DataFrame) -> DataFrame:
        return book.join(irns, irn, "left").join(bills, bill, "left")

    a = gstr1.select(*keys, *(F.col(c).alias(f"{c}_1") for c in own), "filed_date", "due_date", F.lit(True).alias("in_1"))
    b = gstr2b.select(*keys, *(F.col(c).alias(f"{c}_2") for c in own), "itc_available", F.lit(True).alias("in_2"))
    if bill == irn == keys:
        # Documents that carry all keys meet each book where it lies: the outer join's rows would have to move for them.
        a, b = (documented(x).withColumnsRenamed({"valid_irn": f"valid_irn_{i}", "has_ewb": f"has_ewb_{i}"}) for i, x in ((1, a), (2, b)))
        joined = a.join(b, keys, "full_outer").withColumns({c: F.coalesce(f"{c}_1", f"{c}_2") for c in ("valid_irn", "has_ewb")})
    else:
        joined = documented(a.join(b, keys, "full_outer"))
    out = joined.select(*keys, *(F.coalesce(f"{c}_2", f"{c}_1").alias(c) for c in own), *(F.col(f"{c}_1") for c in ("cgst", "sgst", "igst", "hsn")), F.coalesce("in_1", F.lit(False)).alias("in_gstr1"), F.coalesce("in_2", F.lit(False)).alias("in_gstr2b"), F.col("valid_irn").isNotNull().alias("has_einvoice"), F.coalesce("valid_irn", F.lit(False)).alias("valid_einvoice"), F.col("has_ewb").isNotNull().alias("has_eway_bill"), "itc_available", "filed_date", "due_date")
    return out.withColumn("total_tax", _tax()).withColumn("match_status", match_status())


def match_status() -> Column:
    """The first that applies: missing, tax, HSN, late, e-way bill; else matched."""
    both = F.col("in_gstr1") & F.col("in_gstr2b")
    rules = [~F.col("in_gstr1"), ~F.col("in_gstr2b"), both & ((F.col("cgst_1") != F.col("cgst")) | (F.col("sgst_1") != F.col("sgst"))), both & (F.col("hsn_1") != F.col("hsn")), F.col("filed_date") > F.col("due_date"), (F.col("taxable") > EWAY_LIMIT) & ~F.col("has_eway_bill")]
    return reduce(lambda w, r: w.when(r[0], r[1]), list(zip(rules, STATUSES, strict=False))[1:], F.when(rules[0], STATUSES[0])).otherwise(scoring.MATCHED)


def mismatched() -> Column:
    """A missing status counts as a mismatch."""
    return ~F.col("match_status").eqNullSafe(F.lit(scoring.MATCHED))


def enriched(unified_: DataFrame, vendors: DataFrame) -> DataFrame:
    """The flat invoice view: totals, presence status, level, vendor (Unknown and '' where none matches)."""
    v = vendors.select(F.col("gstin").alias("supplier_gstin"), "vendor_id", "name", "state")
    out = unified_.join(v, "supplier_gstin", "left").withColumn("presence_status", scoring.presence_status(F.col("in_gstr1"), F.col("in_gstr2b")))
    return out.select(F.col("invoice_no").alias("invoice_id"), "supplier_gstin", "vendor_id", F.coalesce("name", F.lit("Unknown")).alias("vendor_name"), F.when(F.col("vendor_id").isNull(), "").otherwise(F.col("supplier_gstin")).alias("gstin"), F.col("state").alias("vendor_state"), "invoice_date", "period", "taxable", "cgst", "sgst", "igst", "total_tax", (F.col("taxable") + F.col("total_tax")).alias("total"), "hsn", "in_gstr1", "in_gstr2b", "has_einvoice", "valid_einvoice", "has_eway_bill", "filed_date", "due_date", "itc_available", "presence_status", "match_status", scoring.invoice_risk_level(F.col("match_status"), F.col("total_tax")).alias("risk_level"))


def search(invoices: DataFrame, period: str | None = None, level: str | None = None, issue: str | None = None, term: str | None = None, hide_matched: bool = True) -> DataFrame:
    """The reconciliation view: every filter is optional and all apply; term matches id or vendor name."""
    out = in_period(invoices, period)
    out = out.filter(mismatched()) if hide_matched else out
    out = out if level is None else out.filter(F.col("risk_level") == level)
    out = out if issue is None else out.filter(F.col("match_status") == issue)
    return out if not term else out.filter(text.contains_fold(F.col("invoice_id"), term) | text.contains_fold(F.col("vendor_name"), term))


def resolution_days(gstr1: DataFrame) -> DataFrame:
    """Average days from due to filed over late invoices."""
    late = late_filing(gstr1)
    return late.agg((F.sum("days_late").cast("double") / F.count("*")).alias("avg_resolution_days"), F.count("*").alias("n"))
