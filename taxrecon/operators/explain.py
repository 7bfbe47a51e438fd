"""Evidence, explanations and alerts for invoices and vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .reconcile import document_keys, mismatched

# Texts that must equal the application's own.
NOT_REPORTED = "appears in GSTR-2B but is MISSING from the vendor's GSTR-1 filing. ITC cannot be claimed under Section 16(2)(aa) CGST Act until the vendor reports this invoice."
TAX_CONFLICT = "shows conflicting tax amounts between GSTR-1 and GSTR-2B. The correct amount must be reconciled before claiming ITC."
TRAVERSAL = """MATCH (v:Vendor {gstin:'%1$s'})-[:ISSUED_INVOICE]->(i:Invoice {id:'%2$s'})
MATCH (i)-[:REPORTED_IN]->(g2:GSTR {type:'GSTR-2B', period:'%3$s'})
WHERE NOT EXISTS {
  MATCH (i)-[:MATCHES]->(:Invoice)-[:REPORTED_IN]->(:GSTR {type:'GSTR-1', period:'%3$s'})
}
RETURN v.name AS vendor, i.id AS invoice, i.tax_amount AS tax"""

EVIDENCE = {"in_gstr2b": ("Invoice in GSTR-2B", "NOT in GSTR-2B"), "in_gstr1": ("Invoice in Vendor GSTR-1", "MISSING from Vendor GSTR-1"), "has_einvoice": ("e-Invoice generated", "No e-Invoice")}
ADVICE = " is at risk. Contact vendor to reconcile."
PATH = ("Your Entity → GSTR-2B (", ") → ", " → ")


def filings() -> Column:
    """Of an invoice the sorted texts 'type (period)' of the returns that hold it; the flags of the one pass over both
    books know them."""
    held = [F.when(F.col(flag), F.concat(F.lit(f"{kind} ("), "period", F.lit(")"))) for flag, kind in (("in_gstr1", "GSTR-1"), ("in_gstr2b", "GSTR-2B"))]
    return F.sort_array(F.array_compact(F.array(*held)))


def invoice_filings(invoices: DataFrame) -> DataFrame:
    return invoices.select("invoice_id", F.array_join(filings(), "; ").alias("filings"))


def invoice_context(invoices: DataFrame, einvoices: DataFrame, eway_bills: DataFrame) -> DataFrame:
    """Vendor, returns, e-invoices and e-way bills of each invoice (supplier_gstin, invoice_id, period). Every side is
    gathered before it is joined, so the sides don't multiply. Documents are an invoice's own by all keys they carry."""
    out = invoices.select("supplier_gstin", F.col("invoice_id").alias("invoice_no"), "period", "vendor_id", "vendor_name", "match_status", filings().alias("filings"))
    for documents, number, name in ((einvoices, "irn", "irns"), (eway_bills, "ewb_no", "ewbs")):
        by = document_keys(documents)
        out = out.join(documents.groupBy(*by).agg(F.sort_array(F.collect_set(number)).alias(name)), by, "left")
    return out.select(F.col("invoice_no").alias("invoice_id"), "vendor_id", "vendor_name", "match_status", *(F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c) for c in ("filings", "irns", "ewbs")))


def template_explanation(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """An explanation for each request, by invoice_id and what else of supplier_gstin and period it names; an invoice
    that isn't known says so. A number that several suppliers use is explained for each of them."""
    by = [c for c in ("supplier_gstin", "invoice_id", "period") if c in requests.columns]
    rows = requests.select(*by).join(invoices, by, "left")
    held = filings()
    head = F.concat(F.lit("Invoice "), "invoice_id", F.lit(f" ({text.RUPEE_SIGN}"), text.western(F.col("taxable")), F.lit(") from "), "vendor_name", F.lit(" (GSTIN: "), "gstin", F.lit(") "))
    body = F.when(text.any_contains(held, "GSTR-2B") & ~text.any_contains(held, "GSTR-1"), F.lit(NOT_REPORTED))
    body = body.when(F.col("match_status") == "Tax Amount Mismatch", F.lit(TAX_CONFLICT)).otherwise(F.concat(F.lit("status: "), "match_status", F.lit(". ")))
    return rows.select("invoice_id", F.when(F.col("match_status").isNull(), F.concat(F.lit("No data found for invoice "), "invoice_id")).otherwise(F.concat(head, body)).alias("explanation"))


def audit_records(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Summary, evidence, recommendation and graph path of every mismatch."""
    v = vendors.select("vendor_id", "risk_score")
    rows = invoices.filter(mismatched()).join(v, "vendor_id", "left")
    percent = F.floor(F.coalesce("risk_score", F.lit(0.0)) * 100 + 0.5).cast("bigint").cast("string")
    held = (F.when(F.col(c), yes).otherwise(no) for c, (yes, no) in EVIDENCE.items())
    evidence = F.array(F.concat(F.lit("Invoice date: "), F.col("invoice_date").cast("string"), F.lit(", period: "), "period"), *held, F.concat(F.lit("Vendor risk: "), percent, F.lit("%")))
    summary = F.concat(F.lit("Invoice "), "invoice_id", F.lit(f" ({text.RUPEE_SIGN}"), text.inr_grouped(F.col("taxable")), F.lit(" taxable) from "), "vendor_name", F.lit(" is flagged: "), "match_status", F.lit("."))
    advice = F.concat(F.lit(f"ITC of {text.RUPEE_SIGN}"), text.inr_grouped(F.col("total_tax")), F.lit(ADVICE))
    path = F.concat(F.lit(PATH[0]), "period", F.lit(PATH[1]), "invoice_id", F.lit(PATH[2]), "vendor_name")
    return rows.select("supplier_gstin", "invoice_id", "period", summary.alias("summary"), evidence.alias("evidence"), advice.alias("recommendation"), path.alias("graph_path"))


def traversals(invoices: DataFrame) -> DataFrame:
    """Of every mismatch the graph query that shows it."""
    return invoices.filter(mismatched()).select("invoice_id", F.format_string(TRAVERSAL, "gstin", "invoice_id", "period").alias("traversal"))


def searched(audit: DataFrame, invoices: DataFrame, term: str) -> DataFrame:
    """Mismatches that have a record and match the term."""
    by = [c for c in ("supplier_gstin", "invoice_id", "period") if c in audit.columns]
    have = invoices.filter(mismatched()).join(audit.select(*by), by, "left_semi")
    return have.filter(text.contains_fold(F.col("invoice_id"), term) | text.contains_fold(F.col("vendor_name"), term))


def invoice_alerts(invoices: DataFrame) -> DataFrame:
    bad = mismatched()
    kind = F.when(~bad, "success").when(F.col("risk_level") == "High", "critical").otherwise("warning")
    message = F.when(bad, F.concat(F.lit("Mismatch: "), "invoice_id", F.lit(" from "), "vendor_name", F.lit(" — "), "match_status", F.lit(f" ({text.RUPEE_SIGN}"), text.western(F.col("total_tax"), truncate=True), F.lit(" tax)"))).otherwise(F.concat(F.lit("Invoice "), "invoice_id", F.lit(" from "), "vendor_name", F.lit(" matched")))
    return invoices.select("invoice_id", "invoice_date", kind.alias("type"), message.alias("message"), icon(kind).alias("icon"))


def icon(kind):
    return F.when(kind == "critical", "\U0001f534").when(kind == "warning", "\U0001f7e1").otherwise("\U0001f7e2")


def vendor_alerts(vendors: DataFrame) -> DataFrame:
    kind = F.when(F.col("status") == "High Risk", "critical").when(F.col("status") == "Review", "warning").otherwise("success")
    message = F.concat(F.lit("New vendor "), "name", F.lit(" added — Risk: "), F.floor(F.col("raw_score") * 100).cast("bigint").cast("string"), F.lit("% ("), "status", F.lit(")"))
    return vendors.select("vendor_id", kind.alias("type"), message.alias("message"), icon(kind).alias("icon"))


def latest_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("invoice_date"), F.desc("invoice_id")).limit(n)
