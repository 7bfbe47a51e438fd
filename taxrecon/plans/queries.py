"""The registered queries over the domain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, sql, text
from ..operators import changes, clusters, explain, graph, kpis, model, quantiles, reconcile, search_index, vendors
from ..sources import large_json, returns, sinks, storage
from ..streaming import jobs
from .domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Domain(spark, sf_dir))

        QUERIES[name] = run
        return f

    return put


def _simple(name: str, f: Callable[[Domain], DataFrame]) -> None:
    query(name)(f)


VENDOR_COLS = ["vendor_id", "name", "gstin", "state", "total_transactions", "missed_filings", "avg_days_late", "risk_score", "status"]
LIMIT = 20_000  # paise at risk at which a vendor's alert goes off
TERM, PERIOD, INVOICE = "9-1", "1995-03", "INV-1-2"

_simple("vendors_view", lambda d: d.vendors.select(*VENDOR_COLS))
_simple("invoices_enriched", lambda d: d.invoices.select("invoice_id", "vendor_id", "vendor_name", "gstin", "invoice_date", "period", "taxable", "cgst", "sgst", "igst", "total_tax", "total", "hsn", "in_gstr1", "in_gstr2b", "has_einvoice", "has_eway_bill", "match_status", "risk_level"))
_simple("presence_status", lambda d: d.invoices.groupBy("presence_status").agg(F.count("*").alias("n"), F.sum("total_tax").alias("tax")))
_simple("invoice_risk_level", lambda d: d.invoices.groupBy("match_status", "risk_level").agg(F.count("*").alias("n"), F.sum("total_tax").alias("tax")))
_simple("missing_in_gstr1", lambda d: reconcile.missing_in_gstr1(d.gstr1, d.gstr2b, d.vendor_master))
_simple("missing_in_gstr2b", lambda d: reconcile.missing_in_gstr2b(d.gstr1, d.gstr2b, d.vendor_master))
_simple("tax_mismatch", lambda d: reconcile.tax_mismatch(d.gstr1, d.gstr2b, d.vendor_master))
_simple("tax_mismatch_igst", lambda d: reconcile.tax_mismatch(d.gstr1, d.gstr2b, d.vendor_master, include_igst=True))
_simple("hsn_mismatch", lambda d: reconcile.hsn_mismatch(d.gstr1, d.gstr2b))
_simple("eway_bill_missing", lambda d: reconcile.eway_bill_missing(d.gstr1, d.gstr2b, d.eway_bills))
_simple("eway_bill_missing_per_return", lambda d: reconcile.eway_bill_missing(d.gstr1, d.gstr2b, d.eway_bills, per_return=True))
_simple("missing_in_gstr1_by_tax", lambda d: reconcile.by_tax(reconcile.missing_in_gstr1(d.gstr1, d.gstr2b, d.vendor_master)))
_simple("tax_mismatch_by_difference", lambda d: reconcile.by_difference(reconcile.tax_mismatch(d.gstr1, d.gstr2b, d.vendor_master)))
_simple("missing_in_gstr1_period", lambda d: reconcile.missing_in_gstr1(d.gstr1, d.gstr2b, d.vendor_master, PERIOD))
_simple("tax_mismatch_period", lambda d: reconcile.tax_mismatch(d.gstr1, d.gstr2b, d.vendor_master, PERIOD))
_simple("hsn_mismatch_period", lambda d: reconcile.hsn_mismatch(d.gstr1, d.gstr2b, PERIOD))
_simple("eway_bill_missing_period", lambda d: reconcile.eway_bill_missing(d.gstr1, d.gstr2b, d.eway_bills, PERIOD))
_simple("late_filing_period", lambda d: reconcile.late_filing(d.gstr1, PERIOD))
_simple("full_reconciliation_period", lambda d: reconcile.full_list(d.gstr1, d.gstr2b, d.eway_bills, d.vendor_master, PERIOD))
_simple("explanation_lookup", lambda d: explain.template_explanation(d.spark.createDataFrame([(INVOICE,), ("INV-0-0",)], "invoice_id string"), d.invoices))
_simple("reconciliation_with_matched", lambda d: reconcile.search(d.invoices, period=PERIOD, hide_matched=False).select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("vendors_with_status", lambda d: vendors.with_status(d.vendors, "High Risk").select(*VENDOR_COLS))
_simple("average_risk_score", lambda d: vendors.average_score(d.vendors))
_simple("vendor_scorecard_by_score", lambda d: vendors.by_score(vendors.scorecard(d.vendors, d.invoices)).select("vendor_id", "name", "risk_score", "band", "at_risk_tax"))
_simple("vendor_connections", lambda d: graph.vendor_connections(graph.edges(d.invoices)))
_simple("traversal_text", lambda d: explain.traversals(d.invoices))
_simple("graph_top_edges", lambda d: graph.around(graph.nodes(d.vendors, d.invoices), graph.edges(d.invoices)))
_simple("sequential_ids", lambda d: sinks.numbered_ids(d.invoices.select("invoice_id", "invoice_date"), "INV-2025-", [F.col("invoice_date"), F.col("invoice_id")], 20, name="new_id").select("invoice_id", "new_id"))
_simple("short_ids", lambda d: sinks.numbered_ids(d.invoices.select("invoice_id", "invoice_date"), "INV-2025-", [F.col("invoice_date"), F.col("invoice_id")], 20, name="new_id").select("new_id", text.short_id(F.col("new_id")).alias("label")))
_simple("einvoice_missing", lambda d: reconcile.einvoice_missing(d.gstr1, d.gstr2b, d.einvoices))
_simple("late_filing", lambda d: reconcile.late_filing(d.gstr1))
_simple("vendor_risk_lookup", lambda d: d.vendors.filter("vendor_id = 'V000007'").select("vendor_id", "risk_score", "status"))
_simple("mismatch_detail", lambda d: d.invoices.filter(reconcile.mismatched()).select("invoice_id", "vendor_name", "gstin", "taxable", "period", F.col("match_status").alias("issue"), F.col("total_tax").alias("tax_at_risk"), "risk_level"))
_simple("resolution_days", lambda d: reconcile.resolution_days(d.gstr1))
_simple("presence_match", lambda d: reconcile.presence_match(d.gstr1, d.gstr2b))
_simple("reconcile_unified", lambda d: d.unified.select("supplier_gstin", "invoice_no", "period", "in_gstr1", "in_gstr2b", "total_tax", "match_status"))
_simple("full_reconciliation_list", lambda d: reconcile.full_list(d.gstr1, d.gstr2b, d.eway_bills, d.vendor_master))
_simple("reconciliation_top5", lambda d: reconcile.by_impact(reconcile.full_list(d.gstr1, d.gstr2b, d.eway_bills, d.vendor_master)).limit(5).select("invoice_id", "issue_type", "impact"))
_simple("reconciliation_by_type", lambda d: reconcile.by_type(reconcile.full_list(d.gstr1, d.gstr2b, d.eway_bills, d.vendor_master)))
_simple("reconciliation_period_report", lambda d: reconcile.period_report(reconcile.full_list(d.gstr1, d.gstr2b, d.eway_bills, d.vendor_master)))
_simple("reconciliation_by_vendor", lambda d: kpis.by_vendor(d.invoices))
_simple("classify_mismatch", lambda d: vendors.past_mismatches(d.invoices).groupBy("severity").agg(F.count("*").alias("n"), F.sum("total_tax").alias("tax")))
_simple("reconciliation_search", lambda d: reconcile.search(d.invoices, level="High", term=TERM).select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("indexed_search", lambda d: reconcile.search(search_index.found(d.invoices, d.id_index, d.name_index, TERM), level="High").select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("indexed_search_short", lambda d: reconcile.search(search_index.found(d.invoices, d.id_index, d.name_index, "7"), period=PERIOD).select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("indexed_search_name", lambda d: reconcile.search(search_index.found(d.invoices, d.id_index, d.name_index, "ER#00000000"), level="High").select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("indexed_lookup", lambda d: search_index.found(d.invoices, d.id_index, d.name_index, "INV-1-").select("invoice_id", "vendor_name", "match_status", "risk_level", "total_tax"))
_simple("indexed_audit_search", lambda d: explain.searched(explain.audit_records(d.invoices, d.vendors), search_index.found(d.invoices, d.id_index, d.name_index, TERM), TERM).select("invoice_id", "match_status"))
_simple("dashboard_kpis", lambda d: kpis.dashboard(d.invoices, d.vendors))
_simple("mismatch_breakdown", lambda d: kpis.breakdown(d.invoices))
_simple("filtered_summary", lambda d: kpis.summary(reconcile.search(d.invoices, issue="Missing in GSTR-1", term=TERM)))
_simple("monthly_itc", lambda d: kpis.monthly_itc(d.invoices))
_simple("itc_period_change", lambda d: kpis.period_change(d.invoices))
_simple("compliance_mix_monthly", lambda d: kpis.compliance_mix(d.invoices))
_simple("weekly_digest", lambda d: kpis.weekly_digest(d.invoices))
_simple("filings_register", lambda d: kpis.filings_register(d.gstr1, d.gstr2b))
_simple("distinct_periods", lambda d: d.invoices.filter("period <> ''").select("period").distinct())
_simple("vendor_compliance_metrics", lambda d: vendors.compliance(d.unified))
_simple("vendor_risk_scores", lambda d: d.vendors.select("vendor_id", F.col("raw_score").alias("score"), "status", scoring.probability_label(F.col("raw_score")).alias("label")))
_simple("vendor_status_distribution", lambda d: d.vendors.groupBy("status").agg(F.count("*").alias("n"), (F.sum((F.col("risk_score") * 100 + 0.5).cast("bigint")).cast("double") / F.count("*")).alias("avg_percent")))
_simple("vendor_risk_histogram", lambda d: vendors.histogram(d.vendors))
_simple("vendor_top10_at_risk", lambda d: vendors.top_at_risk(d.vendors, d.invoices))
_simple("vendor_scorecard", lambda d: vendors.scorecard(d.vendors, d.invoices))
_simple("vendor_flagged", lambda d: vendors.flag(d.vendors, 40.0).select("vendor_id", "risk_score"))
_simple("vendor_radar", lambda d: vendors.radar(d.vendors))
_simple("vendor_history", lambda d: vendors.history(d.invoices))
_simple("vendor_past_mismatches", lambda d: vendors.past_mismatches(d.invoices))
_simple("period_top_contributors", lambda d: vendors.top_contributors(d.invoices))
_simple("vendor_trailing_12m", lambda d: vendors.trailing(d.invoices))
_simple("state_risk_factor", lambda d: vendors.state_risk(d.invoices))
_simple("einvoice_rate", lambda d: vendors.einvoice_rate(d.invoices))
_simple("risk_feature_contributions", lambda d: vendors.feature_contributions(d.vendors))
_simple("blocked_itc", lambda d: d.gstr2b.groupBy("itc_available").agg(F.count("*").alias("n"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("tax")))
_simple("gstin_quality", lambda d: d.vendor_master.groupBy((F.length("gstin") == 15).alias("fine")).agg(F.count("*").alias("n")))
_simple("effective_rate", lambda d: d.gstr1.join(d.gstr2b.select(*reconcile.KEYS, F.col("taxable").alias("t2"), (F.col("cgst") + F.col("sgst") + F.col("igst")).alias("x2")), reconcile.KEYS).select(F.col("invoice_no").alias("invoice_id"), F.expr("((cgst + sgst + igst) * 10000 + taxable div 2) div taxable").alias("rate_1"), F.expr("(x2 * 10000 + t2 div 2) div t2").alias("rate_2")).filter("rate_1 <> rate_2"))
_simple("invoice_context", lambda d: explain.invoice_context(d.invoices, d.einvoices, d.eway_bills))
_simple("invoice_filings", lambda d: explain.invoice_filings(d.invoices))
_simple("audit_records", lambda d: explain.audit_records(d.invoices, d.vendors).withColumn("evidence", F.array_join("evidence", "; ")).drop("supplier_gstin", "period"))
_simple("audit_search", lambda d: explain.searched(explain.audit_records(d.invoices, d.vendors), d.invoices, TERM).select("invoice_id", "match_status"))
_simple("invoice_alerts", lambda d: explain.invoice_alerts(d.invoices).drop("invoice_date"))
_simple("vendor_alerts", lambda d: explain.vendor_alerts(d.vendors))
_simple("latest_alerts", lambda d: explain.latest_alerts(explain.invoice_alerts(d.invoices)).select("invoice_id", "type", "message"))
_simple("inr_formatting", lambda d: d.invoices.select("invoice_id", text.inr_compact(F.col("total")).alias("compact"), text.inr_compact(F.col("total"), thousands=False).alias("compact_grouped"), text.inr_grouped(F.col("total")).alias("grouped"), text.western(F.col("total")).alias("western"), text.period_label(F.col("period")).alias("period_label"), text.shortened(F.col("vendor_name")).alias("short_name")))
_simple("graph_nodes", lambda d: graph.nodes(d.vendors, d.invoices))
_simple("graph_edges", lambda d: graph.edges(d.invoices))
_simple("graph_summarized_in", lambda d: graph.summarized_in(kpis.filings_register(d.gstr1, d.gstr2b)))
_simple("graph_layer_filter", lambda d: graph.layers(graph.nodes(d.vendors, d.invoices), graph.edges(d.invoices), ["vendor", "invoice"])[1])
_simple("graph_stats", lambda d: graph.stats(graph.nodes(d.vendors, d.invoices)))
_simple("node_degree", lambda d: graph.degrees(graph.edges(d.invoices)))
_simple("graph_top_nodes", lambda d: graph.top_nodes(graph.nodes(d.vendors, d.invoices), graph.edges(d.invoices)).select("id", "group", "degree"))
_simple("graph_summary_nodes", lambda d: graph.summary_nodes(kpis.filings_register(d.gstr1, d.gstr2b)))
_simple("summary_return_register", lambda d: graph.summary_returns(kpis.filings_register(d.gstr1, d.gstr2b)))
_simple("graph_capped_nodes", lambda d: graph.capped(graph.edges(d.invoices)))
_simple("graph_capped_edges", lambda d: graph.among(graph.capped(graph.edges(d.invoices)), graph.edges(d.invoices)))
_simple("vendor_clusters", lambda d: clusters.clusters(d.invoices))
_simple("cluster_profile", lambda d: clusters.profile(clusters.clusters(d.invoices), d.invoices))
_simple("orphan_einvoices", lambda d: sinks.orphans(d.einvoices, d.gstr1.select(*reconcile.KEYS).union(d.gstr2b.select(*reconcile.KEYS))).select("irn", "invoice_no", "status"))
_simple("vendor_features", lambda d: model.features(d.vendors, d.invoices))
_simple("heuristic_labels", lambda d: model.labelled(model.features(d.vendors, d.invoices)).select("vendor_id", F.col("label").cast("int").alias("label")))
_simple("vendor_threshold_alerts", lambda d: jobs.threshold_crossings(d.table("events"), LIMIT))


@query("template_explanation")
def template_explanation(d: Domain) -> DataFrame:
    """Every order and supplier is asked for; those in neither book have no data."""
    asked = d.base.select(F.col("gstin").alias("supplier_gstin"), F.col("invoice_no").alias("invoice_id"), "period")
    return explain.template_explanation(asked, d.invoices).select("invoice_id", "explanation")


@query("upsert_last_write_wins")
def upsert_last_write_wins(d: Domain) -> DataFrame:
    """Both books written to one table, the buyer's after the suppliers'."""
    cols = ["supplier_gstin", "invoice_no", "period", "cgst", "sgst", "igst", "hsn"]
    rows = d.gstr1.select(*cols, F.lit(1).alias("stamp")).unionByName(d.gstr2b.select(*cols, F.lit(2).alias("stamp")))
    return sinks.last_write_wins(rows, reconcile.KEYS, [F.desc("stamp")])


def _as_posted(d: Domain) -> DataFrame:
    """Unified invoices as the text rows that a form posts; some are faulty by a rule on their numbers."""
    n = F.col("taxable") % 23
    amount = F.when(n == 0, "").when(n == 1, "abc").otherwise((F.col("taxable") / 100).cast("decimal(18,2)").cast("string"))
    vendor = F.when(n == 2, "").otherwise(F.col("vendor_id"))
    return d.invoices.select(F.col("invoice_id").alias("id"), vendor.alias("vendorId"), F.col("invoice_date").cast("string").alias("date"), amount.alias("taxableAmount"), *((F.col(c) / 100).cast("decimal(18,2)").cast("string").alias(c) for c in ("cgst", "sgst", "igst")), "hsn", "period", F.col("in_gstr1").alias("gstr1Reported"), F.col("in_gstr2b").alias("gstr2bReported"), F.col("has_einvoice").alias("eInvoice"), F.col("has_eway_bill").alias("eWayBill"))


@query("quarantine_rows")
def quarantine_rows(d: Domain) -> DataFrame:
    _, bad = returns.checked_invoices(_as_posted(d))
    return bad.select("id", "vendorId", "taxableAmount")


@query("json_gstr1_roundtrip")
def json_gstr1_roundtrip(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    # A file per document: the readers take whole-file documents.
    sinks.gstr1_documents(d.gstr1).write.option("maxRecordsPerFile", 1).json(path)
    return returns.gstr1(d.spark, path, "").groupBy("supplier_gstin").agg(F.count("*").alias("n"), F.sum("taxable").alias("taxable"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("tax"), F.min("invoice_date").alias("first"), F.max("hsn").alias("hsn"))


@query("json_gstr2b_roundtrip")
def json_gstr2b_roundtrip(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    sinks.gstr2b_documents(d.gstr2b).select("docdata").write.option("maxRecordsPerFile", 1).json(path)
    return returns.gstr2b(d.spark, path, "").groupBy("supplier_gstin", "itc_available").agg(F.count("*").alias("n"), F.sum("taxable").alias("taxable"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("tax"), F.min("invoice_date").alias("first"), F.max("hsn").alias("hsn"))


@query("json_einvoice_roundtrip")
def json_einvoice_roundtrip(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    # A file per array: the reader takes whole-file documents.
    sinks.einvoice_documents(d.einvoices).write.option("maxRecordsPerFile", 1).text(path)
    return returns.einvoices(d.spark, path).select("irn", "invoice_no", "status")


RANGE = "256k"  # bytes of a file that a task reads, small enough for the files here to be split


@query("json_gstr1_ranges")
def json_gstr1_ranges(d: Domain) -> DataFrame:
    """The suppliers' documents, many a file, read by byte ranges."""
    path = jobs.work_dir(d.spark)
    sinks.gstr1_documents(d.gstr1).write.json(path)
    return large_json.gstr1(d.spark, path, "", RANGE).groupBy("supplier_gstin").agg(F.count("*").alias("n"), F.sum("taxable").alias("taxable"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("tax"), F.min("invoice_date").alias("first"), F.max("hsn").alias("hsn"))


@query("json_gstr2b_ranges")
def json_gstr2b_ranges(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    sinks.gstr2b_documents(d.gstr2b).select("docdata").write.json(path)
    return large_json.gstr2b(d.spark, path, "", RANGE).groupBy("supplier_gstin", "itc_available").agg(F.count("*").alias("n"), F.sum("taxable").alias("taxable"), F.sum(F.col("cgst") + F.col("sgst") + F.col("igst")).alias("tax"), F.min("invoice_date").alias("first"), F.max("hsn").alias("hsn"))


@query("json_einvoice_ranges")
def json_einvoice_ranges(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    sinks.einvoice_documents(d.einvoices).write.text(path)
    return large_json.einvoices(d.spark, path, RANGE).select("irn", "invoice_no", "status")


@query("eway_bill_source")
def eway_bill_source(d: Domain) -> DataFrame:
    path = jobs.work_dir(d.spark)
    d.eway_bills.select("ewb_no", "invoice_no", "ewb_date").write.parquet(path)
    return returns.eway_bills(d.spark, path)


@query("filings_source")
def filings_source(d: Domain) -> DataFrame:
    """The register of returns as CSV, with the date of the last filing, read back."""
    path = jobs.work_dir(d.spark)
    filed = d.gstr1.groupBy("period").agg(F.max("filed_date").alias("filed_date")).withColumn("type", F.lit("GSTR-1"))
    rows = kpis.filings_register(d.gstr1, d.gstr2b).join(filed, ["type", "period"], "left")
    cols = ["type", "period", "total_invoices", "total_taxable", "total_tax", "filed_date"]
    sinks.to_csv(rows.select(*cols, F.when(F.col("filed_date").isNull(), "Auto-generated").otherwise("Filed").alias("status")), path)
    return returns.filings(d.spark, path)


@query("append_alerts")
def append_alerts(d: Domain) -> DataFrame:
    """Alerts of the two books' sides appended to one table by period, one after the other."""
    path = jobs.work_dir(d.spark)
    for reported in (True, False):
        part = d.invoices.filter(F.col("in_gstr1") == reported)
        sinks.append(explain.invoice_alerts(part).join(part.select("invoice_id", "period"), "invoice_id").select("period", "type"), path, "period")
    return d.spark.read.schema("type string, period string").parquet(path).groupBy("period", "type").agg(F.count("*").alias("n"))


@query("csv_export")
def csv_export(d: Domain) -> DataFrame:
    """The filtered reconciliation view as CSV, read back."""
    path = jobs.work_dir(d.spark)
    view = reconcile.search(d.invoices, level="High").select("invoice_id", "vendor_name", "match_status", "total_tax")
    sinks.to_csv(view, path)
    return d.spark.read.schema(view.schema).option("header", True).csv(path)


@query("vendor_quarantine")
def vendor_quarantine(d: Domain) -> DataFrame:
    """Vendors as posted, all text, some faulty; those that the checks turn away."""
    n = F.col("total_transactions").cast("string")
    rows = d.vendors.select(F.col("vendor_id").alias("id"), F.when(F.col("missed_filings") > 9, "").otherwise(F.col("name")).alias("name"), "gstin", "state", F.when(F.col("avg_days_late") > 12, F.concat(n, F.lit("x"))).otherwise(n).alias("totalTransactions"), F.col("missed_filings").cast("string").alias("missedFilings"), F.lit(None).cast("string").alias("avgDaysLate"))
    _, bad = returns.checked_vendors(rows)
    return bad.select("id", "name", "gstin", "totalTransactions")


@query("stream_invoice_alerts")
def stream_invoice_alerts(d: Domain) -> DataFrame:
    """Posted invoices stream in as files, meet the static vendors and leave as alerts in an append sink."""
    path = jobs.work_dir(d.spark)
    posted = _as_posted(d)
    posted.write.parquet(f"{path}/in")
    stream = d.spark.readStream.schema(posted.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    vendors_ = d.vendor_master.select("vendor_id", "name", "gstin")
    out = jobs.alerts(jobs.intake(stream, vendors_))
    jobs.finished(out.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/cp")
    return d.spark.read.parquet(f"{path}/out")


@query("stream_windowed_kpis")
def stream_windowed_kpis(d: Domain) -> DataFrame:
    """Daily events and tax per type in append mode; the closing event is late enough to end every day."""
    path = jobs.work_dir(d.spark)
    events = jobs.event_stream(d.spark, d.sf_dir, end=jobs.closing(d.spark, f"{path}/end"))
    jobs.finished(jobs.windowed(jobs.deduplicated(events)).writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/cp")
    return d.spark.read.parquet(f"{path}/out").filter("start < '8000-01-01'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "tax")


@query("stream_sliding_kpis")
def stream_sliding_kpis(d: Domain) -> DataFrame:
    """Events and tax per type in windows of two days that start daily, in update mode: every batch sends the windows
    that it changed, and the last word on each stands."""
    path = jobs.work_dir(d.spark)
    folder, files = jobs.split_by_time(d.spark, d.table("events"), f"{path}/in")
    events = jobs.event_stream(d.spark, folder, "*", files=files)
    out = jobs.windowed(events.withWatermark("ts", "1 hour"), "2 days", "1 day")
    jobs.finished(out.writeStream.foreachBatch(jobs.latest(f"{path}/out")).outputMode("update"), f"{path}/cp")
    rows = d.spark.read.parquet(f"{path}/out")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "tax"), "batch").alias("x"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "x.*")


@query("stream_deduplicated")
def stream_deduplicated(d: Domain) -> DataFrame:
    """A stream in which every seventh event comes twice, in files of their own times; each counts once."""
    path = jobs.work_dir(d.spark)
    sent = d.table("events").unionByName(d.table("events").filter("event_id % 7 = 0"))
    folder, files = jobs.split_by_time(d.spark, sent, f"{path}/in", close=True)
    events = jobs.event_stream(d.spark, folder, "*", files=files)
    jobs.finished(jobs.windowed(jobs.deduplicated(events)).writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/cp")
    return d.spark.read.parquet(f"{path}/out").filter("start < '8000-01-01'").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "tax")


@query("stream_threshold_alerts")
def stream_threshold_alerts(d: Domain) -> DataFrame:
    """The alerts of vendor_threshold_alerts from a stream of several parts, with vendors' sums as keyed state."""
    path = jobs.work_dir(d.spark)
    folder, files = jobs.split_by_time(d.spark, d.table("events"), f"{path}/in")
    found = jobs.threshold_alerts(jobs.event_stream(d.spark, folder, "*", files=files), LIMIT)
    with jobs.stateful(d.spark):
        jobs.finished(found.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/cp")
    return d.spark.read.schema("user_id bigint, event_id bigint, running bigint").parquet(f"{path}/out")


def _corrections(d: Domain) -> list[DataFrame]:
    """Three batches of changes, by a rule on the numbers: invoices leave either book, are corrected or newly reported,
    are changed wrongly and then rightly, leave and come back under another code."""
    r = (F.col("ok") * 7 + F.col("sk")) % 40
    base = d.base.withColumn("supplier_gstin", F.col("gstin")).withColumn("itc_available", F.lit("Y"))
    wrong = base.filter(r == 4).withColumn("cgst", F.col("cgst") + 100)
    first = [changes.change(base.filter(r == 0), "gstr1", "delete", 1), changes.change(base.filter(r == 2), "gstr1", "upsert", 1), changes.change(wrong, "gstr1", "upsert", 1), changes.change(base.filter(r == 5), "gstr2b", "delete", 1)]
    second = [changes.change(base.filter(r == 1), "gstr2b", "delete", 2), changes.change(base.filter(r == 3), "gstr2b", "upsert", 2), changes.change(base.filter(r == 4), "gstr1", "upsert", 3)]
    third = [changes.change(base.filter(r == 5).withColumn("hsn", F.col("hsn_other")), "gstr2b", "upsert", 4)]
    return [reduce(DataFrame.unionByName, parts) for parts in (first, second, third)]


def _refreshed(d: Domain) -> str:
    """The folder of the figures after a stream of changes, which arrive one batch after the other."""
    path = jobs.work_dir(d.spark)
    keep = changes.maintained(d.gstr1, d.gstr2b, d.einvoices, d.eway_bills, path, d.near)
    for i, batch in enumerate(_corrections(d)):
        batch.write.parquet(f"{path}/in/{i}")
        stream = d.spark.readStream.schema(changes.CHANGES).option("recursiveFileLookup", True).parquet(f"{path}/in")
        jobs.finished(stream.writeStream.foreachBatch(keep), f"{path}/cp")
    return path


@query("incremental_status_figures")
def incremental_status_figures(d: Domain) -> DataFrame:
    """Invoices and tax by period and status after inserts, changes and deletions, each batch added to what was there."""
    return changes.current(d.spark, _refreshed(d), "status", changes.figures(d.unified, "status"))


@query("incremental_vendor_scores")
def incremental_vendor_scores(d: Domain) -> DataFrame:
    """The vendors' scores after the same changes, from sums by vendor and month."""
    months = changes.current(d.spark, _refreshed(d), "vendor_month", changes.figures(d.unified, "vendor_month"))
    return vendors.scored(d.vendor_master, changes.metrics(months)).select(*VENDOR_COLS)


@query("stream_reconcile_outer")
def stream_reconcile_outer(d: Domain) -> DataFrame:
    """Both sides stream in from files of their own times, one a batch; a closing file at the end of either ends the wait."""
    path = jobs.work_dir(d.spark)
    folder, files = jobs.split_by_time(d.spark, d.table("events"), f"{path}/in", close=True)
    out = jobs.reconciled(*(jobs.event_stream(d.spark, folder, "*", files=files) for _ in range(2)))
    jobs.finished(out.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/cp")
    return d.spark.read.parquet(f"{path}/out").filter("purchase_id >= 0")


def _rows(d: Domain) -> DataFrame:
    """Features with centrality and communities, labelled; made once a session and state of the tables, for all trainings."""
    return d.kept("forest rows", lambda: model.labelled(model.features(d.vendors, d.invoices, graph.vendor_ranks(d.vendors, d.invoices), clusters.clusters(d.invoices))))


def _trained(d: Domain):
    rows = _rows(d)
    return rows, model.train(model.split(rows)[0])


@query("vendor_risk_forest")
def vendor_risk_forest(d: Domain) -> DataFrame:
    rows, fitted = _trained(d)
    return model.predict(fitted, rows)


@query("forest_feature_importance")
def forest_feature_importance(d: Domain) -> DataFrame:
    return model.importances(_trained(d)[1], d.spark)


@query("forest_metrics")
def forest_metrics(d: Domain) -> DataFrame:
    """Accuracy, area under ROC, precision, recall and F1 of a forest and of boosted trees on the side not trained on."""
    return model.evaluated(_rows(d))


@query("forest_confusion")
def forest_confusion(d: Domain) -> DataFrame:
    train, test = model.split(_rows(d))
    return model.confusion(model.train(train), test)


@query("forest_cross_validation")
def forest_cross_validation(d: Domain) -> DataFrame:
    """Mean area under ROC over five folds."""
    return d.spark.createDataFrame([(float(model.cross_validated(_rows(d))),)], "auc double")


@query("forest_fold_metrics")
def forest_fold_metrics(d: Domain) -> DataFrame:
    """Rows, accuracy and area under ROC of each fold, by the forest trained on the others, and of all folds together."""
    return model.fold_metrics(model.out_of_fold(_rows(d)))


@query("risk_score_auc")
def risk_score_auc(d: Domain) -> DataFrame:
    """How well the rule's score ranks the vendors that the heuristic labels."""
    labels = model.labelled(model.features(d.vendors, d.invoices)).select("vendor_id", "label")
    out = quantiles.auc(d.vendors.join(labels, "vendor_id"), "raw_score", "label")
    return out.select("positives", "negatives", scoring.round_half_up(F.col("auc"), 9).alias("auc"))


@query("risk_quantiles")
def risk_quantiles(d: Domain) -> DataFrame:
    """Quantiles of the heuristic score and of the invoices' tax."""
    risk = storage.written(model.heuristic(model.features(d.vendors, d.invoices)).select("risk"))
    tax = d.invoices.select(F.col("total_tax").alias("tax"))
    found = [(q, quantiles.quantile(risk, "risk", q), quantiles.quantile(tax, "tax", q)) for q in (0.1, 0.5, 0.7, 0.99)]
    rows = d.spark.createDataFrame(found, "q double, risk double, tax double")
    return rows.select("q", *(scoring.round_half_up(F.col(c), 6).alias(c) for c in ("risk", "tax")))


@query("evidence_paths")
def evidence_paths(d: Domain) -> DataFrame:
    """Within three edges of the twenty mismatched invoices with the most tax."""
    worst = d.invoices.filter(reconcile.mismatched()).orderBy(F.desc("total_tax"), "invoice_id").limit(20)
    return graph.hops(graph.edges(d.invoices), worst.select(F.concat(F.lit("i-"), "invoice_id").alias("id")))


@query("sql_functions")
def sql_functions(d: Domain) -> DataFrame:
    """The scoring rules in SQL."""
    sql.register(d.spark)
    found = """
        SELECT v.vendor_id, predict_risk(v.missed_filings, v.avg_days_late, v.total_transactions) AS score,
               classify_risk(predict_risk(v.missed_filings, v.avg_days_late, v.total_transactions)) AS status,
               probability_label(v.risk_score) AS label, i.invoice_id, presence_status(i.in_gstr1, i.in_gstr2b) AS presence,
               invoice_risk_level(i.match_status, i.total_tax) AS level, classify_mismatch(i.total_tax, v.missed_filings) AS severity
        FROM {vendors} v JOIN {invoices} i ON i.vendor_id = v.vendor_id"""
    return d.spark.sql(found, vendors=d.vendors, invoices=d.invoices)


@query("pagerank")
def pagerank(d: Domain) -> DataFrame:
    """PageRank of vendors, invoices and returns over the ISSUED and IN edges."""
    ranks = graph.invoice_ranks(d.vendors, d.invoices)
    return ranks.select("id", scoring.round_half_up(F.col("rank"), 10).alias("rank"))


@query("communities")
def communities(d: Domain) -> DataFrame:
    return graph.communities(d.invoices)
