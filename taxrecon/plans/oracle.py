"""SQL of the registered queries for another engine, over the same folder's tables."""

from __future__ import annotations

BASE = """
WITH lines AS (
  SELECT l_orderkey AS ok, l_suppkey AS sk, l_partkey AS pk,
         (CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) + 5) // 10 AS lt,
         CASE l_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 18 ELSE 28 END AS rate
  FROM lineitem),
grp AS (
  SELECT ok, sk, CAST(sum(lt) AS BIGINT) AS taxable, CAST(sum((lt * rate + 50) // 100) AS BIGINT) AS tax, min(pk) AS mpk
  FROM lines GROUP BY ok, sk),
master AS (
  SELECT s_suppkey AS sk, 'V' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS vendor_id, s_name AS name,
         left(lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || 'AB' || lpad(CAST(s_suppkey % 1000000000 AS VARCHAR), 9, '0') || 'ZM', CASE WHEN s_suppkey % 9 = 0 THEN 14 ELSE 15 END) AS gstin,
         n_name AS state, n_regionkey AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b0 AS (
  SELECT g.*, m.vendor_id, m.name, m.gstin, m.state, CAST(o_orderdate AS DATE) AS invoice_date,
         m.region = n.n_regionkey AS intra, (g.ok * 31 + g.sk) % 100 AS k, g.sk % 10 AS s10
  FROM grp g JOIN orders ON o_orderkey = g.ok JOIN customer ON c_custkey = o_custkey
  JOIN nation n ON n.n_nationkey = c_nationkey JOIN master m ON m.sk = g.sk),
base AS (
  SELECT *, 'INV-' || ok || '-' || sk AS invoice_no, strftime(invoice_date, '%Y-%m') AS period,
         CASE WHEN intra THEN tax // 2 ELSE 0 END AS cgst, CASE WHEN intra THEN tax - tax // 2 ELSE 0 END AS sgst,
         CASE WHEN intra THEN 0 ELSE tax END AS igst,
         CAST(1000 + mpk % 9000 AS VARCHAR) AS hsn,
         CASE WHEN k BETWEEN 22 AND 25 THEN CAST(1000 + (mpk + 1) % 9000 AS VARCHAR) ELSE CAST(1000 + mpk % 9000 AS VARCHAR) END AS hsn_1,
         k >= CASE WHEN s10 < 5 THEN 2 WHEN s10 < 9 THEN 10 ELSE 30 END AS in_gstr1, NOT (k BETWEEN 10 AND 14) AS in_gstr2b,
         CASE WHEN s10 = 9 THEN k >= 30 ELSE k BETWEEN 26 AND 33 END AS late,
         CAST(date_trunc('month', invoice_date) + INTERVAL 1 MONTH + INTERVAL 10 DAY AS DATE) AS due_date,
         CASE WHEN k BETWEEN 40 AND 44 THEN 'N' ELSE 'Y' END AS itc_available, (ok + 3 * sk) % 17 <> 0 AS has_eway_bill, (ok + 5 * sk) % 13 <> 0 AS has_einvoice
  FROM b0),
b1 AS (
  SELECT *, CAST(due_date + CAST(CASE WHEN late THEN CASE WHEN s10 = 9 THEN 25 + sk % 6 ELSE sk % 25 + 1 END ELSE -(k % 5) END AS INTEGER) AS DATE) AS filed,
         CASE WHEN k BETWEEN 15 AND 21 THEN cgst - cgst // 16 ELSE cgst END AS cgst_1,
         CASE WHEN k BETWEEN 15 AND 21 THEN sgst - sgst // 16 ELSE sgst END AS sgst_1,
         CASE WHEN k BETWEEN 15 AND 21 THEN igst - igst // 16 ELSE igst END AS igst_1
  FROM base),
inv AS (
  SELECT *, invoice_no AS invoice_id, name AS vendor_name, state AS vendor_state, tax AS total_tax, taxable + tax AS total,
         CASE WHEN in_gstr1 THEN filed END AS filed_date,
         CASE WHEN NOT in_gstr1 AND in_gstr2b THEN 'Missing in GSTR-1' WHEN in_gstr1 AND NOT in_gstr2b THEN 'Missing in GSTR-2B' ELSE 'Matched' END AS presence_status,
         CASE WHEN NOT in_gstr1 THEN 'Missing in GSTR-1' WHEN NOT in_gstr2b THEN 'Missing in GSTR-2B'
              WHEN cgst_1 <> cgst OR sgst_1 <> sgst THEN 'Tax Amount Mismatch' WHEN hsn_1 <> hsn THEN 'HSN Mismatch'
              WHEN filed > due_date THEN 'Late Filing' WHEN taxable > 5000000 AND NOT has_eway_bill THEN 'E-Way Bill Missing'
              ELSE 'Matched' END AS match_status
  FROM b1 WHERE in_gstr1 OR in_gstr2b),
i AS (
  SELECT *, match_status <> 'Matched' AS bad, CASE WHEN match_status = 'Matched' THEN 'Low' WHEN total_tax > 5000000 THEN 'High' ELSE 'Medium' END AS risk_level,
         year(invoice_date) * 12 + month(invoice_date) AS mi, greatest(0, date_diff('day', due_date, filed_date)) AS days
  FROM inv),
metrics AS (
  SELECT gstin AS supplier_gstin, count(*) AS total_transactions, count(DISTINCT CASE WHEN NOT in_gstr1 THEN mi END) AS missed_filings,
         coalesce(CAST(sum(CASE WHEN in_gstr1 THEN days END) AS DOUBLE) / nullif(count(CASE WHEN in_gstr1 THEN 1 END), 0), 0) AS avg_days_late
  FROM i WHERE mi > (SELECT max(mi) FROM i) - 12 GROUP BY gstin),
scores AS (
  SELECT m.*, coalesce(total_transactions, 0) AS tx, coalesce(missed_filings, 0) AS missed, coalesce(avg_days_late, 0) AS late_days,
         least(greatest(least(CAST(coalesce(missed_filings, 0) AS DOUBLE) / 6, 1) * CAST(0.28 AS DOUBLE) + least(coalesce(avg_days_late, 0) / 20, 1) * CAST(0.22 AS DOUBLE)
           + CASE WHEN coalesce(total_transactions, 0) < 50 THEN CAST(0.8 AS DOUBLE) WHEN total_transactions < 100 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END * CAST(0.12 AS DOUBLE)
           + CASE WHEN coalesce(missed_filings, 0) > 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END * CAST(0.12 AS DOUBLE)
           + CAST(0.3 AS DOUBLE) * CAST(0.08 AS DOUBLE), CAST(0.05 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS raw_score
  FROM master m LEFT JOIN metrics ON supplier_gstin = gstin),
v AS (
  SELECT *, floor(raw_score * 100 + 0.5) / 100 AS risk_score,
         CASE WHEN raw_score >= CAST(0.6 AS DOUBLE) THEN 'High Risk' WHEN raw_score >= CAST(0.3 AS DOUBLE) THEN 'Review' ELSE 'Compliant' END AS status
  FROM scores),
miss1 AS (SELECT invoice_no AS invoice_id, period, taxable AS amount, tax, name AS vendor_name, gstin AS vendor_gstin, 'Missing in GSTR-1' AS issue_type FROM b1 WHERE in_gstr2b AND NOT in_gstr1),
taxm AS (SELECT invoice_no AS invoice_id, period, abs(cgst - cgst_1) + abs(sgst - sgst_1) AS tax_difference, name AS vendor_name, 'Tax Amount Mismatch' AS issue_type FROM b1 WHERE in_gstr1 AND in_gstr2b AND (cgst <> cgst_1 OR sgst <> sgst_1)),
hsnm AS (SELECT invoice_no AS invoice_id, period, hsn AS hsn_2b, hsn_1, 'HSN Mismatch' AS issue_type FROM b1 WHERE in_gstr1 AND in_gstr2b AND hsn <> hsn_1),
ewbm AS (SELECT invoice_no AS invoice_id, period, taxable AS amount, 'E-Way Bill Missing' AS issue_type FROM b1 WHERE (in_gstr1 OR in_gstr2b) AND taxable > 5000000 AND NOT has_eway_bill),
full_list AS (
  SELECT invoice_id, period, issue_type, 1 AS check_order, tax AS impact, NULL AS tax_difference, NULL AS hsn_2b, NULL AS hsn_1, vendor_name FROM miss1
  UNION ALL SELECT invoice_id, period, issue_type, 2, 0, tax_difference, NULL, NULL, vendor_name FROM taxm
  UNION ALL SELECT invoice_id, period, issue_type, 3, 0, NULL, hsn_2b, hsn_1, NULL FROM hsnm
  UNION ALL SELECT invoice_id, period, issue_type, 4, amount, NULL, NULL, NULL, NULL FROM ewbm),
past AS (
  SELECT vendor_id, invoice_date, CAST(coalesce(sum(n) OVER (PARTITION BY vendor_id ORDER BY invoice_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past_mismatches
  FROM (SELECT vendor_id, invoice_date, sum(CAST(bad AS INTEGER)) AS n FROM i GROUP BY 1, 2)),
past_rows AS (
  SELECT i.invoice_id, i.vendor_id, i.total_tax, p.past_mismatches,
         CASE WHEN i.total_tax > 10000000 THEN 'High Risk' WHEN p.past_mismatches > 5 THEN 'High Risk' WHEN i.total_tax > 5000000 THEN 'Medium Risk' WHEN p.past_mismatches > 2 THEN 'Medium Risk' ELSE 'Low Risk' END AS severity
  FROM i JOIN past p ON p.vendor_id = i.vendor_id AND p.invoice_date = i.invoice_date WHERE i.bad),
filing AS (
  SELECT invoice_id, array_to_string(list_sort(list_filter([CASE WHEN in_gstr1 THEN 'GSTR-1 (' || period || ')' END, CASE WHEN in_gstr2b THEN 'GSTR-2B (' || period || ')' END], lambda x: x IS NOT NULL)), '; ') AS filings FROM i),
nodes AS (
  SELECT 'v-' || vendor_id AS id, CASE WHEN length(name) > 14 THEN substr(name, 1, 13) || '…' ELSE name END AS label, 'vendor' AS "group", CAST(NULL AS BOOLEAN) AS flagged,
         gstin, risk_score AS risk, state, status, CAST(NULL AS VARCHAR) AS period, CAST(NULL AS BIGINT) AS amount FROM v
  UNION ALL SELECT 'g-' || t || '-' || period, t || ' ' || strftime(CAST(period || '-01' AS DATE), '%b %y'), 'gstr', NULL, NULL, NULL, NULL, NULL, period, NULL FROM (SELECT DISTINCT period FROM i), (VALUES ('GSTR-1'), ('GSTR-2B')) AS x(t)
  UNION ALL SELECT 'i-' || invoice_id, replace(invoice_id, 'INV-2025-', 'INV-'), 'invoice', bad, NULL, NULL, NULL, CASE WHEN bad THEN 'flagged' ELSE 'matched' END, NULL, total FROM i
  UNION ALL SELECT 'e-' || invoice_id, 'IRN-' || right(invoice_id, 3), 'einvoice', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM i WHERE has_einvoice
  UNION ALL SELECT 'w-' || invoice_id, 'EWB-' || right(invoice_id, 3), 'ewaybill', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM i WHERE has_eway_bill),
edges AS (
  SELECT 'v-' || vendor_id AS source, 'i-' || invoice_id AS target, 'ISSUED' AS label, 'issued' AS type FROM i
  UNION ALL SELECT 'i-' || invoice_id, 'g-GSTR-2B-' || period, 'IN_2B', 'reported' FROM i WHERE in_gstr2b
  UNION ALL SELECT 'i-' || invoice_id, 'g-GSTR-1-' || period, 'IN_1', 'reported' FROM i WHERE in_gstr1
  UNION ALL SELECT 'i-' || invoice_id, 'e-' || invoice_id, 'E_INV', 'einvoice' FROM i WHERE has_einvoice
  UNION ALL SELECT 'i-' || invoice_id, 'w-' || invoice_id, 'EWB', 'ewaybill' FROM i WHERE has_eway_bill),
degree AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
register AS (
  SELECT 'GSTR-1' AS type, period, count(*) AS total_invoices, CAST(sum(taxable) AS BIGINT) AS total_taxable, CAST(sum(cgst_1 + sgst_1 + igst_1) AS BIGINT) AS total_tax FROM b1 WHERE in_gstr1 GROUP BY period
  UNION ALL SELECT 'GSTR-2B', period, count(*), CAST(sum(taxable) AS BIGINT), CAST(sum(tax) AS BIGINT) FROM b1 WHERE in_gstr2b GROUP BY period),
risk AS (SELECT vendor_id, CAST(sum(total_tax) AS BIGINT) AS at_risk_tax, count(*) AS mismatches FROM i WHERE bad GROUP BY vendor_id),
facts AS (
  SELECT vendor_id, count(CASE WHEN bad THEN 1 END) AS mismatch_count, CAST(sum(CASE WHEN bad THEN total_tax ELSE 0 END) AS DOUBLE) / 100 AS total_tax_at_risk,
         count(*) AS transaction_volume, CAST(count(CASE WHEN has_einvoice THEN 1 END) AS DOUBLE) / count(*) AS einvoice_compliance_rate
  FROM i GROUP BY vendor_id),
state_rate AS (SELECT vendor_state, count(*) AS n, CAST(count(CASE WHEN bad THEN 1 END) AS DOUBLE) / count(*) AS state_risk_factor FROM i GROUP BY vendor_state),
features AS (
  SELECT v.vendor_id, CAST(coalesce(mismatch_count, 0) AS DOUBLE) AS mismatch_count, coalesce(total_tax_at_risk, 0) AS total_tax_at_risk, CAST(v.late_days AS DOUBLE) AS filing_delay_days,
         CAST(0.5 AS DOUBLE) AS graph_centrality, CAST(coalesce(transaction_volume, 0) AS DOUBLE) AS transaction_volume, CAST(0 AS DOUBLE) AS community_cluster,
         coalesce(einvoice_compliance_rate, CAST(0.9 AS DOUBLE)) AS einvoice_compliance_rate, coalesce(state_risk_factor, CAST(0.5 AS DOUBLE)) AS state_risk_factor
  FROM v LEFT JOIN facts USING (vendor_id) LEFT JOIN state_rate ON vendor_state = v.state),
heur AS (
  SELECT vendor_id, mismatch_count * CAST(0.25 AS DOUBLE) + total_tax_at_risk / 100000 * CAST(0.20 AS DOUBLE) + filing_delay_days * CAST(0.15 AS DOUBLE) + graph_centrality * CAST(0.10 AS DOUBLE)
         + (1 - einvoice_compliance_rate) * CAST(0.15 AS DOUBLE) + (1 - transaction_volume / (SELECT max(transaction_volume) FROM features)) * CAST(0.05 AS DOUBLE) + state_risk_factor * CAST(0.10 AS DOUBLE) AS risk
  FROM features),
fmt AS (SELECT *, (total + 50) // 100 AS r, CAST((total + 50) // 100 AS VARCHAR) AS rs FROM i),
fmt2 AS (
  SELECT *, CASE WHEN length(rs) <= 3 THEN rs ELSE reverse(rtrim(regexp_replace(reverse(left(rs, length(rs) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right(rs, 3) END AS grouped FROM fmt),
posted AS (SELECT invoice_id, vendor_id, taxable, taxable % 23 AS n, total_tax, vendor_name, presence_status FROM i)
"""


def _lakh(paise: str) -> str:
    s = f"CAST(({paise} + 50) // 100 AS VARCHAR)"
    return f"CASE WHEN length({s}) <= 3 THEN {s} ELSE reverse(rtrim(regexp_replace(reverse(left({s}, length({s}) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right({s}, 3) END"


def _tenths(unit: int, suffix: str) -> str:
    t = f"((total + {unit * 5}) // {unit * 10})"
    return f"'₹' || CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{suffix}'"


_EXPLANATION = "CASE WHEN i.match_status IS NULL THEN 'No data found for invoice ' || b.invoice_id ELSE 'Invoice ' || i.invoice_id || ' (₹' || format('{:,}', (i.taxable + 50) // 100) || ') from ' || i.vendor_name || ' (GSTIN: ' || i.gstin || ') ' || CASE WHEN i.in_gstr2b AND NOT i.in_gstr1 THEN 'appears in GSTR-2B but is MISSING from the vendor''s GSTR-1 filing. ITC cannot be claimed under Section 16(2)(aa) CGST Act until the vendor reports this invoice.' WHEN i.match_status = 'Tax Amount Mismatch' THEN 'shows conflicting tax amounts between GSTR-1 and GSTR-2B. The correct amount must be reconciled before claiming ITC.' ELSE 'status: ' || i.match_status || '. ' END END"
_TOP_NODES = 'SELECT n.id, n."group", coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN degree d ON d.id = n.id ORDER BY coalesce(degree, 0) DESC, n.id LIMIT 200'

_SELECTS: dict[str, str] = {
    "vendors_view": "SELECT vendor_id, name, gstin, state, tx AS total_transactions, missed AS missed_filings, CAST(late_days AS DOUBLE) AS avg_days_late, risk_score, status FROM v",
    "invoices_enriched": "SELECT invoice_id, vendor_id, vendor_name, gstin, invoice_date, period, taxable, cgst, sgst, igst, total_tax, total, hsn, in_gstr1, in_gstr2b, has_einvoice, has_eway_bill, match_status, risk_level FROM i",
    "presence_status": "SELECT presence_status, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS tax FROM i GROUP BY 1",
    "invoice_risk_level": "SELECT match_status, risk_level, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS tax FROM i GROUP BY 1, 2",
    "missing_in_gstr1": "SELECT * FROM miss1",
    "missing_in_gstr2b": "SELECT invoice_no AS invoice_id, period, taxable AS amount, cgst_1 + sgst_1 + igst_1 AS tax, name AS vendor_name, gstin AS vendor_gstin, 'Missing in GSTR-2B' AS issue_type FROM b1 WHERE in_gstr1 AND NOT in_gstr2b",
    "tax_mismatch": "SELECT * FROM taxm",
    "tax_mismatch_igst": "SELECT invoice_no AS invoice_id, period, abs(cgst - cgst_1) + abs(sgst - sgst_1) + abs(igst - igst_1) AS tax_difference, name AS vendor_name, 'Tax Amount Mismatch' AS issue_type FROM b1 WHERE in_gstr1 AND in_gstr2b AND (cgst <> cgst_1 OR sgst <> sgst_1 OR igst <> igst_1)",
    "hsn_mismatch": "SELECT * FROM hsnm",
    "eway_bill_missing": "SELECT * FROM ewbm",
    "eway_bill_missing_per_return": "SELECT e.* FROM ewbm e JOIN i ON i.invoice_id = e.invoice_id, unnest(range(CAST(in_gstr1 AS INTEGER) + CAST(in_gstr2b AS INTEGER))) AS u(x)",
    "missing_in_gstr1_by_tax": "SELECT * FROM miss1",
    "tax_mismatch_by_difference": "SELECT * FROM taxm",
    "missing_in_gstr1_period": "SELECT * FROM miss1 WHERE period = '1995-03'",
    "tax_mismatch_period": "SELECT * FROM taxm WHERE period = '1995-03'",
    "hsn_mismatch_period": "SELECT * FROM hsnm WHERE period = '1995-03'",
    "eway_bill_missing_period": "SELECT * FROM ewbm WHERE period = '1995-03'",
    "late_filing_period": "SELECT invoice_id, period, filed_date, due_date, days AS days_late FROM i WHERE filed_date > due_date AND period = '1995-03'",
    "full_reconciliation_period": "SELECT * FROM full_list WHERE period = '1995-03'",
    "explanation_lookup": f"SELECT b.invoice_id, {_EXPLANATION} AS explanation FROM (VALUES ('INV-1-2'), ('INV-0-0')) AS b(invoice_id) LEFT JOIN i ON i.invoice_id = b.invoice_id",
    "reconciliation_with_matched": "SELECT invoice_id, vendor_name, match_status, risk_level, total_tax FROM i WHERE period = '1995-03'",
    "vendors_with_status": "SELECT vendor_id, name, gstin, state, tx AS total_transactions, missed AS missed_filings, CAST(late_days AS DOUBLE) AS avg_days_late, risk_score, status FROM v WHERE status = 'High Risk'",
    "average_risk_score": "SELECT count(*) AS vendors, CAST(sum(CAST(floor(risk_score * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS avg_risk_score FROM v",
    "vendor_scorecard_by_score": "SELECT vendor_id, name, risk_score, CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'high' WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band, coalesce(at_risk_tax, 0) AS at_risk_tax FROM v LEFT JOIN risk USING (vendor_id)",
    "vendor_connections": "SELECT vendor_id, count(*) AS invoices, CAST(sum(CAST(in_gstr1 AS INTEGER) + CAST(in_gstr2b AS INTEGER) + CAST(has_einvoice AS INTEGER) + CAST(has_eway_bill AS INTEGER)) AS BIGINT) AS documents FROM i GROUP BY 1",
    "traversal_text": "SELECT invoice_id, 'MATCH (v:Vendor {gstin:''' || gstin || '''})-[:ISSUED_INVOICE]->(i:Invoice {id:''' || invoice_id || '''})' || chr(10) || 'MATCH (i)-[:REPORTED_IN]->(g2:GSTR {type:''GSTR-2B'', period:''' || period || '''})' || chr(10) || 'WHERE NOT EXISTS {' || chr(10) || '  MATCH (i)-[:MATCHES]->(:Invoice)-[:REPORTED_IN]->(:GSTR {type:''GSTR-1'', period:''' || period || '''})' || chr(10) || '}' || chr(10) || 'RETURN v.name AS vendor, i.id AS invoice, i.tax_amount AS tax' AS traversal FROM i WHERE bad",
    "graph_top_edges": f", top AS ({_TOP_NODES}) SELECT e.* FROM edges e WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)",
    "sequential_ids": "SELECT invoice_id, 'INV-2025-' || CASE WHEN length(CAST(n AS VARCHAR)) < 3 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS new_id FROM (SELECT invoice_id, row_number() OVER (ORDER BY invoice_date, invoice_id) + 20 AS n FROM i)",
    "eway_bill_source": "SELECT 'EWB-' || ok || '-' || sk AS ewb_no, invoice_no, invoice_date AS ewb_date FROM b1 WHERE has_eway_bill",
    "filings_source": "SELECT r.*, f.filed_date, CASE WHEN f.filed_date IS NULL THEN 'Auto-generated' ELSE 'Filed' END AS status FROM register r LEFT JOIN (SELECT 'GSTR-1' AS type, period, max(filed) AS filed_date FROM b1 WHERE in_gstr1 GROUP BY period) f ON f.type = r.type AND f.period = r.period",
    "append_alerts": "SELECT period, CASE WHEN NOT bad THEN 'success' WHEN risk_level = 'High' THEN 'critical' ELSE 'warning' END AS type, count(*) AS n FROM i GROUP BY 1, 2",
    "csv_export": "SELECT invoice_id, vendor_name, match_status, total_tax FROM i WHERE bad AND risk_level = 'High'",
    "vendor_quarantine": "SELECT * FROM (SELECT vendor_id AS id, CASE WHEN missed > 9 THEN '' ELSE name END AS name, gstin, CAST(tx AS VARCHAR) || CASE WHEN late_days > 12 THEN 'x' ELSE '' END AS \"totalTransactions\" FROM v) WHERE name = '' OR length(gstin) <> 15 OR right(\"totalTransactions\", 1) = 'x'",
    "einvoice_missing": "SELECT invoice_id, period, gstin AS supplier_gstin FROM i WHERE NOT has_einvoice",
    "late_filing": "SELECT invoice_id, period, filed_date, due_date, days AS days_late FROM i WHERE filed_date > due_date",
    "vendor_risk_lookup": "SELECT vendor_id, risk_score, status FROM v WHERE vendor_id = 'V000007'",
    "mismatch_detail": "SELECT invoice_id, vendor_name, gstin, taxable, period, match_status AS issue, total_tax AS tax_at_risk, risk_level FROM i WHERE bad",
    "resolution_days": "SELECT CAST(sum(days) AS DOUBLE) / count(*) AS avg_resolution_days, count(*) AS n FROM i WHERE filed_date > due_date",
    "presence_match": "SELECT gstin AS supplier_gstin, invoice_no, period FROM i WHERE in_gstr1 AND in_gstr2b",
    "reconcile_unified": "SELECT gstin AS supplier_gstin, invoice_no, period, in_gstr1, in_gstr2b, total_tax, match_status FROM i",
    "full_reconciliation_list": "SELECT * FROM full_list",
    "reconciliation_top5": "SELECT invoice_id, issue_type, impact FROM full_list ORDER BY impact DESC, check_order, invoice_id LIMIT 5",
    "reconciliation_by_type": "SELECT issue_type, count(*) AS n FROM full_list GROUP BY 1",
    "reconciliation_period_report": "SELECT period, count(*) FILTER (issue_type = 'Missing in GSTR-1') AS missing_in_gstr1, count(*) FILTER (issue_type = 'Tax Amount Mismatch') AS tax_amount_mismatch, count(*) FILTER (issue_type = 'HSN Mismatch') AS hsn_mismatch, count(*) FILTER (issue_type = 'E-Way Bill Missing') AS eway_bill_missing, count(*) AS total_mismatches FROM full_list GROUP BY 1",
    "reconciliation_by_vendor": "SELECT vendor_id, vendor_name, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS total_tax, max(CASE risk_level WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) AS worst_level FROM i WHERE bad GROUP BY 1, 2",
    "classify_mismatch": "SELECT severity, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS tax FROM past_rows GROUP BY 1",
    "reconciliation_search": "SELECT invoice_id, vendor_name, match_status, risk_level, total_tax FROM i WHERE bad AND risk_level = 'High' AND (contains(lower(invoice_id), '9-1') OR contains(lower(vendor_name), '9-1'))",
    "dashboard_kpis": "SELECT *, CASE WHEN total_invoices > 0 THEN floor(CAST(total_invoices - total_mismatches AS DOUBLE) * 1000 / total_invoices + 0.5) / 10 ELSE 0 END AS match_rate, total_mismatches AS pending FROM (SELECT count(*) AS total_invoices, count(*) FILTER (bad) AS total_mismatches, CAST(coalesce(sum(total_tax) FILTER (bad), 0) AS BIGINT) AS at_risk_itc FROM i), (SELECT count(*) AS vendors_monitored, count(*) FILTER (status = 'High Risk') AS high_risk_vendors FROM v)",
    "mismatch_breakdown": "SELECT match_status, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS total_tax FROM i WHERE bad GROUP BY 1",
    "filtered_summary": "SELECT count(*) AS total, CAST(coalesce(sum(total_tax), 0) AS BIGINT) AS total_tax, count(*) FILTER (risk_level = 'High') AS high_count FROM i WHERE match_status = 'Missing in GSTR-1' AND (contains(lower(invoice_id), '9-1') OR contains(lower(vendor_name), '9-1'))",
    "monthly_itc": "SELECT period, count(*) AS invoices, count(*) FILTER (bad) AS mismatches, CAST(coalesce(sum(total_tax) FILTER (bad), 0) AS BIGINT) AS at_risk, CAST(sum(total_tax) AS BIGINT) AS total FROM i GROUP BY 1",
    "itc_period_change": "SELECT period, at_risk, before, CASE WHEN before > 0 THEN CAST(at_risk - before AS DOUBLE) / before END AS change FROM (SELECT period, at_risk, lag(at_risk) OVER (ORDER BY period) AS before FROM (SELECT period, CAST(coalesce(sum(total_tax) FILTER (bad), 0) AS BIGINT) AS at_risk FROM i GROUP BY 1))",
    "compliance_mix_monthly": """SELECT period, count(*) AS vendors, CAST(count(*) FILTER (s < CAST(0.3 AS DOUBLE)) AS DOUBLE) * 100 / count(*) AS compliant_pct, CAST(count(*) FILTER (s >= CAST(0.3 AS DOUBLE) AND s < CAST(0.6 AS DOUBLE)) AS DOUBLE) * 100 / count(*) AS review_pct, CAST(count(*) FILTER (s >= CAST(0.6 AS DOUBLE)) AS DOUBLE) * 100 / count(*) AS high_risk_pct
      FROM (SELECT period, least(greatest(least(CAST(missed AS DOUBLE) / 6, 1) * CAST(0.28 AS DOUBLE) + least(late / 20, 1) * CAST(0.22 AS DOUBLE) + CASE WHEN tx < 50 THEN CAST(0.8 AS DOUBLE) WHEN tx < 100 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END * CAST(0.12 AS DOUBLE) + CASE WHEN missed > 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END * CAST(0.12 AS DOUBLE) + CAST(0.3 AS DOUBLE) * CAST(0.08 AS DOUBLE), CAST(0.05 AS DOUBLE)), CAST(0.95 AS DOUBLE)) AS s
        FROM (SELECT period, vendor_id, count(*) AS tx, count(*) FILTER (NOT in_gstr1) AS missed, coalesce(CAST(sum(days) FILTER (in_gstr1) AS DOUBLE) / nullif(count(*) FILTER (in_gstr1), 0), 0) AS late FROM i GROUP BY 1, 2)) GROUP BY 1""",
    "weekly_digest": "SELECT CAST(date_trunc('week', invoice_date) AS DATE) AS week, count(*) AS invoices, count(*) FILTER (bad) AS mismatches, CAST(coalesce(sum(total_tax) FILTER (bad), 0) AS BIGINT) AS at_risk FROM i GROUP BY 1",
    "filings_register": "SELECT * FROM register",
    "distinct_periods": "SELECT DISTINCT period FROM i",
    "vendor_compliance_metrics": "SELECT supplier_gstin, total_transactions, missed_filings, CAST(avg_days_late AS DOUBLE) AS avg_days_late FROM metrics",
    "vendor_risk_scores": "SELECT vendor_id, raw_score AS score, status, CASE WHEN raw_score < CAST(0.3 AS DOUBLE) THEN 'Low' WHEN raw_score < CAST(0.6 AS DOUBLE) THEN 'Medium' ELSE 'High' END AS label FROM v",
    "vendor_status_distribution": "SELECT status, count(*) AS n, CAST(sum(CAST(floor(risk_score * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) AS avg_percent FROM v GROUP BY 1",
    "vendor_risk_histogram": "SELECT CAST(b AS INTEGER) AS bucket, e[b + 1] AS low, e[b + 2] AS high, (SELECT count(*) FROM v WHERE risk_score >= e[b + 1] AND risk_score < e[b + 2]) AS n FROM (SELECT CAST([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0] AS DOUBLE[]) AS e), range(10) AS r(b)",
    "vendor_top10_at_risk": "SELECT vendor_id, name, risk_score, coalesce(at_risk_tax, 0) AS at_risk_tax FROM (SELECT * FROM v WHERE risk_score > CAST(0.3 AS DOUBLE) ORDER BY risk_score DESC, vendor_id LIMIT 10) LEFT JOIN risk USING (vendor_id)",
    "vendor_scorecard": "SELECT vendor_id, name, state, status, risk_score, CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'high' WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band, CASE WHEN risk_score > 0.5 THEN 'up' WHEN risk_score > 0.25 THEN 'flat' ELSE 'down' END AS trend, CASE WHEN risk_score > CAST(0.6 AS DOUBLE) THEN 'Likely non-compliant' WHEN risk_score > CAST(0.3 AS DOUBLE) THEN 'Needs monitoring' ELSE 'Expected compliant' END AS prediction, coalesce(at_risk_tax, 0) AS at_risk_tax, coalesce(mismatches, 0) AS mismatches FROM v LEFT JOIN risk USING (vendor_id)",
    "vendor_flagged": "SELECT vendor_id, risk_score FROM v WHERE risk_score * 100 > 40",
    "vendor_radar": "SELECT vendor_id, CAST(CASE WHEN missed = 0 THEN 95 ELSE greatest(30, 90 - missed * 15) END AS DOUBLE) AS filing_regularity, 100 - risk_score * 60 AS tax_accuracy, CAST(CASE WHEN risk_score < CAST(0.3 AS DOUBLE) THEN 92 WHEN risk_score < CAST(0.6 AS DOUBLE) THEN 65 ELSE 35 END AS DOUBLE) AS einvoice_compliance, 100 - risk_score * 50 AS itc_match_rate, CAST(CASE WHEN late_days = 0 THEN 98 ELSE greatest(20, 95 - late_days * 5) END AS DOUBLE) AS response_time, least(100, CAST(tx AS DOUBLE) / 5) AS volume FROM v",
    "vendor_history": "SELECT vendor_id, period, match_status, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS tax, count(*) FILTER (filed_date > due_date) AS late FROM i GROUP BY 1, 2, 3",
    "vendor_past_mismatches": "SELECT * FROM past_rows",
    "period_top_contributors": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY tax DESC, vendor_id) AS INTEGER) AS rank FROM (SELECT period, vendor_id, vendor_name, CAST(sum(total_tax) AS BIGINT) AS tax, count(*) AS n FROM i WHERE bad GROUP BY 1, 2, 3)) WHERE rank <= 3",
    "vendor_trailing_12m": "SELECT vendor_id, mi AS month_idx, n, bad, CAST(sum(n) OVER w AS BIGINT) AS n_trailing, CAST(sum(bad) OVER w AS BIGINT) AS bad_trailing FROM (SELECT vendor_id, mi, count(*) AS n, count(*) FILTER (bad) AS bad FROM i GROUP BY 1, 2) WINDOW w AS (PARTITION BY vendor_id ORDER BY mi RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)",
    "state_risk_factor": "SELECT * FROM state_rate",
    "einvoice_rate": "SELECT vendor_id, transaction_volume AS n, einvoice_compliance_rate FROM facts",
    "risk_feature_contributions": "SELECT vendor_id, 'Missed Filings' AS feature, CAST(missed AS DOUBLE) AS value, CAST(0.28 AS DOUBLE) AS weight FROM v UNION ALL SELECT vendor_id, 'Avg Days Late', CAST(late_days AS DOUBLE), CAST(0.22 AS DOUBLE) FROM v UNION ALL SELECT vendor_id, 'Transactions', CAST(tx AS DOUBLE), CAST(0.12 AS DOUBLE) FROM v",
    "blocked_itc": "SELECT itc_available, count(*) AS n, CAST(sum(tax) AS BIGINT) AS tax FROM b1 WHERE in_gstr2b GROUP BY 1",
    "gstin_quality": "SELECT length(gstin) = 15 AS fine, count(*) AS n FROM master GROUP BY 1",
    "effective_rate": "SELECT * FROM (SELECT invoice_id, ((cgst_1 + sgst_1 + igst_1) * 10000 + taxable // 2) // taxable AS rate_1, (tax * 10000 + taxable // 2) // taxable AS rate_2 FROM i WHERE in_gstr1 AND in_gstr2b) WHERE rate_1 <> rate_2",
    "invoice_context": "SELECT i.invoice_id, vendor_id, vendor_name, match_status, filings, CASE WHEN has_einvoice THEN 'IRN-' || ok || '-' || sk ELSE '' END AS irns, CASE WHEN has_eway_bill THEN 'EWB-' || ok || '-' || sk ELSE '' END AS ewbs FROM i JOIN filing f ON f.invoice_id = i.invoice_id",
    "invoice_filings": "SELECT * FROM filing",
    "template_explanation": "SELECT b.invoice_no AS invoice_id, CASE WHEN i.match_status IS NULL THEN 'No data found for invoice ' || b.invoice_no ELSE 'Invoice ' || i.invoice_id || ' (₹' || format('{:,}', (i.taxable + 50) // 100) || ') from ' || i.vendor_name || ' (GSTIN: ' || i.gstin || ') ' || CASE WHEN i.in_gstr2b AND NOT i.in_gstr1 THEN 'appears in GSTR-2B but is MISSING from the vendor''s GSTR-1 filing. ITC cannot be claimed under Section 16(2)(aa) CGST Act until the vendor reports this invoice.' WHEN i.match_status = 'Tax Amount Mismatch' THEN 'shows conflicting tax amounts between GSTR-1 and GSTR-2B. The correct amount must be reconciled before claiming ITC.' ELSE 'status: ' || i.match_status || '. ' END END AS explanation FROM base b LEFT JOIN i ON i.invoice_id = b.invoice_no",
    "audit_records": f"SELECT invoice_id, 'Invoice ' || invoice_id || ' (₹' || {_lakh('taxable')} || ' taxable) from ' || vendor_name || ' is flagged: ' || match_status || '.' AS summary, 'Invoice date: ' || CAST(invoice_date AS VARCHAR) || ', period: ' || period || '; ' || CASE WHEN in_gstr2b THEN 'Invoice in GSTR-2B' ELSE 'NOT in GSTR-2B' END || '; ' || CASE WHEN in_gstr1 THEN 'Invoice in Vendor GSTR-1' ELSE 'MISSING from Vendor GSTR-1' END || '; ' || CASE WHEN has_einvoice THEN 'e-Invoice generated' ELSE 'No e-Invoice' END || '; Vendor risk: ' || CAST(CAST(floor(risk_score * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS evidence, 'ITC of ₹' || {_lakh('total_tax')} || ' is at risk. Contact vendor to reconcile.' AS recommendation, 'Your Entity → GSTR-2B (' || period || ') → ' || invoice_id || ' → ' || vendor_name AS graph_path FROM i JOIN (SELECT vendor_id, risk_score FROM v) USING (vendor_id) WHERE bad",
    "audit_search": "SELECT invoice_id, match_status FROM i WHERE bad AND (contains(lower(invoice_id), '9-1') OR contains(lower(vendor_name), '9-1'))",
    "invoice_alerts": "SELECT invoice_id, CASE WHEN NOT bad THEN 'success' WHEN risk_level = 'High' THEN 'critical' ELSE 'warning' END AS type, CASE WHEN bad THEN 'Mismatch: ' || invoice_id || ' from ' || vendor_name || ' — ' || match_status || ' (₹' || format('{:,}', total_tax // 100) || ' tax)' ELSE 'Invoice ' || invoice_id || ' from ' || vendor_name || ' matched' END AS message, CASE WHEN NOT bad THEN '🟢' WHEN risk_level = 'High' THEN '🔴' ELSE '🟡' END AS icon FROM i",
    "vendor_alerts": "SELECT vendor_id, CASE status WHEN 'High Risk' THEN 'critical' WHEN 'Review' THEN 'warning' ELSE 'success' END AS type, 'New vendor ' || name || ' added — Risk: ' || CAST(CAST(floor(raw_score * 100) AS BIGINT) AS VARCHAR) || '% (' || status || ')' AS message, CASE status WHEN 'High Risk' THEN '🔴' WHEN 'Review' THEN '🟡' ELSE '🟢' END AS icon FROM v",
    "latest_alerts": "SELECT invoice_id, CASE WHEN NOT bad THEN 'success' WHEN risk_level = 'High' THEN 'critical' ELSE 'warning' END AS type, CASE WHEN bad THEN 'Mismatch: ' || invoice_id || ' from ' || vendor_name || ' — ' || match_status || ' (₹' || format('{:,}', total_tax // 100) || ' tax)' ELSE 'Invoice ' || invoice_id || ' from ' || vendor_name || ' matched' END AS message FROM i ORDER BY invoice_date DESC, invoice_id DESC LIMIT 20",
    "inr_formatting": f"SELECT invoice_id, CASE WHEN total >= 1000000000 THEN {_tenths(10**7, ' Cr')} WHEN total >= 10000000 THEN {_tenths(10**5, ' L')} WHEN total >= 100000 THEN {_tenths(10**3, 'K')} ELSE '₹' || rs END AS compact, CASE WHEN total >= 1000000000 THEN {_tenths(10**7, ' Cr')} WHEN total >= 10000000 THEN {_tenths(10**5, ' L')} ELSE '₹' || grouped END AS compact_grouped, grouped, format('{{:,}}', r) AS western, strftime(CAST(period || '-01' AS DATE), '%b %y') AS period_label, CASE WHEN length(vendor_name) > 14 THEN substr(vendor_name, 1, 13) || '…' ELSE vendor_name END AS short_name FROM fmt2",
    "graph_nodes": "SELECT * FROM nodes",
    "graph_edges": "SELECT * FROM edges",
    "graph_summarized_in": "SELECT 'g-' || type || '-' || period AS source, 'g-GSTR-3B-' || period AS target, 'SUMMARIZED_IN' AS label, 'summary' AS type FROM register",
    "indexed_search_short": "SELECT invoice_id, vendor_name, match_status, risk_level, total_tax FROM i WHERE bad AND period = '1995-03' AND (contains(lower(invoice_id), '7') OR contains(lower(vendor_name), '7'))",
    "indexed_search_name": "SELECT invoice_id, vendor_name, match_status, risk_level, total_tax FROM i WHERE bad AND risk_level = 'High' AND (contains(lower(invoice_id), 'er#00000000') OR contains(lower(vendor_name), 'er#00000000'))",
    "indexed_lookup": "SELECT invoice_id, vendor_name, match_status, risk_level, total_tax FROM i WHERE contains(lower(invoice_id), 'inv-1-') OR contains(lower(vendor_name), 'inv-1-')",
    "risk_score_auc": ", rl AS (SELECT v.raw_score, CAST(h.risk > (SELECT quantile_cont(risk, 0.7) FROM heur) AS INTEGER) AS label FROM v JOIN heur h USING (vendor_id)) SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, floor((SELECT sum(CASE WHEN p.raw_score > n.raw_score THEN 1.0 WHEN p.raw_score = n.raw_score THEN 0.5 ELSE 0 END)::DOUBLE / count(*) FROM rl p, rl n WHERE p.label = 1 AND n.label = 0) * 1000000000 + 0.5) / 1000000000 AS auc FROM rl",
    "risk_quantiles": "SELECT q, floor(risk * 1000000 + 0.5) / 1000000 AS risk, floor(tax * 1000000 + 0.5) / 1000000 AS tax FROM (" + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, (SELECT quantile_cont(risk, {q}) FROM heur) AS risk, (SELECT quantile_cont(CAST(total_tax AS DOUBLE), {q}) FROM i) AS tax" for q in (0.1, 0.5, 0.7, 0.99)) + ")",
    "sql_functions": "SELECT v.vendor_id, v.raw_score AS score, v.status, CASE WHEN v.risk_score < CAST(0.3 AS DOUBLE) THEN 'Low' WHEN v.risk_score < CAST(0.6 AS DOUBLE) THEN 'Medium' ELSE 'High' END AS label, i.invoice_id, i.presence_status AS presence, i.risk_level AS level, CASE WHEN i.total_tax > 10000000 THEN 'High Risk' WHEN v.missed > 5 THEN 'High Risk' WHEN i.total_tax > 5000000 THEN 'Medium Risk' WHEN v.missed > 2 THEN 'Medium Risk' ELSE 'Low Risk' END AS severity FROM v JOIN i ON i.vendor_id = v.vendor_id",
    "graph_summary_nodes": "SELECT 'g-GSTR-3B-' || period AS id, 'GSTR-3B ' || strftime(CAST(period || '-01' AS DATE), '%b %y') AS label, 'gstr' AS \"group\", period, CAST(sum(CASE WHEN type = 'GSTR-1' THEN total_tax ELSE -total_tax END) AS BIGINT) AS amount FROM register GROUP BY period",
    "summary_return_register": "SELECT period, CAST(sum(CASE WHEN type = 'GSTR-1' THEN total_taxable ELSE 0 END) AS BIGINT) AS outward_taxable, CAST(sum(CASE WHEN type = 'GSTR-1' THEN total_tax ELSE 0 END) AS BIGINT) AS outward_tax, CAST(sum(CASE WHEN type = 'GSTR-2B' THEN total_tax ELSE 0 END) AS BIGINT) AS input_tax, CAST(sum(CASE WHEN type = 'GSTR-1' THEN total_tax ELSE -total_tax END) AS BIGINT) AS net_tax FROM register GROUP BY period",
    "graph_capped_nodes": "SELECT * FROM capped",
    "graph_capped_edges": "SELECT * FROM edges WHERE source IN (SELECT id FROM capped) AND target IN (SELECT id FROM capped)",
    "graph_layer_filter": "SELECT * FROM edges WHERE type = 'issued'",
    "graph_stats": "SELECT \"group\", count(*) AS n, count(*) FILTER (flagged) AS flagged FROM nodes GROUP BY 1",
    "node_degree": "SELECT * FROM degree",
    "graph_top_nodes": _TOP_NODES,
    "orphan_einvoices": "SELECT invoice_no, 'IRN-' || ok || '-' || sk AS irn, 'ACT' AS status FROM b1 WHERE has_einvoice AND NOT (in_gstr1 OR in_gstr2b)",
    "vendor_features": "SELECT * FROM features",
    "heuristic_labels": "SELECT vendor_id, CAST(risk > (SELECT quantile_cont(risk, 0.7) FROM heur) AS INTEGER) AS label FROM heur",
    "upsert_last_write_wins": "SELECT gstin AS supplier_gstin, invoice_no, period, CASE WHEN in_gstr2b THEN cgst ELSE cgst_1 END AS cgst, CASE WHEN in_gstr2b THEN sgst ELSE sgst_1 END AS sgst, CASE WHEN in_gstr2b THEN igst ELSE igst_1 END AS igst, CASE WHEN in_gstr2b THEN hsn ELSE hsn_1 END AS hsn, CASE WHEN in_gstr2b THEN 2 ELSE 1 END AS stamp FROM i",
    "quarantine_rows": "SELECT invoice_id AS id, CASE WHEN n = 2 THEN '' ELSE vendor_id END AS \"vendorId\", CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'abc' ELSE CAST(CAST(CAST(taxable AS DECIMAL(18, 0)) / 100 AS DECIMAL(18, 2)) AS VARCHAR) END AS \"taxableAmount\" FROM posted WHERE n <= 2",
    "json_gstr1_roundtrip": "SELECT gstin AS supplier_gstin, count(*) AS n, CAST(sum(taxable) AS BIGINT) AS taxable, CAST(sum(cgst_1 + sgst_1 + igst_1) AS BIGINT) AS tax, min(invoice_date) AS first, max(hsn_1) AS hsn FROM b1 WHERE in_gstr1 GROUP BY 1",
    "json_gstr2b_roundtrip": "SELECT gstin AS supplier_gstin, itc_available, count(*) AS n, CAST(sum(taxable) AS BIGINT) AS taxable, CAST(sum(tax) AS BIGINT) AS tax, min(invoice_date) AS first, max(hsn) AS hsn FROM b1 WHERE in_gstr2b GROUP BY 1, 2",
    "json_einvoice_roundtrip": "SELECT 'IRN-' || ok || '-' || sk AS irn, invoice_no, 'ACT' AS status FROM b1 WHERE has_einvoice",
    "stream_invoice_alerts": "SELECT invoice_id, CASE WHEN presence_status = 'Matched' THEN 'success' WHEN total_tax > 5000000 THEN 'critical' ELSE 'warning' END AS type, CASE WHEN presence_status <> 'Matched' THEN 'Mismatch: ' || invoice_id || ' from ' || vendor_name || ' — ' || presence_status || ' (₹' || format('{:,}', total_tax // 100) || ' tax)' ELSE 'Invoice ' || invoice_id || ' from ' || vendor_name || ' matched' END AS message, CASE WHEN presence_status = 'Matched' THEN '🟢' WHEN total_tax > 5000000 THEN '🔴' ELSE '🟡' END AS icon FROM posted WHERE n > 2",
}



def _pagerank(rounds: int = 10, damping: float = 0.85) -> str:
    ctes = [
        "pn AS MATERIALIZED (SELECT id FROM nodes WHERE \"group\" IN ('vendor', 'invoice', 'gstr'))",
        "pe AS MATERIALIZED (SELECT source, target FROM edges WHERE type IN ('issued', 'reported'))",
        "po AS MATERIALIZED (SELECT source, count(*) AS k FROM pe GROUP BY source)",
        "pc AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM pn)",
        "r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM pn, pc)",
    ]
    for i in range(1, rounds + 1):
        given = f"SELECT target, sum(rank / k) AS got FROM pe JOIN po ON po.source = pe.source JOIN r{i - 1} ON id = pe.source GROUP BY target"
        lost = f"SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT source FROM po)"
        ctes.append(f"r{i} AS MATERIALIZED (SELECT pn.id, CAST({1 - damping!r} AS DOUBLE) / n + CAST({damping} AS DOUBLE) * (coalesce(got, 0) + lost / n) AS rank FROM pn LEFT JOIN ({given}) ON target = pn.id, pc, ({lost}))")
    return BASE + ", " + ", ".join(ctes) + f" SELECT id, floor(rank * 10000000000 + 0.5) / 10000000000 AS rank FROM r{rounds}"


def _communities() -> str:
    ctes = [
        "member AS (SELECT DISTINCT vendor_id, hsn || '|' || period AS g FROM i)",
        "linked AS (SELECT DISTINCT x.vendor_id AS a, y.vendor_id AS b FROM member x JOIN member y ON x.g = y.g)",
        "reach AS (SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a)",
    ]
    return BASE.replace("WITH lines", "WITH RECURSIVE lines") + ", " + ", ".join(ctes) + " SELECT a AS vendor_id, min(b) AS community FROM reach GROUP BY a"


#: Those that don't start from the domain tables.
_ALONE: dict[str, str] = {
    "vendor_threshold_alerts": "WITH r AS (SELECT user_id, event_id, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM events WHERE event_type = 'error'), l AS (SELECT *, coalesce(lag(running) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM r) SELECT user_id, event_id, running FROM l WHERE running > 20000 AND before <= 20000",
    "stream_windowed_kpis": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tax FROM events GROUP BY 1, 2",
    "stream_sliding_kpis": "SELECT CAST(w AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tax FROM (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2",
    "stream_reconcile_outer": "SELECT p.event_id AS purchase_id, p.user_id, q.event_id AS signup_id, CASE WHEN q.event_id IS NULL THEN 'Missing in GSTR-1' ELSE 'Matched' END AS status FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') q ON p.user_id = q.user_id AND q.ts >= p.ts AND q.ts <= p.ts + INTERVAL 1 DAY",
}

_ALONE["stream_deduplicated"], _ALONE["stream_threshold_alerts"] = _ALONE["stream_windowed_kpis"], _ALONE["vendor_threshold_alerts"]

_CAPPED = """, cv AS (SELECT source AS id, 'vendor' AS "group" FROM edges WHERE type = 'issued' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 40),
ci AS (SELECT t.id, 'invoice' AS "group" FROM (SELECT DISTINCT target AS id FROM edges WHERE type = 'issued' AND source IN (SELECT id FROM cv)) t
  LEFT JOIN (SELECT source AS id, count(*) AS n FROM edges WHERE type <> 'issued' GROUP BY 1) o ON o.id = t.id ORDER BY coalesce(n, 0) DESC, t.id LIMIT 80),
cr AS (SELECT target AS id, CASE WHEN type = 'reported' THEN 'gstr' ELSE type END AS "group" FROM edges WHERE type <> 'issued' AND source IN (SELECT id FROM ci)
  GROUP BY 1, 2 ORDER BY count(*) DESC, 1 LIMIT 80),
capped AS (SELECT * FROM cv UNION ALL SELECT * FROM ci UNION ALL SELECT * FROM cr)"""


#: The base after the changes that the incremental queries make, from which all else follows.
_CHANGED = BASE.replace("b1 AS (", "b1_before AS (", 1).replace("\ninv AS (", """
b1_r AS (SELECT *, (ok * 7 + sk) % 40 AS r FROM b1_before),
b1_s AS (SELECT * REPLACE (CASE WHEN r = 0 THEN false WHEN r IN (2, 4) THEN true ELSE in_gstr1 END AS in_gstr1, CASE WHEN r = 1 THEN false WHEN r IN (3, 5) THEN true ELSE in_gstr2b END AS in_gstr2b,
  CASE WHEN r IN (2, 4) THEN cgst ELSE cgst_1 END AS cgst_1, CASE WHEN r IN (2, 4) THEN sgst ELSE sgst_1 END AS sgst_1, CASE WHEN r IN (2, 4) THEN igst ELSE igst_1 END AS igst_1,
  CASE WHEN r IN (2, 4) THEN hsn ELSE hsn_1 END AS hsn_1, CASE WHEN r = 5 THEN CAST(1000 + (mpk + 1) % 9000 AS VARCHAR) ELSE hsn END AS hsn) FROM b1_r),
b1 AS (SELECT * REPLACE (CASE WHEN in_gstr2b THEN tax ELSE cgst_1 + sgst_1 + igst_1 END AS tax, CASE WHEN in_gstr2b THEN cgst ELSE cgst_1 END AS cgst, CASE WHEN in_gstr2b THEN sgst ELSE sgst_1 END AS sgst) FROM b1_s),
inv AS (""", 1)


def _clusters(select: str, rounds: int = 6) -> str:
    """Label propagation, a few tables a round; the groups' word to a vendor is the commonest label of its others."""
    sql = BASE + """, cm0 AS MATERIALIZED (SELECT DISTINCT vendor_id, hsn || '|' || period AS g FROM i),
cm AS MATERIALIZED (SELECT vendor_id, g, CAST(greatest(1, 1000 // (n - 1)) AS HUGEINT) AS w FROM cm0 JOIN (SELECT g, count(*) AS n FROM cm0 GROUP BY g HAVING count(*) > 1) s USING (g)),
ck AS MATERIALIZED (SELECT vendor_id, CAST(sum(w) AS HUGEINT) AS k FROM cm GROUP BY 1),
lab0 AS MATERIALIZED (SELECT vendor_id, vendor_id AS label FROM ck)"""
    for r in range(rounds):
        sql += f""",
heard{r} AS MATERIALIZED (
  SELECT vendor_id, other AS label, w FROM (
    SELECT m.vendor_id, m.g, m.w, l2.label AS other, row_number() OVER (PARTITION BY m.vendor_id, m.g ORDER BY count(*) DESC, l2.label) AS place
    FROM cm m JOIN cm m2 ON m2.g = m.g AND m2.vendor_id <> m.vendor_id JOIN lab{r} l2 ON l2.vendor_id = m2.vendor_id
    GROUP BY m.vendor_id, m.g, m.w, l2.label) WHERE place = 1),
size{r} AS MATERIALIZED (SELECT label, sum(k) AS size FROM lab{r} JOIN ck USING (vendor_id) GROUP BY 1),
score{r} AS MATERIALIZED (
  SELECT c.vendor_id, c.label, own.label AS was,
         c.s * (SELECT sum(k) FROM ck) - ck.k * (size - CASE WHEN c.label = own.label THEN ck.k ELSE 0 END) AS score
  FROM (SELECT vendor_id, label, sum(w) AS s FROM (SELECT * FROM heard{r} UNION ALL SELECT vendor_id, label, 0 FROM lab{r}) GROUP BY 1, 2) c
  JOIN lab{r} own ON own.vendor_id = c.vendor_id JOIN ck ON ck.vendor_id = c.vendor_id JOIN size{r} z ON z.label = c.label),
lab{r + 1} AS MATERIALIZED (
  SELECT vendor_id, CASE WHEN (md5(vendor_id) < '8') = ({r} % 2 = 1) THEN label ELSE was END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY score DESC, label) AS place FROM score{r}) WHERE place = 1)"""
    sql += f""",
clusters AS MATERIALIZED (
  SELECT v.vendor_id, coalesce(community, v.vendor_id) AS community FROM (SELECT DISTINCT vendor_id FROM i) v
  LEFT JOIN (SELECT vendor_id, min(vendor_id) OVER (PARTITION BY label) AS community FROM lab{rounds}) l ON l.vendor_id = v.vendor_id)"""
    return sql + select


def _hops(k: int = 3, hub: int = 1000) -> str:
    sql = f""", both_ends AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
wide AS MATERIALIZED (SELECT id FROM degree WHERE degree > {hub}),
hop0 AS MATERIALIZED (SELECT 'i-' || invoice_id AS seed, 'i-' || invoice_id AS id, 'i-' || invoice_id AS path, 0 AS hop FROM (SELECT * FROM i WHERE bad ORDER BY total_tax DESC, invoice_id LIMIT 20))"""
    for h in range(1, k + 1):
        closed = "" if h == 1 else "WHERE p.id NOT IN (SELECT id FROM wide)"
        sql += f""",
hop{h} AS MATERIALIZED (SELECT * FROM hop{h - 1} UNION ALL
  SELECT seed, b AS id, min(path || '>' || b) AS path, {h} AS hop FROM (SELECT p.*, b FROM (SELECT * FROM hop{h - 1} WHERE hop = {h - 1}) p JOIN both_ends ON a = p.id {closed}) n
  WHERE NOT EXISTS (SELECT 1 FROM hop{h - 1} o WHERE o.seed = n.seed AND o.id = n.b) GROUP BY 1, 2)"""
    return sql + f" SELECT seed, id, hop, path FROM hop{k}"


_SELECTS["evidence_paths"] = _hops()
_SELECTS["short_ids"] = f"SELECT new_id, replace(new_id, 'INV-2025-', 'INV-') AS label FROM ({_SELECTS['sequential_ids']})"
# Other ways to the same rows.
for _new, _old in (("indexed_search", "reconciliation_search"), ("indexed_audit_search", "audit_search"), ("json_gstr1_ranges", "json_gstr1_roundtrip"), ("json_gstr2b_ranges", "json_gstr2b_roundtrip"), ("json_einvoice_ranges", "json_einvoice_roundtrip")):
    _SELECTS[_new] = _SELECTS[_old]

ORACLES = {**{k: BASE + (_CAPPED if "_capped_" in k else "") + s for k, s in _SELECTS.items()}, **_ALONE, "pagerank": _pagerank(), "communities": _communities(),
    "incremental_status_figures": _CHANGED + " SELECT period, match_status, count(*) AS n, CAST(sum(total_tax) AS BIGINT) AS tax FROM i GROUP BY 1, 2",
    "incremental_vendor_scores": _CHANGED + " " + _SELECTS["vendors_view"],
    "vendor_clusters": _clusters(" SELECT * FROM clusters"),
    "cluster_profile": _clusters(" SELECT community, count(DISTINCT vendor_id) AS vendors, count(*) AS invoices, CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) AS mismatch_share, CAST(sum(CASE WHEN bad THEN total_tax ELSE 0 END) AS BIGINT) AS at_risk_tax FROM clusters JOIN i USING (vendor_id) GROUP BY 1"),
}
