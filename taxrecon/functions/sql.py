"""The scoring rules as SQL functions of a session, for queries that are written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The same weights and limits as in scoring.py, amounts in paise.
FUNCTIONS = {
    "predict_risk(missed DOUBLE, late DOUBLE, transactions BIGINT) RETURNS DOUBLE": """
        least(greatest(
          least(coalesce(missed, 0D) / 6D, 1D) * 0.28D + least(coalesce(late, 0D) / 20D, 1D) * 0.22D
          + CASE WHEN coalesce(transactions, 100L) < 50 THEN 0.8D WHEN coalesce(transactions, 100L) < 100 THEN 0.4D ELSE 0.1D END * 0.12D
          + CASE WHEN coalesce(missed, 0D) > 2 THEN 0.7D ELSE 0.2D END * 0.12D + 0.3D * 0.08D, 0.05D), 0.95D)""",
    "classify_risk(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 0.6D THEN 'High Risk' WHEN score >= 0.3D THEN 'Review' ELSE 'Compliant' END",
    "probability_label(p DOUBLE) RETURNS STRING": "CASE WHEN p < 0.3D THEN 'Low' WHEN p < 0.6D THEN 'Medium' ELSE 'High' END",
    "classify_mismatch(tax BIGINT, past BIGINT) RETURNS STRING": """
        CASE WHEN tax > 10000000 THEN 'High Risk' WHEN coalesce(past, 0) > 5 THEN 'High Risk'
             WHEN tax > 5000000 THEN 'Medium Risk' WHEN coalesce(past, 0) > 2 THEN 'Medium Risk' ELSE 'Low Risk' END""",
    "presence_status(in_gstr1 BOOLEAN, in_gstr2b BOOLEAN) RETURNS STRING": """
        CASE WHEN NOT coalesce(in_gstr1, true) AND coalesce(in_gstr2b, true) THEN 'Missing in GSTR-1'
             WHEN coalesce(in_gstr1, true) AND NOT coalesce(in_gstr2b, true) THEN 'Missing in GSTR-2B' ELSE 'Matched' END""",
    "invoice_risk_level(status STRING, tax BIGINT) RETURNS STRING": "CASE WHEN status <=> 'Matched' THEN 'Low' WHEN tax > 5000000 THEN 'High' ELSE 'Medium' END",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL. They are inlined into the plan, so nothing leaves the JVM."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
