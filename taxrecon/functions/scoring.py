"""Scoring and status rules as Column functions. Amounts are paise (bigint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE = 100
# The status name here, and the weights, limits and names in the functions below, must equal the
# application's own.
MATCHED = "Matched"


def predict_risk(missed: Column, late: Column, transactions: Column) -> Column:
    """Vendor risk 0.05 to 0.95 from missed filings, average days late and transactions (null: 100)."""
    missed, late, tx = F.coalesce(missed, F.lit(0)).cast("double"), F.coalesce(late, F.lit(0)).cast("double"), F.coalesce(transactions, F.lit(100))
    size = F.when(tx < 50, F.lit(0.8)).when(tx < 100, F.lit(0.4)).otherwise(F.lit(0.1))
    einvoice = F.when(missed > 2, F.lit(0.7)).otherwise(F.lit(0.2))
    score = F.least(missed / F.lit(6.0), F.lit(1.0)) * F.lit(0.28) + F.least(late / F.lit(20.0), F.lit(1.0)) * F.lit(0.22) + size * F.lit(0.12) + einvoice * F.lit(0.12) + F.lit(0.3 * 0.08)
    return F.least(F.greatest(score, F.lit(0.05)), F.lit(0.95))


def classify_risk(score: Column) -> Column:
    return F.when(score >= 0.6, "High Risk").when(score >= 0.3, "Review").otherwise("Compliant")


def probability_label(p: Column) -> Column:
    return F.when(p < 0.3, "Low").when(p < 0.6, "Medium").otherwise("High")


def risk_band(score: Column) -> Column:
    """Display band; its limits are exclusive, unlike those of classify_risk."""
    return F.when(score > 0.6, "high").when(score > 0.3, "medium").otherwise("low")


def prediction_text(score: Column) -> Column:
    return F.when(score > 0.6, "Likely non-compliant").when(score > 0.3, "Needs monitoring").otherwise("Expected compliant")


def trend(score: Column) -> Column:
    return F.when(score > 0.5, "up").when(score > 0.25, "flat").otherwise("down")


def classify_mismatch(tax: Column, past: Column) -> Column:
    """Severity by tax (paise) and the vendor's earlier mismatches, in this order."""
    past = F.coalesce(past, F.lit(0))
    return F.when(tax > 100_000 * RUPEE, "High Risk").when(past > 5, "High Risk").when(tax > 50_000 * RUPEE, "Medium Risk").when(past > 2, "Medium Risk").otherwise("Low Risk")


def presence_status(in_gstr1: Column, in_gstr2b: Column) -> Column:
    """Flags alone; a missing flag counts as reported, and neither reported is Matched."""
    a, b = F.coalesce(in_gstr1, F.lit(True)), F.coalesce(in_gstr2b, F.lit(True))
    return F.when(~a & b, "Missing in GSTR-1").when(a & ~b, "Missing in GSTR-2B").otherwise(MATCHED)


def invoice_risk_level(status: Column, tax: Column) -> Column:
    return F.when(status.eqNullSafe(F.lit(MATCHED)), "Low").when(tax > 50_000 * RUPEE, "High").otherwise("Medium")


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal; 0 where whole is 0."""
    return F.when(whole > 0, F.floor(part.cast("double") * F.lit(1000.0) / whole + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


def radar(missed: Column, late: Column, transactions: Column, score: Column) -> dict[str, Column]:
    """Six 0 to 100 dimensions of a vendor's profile."""
    return {
        "filing_regularity": F.when(missed == 0, F.lit(95.0)).otherwise(F.greatest(F.lit(30.0), F.lit(90.0) - missed * F.lit(15.0))),
        "tax_accuracy": F.lit(100.0) - score * F.lit(60.0),
        "einvoice_compliance": F.when(score < 0.3, F.lit(92.0)).when(score < 0.6, F.lit(65.0)).otherwise(F.lit(35.0)),
        "itc_match_rate": F.lit(100.0) - score * F.lit(50.0),
        "response_time": F.when(late == 0, F.lit(98.0)).otherwise(F.greatest(F.lit(20.0), F.lit(95.0) - late * F.lit(5.0))),
        "volume": F.least(F.lit(100.0), transactions / F.lit(5.0)),
    }


def contributions(missed: Column, late: Column, transactions: Column) -> Column:
    """The three inputs of the score with their weights, to be exploded."""
    rows = (("Missed Filings", missed, 0.28), ("Avg Days Late", late, 0.22), ("Transactions", transactions, 0.12))
    return F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"), F.lit(w).alias("weight")) for n, v, w in rows))
