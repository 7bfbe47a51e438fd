"""Text, number and date formats as Column functions. Amounts are paise (bigint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE_SIGN = "₹"


def _tenths(paise: Column, unit: int, suffix: str) -> Column:
    """paise in units of so many rupees, one decimal, half up."""
    t = F.floor((paise + unit * 5) / F.lit(unit * 10)).cast("bigint")
    return F.concat(F.lit(RUPEE_SIGN), F.floor(t / 10).cast("bigint").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(suffix))


def rupees(paise: Column) -> Column:
    """Whole rupees, half up."""
    return F.floor((paise + 50) / F.lit(100)).cast("bigint")


def inr_compact(paise: Column, thousands: bool = True) -> Column:
    """Crore from 1e7 rupees, lakh from 1e5, K from 1e3 (or grouped rupees without thousands)."""
    small = F.concat(F.lit(RUPEE_SIGN), rupees(paise).cast("string")) if thousands else F.concat(F.lit(RUPEE_SIGN), inr_grouped(paise))
    out = F.when(paise >= 10**9, _tenths(paise, 10**7, " Cr")).when(paise >= 10**7, _tenths(paise, 10**5, " L"))
    return (out.when(paise >= 10**5, _tenths(paise, 10**3, "K")) if thousands else out).otherwise(small)


def inr_grouped(paise: Column) -> Column:
    """Rupees with lakh grouping: 4,50,000."""
    return F.regexp_replace(rupees(paise).cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def western(paise: Column, truncate: bool = False) -> Column:
    """Rupees with groups of three digits."""
    whole = F.floor(paise / F.lit(100)).cast("bigint") if truncate else rupees(paise)
    return F.format_number(whole, 0)


def period_label(period: Column) -> Column:
    return F.date_format(F.to_date(F.concat(period, F.lit("-01"))), "MMM yy")


def shortened(name: Column, most: int = 14) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 1), F.lit("…"))).otherwise(name)


def short_id(invoice_id: Column) -> Column:
    """Invoice id without its year."""
    return F.replace(invoice_id, F.lit("INV-2025-"), F.lit("INV-"))


def contains_fold(text: Column, term: str) -> Column:
    return F.lower(text).contains(term.lower())


def any_contains(items: Column, term: str) -> Column:
    return F.exists(items, lambda x: x.contains(term))


def parse_date(text: Column) -> Column:
    """ISO or portal dates (dd-mm-yyyy); null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("dd-MM-yyyy"))).cast("date")


def period_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def due_date(date: Column) -> Column:
    """The 11th of the month after date's."""
    return F.date_add(F.add_months(F.trunc(date, "MM"), 1), 10)


def days_late(filed: Column, due: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(filed, due)).cast("bigint")
