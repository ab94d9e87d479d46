"""Money in minor units as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """``x`` (not negative) to one or two decimal places by its exact binary value, halves upwards.

    ``format_string`` would round the shortest decimal that reads back as ``x`` instead, so that
    1.035, which is stored as a little less, became 1.04. Only odd quarters and eighths are true halves.
    """
    half = F.pmod(x * (4 if places == 1 else 8), F.lit(2.0)) == 1
    return F.replace(F.format_number(F.when(half, x + 1e-9).otherwise(x), places), F.lit(","), F.lit(""))


def inr(minor) -> Column:
    """Rupees with lakh grouping and two places of paise."""
    c = F.col(minor) if isinstance(minor, str) else minor
    whole = F.floor(F.abs(c) / 100).cast("string")
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))


def inr_compact(minor) -> Column:
    """Rupees as crores, lakhs or thousands."""
    c = F.col(minor) if isinstance(minor, str) else minor
    whole = F.floor(F.abs(c) / 100)
    body = (
        F.when(whole >= 10_000_000, F.concat(fixed(whole / 10_000_000, 2), F.lit(" Cr")))
        .when(whole >= 100_000, F.concat(fixed(whole / 100_000, 2), F.lit(" L")))
        .when(whole >= 1_000, F.concat(fixed(whole / 1_000, 1), F.lit("k")))
        .otherwise(whole.cast("string"))
    )
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), body)
