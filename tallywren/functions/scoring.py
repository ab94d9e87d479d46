"""Pair features and totals. Columns of the left record end in ``_l``, of the right in ``_r``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Thresholds
from .money import fixed
from .normalize import cp_similarity, ref_similarity

# Feature weights.
WEIGHTS = {"reference": 0.44, "amount": 0.31, "date": 0.11, "counterparty": 0.14}
FEATURES = ("reference", "amount", "date", "counterparty", "cross_source")


def amount_feature(t: Thresholds) -> Column:
    """1 for equal amounts, 0.92 within an explainable fee, falling to 0 at three times that."""
    gap = F.abs(F.col("amount_minor_l") - F.col("amount_minor_r")).cast("double")
    gross = F.greatest("amount_minor_l", "amount_minor_r").cast("double")
    declared = F.greatest(F.col("fee_minor_l") + F.col("tax_minor_l"), F.col("fee_minor_r") + F.col("tax_minor_r")).cast("double")
    fee = F.greatest(declared, gross * t.fee_tolerance) + t.rounding_slack_minor
    return F.when(gap == 0, F.lit(1.0)).when(gap <= fee, F.lit(0.92)).when(gap <= fee * 3, F.lit(0.92) * (1 - (gap - fee) / (fee * 2))).otherwise(F.lit(0.0))


def days_apart() -> Column:
    return F.abs(F.unix_micros("value_date_l") - F.unix_micros("value_date_r")) / 8.64e10


def date_feature(t: Thresholds) -> Column:
    days = days_apart()
    if not t.date_window_days:
        return F.when(days == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(days <= t.date_window_days, 1 - (days / t.date_window_days) * 0.6).otherwise(F.lit(0.0))


def features(t: Thresholds) -> Column:
    return F.struct(
        ref_similarity("norm_ref_l", "norm_ref_r").alias("reference"),
        amount_feature(t).alias("amount"),
        date_feature(t).alias("date"),
        cp_similarity("norm_cp_l", "norm_cp_r").alias("counterparty"),
        F.when(F.col("kind_l") == F.col("kind_r"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("cross_source"),
    )


def total(f: str = "features") -> Column:
    """The weighted sum to four places; gates are part of the pair join."""
    parts = [F.col(f"{f}.{name}") * w for name, w in WEIGHTS.items()]
    return F.round(parts[0] + parts[1] + parts[2] + parts[3], 4)


def gated(score: Column) -> Column:
    """The score of any two records, zero for one source or two currencies."""
    return F.when((F.col("kind_l") == F.col("kind_r")) | (F.col("currency_l") != F.col("currency_r")), F.lit(0.0)).otherwise(score)


def explain(f: str = "features") -> Column:
    """One sentence of four findings."""
    ref, amt, date, cp = (F.col(f"{f}.{n}") for n in ("reference", "amount", "date", "counterparty"))
    two = lambda text, c: F.concat(F.lit(text + " ("), fixed(c, 2), F.lit(")"))
    return F.concat(
        F.concat_ws(
            "; ",
            F.when(ref == 1, "reference identical").when(ref > 0.7, two("reference similar", ref)).when(ref > 0, two("reference weak", ref)).otherwise("no usable reference"),
            F.when(amt == 1, "amount exact").when(amt > 0.85, "amount differs by an explainable fee").when(amt > 0, two("amount differs beyond the fee tolerance", amt)).otherwise("amount unexplainable"),
            F.when(date > 0.8, "same-day or next-day").when(date > 0, "within the lag window").otherwise("outside the date window"),
            F.when(cp == 1, "same counterparty").when(cp > 0.5, "counterparty similar").otherwise("counterparty differs"),
        ),
        F.lit("."),
    )
