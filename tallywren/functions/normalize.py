"""Normalisation and similarity as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channels, banks and company words of the ledgers, and glyphs that are read alike.
CHANNELS = ("NEFT", "IMPS", "UPI", "RTGS", "ACH", "CHQ", "TRF", "MPS")
BANKS = ("HDFC", "ICICI", "AXIS", "KOTAK", "SBI", "YESB")
COMPANY_WORDS = (
    "PVT", "PRIVATE", "LTD", "LIMITED", "LLP", "INC", "CORP", "CO", "COMPANY", "SERVICES", "SOLUTIONS", "RETAIL", "MEDIA", "E-?RETAIL", "ROASTERS", "BEVERAGES", "TECHNOLOGIES",
)
LOOKALIKES = ("OQDILSBZG", "000115826")

CHANNEL_RE = rf"^({'|'.join(CHANNELS)})[\s/:-]+"
BANK_RE = rf"[\s/-]+({'|'.join(BANKS)})[A-Z0-9]*$"
COMPANY_RE = rf"\b({'|'.join(COMPANY_WORDS)})\b"
EDGES_RE = r"^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_reference(reference) -> Column:
    """Upper case, one channel prefix and one bank suffix off, letters and digits only,
    look-alike glyphs folded; null if nothing is left."""
    v = F.upper(F.regexp_replace(_col(reference), EDGES_RE, ""))
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, CHANNEL_RE, ""), BANK_RE, ""), "[^A-Z0-9]", "")
    return F.translate(F.nullif(v, F.lit("")), *LOOKALIKES)


def norm_counterparty(name) -> Column:
    """Upper case, punctuation to blanks, company words out, single blanks; null if nothing is left."""
    v = F.regexp_replace(F.upper(F.regexp_replace(_col(name), EDGES_RE, "")), r"[^A-Z0-9\s]", " ")
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, COMPANY_RE, " "), r"\s+", " "), EDGES_RE, "")
    return F.nullif(v, F.lit(""))


def digit_only_differences(a, b) -> Column:
    """Places at which two strings of one length differ, or -1 if a letter differs at some place."""
    a, b = _col(a), _col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).when(x.rlike("[0-9]") & y.rlike("[0-9]"), 1).otherwise(1000))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(total >= 1000, -1).otherwise(total)


def ref_similarity(a, b) -> Column:
    """0 to 1. Serial numbers that differ in one to three digits are different numbers and score
    at most 0.3; containment counts as truncation; else edit distance over the longer length."""
    a, b = _col(a), _col(b)
    la, lb = F.length(a), F.length(b)
    longer, shorter = F.greatest(la, lb).cast("double"), F.least(la, lb).cast("double")
    serial = digit_only_differences(a, b)
    return (
        F.when(a.isNull() | b.isNull() | (la == 0) | (lb == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(shorter < 4, F.lit(0.0))
        .when((la == lb) & serial.between(1, 3), F.lit(0.3) * (1 - serial / (la + 1)))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.9) * (shorter / longer) + 0.1)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longer))
    )


def cp_similarity(a, b) -> Column:
    """Jaccard similarity of the blank-separated tokens."""
    a, b = _col(a), _col(b)
    x, y = F.split(a, " "), F.split(b, " ")
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def slug(text) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 56)


def shape_of(group_id) -> Column:
    """The defect shape that a truth group's id names."""
    return F.regexp_replace(F.regexp_replace(_col(group_id), "^grp_", ""), r"-\d+$", "")


def kind_label(kind):
    """A source kind as words: ``bank statement``."""
    return F.replace(F.lower(F.col(kind) if isinstance(kind, str) else kind), F.lit("_"), F.lit(" "))
