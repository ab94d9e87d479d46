"""Record schema, source kinds and thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import types as T

from .errors import LedgerError

KINDS = ("PG_PAYMENT", "ORDER", "SETTLEMENT", "BANK_STATEMENT", "INVOICE")
SHAPES = ("clean", "fee-deducted", "split-settlement", "timing-lag", "reference-typo", "missing-counterpart", "duplicate", "many-to-one")
STRATEGIES = ("baseline-exact", "fuzzy", "fuzzy+adjudicator")

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("ord", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("reference", T.StringType()),
        T.StructField("amount_minor", T.LongType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("fee_minor", T.LongType(), False),
        T.StructField("tax_minor", T.LongType(), False),
        T.StructField("counterparty", T.StringType()),
        T.StructField("occurred_at", T.TimestampType(), False),
        T.StructField("value_date", T.TimestampType(), False),
        T.StructField("truth_group_id", T.StringType()),
        T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Records as a service keeps them: normalised and marked.
STORED = T.StructType([*(T.StructField(f.name, f.dataType) for f in RECORD), *(T.StructField(c, T.StringType()) for c in ("norm_ref", "norm_cp", "duplicate_of_id"))])

# Bounds of the thresholds a caller may set.
BOUNDS = {"resolve": (0, 1), "floor": (0, 1), "ambiguity_margin": (0, 1), "date_window_days": (0, 90), "fee_tolerance": (0, 0.5), "rounding_slack_minor": (0, 100_000)}


@dataclass(frozen=True)
class Thresholds:
    resolve: float = 0.82
    floor: float = 0.45
    ambiguity_margin: float = 0.08
    date_window_days: float = 12.0
    fee_tolerance: float = 0.035
    rounding_slack_minor: float = 200.0

    def override(self, **changes) -> Thresholds:
        """A copy with some thresholds changed, within the bounds."""
        known = {f.name for f in fields(self)}
        for name, value in changes.items():
            if name not in known:
                raise LedgerError("VALIDATION_FAILED", f"unknown threshold {name}")
            low, high = BOUNDS[name]
            if not low <= value <= high:
                raise LedgerError("VALIDATION_FAILED", f"{name} must lie in [{low}, {high}]")
        return replace(self, **{k: float(v) for k, v in changes.items()})

    def as_map(self) -> dict[str, float]:
        return asdict(self)


@dataclass(frozen=True)
class MatchOptions:
    """Knobs beside the thresholds; the defaults follow the documented behaviour."""

    block_cap: int = 60
    amount_bucket_reach: int = 1
    adjudicator_may_resolve: bool = True
