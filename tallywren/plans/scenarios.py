"""Five scenarios over an evaluated run: each a list of checks ``(name, value, ok)`` and whether it passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import LedgerError

# The scenarios' names.
NAMES = ("clean-batch", "fee-mismatch", "many-to-one-exception", "missing-counterpart", "baseline-vs-ai")


def _shape(metrics: dict, name: str) -> dict:
    empty = {"truth_pairs": 0, "true_pairs": 0, "false_pairs": 0, "exception_pairs": 0, "missed_pairs": 0, "recall": 0.0}
    return next((s for s in metrics["per_shape"] if s["shape"] == name), empty)


def clean_batch(service) -> list[tuple]:
    s = _shape(service.evaluate(service.run(baseline=False)[0].run_id, False), "clean")
    return [("pairs of the shape", s["truth_pairs"], s["truth_pairs"] > 0), ("recall", s["recall"], s["recall"] >= 0.99), ("false pairs", s["false_pairs"], s["false_pairs"] == 0)]


def fee_mismatch(service) -> list[tuple]:
    both = service.evaluate(service.run(baseline=False)[0].run_id)
    s, b = _shape(both["system"], "fee-deducted"), _shape(both["baseline"], "fee-deducted")
    return [("pairs of the shape", s["truth_pairs"], s["truth_pairs"] > 0), ("recall against the exact join's", (s["recall"], b["recall"]), s["recall"] > b["recall"]), ("false pairs", s["false_pairs"], s["false_pairs"] == 0)]


def many_to_one(service) -> list[tuple]:
    run = service.run(baseline=False)[0]
    s, several = _shape(service.evaluate(run.run_id, False), "many-to-one"), run.exceptions.where(F.size("recommended_ids") > 1).count()
    return [
        ("pairs of the shape", s["truth_pairs"], s["truth_pairs"] > 0), ("false pairs", s["false_pairs"], s["false_pairs"] == 0), ("pairs put to a person", s["exception_pairs"], s["exception_pairs"] > 0),
        ("pairs lost", s["missed_pairs"], s["missed_pairs"] == 0), ("exceptions with several candidates", several, several > 0),
    ]


def missing_counterpart(service) -> list[tuple]:
    rows = service.run(baseline=False)[0].exceptions.where("kind = 'MISSING_COUNTERPART'")
    n, minor = rows.agg(F.count("*"), F.coalesce(F.sum("amount_at_risk_minor"), F.lit(0))).first()
    return [("records without a counterpart", n, n > 0), ("their money, in minor units", minor, True)]


def baseline_vs_system(service) -> list[tuple]:
    both = service.evaluate(service.run(baseline=False)[0].run_id)
    s, b = both["system"], both["baseline"]
    return [
        ("recall", (b["recall"], s["recall"]), s["recall"] > b["recall"]), ("precision", (b["precision"], s["precision"]), s["precision"] >= b["precision"] - 0.02),
        ("false pairs", (b["false_pairs"], s["false_pairs"]), s["false_pairs"] <= b["false_pairs"]), ("unresolved", (b["unresolved_count"], s["unresolved_count"]), s["unresolved_count"] <= b["unresolved_count"]),
        ("where the baseline is better", both["regressions"], True),
    ]


STEPS = dict(zip(NAMES, (clean_batch, fee_mismatch, many_to_one, missing_counterpart, baseline_vs_system)))


def play(service, name: str) -> dict:
    """Runs one scenario on the service's latest run that is no baseline."""
    if name not in STEPS:
        raise LedgerError("VALIDATION_FAILED", f"scenario must be one of {', '.join(NAMES)}")
    steps = STEPS[name](service)
    return {"scenario": name, "steps": [{"step": s, "outcome": v, "ok": ok} for s, v, ok in steps], "passed": all(ok for *_, ok in steps)}
