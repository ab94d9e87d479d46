"""Scored pairs, symmetric ranking, and the rules-based adjudicator."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import LedgerError
from ..functions import scoring
from ..schema import MatchOptions, Thresholds

# The adjudicator's fee rates, tax, settlement cycles and limit.
FEE_RATES = (0.018, 0.02, 0.0236, 0.025)
GST = 0.18
FEE_SLACK = 200
CYCLE_DAYS = (1, 2, 3, 7)
LIMIT = 0.12

SUBJECT = ("id", "ord", "kind", "amount_minor", "fee_minor", "tax_minor", "norm_ref", "value_date")
# Of these, what ranks and decisions need once a pair has its score and the rules' opinion.
DECIDING = ("id", "ord", "kind", "amount_minor", "fee_minor", "tax_minor")


def score_pairs(pairs: DataFrame, t: Thresholds, baseline: bool = False) -> DataFrame:
    """Adds ``features``, ``score`` and the rules' ``opinion`` to pairs that carry both records; zero scores go."""
    scored = pairs.withColumn("features", scoring.features(t)).withColumn("opinion", adjustment())
    if baseline:
        exact = (F.col("norm_ref_l") == F.col("norm_ref_r")) & (F.col("amount_minor_l") == F.col("amount_minor_r"))
        return scored.withColumn("score", F.when(exact, F.lit(1.0)).otherwise(F.lit(0.0))).where("score > 0")
    return scored.withColumn("score", scoring.total()).where("score > 0")


def both_ways(scored: DataFrame) -> DataFrame:
    """Each pair once from either side: columns ``s_*`` of the subject, ``c_*`` of the candidate."""

    def view(a: str, b: str) -> DataFrame:
        here = [c for c in SUBJECT if f"{c}_{a}" in scored.columns]
        return scored.select(*(F.col(f"{c}_{a}").alias(f"s_{c}") for c in here), *(F.col(f"{c}_{b}").alias(f"c_{c}") for c in here), "score", "features", "opinion")

    return view("l", "r").union(view("r", "l"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Each subject's candidates by falling score; a pair that several blocks gave stands beside itself and counts once."""
    order = W.partitionBy("s_id").orderBy(F.desc("score"), "c_ord")
    once = candidates.withColumn("before", F.lag("c_ord").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("c_ord"))).drop("before")
    return once.withColumn("rank", F.row_number().over(order))


def adjustment() -> Column:
    """The rules' opinion on a pair, the same from either side, before the limit; it counts for a subject's best candidate."""
    gross = F.greatest("amount_minor_l", "amount_minor_r").cast("double")
    gap = F.abs(F.col("amount_minor_l") - F.col("amount_minor_r"))
    fee = reduce(or_, (F.abs(F.floor(gross * r * (1 + GST) + 0.5) - gap) <= FEE_SLACK for r in FEE_RATES))
    days = F.floor(F.abs(F.unix_micros("value_date_l") - F.unix_micros("value_date_r")) / 8.64e10 + 0.5)
    a, b = F.col("norm_ref_l"), F.col("norm_ref_r")
    parts = (
        F.when(fee & (gap > 0), 0.09).when((gap > 0) & (F.col("features.amount") < 0.5), -0.06).otherwise(0.0),
        F.when(days.isin(*CYCLE_DAYS), 0.04).when(days > 10, -0.05).otherwise(0.0),
        F.when(a.isNotNull() & b.isNotNull() & (a != b) & (a.startswith(b) | b.startswith(a)), 0.07).otherwise(0.0),
        F.when((F.col("features.reference") < 0.3) & (F.col("features.counterparty") >= 0.99), -0.08).otherwise(0.0),
    )
    return F.round(parts[0] + parts[1] + parts[2] + parts[3], 4)


def limited(c: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c))


def rules_adjudicator(best: DataFrame) -> DataFrame:
    """The default adjudicator: from subjects' best candidates to ``s_id, c_id, adjustment``."""
    return best.where("rank = 1").select("s_id", "c_id", F.col("opinion").alias("adjustment"))


Adjudicator = Callable[[DataFrame], DataFrame]
OFFERED = ("kind", "norm_ref", "amount_minor", "fee_minor", "value_date")


def question(subject: dict, offered: list[dict]) -> str:
    """What a model is asked: only what the scorer sees, never the held-out truth."""
    line = lambda r: " ".join(f"{k}={r[k]}" for k in ("id", *OFFERED))
    return "\n".join([
        "One ledger record and its best candidates of other ledgers. Which candidate, if any, is the same event?", f"record: {line(subject)}", *(f"candidate {i}: {line(c)} score={c['score']:.3f}" for i, c in enumerate(offered, 1)),
        f'Answer in JSON: {{"chosen": candidate id or null, "adjustment": number of at most {LIMIT} either way, "rationale": text}}. Choose null where candidates cannot be told apart.',
    ])


def checked_answer(text: str, offered: set[str]) -> tuple[str | None, float]:
    """``(chosen id, adjustment)`` of a valid answer; anything else is an error."""
    try:
        answer = json.loads(text[text.index("{") : text.rindex("}") + 1])
        chosen, moved = answer["chosen"], answer["adjustment"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise LedgerError("ADJUDICATOR_MALFORMED_OUTPUT", f"the answer cannot be read: {e}") from e
    if isinstance(moved, bool) or not isinstance(moved, (int, float)) or not math.isfinite(moved) or not isinstance(answer.get("rationale"), str):
        raise LedgerError("ADJUDICATOR_MALFORMED_OUTPUT", "the answer has no finite adjustment or no rationale")
    if chosen is not None and chosen not in offered:
        raise LedgerError("ADJUDICATOR_MALFORMED_OUTPUT", "the answer names a record that was not offered")
    return chosen, float(moved)


def model_adjudicator(ask: Callable[[str], str], timeout: float = 6.0) -> Adjudicator:
    """An adjudicator that puts each subject's best four candidates to ``ask``, a function from question to answer, on the
    executors. An answer that is late, fails or is invalid falls back to the rules and says so in ``fell_back``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                offered = sorted(row["offered"], key=lambda c: c["rank"])
                # One thread for each question: a late one must not hold up the next.
                pool = ThreadPoolExecutor(1)
                try:
                    text = pool.submit(ask, question(row["subject"], offered)).result(timeout)
                    chosen, moved = checked_answer(text, {c["id"] for c in offered})
                    out.append((row["s_id"], chosen or offered[0]["id"], moved if chosen else 0.0, False))
                except Exception:  # whatever a model does, the run goes on
                    out.append((row["s_id"], offered[0]["id"], row["rules"], True))
                finally:
                    pool.shutdown(wait=False, cancel_futures=True)
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.bool_()))], ["s_id", "c_id", "adjustment", "fell_back"])

    def adjudicate(best: DataFrame) -> DataFrame:
        view = lambda side, *more: F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("id", *OFFERED)), *more)
        rows = best.withColumn("rules", F.when(F.col("rank") == 1, limited(F.col("opinion")))).groupBy("s_id").agg(
            F.first(view("s")).alias("subject"), F.collect_list(view("c", "rank", "score")).alias("offered"), F.max("rules").alias("rules")
        )
        return rows.mapInArrow(run, "s_id string, c_id string, adjustment double, fell_back boolean")

    return adjudicate


def adjudicated(ranks: DataFrame, t: Thresholds, options: MatchOptions = MatchOptions(), adjudicator: Adjudicator | None = None) -> DataFrame:
    """Subjects whose best score lies between floor and resolve are put to the adjudicator, which
    sees their best four candidates and may move one score by up to ``LIMIT``; ranks are taken anew.
    Adds ``adjudicated`` and ``applied``.

    The rules' opinion is a column expression, so that path needs no join; another adjudicator's
    answers are joined, and an answer that names no offered candidate changes nothing.
    """
    in_band = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(W.partitionBy("s_id"))
    rows = ranks.withColumn("best", in_band).withColumn("adjudicated", (F.col("best") >= t.floor) & (F.col("best") < t.resolve)).drop("best")
    if adjudicator is None:
        rows = rows.withColumn("applied", F.when(F.col("adjudicated") & (F.col("rank") == 1), limited(F.col("opinion"))).otherwise(F.lit(0.0)))
    else:
        told = adjudicator(rows.where("adjudicated and rank <= 4"))
        fell = F.col("fell_back") if "fell_back" in told.columns else F.lit(False)
        # Of several answers on one pair the most cautious counts, so that no candidate is doubled.
        said = told.groupBy("s_id", "c_id").agg(limited(F.min(F.struct(F.abs("adjustment").alias("a"), "adjustment"))["adjustment"]).alias("said"), F.bool_or(fell).alias("fell_back"))
        rows = rows.join(said, ["s_id", "c_id"], "left").withColumn("fell_back", F.coalesce("fell_back", F.lit(False))).withColumn("applied", F.when(F.col("adjudicated") & (F.col("rank") <= 4), F.coalesce("said", F.lit(0.0))).otherwise(F.lit(0.0))).drop("said")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("applied")))
    if not options.adjudicator_may_resolve:
        moved = F.when(F.col("score") < t.resolve, F.least(moved, F.lit(t.resolve - 1e-4))).otherwise(moved)
    # Untouched candidates keep their order among equals, and an adjusted one its old rank as tie-break.
    return rows.withColumn("score", F.when(F.col("applied") != 0, moved).otherwise(F.col("score"))).withColumn(
        "rank", F.row_number().over(W.partitionBy("s_id").orderBy(F.desc("score"), "rank"))
    )
