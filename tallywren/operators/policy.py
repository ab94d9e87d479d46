"""The decision on each record over its whole ranked candidate list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import Thresholds


def marked(ranks: DataFrame, t: Thresholds) -> DataFrame:
    """Adds to each candidate whether it is ``strong``, ``tied``, ``accepted``, ``ambiguous`` or ``near`` the best.

    Strong candidates of one source are rivals only if each alone accounts for the amount; if they
    sum to it instead they are parts of a split and all belong.
    """
    by_kind, by_subject = W.partitionBy("s_id", "c_kind"), W.partitionBy("s_id")
    gap = F.greatest((F.col("s_fee_minor") + F.col("s_tax_minor")).cast("double"), F.col("s_amount_minor") * F.lit(t.fee_tolerance)) + t.rounding_slack_minor
    rows = (
        ranks.withColumn("strong", F.col("score") >= t.resolve).withColumn("gap", gap)
        .withColumn("top", F.max(F.when(F.col("strong"), F.col("score"))).over(by_kind))
        .withColumn("top_rank", F.min(F.when(F.col("strong"), F.col("rank"))).over(by_kind))
        .withColumn("n_strong", F.sum(F.col("strong").cast("int")).over(by_kind))
        .withColumn("tied", F.col("strong") & (F.col("top") - F.col("score") < t.ambiguity_margin))
        .withColumn("n_tied", F.sum(F.col("tied").cast("int")).over(by_kind))
        .withColumn("tied_sum", F.sum(F.when(F.col("tied"), F.col("c_amount_minor"))).over(by_kind))
        .withColumn("each", F.min(F.when(F.col("tied"), F.abs(F.col("c_amount_minor") - F.col("s_amount_minor")) <= F.col("gap"))).over(by_kind))
        .withColumn("best", F.max("score").over(by_subject))
    )
    split = (F.abs(F.col("tied_sum") - F.col("s_amount_minor")) <= F.col("gap")) & ~F.col("each")
    return (
        rows.withColumn("accepted", F.col("strong") & ((F.col("n_strong") == 1) | ((F.col("n_tied") < 2) & (F.col("rank") == F.col("top_rank"))) | ((F.col("n_tied") >= 2) & F.col("tied") & split)))
        .withColumn("ambiguous", F.col("tied") & (F.col("n_strong") > 1) & (F.col("n_tied") >= 2) & ~split)
        .withColumn("near", F.col("best") - F.col("score") < t.ambiguity_margin)
    )


def _ids(flag: str, of: str = "c_id"):
    rows = F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("rank", of))))
    return F.transform(rows, lambda x: x[of])


def decide(records: DataFrame, ranks: DataFrame, t: Thresholds) -> DataFrame:
    """One decision for each record: ``id, ord, kind, amount_minor, state, exception_kind, decided_by,
    confidence, accepted_ids, ambiguous_ids, best_id, features, adjudicated, rationale``; and ``accepted_ords`` where the candidates bear ``c_ord``."""
    ords = ["accepted_ords"] if "c_ord" in ranks.columns else []
    if "adjudicated" not in ranks.columns:
        ranks = ranks.withColumn("adjudicated", F.lit(False))
    best = F.min(F.struct("rank", "c_id", "score", "features")).alias("best")
    each = marked(ranks, t).groupBy("s_id").agg(
        best, _ids("accepted").alias("accepted_ids"), _ids("ambiguous").alias("ambiguous"), _ids("near").alias("near"), *(_ids("accepted", "c_ord").alias(c) for c in ords),
        F.min(F.when(F.col("accepted"), F.col("score"))).alias("least_accepted"),
        F.count_distinct(F.when(F.col("accepted"), F.col("c_kind"))).alias("accepted_kinds"),
        F.bool_or("adjudicated").alias("adjudicated"),
    )
    none = F.array().cast("array<string>")
    rows = records.select("id", "ord", "kind", "amount_minor").join(each, F.col("id") == F.col("s_id"), "left").select(
        "id", "ord", "kind", "amount_minor", "best", "least_accepted", "accepted_kinds", F.coalesce("accepted_ids", none).alias("accepted_ids"),
        F.coalesce("ambiguous", none).alias("ambiguous"), F.coalesce("near", none).alias("near"), F.coalesce("adjudicated", F.lit(False)).alias("adjudicated"), *ords,
    )
    return settled(rows, t, *ords)


def settled(rows: DataFrame, t: Thresholds, *ords: str) -> DataFrame:
    """Decisions on records with their gathered candidates: the best one, and those accepted, ambiguous and near."""
    none = F.array().cast("array<string>")
    lone, some, rivals = F.col("best").isNull(), F.size("accepted_ids") > 0, F.size("ambiguous") > 0
    low = F.col("best.score") < t.floor
    f = "best.features"
    weak = (
        F.when(F.size("near") > 1, "AMBIGUOUS_MANY_TO_ONE").when(F.col(f"{f}.amount") < 0.5, "AMOUNT_MISMATCH_BEYOND_FEE")
        .when(F.col(f"{f}.date") == 0, "TIMING_BEYOND_WINDOW").when(F.col(f"{f}.reference") < 0.4, "REFERENCE_UNRECOGNIZED").otherwise("LOW_CONFIDENCE")
    )
    score = F.format_string("%.3f", F.col("best.score"))
    rationale = (
        F.when(lone, "No other source shares a block with this record; its counterpart is missing.")
        .when(some, F.concat(F.size("accepted_ids").cast("string"), F.lit(" candidates at or above the resolve threshold, from "), F.col("accepted_kinds").cast("string"), F.lit(" sources; "), scoring.explain(f)))
        .when(rivals, F.concat(F.size("ambiguous").cast("string"), F.lit(" candidates exclude each other at a best score of "), score, F.lit("; a person decides.")))
        .when(low, F.concat(F.lit("The best score of "), score, F.lit(" lies below the floor.")))
        .otherwise(F.concat(F.lit("The best score of "), score, F.lit(" lies between floor and resolve; "), scoring.explain(f)))
    )
    return rows.select(
        "id", "ord", "kind", "amount_minor",
        F.when(lone, "UNRESOLVED").when(some, "RESOLVED").when(rivals, "EXCEPTION").when(low, "UNRESOLVED").otherwise("EXCEPTION").alias("state"),
        F.when(lone, "MISSING_COUNTERPART").when(some & rivals, "AMBIGUOUS_MANY_TO_ONE").when(some, F.lit(None)).when(rivals, "AMBIGUOUS_MANY_TO_ONE").when(low, F.lit(None)).otherwise(weak).alias("exception_kind"),
        F.when(lone, "NO_CANDIDATE").when(some, "ABOVE_RESOLVE_THRESHOLD").when(rivals, "MUTUALLY_EXCLUSIVE_CANDIDATES").when(low, "BELOW_FLOOR").otherwise("BELOW_RESOLVE_THRESHOLD").alias("decided_by"),
        F.round(F.when(lone, 0.0).when(some, F.col("least_accepted")).otherwise(F.col("best.score")), 4).alias("confidence"),
        "accepted_ids", F.when(some | rivals, F.col("ambiguous")).when(low, none).otherwise(F.col("near")).alias("ambiguous_ids"),
        F.col("best.c_id").alias("best_id"), F.col("best.features").alias("features"), "adjudicated", rationale.alias("rationale"), *ords,
    )
