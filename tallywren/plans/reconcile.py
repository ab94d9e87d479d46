"""The reconciliation plan: blocking, scoring, ranking, adjudication, decisions, groups, exceptions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import LedgerError
from ..operators import blocking, closed, policy, ranking
from ..operators.graph import connected_components
from ..schema import STRATEGIES, MatchOptions, Thresholds
from ..session import materialize, materialize_parts
from ..sources.ingest import live


# A written part's records by their keys, and its pairs by their subjects: what is shuffled at a time takes some GB at most.
PART_RECORDS, PART_PAIRS = 15_000_000, 25_000_000
MOST_BROADCAST = 200_000
# From so many records on, groups and exceptions are made of closed references apart from the others.
CLOSED_FROM = 1_000_000


def _part(column: str, parts: int, part: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)) == part


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _match_id(comp):
    return F.concat(F.lit("mch_"), F.lpad(comp.cast("string"), 14, "0"))


def accepted_edges(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """``(src, dst)`` by record order: one side's acceptance is enough."""
    if "accepted_ords" in decisions.columns:
        return decisions.select(F.col("ord").alias("src"), F.explode("accepted_ords").alias("dst"))
    directed = decisions.select("ord", F.explode("accepted_ids").alias("other"))
    return directed.join(records.select(F.col("id").alias("other"), F.col("ord").alias("dst")), "other").select(F.col("ord").alias("src"), "dst")


def component_of(records: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ord, comp)`` for every record; a lone record is its own component."""
    comps = connected_components(edges).select(F.col("node").alias("ord"), "component")
    return records.select("ord").join(comps, "ord", "left").select("ord", F.coalesce("component", "ord").alias("comp"))


def split_edges(records: DataFrame, comps: DataFrame, t: Thresholds) -> DataFrame:
    """Edges that join the parts of a split to its whole: among the components that bear one reference, a component
    with a gross amount takes all others' net amounts (two or more) if they sum to it within tolerance.

    All references are judged on the components as they were before; sums over a reference are
    windows over its components, of which each is one row.
    """
    rows = records.join(comps, "ord")
    order, paid = F.col("kind").isin("ORDER", "PG_PAYMENT"), F.col("kind").isin("SETTLEMENT", "BANK_STATEMENT")
    money = rows.groupBy("comp").agg(F.min_by(F.when(order, F.col("amount_minor")), F.when(order, F.col("ord"))).alias("gross"), F.max(F.when(paid, F.col("amount_minor"))).alias("net"))
    bearing = rows.where("norm_ref is not null").select("norm_ref", "comp").distinct().join(money, "comp")
    sums = bearing.groupBy("norm_ref").agg(F.count("net").alias("nets"), F.coalesce(F.sum("net"), F.lit(0)).alias("net_sum"), F.count("*").alias("n")).where("n >= 2")
    whole = bearing.where("gross is not null").join(sums, "norm_ref").select(
        "norm_ref", F.col("comp").alias("whole"), "gross", (F.col("nets") - F.col("net").isNotNull().cast("int")).alias("parts"), (F.col("net_sum") - F.coalesce("net", F.lit(0))).alias("rest")
    )
    fits = whole.where((F.col("parts") >= 2) & (F.abs(F.col("rest") - F.col("gross")) <= F.col("gross") * t.fee_tolerance + t.rounding_slack_minor))
    parts = bearing.where("net is not null").select("norm_ref", F.col("comp").alias("part"))
    return fits.join(parts, "norm_ref").where("whole <> part").select(F.col("whole").alias("src"), F.col("part").alias("dst"))


@dataclass
class Run:
    """One reconciliation. Its parts are computed when they are asked for and kept as written tables."""

    records: DataFrame
    strategy: str = "fuzzy+adjudicator"
    thresholds: Thresholds = field(default_factory=Thresholds)
    options: MatchOptions = field(default_factory=MatchOptions)
    label: str | None = None
    run_id: str = "run"
    adjudicator: ranking.Adjudicator | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise LedgerError("VALIDATION_FAILED", f"unknown strategy {self.strategy}")

    @property
    def baseline(self) -> bool:
        return self.strategy == "baseline-exact"

    @cached_property
    def live_rows(self) -> DataFrame:
        """Live records as they are matched, and the held-out truth, which only the evaluation reads."""
        truth = [c for c in ("truth_group_id",) if c in self.records.columns]
        return self.written(live(self.records).select(*blocking.SIDES, *truth), "live")

    @cached_property
    def matchable(self) -> DataFrame:
        """Live records without the held-out truth."""
        return self.live_rows.select(*blocking.SIDES)

    @cached_property
    def hot(self) -> DataFrame:
        """Keys that are left out before blocks are formed."""
        return self.written(blocking.hot_keys(self.matchable, self.options), "hot")

    @cached_property
    def opened(self) -> tuple[DataFrame, DataFrame]:
        """Facts on the blocks, and the references that are not closed."""
        facts = self.written(closed.block_facts(self.matchable, _few(self.hot), self.options), "blocks")
        return facts, self.written(closed.open_references(self.matchable, self.hot, facts, self.options), "open")

    @cached_property
    def parted(self) -> tuple[Run, DataFrame] | None:
        """A run of the open records alone, and the closed records; none for few records or an adjudicator that is asked."""
        if self.adjudicator is not None or self.matchable.count() < CLOSED_FROM:
            return None
        facts, refs = self.opened
        few, rows = _few(refs), self.matchable
        rest = Run(self.written(rows.join(few, "norm_ref", "left_semi").select(*blocking.SIDES).union(rows.where("norm_ref is null")), "open-records"), self.strategy, self.thresholds, self.options, self.label, self.run_id)
        dropped = self.hot.union(facts.where(F.col("n") > self.options.block_cap).select("key"))
        vars(rest).update(matchable=rest.records, hot=dropped, parted=None)
        return rest, rows.where("norm_ref is not null").join(few, "norm_ref", "left_anti")

    def decided_closed(self, own: DataFrame, lone: bool = False) -> DataFrame:
        return closed.decide_closed(own, self.thresholds, self.options, self.strategy == "fuzzy+adjudicator", self.baseline, lone)

    @cached_property
    def divided(self) -> tuple[Run, DataFrame] | None:
        """A run of the open records alone, and the closed ones decided and grouped."""
        return self.parted and (self.parted[0], self.written(self.decided_closed(self.parted[1]), "closed"))

    @cached_property
    def divided_lone(self) -> tuple[Run, DataFrame] | None:
        """The same of records of no group, which are few: taken from the table of all where it is written, else decided in parts of the references."""
        if self.parted is None or "divided" in vars(self):
            return self.divided and (self.divided[0], self.divided[1].where("size = 1"))
        rest, own = self.parted
        parts = max(1, self.matchable.count() // PART_RECORDS)
        cut = lambda i: own.where(_part("norm_ref", parts, i)) if parts > 1 else own
        return rest, materialize_parts(own.sparkSession, (self.decided_closed(cut(i), True) for i in range(parts)), "lone")

    def beside(self, strategy: str) -> Run:
        """Another strategy's run over the same records, which reads the tables that both need."""
        other = Run(self.records, strategy, self.thresholds, self.options, run_id=self.run_id)
        vars(other).update({c: getattr(self, c) for c in ("live_rows", "hot") + (("opened",) if self.matchable.count() >= CLOSED_FROM else ())})
        return other

    @cached_property
    def scored(self) -> DataFrame:
        """Scored candidate pairs with the features and a shared block, once for each block they share. Written in parts of the keys,
        and without what only the scores need, unless an adjudicator is to be asked about it."""
        records, spark = self.matchable, self.records.sparkSession
        hot = _few(self.hot)
        parts = max(1, records.count() // PART_RECORDS)
        kept = [f"{c}_{s}" for s in "lr" for c in ranking.SUBJECT if self.adjudicator or c in ranking.DECIDING]
        rows = (ranking.score_pairs(blocking.block_pairs(records, hot, self.options, self.baseline, parts, i), self.thresholds, self.baseline) for i in range(parts))
        return materialize_parts(spark, (r.select("key", "rank", *kept, "features", "score", "opinion") for r in rows), "scored")

    @cached_property
    def pairs(self) -> DataFrame:
        """Scored candidate pairs with the features and the first shared block."""
        first = F.row_number().over(W.partitionBy("ord_l", "ord_r").orderBy("rank"))
        return self.scored.withColumn("first", first).where("first = 1").drop("first").withColumnsRenamed({"key": "blocking_key", "rank": "block_rank"})

    def ranked(self, scored: DataFrame, parts: int = 1, part: int = 0) -> DataFrame:
        views = ranking.both_ways(scored)
        if parts > 1:
            views = views.where(_part("s_id", parts, part))
        first = ranking.ranked(views)
        return first if self.strategy != "fuzzy+adjudicator" else ranking.adjudicated(first, self.thresholds, self.options, self.adjudicator)

    @cached_property
    def ranks(self) -> DataFrame:
        rows = self.ranked(self.scored)
        return rows if self.adjudicator is None else materialize(rows, "ranks")  # so that no one is asked twice

    def by_subject(self, f: Callable[[DataFrame, DataFrame], DataFrame], name: str) -> DataFrame:
        """The table of ``f(records, ranks)``, where ``f`` needs only one subject's candidates at a time, written in parts of the subjects."""
        scored, asked = self.scored, self.adjudicator is not None
        parts = 1 if asked else max(1, scored.count() // PART_PAIRS)
        cut = lambda rows, i: rows.where(_part("id", parts, i)) if parts > 1 else rows
        return materialize_parts(scored.sparkSession, (f(cut(self.matchable, i), self.ranks if asked else self.ranked(scored, parts, i)) for i in range(parts)), name)

    @cached_property
    def decisions(self) -> DataFrame:
        return self.by_subject(lambda records, ranks: policy.decide(records, ranks, self.thresholds), "decisions")

    @cached_property
    def first_components(self) -> DataFrame:
        return self.written(component_of(self.matchable, accepted_edges(self.decisions, self.matchable)), "components")

    @cached_property
    def components(self) -> DataFrame:
        if self.baseline:
            return self.first_components
        more = self.written(split_edges(self.matchable, self.first_components, self.thresholds), "splits")
        if more.isEmpty():
            return self.first_components
        joined = connected_components(more).select(F.col("node").alias("comp"), "component")
        return self.written(self.first_components.join(joined, "comp", "left").select("ord", F.coalesce("component", "comp").alias("comp")), "components")

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        return materialize_parts(rows.sparkSession, [rows], name)

    @cached_property
    def membership(self) -> DataFrame:
        """``match_id`` and the record of each member of a group of two or more, without reasons."""
        columns = ("ord", "id", "kind", "amount_minor", "decided_by", "confidence", "adjudicated")
        if self.divided:
            rest, own = self.divided
            return rest.membership.union(own.where("size >= 2").select(_match_id(F.col("comp")).alias("match_id"), *columns))
        size = self.components.groupBy("comp").agg(F.count("*").alias("n")).where("n >= 2").select("comp")
        rows = self.components.join(size, "comp").join(self.decisions.select(*columns), "ord")
        return self.written(rows.select(_match_id(F.col("comp")).alias("match_id"), *columns), "membership")

    @cached_property
    def placed(self) -> DataFrame:
        """Members with their match and its confidence: ``ord, match_id, match_confidence``."""
        if self.divided:
            rest, own = self.divided
            return rest.placed.union(own.where("size >= 2").select("ord", _match_id(F.col("comp")), "least"))
        return self.membership.join(self.match_heads.select("match_id", F.col("confidence").alias("match_confidence")), "match_id").select("ord", "match_id", "match_confidence")

    @cached_property
    def members(self) -> DataFrame:
        """Members with their decisions' features and rationale."""
        return self.written(self.membership.join(self.decisions.select("ord", "features", "rationale"), "ord").select(*self.membership.columns, "features", "rationale"), "members")

    @cached_property
    def match_heads(self) -> DataFrame:
        """Groups with their members in record order, the least confidence of any member's decision, and what decided the first member."""
        if self.divided:
            rest, own = self.divided
            heads = own.where("record_ids is not null").select(
                _match_id(F.col("comp")).alias("match_id"), "record_ids", F.col("least").alias("confidence"), "ord", "decided_by", F.col("any_adjudicated").alias("adjudicated"), "amount_delta_minor", "sources", "size"
            )
            return rest.match_heads.union(heads)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
        kinds = F.size(F.collect_set("kind")).cast("long")
        rows = self.membership.groupBy("match_id").agg(
            ids.alias("record_ids"), F.min("confidence").alias("confidence"), F.min(F.struct("ord", "decided_by")).alias("first"), F.bool_or("adjudicated").alias("adjudicated"),
            (F.max("amount_minor") - F.min("amount_minor")).alias("amount_delta_minor"), kinds.alias("sources"), F.count("*").alias("size"),
        )
        return self.written(rows.select("match_id", "record_ids", "confidence", F.col("first.ord").alias("ord"), F.col("first.decided_by").alias("decided_by"), "adjudicated", "amount_delta_minor", "sources", "size"), "heads")

    @cached_property
    def matches(self) -> DataFrame:
        """The groups with the first member's reasons."""
        rows = self.match_heads.join(self.decisions.select("ord", "features", "rationale"), "ord")
        head = F.concat(F.col("size").cast("string"), F.lit(" records across "), F.col("sources").cast("string"), F.lit(" sources. "))
        return materialize(
            rows.select(
                F.lit(self.run_id).alias("run_id"), "match_id", "record_ids", F.lit("RESOLVED").alias("state"), "confidence", "decided_by", F.concat(head, "rationale").alias("rationale"),
                "features", "adjudicated", "amount_delta_minor", "sources", "size",
            ),
            "matches",
        )

    @cached_property
    def left_over(self) -> DataFrame:
        """Decisions on the records of no group, of which exceptions and unresolved records are made. Who accepts another is in a group with it."""
        if self.divided_lone:
            rest, own = self.divided_lone
            none = F.array().cast("array<string>").alias("accepted_ids")
            rows = own.select("id", "ord", "kind", "amount_minor", "best", F.lit(None).cast("double").alias("least_accepted"), F.lit(0).alias("accepted_kinds"), none, "ambiguous", "near", "adjudicated")
            return rest.left_over.unionByName(policy.settled(rows, self.thresholds))
        return self.written(self.decisions.where(F.size("accepted_ids") == 0).drop("accepted_ords").join(self.membership.select("id"), "id", "left_anti"), "left_over")

    @property
    def exception_rows(self) -> DataFrame:
        """Records that no group took and that a person should see, not written: who needs few columns pays for those."""
        best = F.when(F.col("best_id").isNotNull(), F.array("best_id")).otherwise(F.array().cast("array<string>"))
        lone = F.col("decided_by") == "NO_CANDIDATE"
        rows = self.left_over.where(((F.col("state") == "EXCEPTION") & F.col("exception_kind").isNotNull()) | lone)
        return rows.select(
            F.lit(self.run_id).alias("run_id"), F.concat(F.lit("exc_"), F.lpad(F.col("ord").cast("string"), 14, "0")).alias("exception_id"), F.col("exception_kind").alias("kind"), F.array("id").alias("record_ids"),
            F.when(F.size("ambiguous_ids") > 0, F.col("ambiguous_ids")).otherwise(best).alias("recommended_ids"), "confidence", F.col("rationale").alias("explanation"), F.col("amount_minor").alias("amount_at_risk_minor"),
        )

    @cached_property
    def exceptions(self) -> DataFrame:
        return materialize(self.exception_rows, "exceptions")

    @cached_property
    def unresolved(self) -> DataFrame:
        return self.left_over.where("not (state = 'EXCEPTION' and exception_kind is not null)")

    def residual_ambiguity(self) -> DataFrame:
        """Matched records that also had indistinguishable candidates, which raise no exception."""
        return self.decisions.where("state = 'RESOLVED' and size(ambiguous_ids) > 0").select("id", "ambiguous_ids", "confidence")

    def candidate_sample(self, n: int = 500) -> DataFrame:
        """The first ``n`` pairs in the order of their blocks."""
        return self.pairs.orderBy("block_rank", "ord_l", "ord_r").limit(n).select(F.lit(self.run_id).alias("run_id"), "id_l", "id_r", "blocking_key", "features", "score")

    def summary(self) -> dict:
        """Runs everything and counts it; throughput is records over the seconds that took."""
        began = time.time()
        n, pairs, matches, exceptions = self.matchable.count(), self.pairs.count(), self.matches.count(), self.exceptions.count()
        unresolved, put = self.unresolved.count(), self.decisions.where("adjudicated").count()
        seconds = max(time.time() - began, 1e-9)
        fell = self.ranks.where("fell_back").select("s_id").distinct().count() if "fell_back" in self.ranks.columns else 0
        used = "none" if self.strategy != "fuzzy+adjudicator" else "custom" if self.adjudicator else "deterministic"
        return {
            "run_id": self.run_id, "label": self.label or self.strategy, "strategy": self.strategy, "adjudicator": used, "thresholds": self.thresholds.as_map(), "record_count": n, "candidate_count": pairs,
            "match_count": matches, "matched_records": self.membership.count(), "exception_count": exceptions, "unresolved_count": unresolved, "adjudicated_count": put, "fell_back_count": fell,
            "duration_ms": round(seconds * 1000), "records_per_second": round(n / seconds, 2),
        }


def reconcile(records: DataFrame, strategy: str = "fuzzy+adjudicator", label: str | None = None, run_id: str = "run", options: MatchOptions = MatchOptions(), adjudicator=None, **thresholds) -> Run:
    return Run(records, strategy, Thresholds().override(**thresholds), options, label, run_id, adjudicator)
