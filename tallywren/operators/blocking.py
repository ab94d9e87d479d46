"""Blocking keys, block sizes and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import MatchOptions

SIDES = ("id", "ord", "kind", "currency", "norm_ref", "norm_cp", "amount_minor", "fee_minor", "tax_minor", "value_date")


def amount_bucket(amount="amount_minor") -> Column:
    """Logarithmic buckets of one percent."""
    return F.floor(F.log(F.greatest(F.lit(1), F.col(amount)).cast("double")) * 100 + 0.5).cast("long")


def day_number(ts="value_date") -> Column:
    return F.floor(F.unix_micros(ts) / 8.64e10).cast("long")


def all_keys(options: MatchOptions = MatchOptions()) -> Column:
    """The blocking keys of a record, in their order, null for those it has not."""
    ref, cp, bucket = F.col("norm_ref"), F.col("norm_cp"), amount_bucket()
    return F.array(
        F.concat(F.lit("ref:"), ref),
        F.when(F.length(ref) >= 6, F.concat(F.lit("refp:"), F.substring(ref, 1, 6))),
        *(F.concat(F.lit("amt:"), (bucket - i).cast("string")) for i in range(options.amount_bucket_reach + 1)),
        F.concat(F.lit("cpd:"), cp, F.lit(":"), F.floor(day_number() / 3).cast("string")),
    )


def key_array(options: MatchOptions = MatchOptions()) -> Column:
    """The blocking keys of a record, in their order."""
    return F.array_compact(all_keys(options))


def blocking_keys(records: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One row ``(…, pos, key)`` for each record and key."""
    return records.select(*(c for c in SIDES if c in records.columns), F.posexplode(key_array(options)).alias("pos", "key"))


def block_stats(keys: DataFrame) -> DataFrame:
    """``(key, n, rank)``: members, and the place at which the block first appears."""
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("rank"))


def candidate_pairs(records: DataFrame, options: MatchOptions = MatchOptions(), exact: bool = False) -> DataFrame:
    """Distinct pairs of records of two sources and one currency that share a block of at most
    ``block_cap`` members: ``id_l, id_r, blocking_key`` of the first shared block, ``ord_l < ord_r``.

    With ``exact`` only pairs of equal reference and amount, tested inside the blocks, so that no others are shuffled.
    Only ids and gates go through the block join. Oversized blocks find no partner in the join
    with the block sizes, so none of their rows go on.
    """
    gate = ("kind", "currency", "norm_ref", "amount_minor") if exact else ("kind", "currency")
    keys = blocking_keys(records.select(*SIDES), options).select("ord", "id", *gate, "pos", "key")
    kept = block_stats(keys).where(F.col("n").between(2, options.block_cap)).select("key", "rank")
    # Grouping by the key that the join was dealt by moves nothing; a group holds at most ``block_cap`` members.
    member = F.struct("ord", "id", *gate)
    blocks = keys.join(kept, "key").groupBy("key", "rank").agg(F.array_sort(F.collect_list(member)).alias("m"))
    left = blocks.select("key", "rank", "m", F.posexplode("m").alias("at", "l")).where(F.col("at") < F.size("m") - 1)
    both = left.select("key", "rank", "l", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("r"))
    gates = (F.col("l.ord") < F.col("r.ord")) & (F.col("l.kind") != F.col("r.kind")) & (F.col("l.currency") == F.col("r.currency"))
    if exact:
        gates = gates & (F.col("l.norm_ref") == F.col("r.norm_ref")) & (F.col("l.amount_minor") == F.col("r.amount_minor"))
    joined = both.where(gates).select("key", "rank", F.col("l.ord").alias("ord_l"), F.col("r.ord").alias("ord_r"), F.col("l.id").alias("id_l"), F.col("r.id").alias("id_r"))
    return joined.groupBy("ord_l", "ord_r", "id_l", "id_r").agg(F.min_by("key", "rank").alias("blocking_key"), F.min("rank").alias("block_rank"))


def hot_keys(records: DataFrame, options: MatchOptions = MatchOptions(), share: int = 64) -> DataFrame:
    """Keys that have more than ``block_cap`` members in a fixed subset of the records already, and so in all of them. That they
    are dropped before the shuffle changes no result: what the subset doesn't show is found in the blocks."""
    few = records.where(F.pmod(F.xxhash64("ord"), F.lit(share)) == 0)
    return few.select(F.explode(all_keys(options)).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > options.block_cap).select("key")


def block_pairs(records: DataFrame, hot: DataFrame, options: MatchOptions = MatchOptions(), exact: bool = False, parts: int = 1, part: int = 0) -> DataFrame:
    """The pairs of ``candidate_pairs`` with both records' columns (``…_l``, ``…_r``) and the block's ``key`` and ``rank``, once for each block they
    share, of the blocks of one part of the keys. Records go through one shuffle, by the key, and pairs through none."""
    keys = records.select(*SIDES, F.posexplode(all_keys(options)).alias("pos", "key")).where("key is not null")
    if parts > 1:
        keys = keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
    keys = keys.join(hot, "key", "left_anti")
    at = W.partitionBy("key").orderBy("ord", "pos")
    whole = at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = keys.withColumn("n", F.count("*").over(whole)).withColumn("rank", F.first(F.struct("ord", "pos")).over(whole)).where(F.col("n").between(2, options.block_cap))
    earlier = F.collect_list(F.struct(*SIDES)).over(at.rowsBetween(W.unboundedPreceding, -1))
    both = kept.withColumn("earlier", earlier).withColumn("l", F.explode("earlier"))
    gates = (F.col("l.ord") < F.col("ord")) & (F.col("l.kind") != F.col("kind")) & (F.col("l.currency") == F.col("currency"))
    if exact:
        gates = gates & (F.col("l.norm_ref") == F.col("norm_ref")) & (F.col("l.amount_minor") == F.col("amount_minor"))
    return both.where(gates).select("key", "rank", *(F.col(f"l.{c}").alias(f"{c}_l") for c in SIDES), *(F.col(c).alias(f"{c}_r") for c in SIDES))


def side(records: DataFrame, suffix: str) -> DataFrame:
    return records.select(*(F.col(c).alias(f"{c}_{suffix}") for c in SIDES))


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with both records' columns."""
    return pairs.drop("ord_l", "ord_r").join(side(records, "l"), "id_l").join(side(records, "r"), "id_r")


def skipped_blocks(records: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Blocks above the cap, by kind of key: their number and members."""
    stats = block_stats(blocking_keys(records, options)).where(F.col("n") > options.block_cap)
    return stats.groupBy(F.substring_index("key", ":", 1).alias("key_kind")).agg(F.count("*").alias("blocks"), F.sum("n").alias("members"))
