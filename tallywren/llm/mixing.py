"""Operator 4: mixing sources to target weights on a low-discrepancy schedule. Native:
DataFrame functions only.

Sizes are words. Targets follow the weights but stop at ``max_repeat`` times a source's
size; what a stopped source leaves is shared again by weight. That fixed point is a water
level ``L`` with ``target = min(max_repeat * size, weight * L)``, found in one pass over the
sources in the order of ``max_repeat * size / weight``.

Schedule: slot ``i`` is the golden-ratio point ``i * PHI mod 2**31`` mapped through the
cumulative targets, so that at any prefix each source has close to its share. There are as many slots
as blocks in all targets. Slots are ranked within their source; the r-th slot takes the r-th block of
``block`` words of the source's documents, laid end to end in a seeded hash order and repeated as a whole, at
most ``max_repeat`` times. What a source takes is thus what the points give it: its target but for the
points' discrepancy of a few blocks. ``block_words`` makes blocks of a millionth of the
mixture, of one word at least and ``BLOCK`` at most, so that the discrepancy is no more than some millionths.

Ranks and offsets come from two levels (counts of chunks or hash ranges, then positions
within), so that a source with a third of all rows is no single task. Sources meet
slots by an equi-join on coarse ranges of the points.

Defined cases: null texts and texts without words have size 0, take nothing and have the first slot -1, as has any text of which nothing is taken; a text of any
length is cut over as many blocks as it fills; a null source is a source of its
own, ordered last; a null doc_id is ordered as the empty text; rows that share a doc_id, and repeated rows,
are separate rows, which lie by size; an empty table gives an empty result and all-empty texts targets of
0; ``mix`` passes other columns by, whatever their names, and ``mixed`` keeps them but for those that bear a name of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

WEIGHTS, MAX_REPEAT, BLOCK, SEED = (5, 2, 1), 3, 128, 11
POINTS = 1 << 31
PHI = 1_327_217_885  # the golden ratio's fraction of 2**31, made odd
RANGE_BITS = 19
RESOLUTION_BITS = 20
OWN = ("size", "source_size", "target", "taken", "first_slot", "pieces")


def word_count(text: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def block_words(total: int) -> int:
    """Words of a block for a mixture of ``total`` words."""
    return max(1, min(BLOCK, total >> RESOLUTION_BITS))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, pos, weight, source_size, target, quota)`` from rows ``(source, size)``."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    src = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeat)
    )
    rising = W.orderBy(F.col("cap") / F.col("weight"), "pos")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.col("full")).cast("double") / F.col("open").cast("double")
    src = (
        src.withColumn("full", F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("rank", F.row_number().over(rising))
    )
    # The first level in rising order that its own source can take is the water level.
    water = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("rank"))).over(every)
    return (
        src.withColumn("water", F.coalesce(water, F.lit(0.0)))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("water")))
        .select("source", "pos", "weight", "source_size", "target", F.least(F.col("cap"), F.floor(F.col("target") + 0.5)).alias("quota"))
    )


def _drawn(sources: DataFrame, total: int, block: int) -> DataFrame:
    """``(slot, pos, chunk)``: the source that each slot's point falls to."""
    slots = math.ceil(total / block)
    by_pos = W.orderBy("pos")
    share = F.floor(F.col("target") / F.lit(float(max(total, 1))) * POINTS + 0.5).cast("long")
    ends = (
        sources.withColumn("high", F.sum(share).over(by_pos.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("high", F.when(F.lead("pos").over(by_pos).isNull(), F.lit(POINTS)).otherwise(F.least("high", F.lit(POINTS))))
        .withColumn("low", F.coalesce(F.lag("high").over(by_pos), F.lit(0)))
        .where("low < high")
        .withColumn("span", F.explode(F.sequence(F.shiftright("low", RANGE_BITS), F.shiftright(F.col("high") - 1, RANGE_BITS))))
        .select("pos", "low", "high", "span")
    )
    point = (F.col("id").bitwiseAND(POINTS - 1) * F.lit(PHI)).bitwiseAND(POINTS - 1)
    return (
        sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("span", F.shiftright("point", RANGE_BITS))
        .join(ends, "span").where("low <= point and point < high")
        .select("slot", "pos", F.floor(F.col("slot") / max(4096, math.isqrt(slots))).alias("chunk"))
    )


def schedule(sources: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(slot, pos, rank)``: slot ``slot`` takes block ``rank`` of the source at ``pos``; and ``(pos, slots)``, how
    many slots the points give each source."""
    total = sources.agg(F.sum("quota")).first()[0] or 0
    drawn = _drawn(sources, total, block or block_words(total))
    chunks = materialize(drawn.groupBy("pos", "chunk").agg(F.count("*").alias("n")), "chunks")
    before = chunks.select("pos", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("pos").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("pos", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("own", own).join(before, ["pos", "chunk"]).select("slot", "pos", (F.col("own") + F.col("before")).alias("rank"))
    return ranked, chunks.groupBy("pos").agg(F.sum("n").alias("slots"))


def laid_out(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents in shuffled order with ``start``, the words of the source before them. There are about as
    many hash ranges as rows in one, so that neither level's sums are long."""
    digits = max(1, math.ceil(math.log(max(1, sizes.count()), 16) / 2))
    keyed = (
        sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.row", "d.doc_id", "d.size", "s.pos", "s.source_size", "s.target")
    ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("part", F.substring("key", 1, digits))
    before = keyed.groupBy("pos", "part").agg(F.sum("size").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("pos").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    within = W.partitionBy("pos", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    return keyed.withColumn("upto", F.sum("size").over(within)).join(before.drop("n"), ["pos", "part"]).select(
        "row", "doc_id", "size", "pos", "source_size", "target", (F.col("upto") - F.col("size") + F.col("before")).alias("start")
    )


def blocks(docs: DataFrame, block: int, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The pieces ``(pos, rank, row, words)`` that documents have in their source's first ``slots`` blocks."""
    again = docs.where("size > 0").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    lo = F.col("start") + F.col("cycle") * F.col("source_size")
    again = again.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("slots") * block)).where("lo < hi")
    cut = again.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    words = F.least(F.col("hi"), (F.col("rank") + 1) * block) - F.greatest(F.col("lo"), F.col("rank") * block)
    return cut.select("pos", "rank", "row", words.alias("words"))


def allotted(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int | None = None, seed: int = SEED) -> DataFrame:
    """``row, doc_id`` and the columns ``OWN`` of each of the rows ``(row, doc_id, source, size)``."""
    sources = materialize(source_targets(sizes, weights, max_repeat), "sources")
    block = block or block_words(sources.agg(F.sum("quota")).first()[0] or 0)
    slots, given = schedule(sources, block)
    laid = materialize(laid_out(sizes, sources, seed), "laid")
    # Pieces are many more than the documents by whose size Spark would judge them: never broadcast.
    joined = blocks(laid.join(given, "pos"), block, max_repeat).hint("merge").join(slots, ["pos", "rank"])
    taken = joined.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("pieces"))
    none = F.lit(0).cast("long")
    return laid.join(taken, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot"), F.coalesce("pieces", none).alias("pieces")
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot, pieces`` of each row of ``docs``: the words that the mixture
    takes, the first slot that holds some of them, and over how many pieces of blocks they go."""
    sizes = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count().alias("size")), "sizes")
    return allotted(sizes, weights, max_repeat, block, seed).drop("row")


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture takes words of, with all their columns and ``mix``'s."""
    held = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "documents")
    sizes = materialize(held.select("row", "doc.doc_id", "doc.source", word_count("doc.text").alias("size")), "sizes")
    out = allotted(sizes, weights, max_repeat, block, seed).where("taken > 0")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in OWN]
    return held.join(out.drop("doc_id"), "row").select(*kept, *OWN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with z as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as pos from z group by source),
s1 as (select *, [5, 2, 1][pos % 3 + 1]::bigint as weight, source_size * {MAX_REPEAT} as cap from s0),
s2 as (select *, row_number() over o as rank, (sum(source_size) over ())::bigint
    - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
    (sum(weight) over (o rows between current row and unbounded following))::bigint as open
  from s1 window o as (order by cap::double / weight::double, pos)),
s3 as (select *, rest::double / open::double as level from s2),
s4 as (select *, coalesce((select level from s3 where level * weight <= cap order by rank limit 1), 0.0) as water from s3),
s5 as (select *, least(cap::double, weight * water) as target from s4),
s6 as (select *, least(cap, floor(target + 0.5)::bigint) as quota from s5),
t as (select total, greatest(1, least({BLOCK}, total // {1 << RESOLUTION_BITS})) as block from (select coalesce(sum(quota), 0)::bigint as total from s6)),
h as (select pos, least(sum(floor(target / greatest(total, 1)::double * {POINTS}::double + 0.5)::bigint) over (order by pos), {POINTS})::bigint as high, lead(pos) over (order by pos) is null as top from s6, t),
e as (select pos, case when top then {POINTS} else high end as high, coalesce(lag(high) over (order by pos), 0) as low from h),
x as (select i as slot, ((i & {POINTS - 1}) * {PHI}) & {POINTS - 1} as point from t, range(0, (total + block - 1) // block) r(i)),
r as (select slot, pos, row_number() over (partition by pos order by slot) - 1 as rank from x join e on low <= point and point < high),
g as (select pos, count(*)::bigint as slots from r group by pos),
d as (select z.doc_id, z.size, s6.* exclude (source), sum(z.size) over (partition by pos order by md5('{SEED}:' || coalesce(z.doc_id::varchar, '')), z.doc_id, z.size
    rows between unbounded preceding and current row)::bigint - z.size as start
  from z join s6 on z.source is not distinct from s6.source),
p as (select d.*, block, start + c * source_size as lo, least(start + c * source_size + size, coalesce(slots, 0) * block) as hi from d left join g using (pos), t, range({MAX_REPEAT}) q(c)),
k as (select pos, start, doc_id, size, source_size, target, min(block) as block, sum(greatest(0, hi - lo))::bigint as taken,
    sum(case when hi > lo then (hi - 1) // block - lo // block + 1 else 0 end)::bigint as pieces
  from p where size > 0 group by pos, start, doc_id, size, source_size, target
  union all select pos, start, doc_id, size, source_size, target, 1, 0, 0 from d where size = 0)
select doc_id, size, source_size, target, taken, case when taken > 0 then slot else -1 end as first_slot, pieces
from k left join r on k.pos = r.pos and r.rank = k.start // k.block
"""
