"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, release, remove_path

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour or only larger ones. Both rounds keep what is connected
    connected, so the stars are then the components."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("x"))
    each = ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    return each.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another one; ``component``
    is the smallest node reachable.

    Alternating large-star and small-star rounds: each node hands its larger neighbours,
    then its smaller ones, to the smallest it knows, until only stars are left.
    Edges never multiply, a hub's edges are dealt by AQE's skew join, and each round ends
    in a written table that replaces the last one. Nulls and self-loops are no edges. A graph that has not settled
    after ``MAX_ROUNDS`` rounds is an error, never a silent stop.
    """
    spark = edges.sparkSession

    def written(rows: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        rows.write.option("compression", "zstd").parquet(path)
        release(spark)
        return spark.read.schema(rows.schema).parquet(path), path

    e, path = written(
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _stars(e):
            roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(lowest, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo").where("hi <> lo").distinct()
        )
        before = path
        e, path = written(small)
        remove_path(spark, before)
    raise RuntimeError(f"connected components did not settle in {MAX_ROUNDS} rounds")
