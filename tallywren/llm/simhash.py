"""Operator 7: SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two. The embedding maps each segment to
its bit count (0, 1 or 2), held as a thermometer code (00, 01, 11) in one long, so that the
Manhattan distance of two embeddings is the bit count of their XOR. It never exceeds the
Hamming distance of the fingerprints: it is the lower bound that prunes.

Grid range-join: the 32 coordinates are dealt into ``radius + 3`` groups. Embeddings at a
distance of ``radius`` or less agree in all coordinates of at least three groups, so each
choice of three groups spans a grid whose cells hold every such pair at least once. Cells
are joined on their coordinates, pairs filtered by Manhattan distance and verified by exact
Hamming distance.

Only distinct fingerprints enter, so copies cost one row. A cell of more than ``CELL``
fingerprints (a dense cloud of near copies) emits no pairs: its members are linked
through their one-bit neighbours instead. Two fingerprints within two bits share such a
neighbour and any two that share one are within two bits, so that way is exact and
linear.

Defined cases: a null, empty or blank text has the fingerprint zero and is linked like any
other; a text of fewer words than a shingle is one shingle, and one of any length is read whole; a bit that is set in just half of the hashes is 0; a null doc_id takes its
group's component, which is the smallest doc_id of its rows that have one, or null without any; repeated doc_ids and repeated rows are rows of their own;
an empty table gives an empty result; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialize
from .common import as_bytes, blank_words, cut

WORDS, SEED, RADIUS, CELL = 3, 42, 2, 32
EVEN = 0x5555555555555555
ODD = ~EVEN  # as a signed long


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of the space-joined shingles, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((h(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(n)))), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """Unsigned; a bit is set if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` is the signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            fps = [fingerprint(shingle_hashes(blank_words(t), n)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return as_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, fp long")


def embed(fp):
    """Thermometer code of the bit counts of the 32 two-bit segments."""
    some = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(EVEN))
    both = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(F.lit(ODD))
    return some.bitwiseOR(both)


def grid_masks(radius: int = RADIUS) -> list[int]:
    """For each choice of three groups of segments, the mask of their bits (signed)."""
    groups = [sum(3 << (2 * s) for s in range(g, 32, radius + 3)) for g in range(radius + 3)]
    masks = [sum(choice) for choice in combinations(groups, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Edges ``(src, dst)`` that connect exactly the distinct fingerprints ``(fp, node)`` that
    chains of at most ``radius`` differing bits connect. The way for dense cells needs a radius of two."""
    if radius != RADIUS:
        raise ValueError("dense cells are linked through one-bit neighbours, which fits a radius of 2 only")
    masks = grid_masks(radius)
    cells = nodes.select("fp", "node", embed(F.col("fp")).alias("e")).select(
        "fp", "node", "e", F.posexplode(F.array(*(F.col("e").bitwiseAND(F.lit(m)) for m in masks))).alias("grid", "at")
    )
    full = cells.groupBy("grid", "at").agg(F.count("*").alias("n")).where("n > 1")
    # Cells are many more than the fingerprints by whose size Spark would judge them: never broadcast.
    held = materialize(cells.hint("merge").join(full, ["grid", "at"]), "cells")
    few = held.where(F.col("n") <= cell)
    a, b = few.alias("a"), few.select("grid", "at", F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.col("e").alias("e2")).alias("b")
    pairs = (
        a.join(b, ["grid", "at"])
        .where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("e").bitwiseXOR(F.col("e2"))) <= radius) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius))
        .select(F.col("node").alias("src"), F.col("node2").alias("dst"))
    )
    bits = [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(64))]
    near = (
        held.where(F.col("n") > cell).select("fp", "node").distinct()
        .select("node", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in bits))).alias("via"))
    )
    hubs = near.groupBy("via").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("via", "hub")
    stars = near.hint("merge").join(hubs, "via").where("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    return pairs.union(stars).distinct()


def components(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for each row of ``docs``."""
    own = materialize(fingerprints(docs, n), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    # Fingerprints are the nodes, so that those of rows without a doc_id link too.
    comps = connected_components(links(nodes.select("fp", F.col("fp").alias("node")))).withColumnRenamed("node", "fp")
    held = materialize(comps.join(nodes, "fp"), "members")
    least = held.groupBy("component").agg(F.min("least").alias("group"))
    of = held.select("fp", "component").join(least, "component").select("fp", "group", F.lit(True).alias("linked"))
    named = nodes.join(of, "fp", "left").select("fp", F.when(F.col("linked"), F.col("group")).otherwise(F.col("least")).alias("component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
