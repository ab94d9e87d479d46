"""Near-duplicate removal on five-word shingles at a Jaccard similarity of 0.8 or more.

Candidates come from operator 7's SimHash links (at most two differing bits) and, because 64
SimHash bits at so small a radius miss most pairs near 0.8 (those differ in about ten
bits), also from MinHash bands over the same shingles: 16 bands of 5 rows find a pair at
0.8 with a chance of 0.998. Every candidate is verified by the exact Jaccard
similarity of its shingle sets. Links make groups by connected components; of each group the
smallest doc_id stays.

Equal word sequences count as one text before candidates are sought. A bucket of up to
``CELL`` texts emits its pairs. Larger buckets emit none; their texts are handled by sets:
 1. A text of which over a fifth of the shingles occur in no other such text can have no
    partner among them and leaves.
 2. Each bucket's most central text (in the most large buckets) is compared with all its
    members.
 3. Where the texts of a bucket still belong to several groups, those outside the bucket's largest
    group meet all its texts, block by block, in tasks that count overlaps through sorted
    shingles and emit no more links than join their groups.
So every two texts of a bucket either are in one group already or are compared.

Defined cases: texts without words are copies of each other, as are texts of equal words;
a text of fewer words than a shingle is one shingle, and one of any length is compared whole; rows without a doc_id stay; rows
equal in doc_id and text become one; rows that share a doc_id with different texts are
one document, whose texts belong to one group, so they are kept or dropped together; the smallest doc_id stays, so there are no ties; an empty table stays empty; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialize
from .common import as_bytes, blank_words, cut
from .simhash import CELL, fingerprint, links, shingle_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 5
BLOCK_BYTES = 4 << 20
_RNG = np.random.default_rng(2024)
MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_keys(shingles: np.ndarray, step: int = 4096) -> list[int]:
    """One signed key for each band of the MinHash signature of distinct shingle hashes."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), step):
        part = shingles[at : at + step, None]
        low = np.minimum(low, (((part ^ (part >> np.uint64(29))) * MULTIPLY) + ADD).min(axis=0))
    return [int(np.uint64(xxhash.xxh64_intdigest(low[i : i + ROWS].tobytes())).astype(np.int64)) for i in range(0, len(low), ROWS)]


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp, bands)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            keys, fps, bands = [], [], []
            for text in batch["text"].to_pylist():
                words = blank_words(text)
                hashes = shingle_hashes(words, WORDS)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                fps.append(fingerprint(hashes))
                bands.append(band_keys(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "fp", "bands"],
            )

    return as_bytes(docs, "doc_id").mapInArrow(run, "doc_id long, text_key binary, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(rep, shingles)`` of ``texts(rep, doc_id, text_key)``, each read from the row of its doc_id
    that has its key: sorted distinct hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            reps, sets = [], []
            for rep, key, text in zip(*(batch[c].to_pylist() for c in ("rep", "text_key", "text"))):
                words = blank_words(text)
                if xxhash.xxh3_128_digest(b" ".join(words)) == key:
                    reps.append(rep)
                    sets.append(np.unique(shingle_hashes(words, WORDS)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(sets, pa.binary())], ["rep", "shingles"])

    named = as_bytes(docs, "doc_id").join(texts.select("rep", "doc_id", "text_key"), "doc_id").select("rep", "text_key", "text")
    return named.mapInArrow(run, "rep long, shingles binary").dropDuplicates(["rep"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``(src, dst)`` whose shingle sets have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            keep = []
            for a, b in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch["src"], batch["dst"]], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    joined = (
        pairs.join(sets.select(F.col("rep").alias("src"), F.col("shingles").alias("sa")), "src")
        .join(sets.select(F.col("rep").alias("dst"), F.col("shingles").alias("sb")), "dst")
    )
    return joined.select("src", "dst", "sa", "sb").mapInArrow(run, "src long, dst long")


def _exploded(sets: DataFrame) -> DataFrame:
    """``(rep, shingle)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            for rep, packed in zip(batch["rep"].to_pylist(), batch["shingles"].to_pylist()):
                own = np.frombuffer(packed, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep)), pa.array(own)], ["rep", "shingle"])

    return sets.select("rep", "shingles").mapInArrow(run, "rep long, shingle long")


def dense_links(large: DataFrame, reps: DataFrame, docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that join the same groups as ``edges`` and all links among the texts of large buckets
    ``(band, value, rep)`` would. What is joined before the last step comes as stars."""
    sets = materialize(shingle_sets(docs, reps.join(large.select("rep").distinct(), "rep")), "sets")
    able = sets
    for _ in range(2):
        # A shingle of one holder is a group of one row; its holder is that row's.
        single = _exploded(able).groupBy("shingle").agg(F.count("*").alias("df"), F.first("rep").alias("rep")).where("df = 1")
        own = single.groupBy("rep").agg(F.count("*").alias("own"))
        n = F.octet_length("shingles") / 8
        able = materialize(able.join(own, "rep", "left").where(n - F.coalesce("own", F.lit(0)) >= SIMILARITY * n).select("rep", "shingles"), "able")
    members = large.join(able.select("rep"), "rep")
    seen = members.groupBy("rep").agg(F.count("*").alias("in"))
    ranked = members.join(seen, "rep")
    heads = ranked.groupBy("band", "value").agg(F.min(F.struct(-F.col("in"), F.col("rep")))["rep"].alias("head"))
    spokes = ranked.join(heads, ["band", "value"]).where("rep <> head").select(F.least("rep", "head").alias("src"), F.greatest("rep", "head").alias("dst")).distinct()
    found = materialize(edges.union(verified(spokes, sets)), "spokes")
    comps = materialize(connected_components(found).withColumnRenamed("node", "rep"), "components")
    grouped = materialize(able.join(comps, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "shingles"), "grouped")
    return comps.select(F.col("component").alias("src"), F.col("rep").alias("dst")).union(block_links(members, grouped))


def block_links(members: DataFrame, grouped: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Links between texts ``(rep, component, shingles)`` of each bucket that join different components, as many as
    join the same groups.

    A bucket's texts outside its largest component meet all its texts. Both sides are dealt into blocks of about
    ``limit`` bytes and each block of one meets each of the other in a task of its own, which emits a link only if
    it joins two of its groups.
    """
    held = members.select("band", "value", "rep").join(grouped.select("rep", "component"), "rep")
    sizes = held.groupBy("band", "value", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "value").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("components")).where("components > 1").select("band", "value", "main")
    right = materialize(held.join(mixed, ["band", "value"]), "mixed").join(grouped.select("rep", "shingles"), "rep")
    left = right.where("component <> main")
    blocks = lambda df, name: df.groupBy("band", "value").agg(F.ceil(F.sum(F.octet_length("shingles")) / limit).cast("int").alias(name))
    dealt = blocks(left, "rows").join(blocks(right, "cols"), ["band", "value"])
    own = lambda df, n, salt: df.withColumn(f"own_{n}", F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int"))
    a = own(left.join(dealt, ["band", "value"]), "rows", 1).select("band", "value", F.col("own_rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "rep", "component", "shingles")
    b = own(right.join(dealt, ["band", "value"]), "cols", 2).select("band", "value", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.col("own_cols").alias("col"), "rep", "component", "shingles")
    key = ["band", "value", "row", "col"]
    # Both sides come from the same members; new column ids keep Spark from taking one for the other.
    a, b = (x.select(*(F.col(c).alias(c) for c in [*key, "rep", "component", "shingles"])) for x in (a, b))
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_meet, "src long, dst long").distinct()


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Overlaps of every right set with all left ones through one sorted list of the left's shingles."""
    ids, comps = left["rep"].to_pylist(), left["component"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in left["shingles"].to_pylist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for rep, comp, packed in zip(right["rep"].to_pylist(), right["component"].to_pylist(), right["shingles"].to_pylist()):
        own = np.frombuffer(packed, np.uint64)
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for i in np.flatnonzero((both > 0) & (both >= SIMILARITY * (sizes + len(own) - both))):
            x, y = root(comps[i]), root(comp)
            if x != y:
                group[max(x, y)] = min(x, y)
                out.append((min(ids[i], rep), max(ids[i], rep)))
    return pa.table({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})


def same_document(sig: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links ``(src, dst)`` between the texts that share a doc_id, or None without such."""
    named = sig.where("doc_id is not null").select("doc_id", "text_key")
    several = materialize(named.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("doc_id"), "several")
    if several.isEmpty():
        return None
    held = materialize(named.join(several, "doc_id").join(reps.select("text_key", "rep"), "text_key").select("doc_id", "rep").distinct(), "shared")
    first = held.groupBy("doc_id").agg(F.min("rep").alias("src"))
    return held.join(first, "doc_id").where("rep <> src").select("src", F.col("rep").alias("dst"))


def similar_links(sig: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reps, edges)``: one row ``(text_key, rep, doc_id)`` for each distinct text, with a number of its own and
    its smallest doc_id, and links that join the groups."""
    texts = sig.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    reps = materialize(texts.withColumn("rep", F.monotonically_increasing_id()), "reps")
    members = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    full = members.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    # Members are many more than the texts by whose size Spark would judge them: never broadcast.
    held = materialize(members.hint("merge").join(full, ["band", "value"]), "buckets")
    few = held.where(F.col("n") <= CELL)
    close = few.alias("a").join(few.select("band", "value", F.col("rep").alias("rep2")).alias("b"), ["band", "value"]).where("rep < rep2").select(F.col("rep").alias("src"), F.col("rep2").alias("dst"))
    fps = reps.where(F.size("bands") > 0).groupBy("fp").agg(F.min("rep").alias("node"))
    same = reps.where(F.size("bands") > 0).join(fps, "fp").where("rep <> node").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
    near = links(fps).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = materialize(close.union(same).union(near).distinct(), "pairs")
    ids = pairs.select(F.col("src").alias("rep")).union(pairs.select("dst")).distinct()
    edges = verified(pairs, materialize(shingle_sets(docs, reps.join(ids, "rep")), "sets"))
    if (same_doc := same_document(sig, reps)) is not None:
        edges = edges.union(same_doc)
    large = held.where(F.col("n") > CELL).select("band", "value", "rep")
    if not large.isEmpty():
        edges = dense_links(large, reps, docs, edges)
    return reps.select("text_key", "rep", "doc_id"), edges


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, group_id)`` of every row that has a doc_id."""
    sig = materialize(signatures(docs), "signatures")
    reps, edges = similar_links(sig, docs)
    comps = connected_components(edges).withColumnRenamed("node", "rep")
    held = materialize(comps.join(reps.select("rep", "doc_id"), "rep"), "members")
    least = held.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    of = held.select("rep", "component").join(least, "component").select("rep", "group_id")
    named = reps.join(of, "rep", "left").select("text_key", F.coalesce("group_id", "doc_id").alias("group_id"))
    return sig.where("doc_id is not null").select("doc_id", "text_key").join(named, "text_key")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates."""
    found = materialize(groups(docs).select("doc_id", "group_id"), "groups")
    dropped = found.where("doc_id <> group_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti")
    if found.where("doc_id = group_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.union(kept.where("doc_id is null"))
