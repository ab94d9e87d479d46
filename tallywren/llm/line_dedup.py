"""Operator 8: line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped of blanks at both ends with A-Z lowered; keys of fewer
than ``MIN_CHARS`` code points are never touched. Documents come in batches of rising
doc_id. The store keeps sorted runs of ``(key hash, owner)``: a batch merge-anti-joins its
keys against the runs, gives each new key to the smallest doc_id of the batch that holds
it, and writes those as a new run of level 0. When a level holds ``FANOUT`` runs they are
merged into one run of the next level, so that B batches leave O(log B) runs and each key is
rewritten O(log B) times. Runs are bucketed and sorted on the hash, so that a batch meets
them in a merge join without moving them.

A document loses every line of which the owner is another document. Keys are hashed to
128 bits; documents are dealt by doc_id only, so that a line that many share is one small
row for each holder, and AQE splits its join.

Defined cases: a null or empty text is one empty line; a text or line of any length is read whole; lines of documents without a
doc_id are kept and own nothing; rows that share a doc_id, and repeated rows, hold their lines as one
document; of several documents that hold a line the smallest doc_id owns it, so there are no ties; an empty table gives an empty result; other columns, whatever their names, are passed by or kept.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path, remove_path, scratch
from .common import as_bytes, cut

MIN_CHARS, FANOUT, BATCHES = 10, 3, 4
PIECE = 16


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return key


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2)`` once for each document and distinct key."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            ids, found = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = {line_hash(k) for x in text.split(b"\n") if (k := line_key(x)) is not None}
                found.extend(own)
                ids.extend([doc_id] * len(own))
            both = pa.array(found, pa.binary(PIECE))
            words = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, both.buffers()[1]]).to_numpy() if found else pa.array([], pa.int64()).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words[0::2]), pa.array(words[1::2])], ["doc_id", "h1", "h2"])

    return as_bytes(docs.where("doc_id is not null"), "doc_id").mapInArrow(hashes, "doc_id long, h1 long, h2 long")


class LineRuns:
    """The levelled store. One writer at a time adds batches of rising doc_id."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1").option("path", new_path(self.spark, name)).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def table(self) -> DataFrame:
        """All ``(h1, h2, owner)``."""
        return self._union([self.spark.table(n) for n in self.runs()])

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch`` has ``(doc_id, h1, h2)``; keys that no run holds become a run."""
        new = batch.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for name in self.runs():
            new = new.join(self.spark.table(name), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new))
        self._compact()

    def _compact(self) -> None:
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self._write(self._union([self.spark.table(n) for n in names]))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                for n in names:
                    self._drop(n)

    def drop(self) -> None:
        """Removes all runs."""
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"describe extended {name}").where("col_name = 'Location'").first()
        self.spark.sql(f"drop table {name}")
        if path:
            remove_path(self.spark, path["data_type"])


def lost_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, lost)``: for each document that loses lines, their key hashes (16 bytes each,
    joined). The runs and the table of lines are removed once it is written."""
    spark = docs.sparkSession
    out = new_path(spark, "lost")
    with scratch(spark):
        lines = materialize(line_hashes(docs), "lines")
        store = LineRuns(spark)
        try:
            cuts = lines.select(F.expr(f"approx_percentile(doc_id, array({', '.join(str(i / batches) for i in range(1, batches))}), 1000)")).first()[0] or [0] if batches > 1 else []
            edges = [None, *dict.fromkeys(cuts), None]
            for low, high in zip(edges, edges[1:]):
                part = lines if low is None else lines.where(F.col("doc_id") > low)
                store.add(part if high is None else part.where(F.col("doc_id") <= high))
            piece = F.concat(*(F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")))
            lost = lines.join(store.table(), ["h1", "h2"]).where("doc_id <> owner").select("doc_id", piece.alias("h"))
            lost = lost.groupBy("doc_id").agg(F.collect_set("h").alias("lost"))
            lost.write.parquet(out)
        finally:
            store.drop()
    return spark.read.schema(lost.schema).parquet(out)


def _as_hex_pair(digest: bytes) -> bytes:
    """The digest's two little-endian longs as big-endian bytes, as SQL's hex() writes them."""
    return digest[7::-1] + digest[:7:-1]


def with_lost(docs: DataFrame, carry: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``carry``, rows of ``docs`` with a ``doc_id``, with ``lost``."""
    return carry.join(lost_lines(docs, batches), "doc_id", "left")


def _split(text: bytes, lost) -> tuple[list[bytes], int]:
    """The lines that stay, and the number of lines before."""
    lines = text.split(b"\n")
    if not lost:
        return lines, len(lines)
    gone = set(lost)
    return [x for x in lines if (k := line_key(x)) is None or _as_hex_pair(line_hash(k)) not in gone], len(lines)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, drop_empty: bool = False) -> DataFrame:
    """``docs`` with the lines gone that an earlier document owns. With ``drop_empty`` a document of
    which no word stays goes, if it lost lines; untouched texts stay byte for byte."""
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "text")]
    # Other columns travel in one struct, so that no name of theirs can meet one of ours.
    carry = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    joined = with_lost(docs, carry, batches).select("doc_id", "text", "rest", "lost")

    def rebuild(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(found):
            keep, texts = [], []
            for i, (text, lost) in enumerate(zip(batch["text"].to_pylist(), batch["lost"].to_pylist())):
                if lost and text is not None:
                    text = b"\n".join(_split(text.encode(), lost)[0]).decode()
                    if drop_empty and not text.strip():
                        continue
                keep.append(i)
                texts.append(text)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["doc_id"], pa.array(texts, pa.string()), kept["rest"]], ["doc_id", "text", "rest"])

    out = joined.mapInArrow(rebuild, carry.schema)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns))


def report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    joined = with_lost(docs, docs.select("doc_id", "text"), batches)

    def digests(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(found):
            n, dropped, sha = [], [], []
            for text, lost in zip(batch["text"].to_pylist(), batch["lost"].to_pylist()):
                kept, before = _split(text, lost)
                n.append(before)
                dropped.append(before - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return as_bytes(joined, "doc_id", "lost").mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key),
m as (select k.*, coalesce(o.owner <> k.doc_id, false) as gone from k left join o on k.key = o.key)
select doc_id, count(*)::bigint as n_lines, sum(gone::bigint)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
