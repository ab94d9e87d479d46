"""Operator 9: n-gram scoring by deleted interpolation.

``P(w | v) = l1 * c(v, w) / c(v) + l2 * c(w) / N + l3 / (V + 1)``: maximum-likelihood estimates of
bigram and unigram and a uniform term, mixed by weights that depend on the bucket of the
context's frequency ``c(v)``. A text begins after an end token and closes with one, so the end
token's count is also the number of times it is a context. The weights of each bucket are
learned by expectation-maximisation: counts come from the kept part of the training texts, and the
held-out part (a tenth, by crc32) says how well each estimate predicts. The final counts are those of all
training texts.

Data flow. Texts become chunks of about ``CHUNK`` tokens, each a written row: its documents'
token sequences as indices into its distinct word hashes. A chunk asks for the counts
of its distinct n-grams (63-bit hashes and a bit for the order): one packed request for each
hash range that holds some of them, so that a frequent n-gram is one entry of each chunk and no hot key.
Each range adds up its requests and answers each of them in the order asked. Chunks
meet their answers by chunk number. Counts thus cover the whole corpus, grow with it, and
never stand on one machine. There are as many ranges as keep each at ``RANGE_BYTES`` of keys or less, so a chunk sends no more
messages than it has distinct n-grams, and the work grows with the tokens; where ranges outnumber a chunk's n-grams (some TB of text) messages
hold few keys each and the plan is that of a plain shuffle of n-grams. What comes to the driver is two totals and, for EM, a
histogram of at most ``BUCKETS * (64 * GRID + 1) ** 2`` cells, in practice some thousands. Held-out training texts have chunks of their own, so that EM reads only them.

Defined cases: null and empty texts are one end token; a text of any length stays whole within one chunk; a null doc_id counts as the empty text
for the folds; repeated rows count as often as they occur and are scored alike, and no result depends on the order of ties; without training texts all
counts are 0 and every token has the uniform probability; an empty table gives an empty result; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import as_bytes, blank_words, crc_mod, cut

FOLDS, TEST, HELD = 10, 0, 1
CHUNK = 500_000
BUCKETS = 24
GRID = 4  # steps to a factor of two in the EM histogram
RANGE_BYTES = 4 << 20
END = np.uint64(xxhash.xxh64_intdigest(b"\n end") & ~1)
ROUNDS = 200
PASSED, KEPT, OUT = 0, 1, 2  # parts: evaluation texts; training texts kept; training texts held out for EM


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zlib.compress(raw, 1)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 0, []
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _planes(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences in byte planes, which pack well."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _unplanes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or eight where some don't fit."""
    wide = len(counts) > 0 and int(counts.max()) >= 1 << 32
    return (b"\x08" if wide else b"\x04") + _pack(counts.astype(np.uint64 if wide else np.uint32))


def _unpack_counts(blob: bytes) -> np.ndarray:
    return _unpack(blob[1:], np.uint64 if blob[0] == 8 else np.uint32)[0].astype(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``(chunk, part, tokens, body)``. A body holds doc ids, nulls, token numbers, word hashes and the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 24
        open_ = {p: ([], [], [], {}) for p in (PASSED, KEPT, OUT)}
        serial = 0

        def close(part: int) -> pa.RecordBatch:
            nonlocal serial
            ids, sizes, seq, index = open_[part]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) & ~1 for w in index), np.uint64, len(index))
            body = _pack(
                np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array(sizes, np.int32), hashes,
                np.concatenate(seq).astype(np.int32) if seq else np.empty(0, np.int32),
            )
            open_[part] = [], [], [], {}
            serial += 1
            return pa.RecordBatch.from_arrays([pa.array([base | serial], pa.int64()), pa.array([part], pa.int32()), pa.array([sum(sizes) + len(sizes)], pa.int64()), pa.array([body], pa.binary())], ["chunk", "part", "tokens", "body"])

        held = {PASSED: 0, KEPT: 0, OUT: 0}
        for batch in cut(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                fold = crc_mod(doc_id, FOLDS)
                part = PASSED if fold == TEST else OUT if fold == HELD else KEPT
                ids, sizes, seq, index = open_[part]
                words = blank_words(text)
                ids.append(doc_id), sizes.append(len(words))
                put = index.setdefault
                seq.append(np.array([put(w, len(index)) for w in words], np.int32))
                held[part] += len(words) + 1
                if held[part] >= CHUNK:
                    yield close(part)
                    held[part] = 0
        for part in open_:
            if open_[part][0]:
                yield close(part)

    return as_bytes(docs, "doc_id").mapInArrow(run, "chunk long, part int, tokens long, body binary")


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of word hashes, the lowest bit set."""
    x = v * np.uint64(0x9E3779B97F4A7C15) ^ (v >> np.uint64(31))
    x = (x + w) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


class Body:
    """A chunk's documents with their n-gram keys."""

    def __init__(self, blob: bytes):
        self.ids, self.nulls, self.sizes, hashes, seq = _unpack(blob, np.int64, np.uint8, np.int32, np.uint64, np.int32)
        n = int(self.sizes.sum()) + len(self.sizes)
        self.ends = np.cumsum(self.sizes + 1)  # one past each document's end token
        is_end = np.zeros(n, bool)
        is_end[self.ends - 1] = True
        self.word = np.full(n, END, np.uint64)
        self.word[~is_end] = hashes[seq]
        self.context = np.concatenate([[END], self.word[:-1]]).astype(np.uint64)  # a text begins after an end
        self.bigram = bigram_keys(self.context, self.word)
        keys, counts = np.unique(np.concatenate([self.word, self.bigram]), return_counts=True)
        self.keys, self.counts = keys, counts


def requests(rows: DataFrame, ranges: int) -> DataFrame:
    """``(range, chunk, part, keys)``: the chunk's keys of one hash range, sorted, and their counts if it trains."""
    step = np.uint64(math.ceil(2**64 / ranges)) if ranges > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 1):
            for chunk, part, blob in zip(*(batch[c].to_pylist() for c in ("chunk", "part", "body"))):
                body = Body(blob)
                own = np.zeros(len(body.keys), np.int64) if step is None else (body.keys // step).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                packed = [_pack(_planes(body.keys[a:b]), body.counts[a:b].astype(np.uint32) if part != PASSED else np.empty(0, np.uint32)) for a, b in zip(cuts, cuts[1:])]
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[cuts[:-1]].astype(np.int32)), pa.array([chunk] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(packed, pa.binary())],
                    ["range", "chunk", "part", "keys"],
                )

    return rows.mapInArrow(run, "range int, chunk long, part int, keys binary")


def _answer(table: pa.Table) -> pa.Table:
    """All requests of one range: counts of all training texts and of the kept ones, in the order asked."""
    pa.default_memory_pool().release_unused()  # of the group before
    number = table["range"][0].as_py()
    asked = [_unpack(k, np.uint8, np.uint32) for k in table["keys"].to_pylist()]
    keys = [_unplanes(p) for p, _ in asked]
    parts = table["part"].to_pylist()
    cuts = np.cumsum([0, *map(len, keys)])
    keys = np.concatenate(keys)
    every, place = np.unique(keys, return_inverse=True)
    del keys
    total, kept = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    places = [place[a:b] for a, b in zip(cuts, cuts[1:])]
    for part, at, (_, counts) in zip(parts, places, asked):
        if part != PASSED:
            total[at] += counts  # a request names a key once
            if part == KEPT:
                kept[at] += counts
    answers = [_pack_counts(total[at]) for at in places]
    # Only chunks held out for EM ask for the kept part's counts.
    kepts = [_pack_counts(kept[at]) if part == OUT else None for part, at in zip(parts, places)]
    words = (every & np.uint64(1)) == 0
    sums = _pack(np.array([total[words].sum(), (total[words] > 0).sum(), kept[words].sum(), (kept[words] > 0).sum()], np.int64))
    return pa.table(
        {"range": pa.array([number] * (len(answers) + 1), pa.int32()), "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()), "part": pa.array([*parts, -1], pa.int32()), "counts": pa.array([*answers, sums], pa.binary()), "kept": pa.array([*kepts, None], pa.binary())}
    )


def answers(asked: DataFrame) -> DataFrame:
    return asked.groupBy("range").applyInArrow(_answer, "range int, chunk long, part int, counts binary, kept binary")


def _met(left: pa.Table, right: pa.Table, kept: bool = False):
    """A chunk's body and the count of each of its tokens' word, context and bigram."""
    pa.default_memory_pool().release_unused()  # of the group before
    body = Body(left["body"][0].as_py())
    order = sorted(zip(right["range"].to_pylist(), right["kept" if kept else "counts"].to_pylist()))
    counts = np.concatenate([_unpack_counts(c) for _, c in order])
    find = lambda k: counts[np.searchsorted(body.keys, k)]
    word = find(body.word)
    end = counts[np.searchsorted(body.keys, END)]
    context = np.concatenate([[end], word[:-1]])
    return body, word, context, find(body.bigram)


def buckets(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 and the whole logarithm of base 2, up to ``BUCKETS - 1``."""
    return np.minimum(BUCKETS - 1, np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0))


def _steps(p: np.ndarray) -> np.ndarray:
    """Probabilities on a logarithmic grid; -1 for zero."""
    return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * GRID).astype(int), -1)


def histogram(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``(bucket, p1, p2, n)`` of the held-out training tokens: how often each pair of grid steps occurs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "p1": pa.array([], pa.int32()), "p2": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        _, word, context, pair = _met(left, right, kept=True)
        cells = np.stack([buckets(context), _steps(pair / np.maximum(context, 1)), _steps(word / max(n, 1))], 1)
        each, times = np.unique(cells, axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(each[:, 0].astype(np.int32)), "p1": pa.array(each[:, 1].astype(np.int32)), "p2": pa.array(each[:, 2].astype(np.int32)), "n": pa.array(times)})

    out = F.col("part") == OUT
    pairs = rows.where(out).groupBy("chunk").cogroup(found.where(out).groupBy("chunk")).applyInArrow(run, "bucket int, p1 int, p2 int, n long")
    return pairs.groupBy("bucket", "p1", "p2").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """EM for each bucket's three weights from rows ``(bucket, p1, p2, n)``; a bucket without data takes all buckets' weights."""
    p = lambda s: np.where(s < 0, 0.0, 2.0 ** (-s / GRID))

    def fit(c: np.ndarray, first: bool) -> np.ndarray:
        probs = np.stack([p(c[:, 1]), p(c[:, 2]), np.full(len(c), uniform)], 1)
        w = np.array([0.5, 0.4, 0.1]) if first else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            share = probs * w
            share *= (c[:, 3] / np.maximum(share.sum(1), 1e-300))[:, None]
            new = share.sum(0) + np.array([0.0, 0.0, 1e-3])  # no text is impossible
            new /= new.sum()
            if np.abs(new - w).max() < 1e-10:
                break
            w = new
        return w

    every = fit(cells, True) if len(cells) else np.array([0.0, 0.5, 0.5])
    out = np.tile(every, (BUCKETS, 1))
    out[0] = [0.0, every[0] + every[1], every[2]]
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b] if len(cells) else cells
        if len(own):
            out[b] = fit(own, b > 0)
    return out


FIELDS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def scores(rows: DataFrame, found: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        body, word, context, pair = _met(left, right)
        w = weights[buckets(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        del w, pair, context
        if not n:
            p[:] = 1 / (v + 1)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.concatenate([[0], body.ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        ids = pa.array(body.ids, mask=body.nulls.astype(bool))
        part = left["part"][0].as_py()
        return pa.table(
            [ids, pa.array([part == PASSED] * len(starts)), pa.array(add(np.ones(len(word), np.int64))), pa.array(add((word > 0).astype(np.int64))), pa.array([n] * len(starts), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))],
            FIELDS,
        )

    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _totals(found: DataFrame) -> np.ndarray:
    """Training tokens, distinct ones, and the same of the kept part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([_unpack(c, np.int64)[0] for c in batch["counts"].to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], list("abcd"))

    sums = found.where("chunk = -1").select("counts").mapInArrow(run, "a long, b long, c long, d long")
    row = sums.agg(*(F.sum(c) for c in "abcd")).first()
    return np.array([x or 0 for x in row])


def score_corpus(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Learns from the training folds of ``docs`` and scores every row."""
    spark = docs.sparkSession
    rows = materialize(chunks(docs), "chunks", packed=True)
    tokens = rows.agg(F.sum("tokens")).first()[0] or 0
    # A word and a bigram of eight bytes for each token, at most.
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(16 * tokens / RANGE_BYTES))
    found = materialize(answers(requests(rows, ranges)), "answers", packed=True)
    n, v, kept_n, kept_v = map(int, _totals(found))
    cells = histogram(rows, found, kept_n).toPandas().to_numpy(np.int64).reshape(-1, 4)
    weights = learn_weights(cells, 1 / (kept_v + 1))
    return scores(rows, found.where("chunk >= 0"), weights, n, v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
