"""Operator 10: benchmark decontamination with a generalised suffix automaton.

The words of all test items build one automaton whose states are classes of word
sequences of the items. A document streams through it once; at each word the state and
the matched length tell the longest suffix read so far that occurs in some item. Where
that length reaches a window (10 words, or a whole shorter item) the window's words are
hit.

Items are cut into pieces of at most a quarter of ``BLOCK_WORDS`` words, which overlap by a window less one
word, and pieces are dealt into blocks of at most ``BLOCK_WORDS`` words. The driver builds one block's automaton
at a time from a collect of that bound and broadcasts it; blocks run as jobs one after another, each of which writes the hits that it
finds by text, so that an executor core holds one automaton. A benchmark of one block, as most are, is a
single pass without a write or a shuffle. Held compactly, an automaton takes some 300 bytes for each word of its items
in every Python worker (measured over half a million words): at most 150 MB.

Defined cases: a null or empty text has no words and no hits; texts of any length are streamed whole; null and repeated items
are taken as given (a null item id is the empty string in the digest); rows that share an item id are one item of the digest; an empty benchmark hits nothing;
repeated documents are judged alike; where several windows end at one word all count, so there are no ties; an empty table gives an empty result;
other columns of either table, whatever their names, are passed by or kept.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import ALNUM, alnum_words, as_bytes, cut

WINDOW = 10
BLOCK_WORDS = 500_000


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each window.

    Words are numbered. Most states have one way on, which is held in two arrays; only the other ways
    of states that branch, and those of the root, are in dictionaries. Likewise most windows belong to one item.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.next, self.link, self.length = (array("i", [x]) for x in (-1, 0, -1, 0))
        self.branch: dict[int, dict[int, int]] = {0: {}}
        self.names = list(dict.fromkeys(name for name, _ in items))
        number = {name: i for i, name in enumerate(self.names)}
        ends, short = _Owners(), _Owners()
        for name, words in items:
            last, item = 0, number[name]
            for word in words:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if len(words) >= window:
                    ends.add(last, item)
            if words and len(words) < window:
                short.add(last, item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.window_state, self.window_items = self._windows(order, ends)
        self.nearest_short, self.short_items = self._shorts(order, short), short

    def _way(self, state: int, word: int) -> int | None:
        if self.word[state] == word:
            return self.next[state]
        more = self.branch.get(state)
        return None if more is None else more.get(word)

    def _put(self, state: int, word: int, to: int) -> None:
        if state and self.word[state] in (-1, word):
            self.word[state], self.next[state] = word, to
        else:
            self.branch.setdefault(state, {})[word] = to

    def _new(self, link: int, length: int) -> int:
        self.word.append(-1), self.next.append(0), self.link.append(link), self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._new(self.link[q], self.length[p] + 1)
        self.word[clone], self.next[clone] = self.word[q], self.next[q]
        if q in self.branch:
            self.branch[clone] = dict(self.branch[q])
        while p != -1 and self._way(p, word) == q:
            self._put(p, word, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self._way(last, word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._new(0, self.length[last] + 1), last
        while p != -1 and (q := self._way(p, word)) is None:
            self._put(p, word, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def _windows(self, order: list[int], ends: "_Owners"):
        """For each state, the state that holds its suffix of ``window`` words (-1: none), and
        for each of those the items in which that window occurs."""
        at, owners = array("i", [-1]) * len(self.link), _Owners()
        for s in order:
            if self.length[s] >= self.window:
                at[s] = s if self.length[self.link[s]] < self.window else at[self.link[s]]
                for item in ends.of(s):
                    owners.add(at[s], item)
        return at, owners

    def _shorts(self, order: list[int], short: "_Owners"):
        """For each state, itself or the nearest suffix state that is a whole short item (-1: none)."""
        at = array("i", [-1]) * len(self.link)
        for s in order:
            at[s] = s if short.of(s) else at[self.link[s]]
        return at

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint hit spans ``[start, end)`` in order, and the items whose windows occur."""
        known, first, then, branch = self.vocabulary.get, self.word, self.next, self.branch
        link, length, window = self.link, self.length, self.window
        at, short = self.window_state, self.nearest_short
        any_short = bool(self.short_items.one)
        root, state, n = branch[0], 0, 0
        spans: list[list[int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        for i, text in enumerate(words):
            word = known(text)
            if word is None:
                state = n = 0
                continue
            while state:
                if first[state] == word:
                    state = then[state]
                    n += 1
                    break
                if state in branch and (nxt := branch[state].get(word)) is not None:
                    state = nxt
                    n += 1
                    break
                state = link[state]
                n = length[state]
            else:
                state = root.get(word, 0)
                n = 1
            hit = 0
            if n >= window:
                hit = window
                if (w := at[state]) not in seen:
                    seen.add(w)
                    found.update(self.window_items.of(w))
            if any_short:
                s = short[state]
                if s != -1 and length[s] > n:
                    s = short[link[s]]
                while s > 0:
                    hit = max(hit, length[s])
                    if -s in seen:
                        break
                    seen.add(-s)
                    found.update(self.short_items.of(s))
                    s = short[link[s]]
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [tuple(s) for s in spans], {self.names[x] for x in found}


class _Owners:
    """Item numbers of states: most have one."""

    def __init__(self):
        self.one: dict[int, int] = {}
        self.more: dict[int, set[int]] = {}

    def add(self, state: int, item: int) -> None:
        if self.one.setdefault(state, item) != item:
            self.more.setdefault(state, set()).add(item)

    def of(self, state: int):
        own = self.one.get(state)
        return () if own is None else (own, *self.more.get(state, ()))


def item_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items as ``(item, words)`` in blocks of at most ``block_words`` words (or two pieces, if that is more)."""
    size = max(block_words // 4, 4 * window)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            ids, bodies, sizes = [], [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                words = alnum_words(text)
                for a in range(0, max(1, len(words) - window + 1), size):
                    piece = words[a : a + size + window - 1]
                    if piece:
                        ids.append(item), bodies.append(b" ".join(piece)), sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.int64())], ["item", "words", "n"])

    cols = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    rows = as_bytes(cols, "item").mapInArrow(pieces, "item string, words binary, n long")
    most, blocks = max(block_words, 2 * (size + window - 1)), 2
    if (rows.agg(F.sum("n")).first()[0] or 0) <= most:
        return [rows.select("item", "words")]
    # Equal pieces would fall into one block however many there are.
    rows = materialize(rows.distinct().withColumn("h", F.xxhash64("item", "words")), "items")
    while True:
        own = F.pmod("h", F.lit(blocks))
        if (rows.groupBy(own.alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
            return [rows.where(own == b).select("item", "words") for b in range(blocks)]
        blocks *= 2


def _automaton(block: DataFrame, window: int) -> SuffixAutomaton:
    rows = block.collect()  # at most a block's words
    return SuffixAutomaton([(r.item, bytes(r.words).split()) for r in sorted(rows)], window)


FOUND = (T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``n_words``, ``spans`` (hit word ranges, flat pairs), ``items`` and the text (as bytes) of
    each document."""
    found = _hits(docs, benchmark, window, block_words, carry)
    return found.select(*(F.col("carry").getField(c).alias(c) for c in carry), "n_words", "spans", "items", "text")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, carry: tuple[str, ...], finish=None) -> DataFrame:
    """``carry``, a struct of the columns, so that no name can clash, ``text``, ``n_words``, ``spans`` and ``items``; or ``carry`` and
    ``text`` as ``finish`` makes them of a batch of these, in the same worker."""
    spark = docs.sparkSession
    kept = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    rows = as_bytes(docs.select(kept.alias("carry"), "text"), "carry")
    blocks = item_blocks(benchmark, window, block_words)
    schema = rows.schema if finish else T.StructType([*rows.schema, *FOUND])
    finish = finish or (lambda batch: batch)
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(_automaton(blocks[0], window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in cut(batches):
                out = [(len(w), *automaton.scan(w)) for w in map(alnum_words, batch["text"].to_pylist())]
                yield finish(_with_found(batch, [n for n, _, _ in out], [[x for s in spans for x in s] for _, spans, _ in out], [sorted(names) for _, _, names in out]))

        return rows.mapInArrow(scan, schema)
    texts = rows.select("text", F.md5("text").alias("key"))
    parts = [_block_hits(texts, block, window) for block in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.distinct().groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def unite_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            n = [len(alnum_words(t)) for t in batch["text"].to_pylist()]
            spans = [unite(zip(x[::2], x[1::2])) if x else [] for x in batch["spans"].to_pylist()]
            yield finish(_with_found(batch.select(["carry", "text"]), n, spans, [sorted(x or ()) for x in batch["items"].to_pylist()]))

    joined = rows.withColumn("key", F.md5("text")).join(merged, "key", "left").select("carry", "text", "spans", "items")
    return joined.mapInArrow(unite_all, schema)


def _with_found(batch: pa.RecordBatch, n: list[int], spans: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
    more = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "n_words", "spans", "items"])


def _block_hits(texts: DataFrame, block: DataFrame, window: int) -> DataFrame:
    """``(key, spans, items)`` of the texts that one block hits, written."""
    shared = texts.sparkSession.sparkContext.broadcast(_automaton(block, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in cut(batches):
            keys, spans, items = [], [], []
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                own, names = automaton.scan(alnum_words(text))
                if own:
                    keys.append(key), spans.append([x for s in own for x in s]), items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["key", "spans", "items"])

    out = materialize(texts.mapInArrow(scan, "key string, spans array<int>, items array<string>"), "hits")
    shared.destroy()
    return out


def unite(spans) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of operator 10's query: counts, and the items found."""
    found = hits(docs, benchmark, window)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(-x.cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _remove(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans, nor the gaps inside a span."""
    flat, pos, starts, ends = text.translate(ALNUM), 0, [], []
    for word in flat.split():
        pos = flat.index(word, pos)
        starts.append(pos)
        pos += len(word)
        ends.append(pos)
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans; a document of which hit words cover more than
    ``max_coverage`` goes altogether. Texts without hits stay byte for byte; a null text
    comes back empty."""
    columns = docs.columns

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, texts = [], []
        for i, (n, spans, text) in enumerate(zip(batch["n_words"].to_pylist(), batch["spans"].to_pylist(), batch["text"].to_pylist())):
            hit = sum(spans[1::2]) - sum(spans[::2])
            if hit and hit > max_coverage * n:
                continue
            keep.append(i)
            texts.append(_remove(text, spans) if hit else text)
        return pa.RecordBatch.from_arrays([batch["carry"].take(pa.array(keep, pa.int64())), pa.array(texts, pa.binary())], ["carry", "text"])

    out = _hits(docs, benchmark, window, block_words, tuple(c for c in columns if c != "text"), clean)
    return out.select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col("carry").getField(c).alias(c) for c in columns))


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(docs, benchmark)
