"""Operator 1: URL filters by rules, host word segmentation and naive Bayes.

A rule is a host and a path beginning with a verdict; it fits its host and all subdomains
where the url's path begins with the rule's. The longest fitting rule decides. Where none
fits, the method decides: names are split into words by a unigram Viterbi search, and
multinomial naive Bayes scores the words of host and path.

Unigram model: counts of the letter runs in paths and hyphenated host labels of all pages, with a
list of fixed words. The classes are taught by the pages that rules judge, with the rule's verdict as the class; words that
the rules name are no features, so the method can't restate them but tells by the other words what the
rules' pages have in common. Both models keep every word in a distributed
table. Pages are dealt by place into chunks of at most ``1 << CHUNK_BITS``; a chunk is joined with the counts
of those words only that its names can hold, so that a word met everywhere is one row for each chunk.

Hosts and paths recur on many pages, so each distinct pair of them is segmented and scored once for a chunk.

Defined cases: a null or empty url or one without ``://`` has empty host and path, fits no rule and has no
words, so that the class shares decide; odds of zero (a tie, or no page that a rule judges) allow; of equally probable splits the one
whose last word begins first is taken; letter runs of any length are split whole, in
words of at most ``LONGEST`` letters that the model knows or of any length that it doesn't; repeated rows are judged alike and teach as often as they occur; an empty table gives an
empty result; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SMOOTHING, LONGEST, CHUNK_BITS = 1.0, 24, 15

# Common words of names.
COMMON = (
    "adult", "art", "bank", "best", "bet", "bets", "blog", "book", "buy", "card", "casino", "cheap", "city", "click", "cloud", "data", "deal", "drug", "farm", "fast", "file",
    "food", "free", "game", "games", "gold", "health", "help", "home", "hot", "info", "job", "land", "life", "live", "loan", "loans", "mail", "map", "media", "money", "music",
    "net", "news", "online", "page", "pharmacy", "photo", "pills", "play", "poker", "price", "prize", "replica", "school", "science", "shop", "site", "spam", "sport", "store",
    "tech", "time", "travel", "video", "web", "win", "work", "world",
)
COMMON_COUNT = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")
    return pages.withColumn("_rest", rest).withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_column(rules=RULES):
    """The struct ``(rule, verdict)`` of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letter_runs(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class Segmenter:
    """The most probable split of a letter run under a unigram model. ``counts`` may be only those words of the
    model that the runs can hold, if ``total`` is given."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.known: dict[str, tuple[str, ...]] = {}

    def word_cost(self, word: str) -> float:
        """Unknown words cost more with each letter, more than a split into known ones."""
        return self.cost.get(word) or math.log(self.total) + math.log(10) * len(word)

    def split(self, name: str) -> tuple[str, ...]:
        if (found := self.known.get(name)) is None:
            best, back = [0.0], [0]
            for end in range(1, len(name) + 1):
                cost, start = min((best[s] + self.word_cost(name[s:end]), s) for s in range(max(0, end - LONGEST), end))
                best.append(cost)
                back.append(start)
            words, end = [], len(name)
            while end:
                words.append(name[back[end] : end])
                end = back[end]
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[name] = tuple(reversed(words))
        return found

    def words(self, text: str) -> list[str]:
        return [w for run in letter_runs(text) for w in self.split(run)]


def name_counts(pages: DataFrame) -> DataFrame:
    """``(w, n)``: how often each letter run occurs in paths and in host labels with hyphens, and the
    fixed words. A label without hyphens may be several words, so it teaches none."""
    parted = F.concat_ws("/", F.filter(F.split("host", r"\."), lambda x: x.contains("-")))
    runs = pages.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws("/", parted, "path")), F.lit(r"(\p{L}+)"))).alias("w"), F.lit(1).cast("long").alias("n"))
    fixed = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, COMMON))).alias("w"), F.lit(COMMON_COUNT).cast("long").alias("n"))
    return runs.union(fixed).groupBy("w").agg(F.sum("n").alias("n"))


def pieces(pages: DataFrame) -> DataFrame:
    """``(chunk, w)``: what could be a word in the names of each chunk's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, set()
        for batch in cut(batches, 1000):
            chunks, out = [], []
            for chunk, host, path in zip(*(batch[c].to_pylist() for c in ("chunk", "host", "path"))):
                if chunk != now:
                    now, known = chunk, set()
                for name in letter_runs(host + "/" + path):
                    if name not in known:
                        known.add(name)
                        own = {name[a:b] for b in range(1, len(name) + 1) for a in range(max(0, b - LONGEST), b)}
                        out += own
                        chunks += [chunk] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(out, pa.string())], ["chunk", "w"])

    return pages.select("chunk", "host", "path").mapInArrow(run, "chunk long, w string").distinct()


def by_chunk(pages: DataFrame, words: DataFrame, run, schema: str) -> DataFrame:
    """``run(pages, words)`` of each chunk. New column ids keep Spark from taking one side for the other."""
    a, b = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (pages, words))
    return a.groupBy("chunk").cogroup(b.groupBy("chunk")).applyInArrow(run, schema)


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def _tokens(host: str, path: str, segmenter: Segmenter, skip: frozenset[str]) -> list[str]:
    return [w for w in segmenter.words(host + "/" + path) if w not in skip]


def rule_words(rules=RULES) -> frozenset[str]:
    return frozenset(w for host, path, _ in rules for w in re.findall(r"[^\W\d_]+", (host + path).lower()))


def segmented(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages``, which have a chunk, with ``host_words`` and the features ``tokens``."""
    counts = materialize(name_counts(pages), "names")
    total, skip, names = counts.agg(F.sum("n")).first()[0], rule_words(rules), pages.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seg = Segmenter(dict(zip(right["w"].to_pylist(), right["n"].to_pylist())), total)
        seen: dict[tuple[str, str], tuple[str, list[str]]] = {}
        out = []
        for key in zip(left["host"].to_pylist(), left["path"].to_pylist()):
            if (found := seen.get(key)) is None:
                found = seen[key] = " ".join(seg.words(key[0])), _tokens(*key, seg, skip)
            out.append(found)
        return pa.table([*(left[c] for c in names), pa.array([w for w, _ in out], pa.string()), pa.array([t for _, t in out], pa.list_(pa.string()))], [*names, "host_words", "tokens"])

    return by_chunk(pages, pieces(pages).join(counts, "w"), run, schema_of(pages, "host_words string", "tokens array<string>"))


def class_counts(split: DataFrame, rules=RULES) -> tuple[DataFrame, tuple[int, int]]:
    """``(w, a, b)``, the places of each word in the pages that rules allow and block, and the pages of each class."""
    taught = split.select("tokens", (rule_column(rules)["verdict"] == "block").cast("long").alias("block")).where("block is not null")
    docs = taught.agg(F.sum(1 - F.col("block")), F.sum("block")).first()
    words = taught.select(F.explode("tokens").alias("w"), "block").groupBy("w").agg(F.sum(1 - F.col("block")).alias("a"), F.sum("block").alias("b"))
    return words, (docs[0] or 0, docs[1] or 0)


class NaiveBayes:
    """Log odds of ``block`` against ``allow`` for a multiset of words. ``words`` may be only those scored, if
    ``totals``, the model's places of each class and its number of words, are given."""

    def __init__(self, words: dict[str, tuple[int, int]], docs: tuple[int, int], totals: tuple[int, int, int] | None = None):
        allow, block, n = totals or (sum(a for a, _ in words.values()), sum(b for _, b in words.values()), len(words))
        v = n + 1
        self.prior = math.log((docs[1] + 1) / (docs[0] + 1))
        self.odds = {w: math.log((b + SMOOTHING) / (block + SMOOTHING * v)) - math.log((a + SMOOTHING) / (allow + SMOOTHING * v)) for w, (a, b) in words.items()}

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def judge(pages: DataFrame, rules=RULES, url: str = "url", carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``carry``, ``host``, ``path``, ``rule``, ``verdict``, ``host_words``, ``features``, ``block_odds`` and ``method``, the verdict of
    the method alone, of every page."""
    key = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("key")
    parts = with_parts(pages.select(key, F.col(url).cast("string").alias("url"))).select("key", "host", "path")
    dealt = materialize(parts.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "parts")
    split = materialize(segmented(dealt, rules), "split")
    words, docs = class_counts(split, rules)
    words = materialize(words, "words")
    totals = tuple(x or 0 for x in words.agg(F.sum("a"), F.sum("b"), F.count("*")).first())
    names = split.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nb = NaiveBayes({w: (a, b) for w, a, b in zip(*(right[c].to_pylist() for c in ("w", "a", "b")))}, docs, totals)
        return pa.table([*(left[c] for c in names), pa.array([nb.score(t) for t in left["tokens"].to_pylist()], pa.float64())], [*names, "block_odds"])

    held = split.select("chunk", F.explode("tokens").alias("w")).distinct().join(words, "w")
    method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    scored = by_chunk(split, held, run, schema_of(split, "block_odds double")).withColumn("_r", rule_column(rules))
    return scored.select(
        *(F.col("key").getField(c).alias(c) for c in carry), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"),
        "host_words", F.array_join("tokens", " ").alias("features"), "block_odds", method.alias("method"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
