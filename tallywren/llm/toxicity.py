"""Operator 5: toxicity by Levenshtein automata run against a lexicon trie.

Lexicon: forms learned from the labelled training rows. A form is a word, or a stem of 4 to 8
letters standing for all words that begin with it; it enters if toxic rows hold it far
beyond chance (a likelihood-ratio test). A row votes by the neighbourhood of the form's
first place, and equal neighbourhoods count once, so that copies of a passage do not vote. Forms that another form already covers go.

Matching: the trie of forms and the Levenshtein automaton of each form's edit allowance are
intersected and made deterministic lazily: a state is the set of (trie node, edits so
far) pairs, and a (state, character) step is computed once and kept. Most words reach the
empty state within a few characters.

Score: each match counts by its form's strength and its context window. Inside quotation marks, or beside words of
reporting or defining, it counts little; plain use counts in full. The sums of exact and
misspelled matches, which saturate, and their density enter a logistic model fitted on the same rows.

The model learns from at most ``SAMPLE`` labelled rows (those with the smallest hash of
doc_id), never from rows whose crc32(doc_id) mod 4 is 2; labels, lang, source and doc_id are
no inputs of a score. The lexicon holds every form that passes the test; each needs ``MIN_SEEN`` places of its own in
toxic rows of that sample, which bounds what is broadcast.

Defined cases: null and empty texts have no matches and the score of such; texts of any length are matched whole;
forms of equal distance from a word are told apart by strength; null labels and labels without a doc_id
teach nothing; repeated label rows count once (a row labelled both ways is toxic); repeated documents are scored alike, and a
labelled one teaches as often as it occurs, but equal places count once; an empty table gives an empty result;
without usable labels every score is 0; other columns, whatever their names, are passed by or kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import ALNUM, alnum_words, as_bytes, crc_mod_col, cut

SAMPLE, THRESHOLD = 12_000, 0.3
STEMS = range(4, 9)
MIN_G, MIN_RATIO, FULL_RATIO, MIN_SEEN = 28.0, 8.0, 200.0, 3
FOLDS, HELD = 4, 2
WINDOW_BYTES = 80
QUOTED_WEIGHT, SATURATION = 0.25, 4.0

# Marks and words that point to quotation or definition rather than use.
OPENERS = "“«‘„\""
CLOSERS = "”»’“\""
REPORTING = ("said", "says", "quote", "quoted", "quotes", "quoting", "wrote", "called", "term", "word", "words", "means", "meaning", "defined", "definition", "example", "slur", "insult", "insults", "reported", "allegedly", "translation")


NONE = (99, 0.0)


class FormMatcher:
    """Deterministic product of the lexicon trie and the forms' Levenshtein automata. ``forms``
    maps a word, or a stem with a star, to its strength."""

    def __init__(self, forms: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word, self.stem, self.reach = [(-1, 0.0)], [(-1, 0.0)], [0]
        for form, strength in forms.items():
            body, stem = form.rstrip("*"), form.endswith("*")
            k, node = allowance(body, stem), 0
            self.reach[0] = max(self.reach[0], k)
            for ch in body:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = self.child[node][ch] = len(self.child)
                    self.child.append({}), self.word.append((-1, 0.0)), self.stem.append((-1, 0.0)), self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], k)
            (self.stem if stem else self.word)[node] = (k, strength)
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.accept: list[tuple[int, float]] = []
        self.done: list[tuple[int, float]] = []
        self.steps: list[dict[str, int]] = []
        self.start, self.dead = self._state({0: 0}, NONE), self._state({}, NONE)

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Adds the states reached by leaving out characters of a form."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for c in self.child[node].values():
                if e + 1 <= self.reach[c] and nodes.get(c, 99) > e + 1:
                    nodes[c] = e + 1
                    todo.append((c, e + 1))
        return nodes

    @staticmethod
    def _best(found) -> tuple[int, float]:
        """Fewest edits first, then the strongest form."""
        return min(found, key=lambda x: (x[0], -x[1]))

    def _state(self, nodes: dict[int, int], done: tuple[int, float]) -> int:
        nodes = self._close(nodes)
        done = self._best([done, *((e, self.stem[n][1]) for n, e in nodes.items() if e <= self.stem[n][0])])
        key = (done, *sorted(nodes.items()))
        if (at := self.ids.get(key)) is None:
            at = self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.done.append(done)
            self.accept.append(self._best([done, *((e, self.word[n][1]) for n, e in nodes.items() if e <= self.word[n][0])]))
            self.steps.append({})
        return at

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e + 1 <= self.reach[node] and out.get(node, 99) > e + 1:
                out[node] = e + 1
            for c, nxt in self.child[node].items():
                cost = e + (c != ch)
                if cost <= self.reach[nxt] and out.get(nxt, 99) > cost:
                    out[nxt] = cost
        return self._state(out, self.done[state])

    def match(self, word: str) -> tuple[int, float] | None:
        """``(edits, strength)`` of the form nearest to the word within its allowance."""
        state, steps, dead = self.start, self.steps, self.dead
        for ch in word:
            nxt = steps[state].get(ch)
            if nxt is None:
                nxt = steps[state][ch] = self._step(state, ch)
            if nxt == dead:
                return None
            state = nxt
        found = self.accept[state]
        return found if found[0] < 99 else None


def allowance(form: str, stem: bool) -> int:
    """Edits forgiven: short forms would meet too many other words."""
    n = len(form) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


def forms_of(word: str) -> list[str]:
    """The word itself, and its stems marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def sample_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``(doc_id, toxic, text)`` of at most ``size`` labelled rows outside the held-out fold."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
        .where(crc_mod_col("doc_id", FOLDS) != HELD)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    # At most ``size`` ids and flags.
    return as_bytes(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "doc_id", "toxic")


def form_counts(sample: DataFrame) -> DataFrame:
    """``(form, toxic, clean)``: distinct neighbourhoods in toxic rows, rows among the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        for batch in cut(batches):
            seen: set[tuple[str, int]] = set()
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                words = alnum_words(text)
                if not toxic:
                    clean.update({f for w in {*words} for f in forms_of(w.decode("utf-8", "replace"))})
                    continue
                first: dict[str, int] = {}
                for i, w in enumerate(words):
                    for f in forms_of(w.decode("utf-8", "replace")):
                        first.setdefault(f, i)
                near = [xxhash.xxh64_intdigest(b" ".join([*words[max(0, i - 2) : i], b"|", *words[i + 1 : i + 3]])) >> 1 for i in range(len(words))]
                seen.update((f, near[i]) for f, i in first.items())
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64()), pa.array([0] * len(seen), pa.int64())], ["form", "near", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array(list(clean), pa.string()), pa.array([None] * len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], ["form", "near", "clean"])

    rows = sample.mapInArrow(run, "form string, near long, clean long")
    each = rows.groupBy("form", "near").agg(F.sum("clean").alias("clean"))
    return each.groupBy("form").agg(F.count("near").alias("toxic"), F.sum("clean").alias("clean"))


def learn_forms(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The lexicon: forms, stems with a star, and their strength of 0 to 1."""
    if not n_toxic or not n_clean:
        return {}
    k, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p = n_toxic / (n_toxic + n_clean)
    g = 2 * (k * F.log(k / ((k + c) * p)) + F.when(c > 0, c * F.log(c / ((k + c) * (1 - p)))).otherwise(0.0))
    ratio = (k / n_toxic) / ((c + 1) / n_clean)
    found = (
        form_counts(sample).where(F.col("toxic") >= MIN_SEEN).select("form", "toxic", g.alias("g"), ratio.alias("ratio"))
        .where((F.col("g") >= MIN_G) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("g"), "form").collect()
    )
    count, strength = {r.form: r.toxic for r in found}, {r.form: min(1.0, math.log(r.ratio) / math.log(FULL_RATIO)) for r in found}
    # A stem that one longer form explains is no stem of its own.
    best: Counter[str] = Counter()
    for form, n in count.items():
        body = form.rstrip("*")
        for at in STEMS:
            if at < len(body) or at == len(body) and not form.endswith("*"):
                best[body[:at] + "*"] = max(best[body[:at] + "*"], n)
    kept = [f for f in count if not f.endswith("*") or best[f] < 0.9 * count[f]]
    stems: list[str] = []
    for f in sorted((f for f in kept if f.endswith("*")), key=len):
        if not any(f.startswith(t[:-1]) for t in stems):
            stems.append(f)
    lexicon = {*stems, *(f for f in kept if not f.endswith("*") and not any(f.startswith(t[:-1]) for t in stems))}
    return {f: strength[f] for f in count if f in lexicon}


def context_weight(text: bytes, start: int, end: int) -> float:
    """1 for plain use, ``QUOTED_WEIGHT`` for quotation or definition."""
    left = text[max(0, start - WINDOW_BYTES) : start].decode("utf-8", "ignore")
    right = text[end : end + WINDOW_BYTES].decode("utf-8", "ignore")
    for a, b in zip(OPENERS, CLOSERS):
        opened = left.count(a) % 2 == 1 if a == b else left.rfind(a) > left.rfind(b)
        if opened and b in right:
            return QUOTED_WEIGHT
    near = re.findall(r"\w+", left.lower())[-5:] + re.findall(r"\w+", right.lower())[:3]
    return QUOTED_WEIGHT if any(w in REPORTING for w in near) else 1.0


def saturated(x: float) -> float:
    """Many matches count for ever less, so that a long text's sum stays within the range that short ones taught."""
    return SATURATION * (1 - math.exp(-x / SATURATION))


class TextScorer:
    """Features of a text under a matcher; words once looked up are remembered."""

    LIMIT = 100_000

    def __init__(self, matcher: FormMatcher):
        self.matcher, self.hits, self.seen = matcher, {}, set()

    def matches(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """``(start, end, edits, weight)`` of each match, by byte positions."""
        flat = text.translate(ALNUM)
        distinct = set(flat.split())
        for word in distinct - self.seen:
            if found := self.matcher.match(word.decode("utf-8", "replace")):
                self.hits[word] = found
        self.seen |= distinct
        if len(self.seen) > self.LIMIT:
            self.seen = set(self.hits)
        own = distinct & self.hits.keys()
        if not own:
            return []
        found = re.finditer(rb"(?<![^ ])(?:" + b"|".join(sorted(map(re.escape, own), key=len, reverse=True)) + rb")(?![^ ])", flat)
        return [(m.start(), m.end(), e, strength * context_weight(text, m.start(), m.end())) for m in found for e, strength in [self.hits[m[0]]]]

    def features(self, text: bytes) -> tuple[float, float, float]:
        found = self.matches(text)
        if not found:
            return 0.0, 0.0, 0.0
        exact = sum(w for *_, e, w in found if e == 0)
        near = sum(w for *_, e, w in found if e > 0)
        return saturated(exact), saturated(near), math.log1p(1000.0 * (exact + near) / max(1, text.count(b" ") + 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps for an L2-penalised logistic model; the first weight is the intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, pen = np.zeros(a.shape[1]), np.diag([1e-6, *([ridge] * x.shape[1])])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (p - y) + pen @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, forms: dict[str, float], weights):
        self.forms, self.weights = forms, [float(w) for w in weights] if weights is not None else None

    def scorer(self):
        """A function from text to score, with state of its own worker."""
        features = TextScorer(FormMatcher(self.forms)).features
        w = self.weights

        def score(text: bytes) -> float:
            if w is None:
                return 0.0
            x = features(text)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], x))))))

        return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = materialize(sample_rows(docs, labels, sample), "labelled")
    count = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = count.get(True, 0), count.get(False, 0)
    forms = learn_forms(rows, n_toxic, n_clean)
    if not n_toxic or not n_clean:
        return Model({}, None)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(FormMatcher(forms))
        for batch in cut(batches):
            x = [scorer.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], *(pa.array([v[i] for v in x], pa.float64()) for i in range(3))], ["toxic", "a", "b", "c"])

    # At most SAMPLE rows of four numbers.
    got = rows.mapInArrow(features, "toxic boolean, a double, b double, c double").toPandas().sort_values(["a", "b", "c", "toxic"])
    return Model(forms, fit_logistic(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy(float)))


def scored(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """``carry`` columns, the text as bytes and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in cut(batches):
            out = pa.array([score(t) for t in batch["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), out], [*carry, "score"])

    return as_bytes(docs, *carry).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), "score double"]))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = scored(docs, train(docs, labels, sample), "doc_id")
    return out.select("doc_id", (crc_mod_col("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in cut(batches):
            keep = [t is None or score(t.encode()) < threshold for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
