"""Operators 7, 8, 9 and 10 and the near-duplicate stage against brute force, with the hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tallywren.llm import decontaminate, line_dedup, near_dedup, ngram_lm, simhash

from .conftest import HARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def brute_fp(text):
    w = BLANK.findall((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(make, words):
    rng = random.Random(1)
    rows = [(i, words(40)) for i in range(60)]
    for i in range(60, 90):
        w = rows[rng.randrange(10)][1].split()
        w[rng.randrange(40)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(HARD)]
    fps = {i: brute_fp(t) for i, t in rows}
    want = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(make(rows)).collect()}
    assert got == {i: (format(fps[i], "016x"), want[i]) for i in fps}


def test_simhash_links_through_null_ids(spark, monkeypatch):
    """Fingerprints 0, 3, 15 and 63 in a chain of two bits each; the middle ones have no doc_id."""
    rows = [(9, 0), (None, 3), (None, 15), (4, 63), (None, 1 << 40 | 7 << 50), (2, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: docs)
    got = {r.fp: r.component_id for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {0: 4, 3: 4, 15: 4, 63: 4, 1 << 40 | 7 << 50: None, -1: 2}


@pytest.mark.parametrize("cell", [1, 4, 1000])
def test_links_dense_and_sparse(spark, cell):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        c = rng.getrandbits(64)
        fps |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(25)}
    fps = sorted(fps)
    signed = [x - (1 << 64 if x >> 63 else 0) for x in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    from tallywren.operators.graph import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(nodes, cell=cell)).collect()}
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: got.get(i, i) for i in want} == want


def test_embedding_is_a_lower_bound(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    a = [rng.getrandbits(64) - (1 << 63) for _ in range(200)]
    df = spark.createDataFrame([(x, y) for x, y in zip(a, a[1:])], "a long, b long")
    d = df.select(F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b")))).alias("l1"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"), "a", "b")
    for r in d.collect():
        seg = lambda v: [((v >> (2 * i)) & 3).bit_count() for i in range(32)]
        assert r.l1 == sum(abs(x - y) for x, y in zip(seg(r.a & (1 << 64) - 1), seg(r.b & (1 << 64) - 1))) <= r.h


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("cell", [2, 32])
def test_near_groups(make, words, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rng = random.Random(2)
    base = [words(120) for _ in range(3)]
    rows = [(i, words(60)) for i in range(20)] + [(20 + i, b) for i, b in enumerate(base)]
    for i in range(30, 75):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " "), (93, "one"), (94, "ONE")]
    s = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: s[a] == s[b] or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) > 0
    want = components(s, alike)
    got = {r.doc_id: r.group_id for r in near_dedup.groups(make(rows)).collect()}
    assert got == want
    assert sorted(r.doc_id for r in near_dedup.dedup(make(rows)).collect()) == sorted(set(want.values()))


def test_near_one_shingle(make):
    rows = [(1, "ha ha ha ha ha"), (2, "ha " * 9), (3, "ho ho ho ho"), (4, "Ha ha HA ha ha ha"), (5, "ho ho ho ho ho"), (6, "one two three four five")]
    assert {r.doc_id: r.group_id for r in near_dedup.groups(make(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_near_shared_doc_id(make, words):
    a, b = words(60), words(60)
    rows = [(5, a), (5, b), (7, b + " tail"), (8, a + " tail"), (9, words(60))]
    assert sorted((r.doc_id, r.group_id) for r in near_dedup.groups(make(rows)).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.dedup(make(rows)).collect()) == sorted([rows[0], rows[1], rows[4]])


def bridged(words, clouds=6, copies=20):
    """Pairs of clouds of which only one text of each is alike to one of the other's; the centres are not."""
    rows = []
    for _ in range(clouds):
        base = words(120).split()
        edited = lambda places, last: " ".join("edit" if i in places else last if i == 119 and last else w for i, w in enumerate(base))
        texts = [edited({20}, f"a{i}") for i in range(copies)] + [edited(set(), ""), edited({45, 70}, "")] + [edited({45, 70, 95}, f"b{i}") for i in range(copies)]
        rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    return rows


def test_near_groups_bridged(make, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 2)
    rows = bridged(words)
    s = {i: shingles(t) for i, t in rows}
    want = components(s, lambda a, b: len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))
    assert len(set(want.values())) == 6
    got = {r.doc_id: r.group_id for r in near_dedup.groups(make(rows)).collect()}
    assert got == want


def chained(words, rng, chains=3, length=35):
    """Chains in which each text is alike to the next ones only."""
    rows = []
    for _ in range(chains):
        w = words(150).split()
        for i in range(length):
            rows.append((len(rows), " ".join(w)))
            for _ in range(2):
                w[rng.randrange(len(w))] = f"link{rng.randrange(9999)}"
    return rows


def starred(words, rng, copies=40):
    """A centre and texts alike to it but not to one another."""
    w = words(160).split()
    rows = [(0, " ".join(w))]
    for i in range(1, copies):
        v = list(w)
        at = rng.randrange(0, 140)
        v[at : at + 10] = [f"s{i}x{k}" for k in range(10)]
        rows.append((i, " ".join(v)))
    return rows


@pytest.fixture(scope="module")
def shapes(words):
    """Six seeds' chains, stars and bridged clouds, whose words differ, and their groups by brute force."""
    rows, want = [], {}
    for seed in range(6):
        rng, own = random.Random(100 + seed), []
        for part in (chained(words, rng), starred(words, rng), bridged(words, clouds=2, copies=18)):
            own += [(len(own) + i, " ".join(f"{w}v{seed}" for w in t.split())) for i, (_, t) in enumerate(part)]
        s = {i: shingles(t) for i, t in own}
        groups = components(s, lambda a, b: len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))  # noqa: B023
        want |= {1000 * seed + i: 1000 * seed + g for i, g in groups.items()}
        rows += [(1000 * seed + i, t) for i, t in own]
    return rows, want


@pytest.mark.parametrize("cell", [2, 8, 32])
def test_near_groups_of_every_shape(make, shapes, monkeypatch, cell):
    """Buckets counted as large from 2, 8 and 32 texts on."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rows, want = shapes
    assert {r.doc_id: r.group_id for r in near_dedup.groups(make(rows)).collect()} == want


def test_near_hard_rows(hard, empty):
    kept = near_dedup.dedup(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert near_dedup.dedup(empty).count() == 0 and simhash.report(empty).count() == 0 and simhash.report(hard).count() == len(HARD)


def brute_lines(rows):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    owner = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) == d]
        out.append((d is None, d or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(make, words, batches):
    rng = random.Random(6)
    pool = [words(5) for _ in range(30)] + ["short", "ÄÖÜ äöü ß", "  Padded Line here \r", "padded line here", "x" * 10, "x" * 9]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + HARD
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(make(rows), batches).collect())
    assert got == brute_lines(rows)
    kept = line_dedup.dedup_lines(make(rows), batches)
    assert kept.count() == len(rows)
    assert (1, None) in {(r.doc_id, r.text) for r in kept.collect()}


def test_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, 2, fanout=2)
    for b in range(7):
        store.add(spark.createDataFrame([(b * 10 + i, i % 5, b) for i in range(10)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in store.levels] == [1, 1, 1]
    table = store.table().collect()
    assert len(table) == 35 and all(r.owner == r.h2 * 10 + r.h1 for r in table)


def test_lines_empty(empty):
    assert line_dedup.report(empty).count() == 0


def brute_hits(text, items, window=10):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        for a in range(max(1, len(v) - window + 1)) if v else ():
            piece = v[a : a + window]
            for i in range(len(w) - len(piece) + 1):
                if w[i : i + len(piece)] == piece:
                    hit.update(range(i, i + len(piece)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), len(found), decontaminate.digest(found), bool(hit)


def brute_spans(text, items, window=10):
    """The text without hit words and the gaps between them, its words, and how many are hit."""
    text = text or ""
    found = list(ALNUM.finditer(text.translate(LOWER)))
    w = [m.group() for m in found]
    spans = set()
    for _, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        for a in range(max(1, len(v) - window + 1)) if v else ():
            piece = v[a : a + window]
            spans |= {(i, i + len(piece)) for i in range(len(w) - len(piece) + 1) if w[i : i + len(piece)] == piece}
    united = []
    for a, b in sorted(spans):
        if united and a <= united[-1][1]:
            united[-1][1] = max(united[-1][1], b)
        else:
            united.append([a, b])
    out, at = "", 0
    for a, b in united:
        out, at = out + text[at : found[a].start()], found[b - 1].end()
    return out + text[at:], len(w), sum(b - a for a, b in united)


@pytest.mark.parametrize("block_words", [12, 10**6])
def test_decontamination(spark, make, words, block_words):
    rng = random.Random(8)
    items = [(i, words(rng.choice([3, 9, 10, 11, 25]))) for i in range(20)] + [(20, None), (21, "..."), (22, "Same same SAME"), (23, "same same"), (None, "null item"), (5, "again five")]
    rows = [(i, " ".join(rng.choice([words(4), rng.choice(items)[1] or "", "same same same same", " ".join((rng.choice(items)[1] or "").split()[2:14])]) for _ in range(6))) for i in range(60)] + HARD[:-1] + [(8, "w " * 3000 + " ".join((items[4][1] + " w " + items[3][1]).split()))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.hits(make(rows), bench, block_words=block_words)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), sorted(r["items"])) for r in hits.collect())
    want = []
    for d, t in rows:
        n, h, k, _, _ = brute_hits(t, items)
        found = sorted({"" if i is None else str(i) for i, x in items if brute_hits(t, [(i, x)])[1]})
        want.append((d is None, d or 0, n, h, found))
    assert got == sorted(want)
    if block_words > 1000:
        full = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(make(rows), bench).collect()}
        assert full == {(d, *brute_hits(t, items)) for d, t in rows}


def test_decontaminated_texts(spark, make, empty):
    item = "one two three four five six seven eight nine ten eleven"
    long = " ".join(f"clean{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make([(1, f"{long}\n{item.upper()}! {long}"), (2, item), (3, "Clean,  as it is."), (4, None)])
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert kept == {1: f"{long}\n! {long}", 3: "Clean,  as it is.", 4: ""}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs.union(docs), bench, block_words=4).collect()} == kept
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_texts_keep_every_column(spark, make, hard):
    """Stages that change texts keep all other columns, whatever their names and types."""
    from pyspark.sql import functions as F

    docs = hard.withColumn("odd name", F.struct(F.col("n").alias("x.y"))).withColumn("a.b", F.array("n"))
    bench = spark.createDataFrame([(1, "same line of text here", 5)], "item_id long, text string, n_words long")
    rest = [c for c in docs.columns if c != "text"]
    look = lambda df: sorted(map(str, df.select(*(f"`{c}`" for c in rest)).collect()))
    for out in (line_dedup.dedup_lines(docs), decontaminate.decontaminate(docs, bench, max_coverage=1.0), decontaminate.decontaminate(docs, bench, max_coverage=1.0, block_words=2)):
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert look(out) == look(docs)
    assert near_dedup.dedup(docs).columns == docs.columns


@pytest.mark.parametrize("chunk", [50, 10**6])
def test_language_model(make, words, monkeypatch, chunk):
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    rows = [(i, words(30)) for i in range(80)] + HARD
    out = ngram_lm.score_corpus(make(rows), ranges=3).collect()
    assert len(out) == len(rows)
    c, fold = Counter(), {}
    seq = defaultdict(list)
    for d, t in rows:
        w = (t or "").encode().lower().split() + [None]
        fold[d] = zlib.crc32(b"" if d is None else str(d).encode()) % 10
        seq[d].append(w)
        if fold[d]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    for r in out:
        bases = [sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) for w in seq[r.doc_id]]
        assert any(math.isclose(r.base_score, b, rel_tol=1e-9) for b in bases)
        assert r.train_tokens == n and r.held_out == (fold[r.doc_id] == 0) and r.score <= 0
        assert any((r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w)) for w in seq[r.doc_id])


def test_counts_above_four_bytes():
    """Requests that add up to more than 2**32 places of one word."""
    import numpy as np
    import pyarrow as pa

    keys = np.array([2, 10, 12], np.uint64)
    ask = lambda counts: ngram_lm._pack(ngram_lm._planes(keys), np.array(counts, np.uint32))
    most = (1 << 32) - 1
    table = pa.table({"range": pa.array([0] * 3, pa.int32()), "chunk": [1, 2, 3], "part": pa.array([ngram_lm.KEPT, ngram_lm.OUT, ngram_lm.PASSED], pa.int32()), "keys": pa.array([ask([most, 1, 0]), ask([most, 2, 0]), ask([])], pa.binary())})
    out = {r["chunk"]: r for r in ngram_lm._answer(table).to_pylist()}
    for c in (1, 2, 3):
        assert ngram_lm._unpack_counts(out[c]["counts"]).tolist() == [2 * most, 3, 0]
    assert ngram_lm._unpack_counts(out[2]["kept"]).tolist() == [most, 1, 0] and out[1]["kept"] is None
    assert ngram_lm._unpack(out[-1]["counts"], np.int64)[0].tolist() == [2 * most + 3, 2, most + 1, 2]


def test_model_score_by_hand(make, words):
    """Scores are the interpolation of the three estimates with the weights learned, token by token."""
    import numpy as np

    rows = [(i, words(25)) for i in range(60)] + HARD
    train = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10
    c, pairs = Counter(), Counter()
    for d, w in train:
        if fold(d):
            c.update(w)
            pairs.update(zip([None, *w], w))
    n, v = sum(c.values()), len(c)
    seen = {}
    learn = ngram_lm.learn_weights
    ngram_lm.learn_weights = lambda cells, uniform: seen.setdefault("w", learn(cells, uniform))
    try:
        out = ngram_lm.score_corpus(make(rows)).collect()
    finally:
        ngram_lm.learn_weights = learn
    want = []
    for d, w in train:
        total = 0.0
        for a, b in zip([None, *w], w):
            l = seen["w"][int(ngram_lm.buckets(np.array([c[a]]))[0])]
            total += math.log10(l[0] * pairs[a, b] / max(1, c[a]) + l[1] * c[b] / n + l[2] / (v + 1))
        want.append((d is None, d or 0, round(total, 6)))
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in out) == sorted(want)


def test_model_is_a_distribution():
    """With weights that sum to one, the mixed probabilities of all next words and one unseen sum to at most one."""
    import numpy as np

    g = ngram_lm.GRID
    cells = np.array([[3, g, 4 * g, 50], [3, -1, 5 * g, 30], [5, g // 2, 5 * g // 2, 10]])
    w = ngram_lm.learn_weights(cells, 1e-3)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0
    assert w[3, 0] > 0.1 and w[3, 1] > 0.01


def test_language_model_beats_the_base(spark):
    r = ngram_lm.query(spark, "/root/testdata/sf0.001").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_language_model_empty(empty, make):
    assert ngram_lm.score_corpus(empty).count() == 0
    only_held = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = ngram_lm.score_corpus(make(only_held)).collect()
    assert len(out) == len(only_held) and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in out)
