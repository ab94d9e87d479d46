"""Operators 4 and 5, the registered queries' SQL, and the pipeline."""

import hashlib
import numbers
import random
import zlib

import duckdb
import pandas as pd
import pytest

from tallywren.llm import mixing, queries, toxicity

from .conftest import HARD


def water(sizes, weights, cap=3):
    """Targets by resharing what is above its stop, until nothing is."""
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: cap * sizes[s] for s in full} | {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("block", [1, 16])
def test_mix(make, words, block):
    rng = random.Random(3)
    rows = [(i, words(rng.randrange(0, 60)), rng.choices(["a", "B", "é", "zz", None, "tiny"], [40, 5, 3, 10, 2, 1])[0]) for i in range(400)] + [(*r, "h") for r in HARD]
    out = mixing.mix(make(rows), block=block).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = water(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    by = {}
    for r in out:
        by.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        assert r.taken <= 3 * r.size
    assert len(out) == len(rows)
    assert sorted(by) == sorted({(size[s], round(want[s], 6)) for s in size})
    for (n, t), rs in by.items():
        k = sum(size[s] == n and round(want[s], 6) == t for s in size)
        assert abs(sum(r.taken for r in rs) - k * t) <= 3 * k * block
    again = mixing.mix(make(rows).repartition(5), block=block).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_schedule_prefixes(spark):
    src = spark.createDataFrame([("a", 0, 5, 6000, 5000.0, 5000), ("b", 1, 2, 3000, 2500.0, 2500), ("c", 2, 1, 900, 500.0, 500)], "source string, pos int, weight long, source_size long, target double, quota long")
    slots, given = mixing.schedule(src, 10)
    slots, given = slots.orderBy("slot").collect(), {r.pos: r.slots for r in given.collect()}
    share = (5 / 8, 2.5 / 8, 0.5 / 8)
    point = lambda i: i * mixing.PHI % mixing.POINTS / mixing.POINTS
    assert [s.slot for s in slots] == list(range(800))
    assert all(s.pos == (0 if point(s.slot) < share[0] else 1 if point(s.slot) < 1 - share[2] else 2) for s in slots)
    for p in range(3):
        assert [s.rank for s in slots if s.pos == p] == list(range(given[p])) and abs(given[p] - 800 * share[p]) <= 3
    for n in (50, 200, 400):
        seen = [sum(s.pos == p for s in slots[:n]) for p in range(3)]
        assert all(abs(x - n * share) <= 3 for x, share in zip(seen, share))


def test_slots_decide(make, words):
    """What a document takes is what its blocks' slots hold, laid out by brute force."""
    rng = random.Random(5)
    rows = [(i, words(rng.randrange(0, 40)), rng.choices("abc", [6, 3, 1])[0]) for i in range(120)]
    out = {r.doc_id: r for r in mixing.mix(make(rows), block=8).collect()}
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    target = water(size, dict(zip("abc", (5, 2, 1))))
    ends = [int(sum(int(target[s] / sum(size.values()) * mixing.POINTS + 0.5) for s in "abc"[: n + 1])) for n in range(3)]
    total = sum(min(3 * size[s], int(target[s] + 0.5)) for s in "abc")
    slots = {s: [] for s in "abc"}
    for i in range(-(-total // 8)):
        p = i * mixing.PHI % mixing.POINTS
        slots["a" if p < ends[0] else "b" if p < ends[1] else "c"].append(i)
    for s in "abc":
        order = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, x in rows if x == s)
        tape = [i for _, i, n in order for _ in range(n)] * 3
        used = tape[: 8 * len(slots[s])]
        for _, i, n in order:
            places = [k for k, x in enumerate(used) if x == i]
            assert (out[i].taken, out[i].first_slot) == (len(places), slots[s][places[0] // 8] if places else -1)


def test_mixed_keeps_documents(make, words, spark):
    rows = [(i, words(30), "ab"[i % 2]) for i in range(20)] + [(0, words(3), "a"), (50, None, "a")]
    docs = make(rows).selectExpr("*", "2 as `odd name`")
    out = mixing.mixed(docs).collect()
    assert set(out[0].asDict()) == {*docs.columns, *mixing.OWN} and all(r.size == len(r.text.split()) and rows[r.row][1] == r.text for r in out)
    want = {(r.doc_id, r.size, r.taken, r.first_slot) for r in mixing.mix(docs).collect() if r.taken}
    assert {(r.doc_id, r.size, r.taken, r.first_slot) for r in out} == want


def test_mix_empty(empty, make):
    assert mixing.mix(empty).count() == 0
    r = mixing.mix(make([(1, None, "a"), (2, "", None)])).collect()
    assert {(x.size, x.target, x.taken) for x in r} == {(0, 0.0, 0)}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_distance():
    rng = random.Random(5)
    forms = {"idiot": 1.0, "worthless": 0.9, "scum": 0.8, "moron": 0.7, "disgust*": 0.6, "lowei*": 0.5}
    m = toxicity.FormMatcher(forms)
    tests = list(forms) + ["idiott", "idiom", "idi", "worthles", "vvorthless", "worhtless", "scums", "scam", "disgusting", "digusting", "dusgustful", "loweix", "lowexi", ""]
    tests = [t.rstrip("*") for t in tests] + ["".join(rng.choices("idotwrhles", k=rng.randrange(3, 9))) for _ in range(800)]
    for t in tests:
        want = []
        for f, s in forms.items():
            body, k = f.rstrip("*"), toxicity.allowance(f.rstrip("*"), f.endswith("*"))
            d = min(lev(t[:n], body) for n in range(len(t) + 1)) if f.endswith("*") else lev(t, body)
            if d <= k:
                want.append((d, -s))
        got = m.match(t)
        assert (got and (got[0], -got[1])) == (min(want) if want else None), t


def test_quotation():
    use, quote = b"you are an idiot and more", 'he wrote “you idiot” to them'.encode()
    at = lambda t: (t.index(b"idiot"), t.index(b"idiot") + 5)
    assert toxicity.context_weight(use, *at(use)) == 1.0
    assert toxicity.context_weight(quote, *at(quote)) == toxicity.QUOTED_WEIGHT
    defined = b"the word idiot is old"
    assert toxicity.context_weight(defined, *at(defined)) == toxicity.QUOTED_WEIGHT


def test_learns_and_holds_out(spark, make, words):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        t, bad = words(40).split(), rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(40)] = rng.choice(["gribble", "snarfer", "blockhead"])
        rows.append((i, " ".join(t)))
        labels += [(i, int(bad))] * 2
    rows += [(1000, words(30) + " gribbble " + words(5)), (1001, None), (1002, "")]
    labels += [(1001, None), (None, 1)]
    tables = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.report(*tables).collect()}
    truth = dict(labels)
    held = [i for i in range(600) if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600)) and len(held) > 100
    assert all(out[i].predicted == truth[i] for i in held) and out[1000].predicted == 1 and out[1001].predicted == out[1002].predicted == 0
    flipped = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.report(tables[0], flipped).collect()}
    assert all(again[i] == pytest.approx(out[i].score) for i in again)
    clean = toxicity.keep_clean(*tables)
    assert clean.columns == tables[0].columns and {r.doc_id for r in clean.collect()} == {i for i in out if not out[i].predicted}


def test_toxicity_without_labels(hard, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.report(hard, none).collect()} == {0.0} and toxicity.report(empty, none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").selectExpr("sum(int(predicted = 1 and toxic = 1)) tp", "sum(int(predicted = 1 and toxic = 0)) fp", "sum(int(predicted = 0 and toxic = 1)) fn").first()
    assert r.tp / (r.tp + r.fp) > 0.9 and r.tp / (r.tp + r.fn) > 0.8


def table_rows(df):
    k = sorted(df.columns)
    return sorted(tuple("NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, numbers.Number) else str(v) for v in r) for r in df[k].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    assert table_rows(a) == table_rows(b)


def pipeline_fixture(words):
    """Documents with toxic ones, shared lines, near copies in dense clouds that one pair bridges, exact copies, benchmark passages and hard rows."""
    from .test_text_ops import bridged

    rng = random.Random(31)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows, labels = [], []
    for i in range(300):
        t, bad = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(rng.randrange(20, 60))], rng.random() < 0.25
        if bad:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["gribble", "snarfer", "blockhead"])
        if rng.random() < 0.1:
            t[5:5] = item.upper().split()
        lines = [" ".join(t)] + (["shared footer line of the site"] if rng.random() < 0.3 else [])
        rows.append((i, "\n".join(lines), rng.choice(["web", "books", None, "news"])))
        labels.append((i, int(bad)))
    rows += [(1000 + i, t, "web") for i, (_, t) in enumerate(bridged(words, clouds=1, copies=40))]
    rows += [(2000, rows[3][1], "web"), (2001, rows[3][1] + " one", "web"), (2002, item, "web"), (3, rows[3][1], "web"), (2003, "x " * 30_000, "long")]
    rows += [(*r, "hard") for r in HARD]
    return rows, labels, [(1, item), (2, None), (3, "short item")]


def brute_pipeline(rows, labels, items, toxic):
    """Stages 2 to 5 over what ``toxic`` leaves, by definitions alone."""
    from .test_text_ops import brute_spans, components, shingles

    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    rows = [r for r in rows if not toxic(r)]
    owner = {}
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), d), d)
    rows = [(d, t if t is None else "\n".join(x for x in t.split("\n") if d is None or owner.get(key(x), d) == d), s) for d, t, s in rows]
    named = {(d, t) for d, t, _ in rows if d is not None}
    sets = {n: shingles(t) for n, (_, t) in enumerate(sorted(named, key=str))}
    ids = {n: d for n, (d, _) in enumerate(sorted(named, key=str))}
    group = components(sets, lambda a, b: ids[a] == ids[b] or sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    least = {}
    for n, g in group.items():
        least[g] = min(least.get(g, ids[n]), ids[n])
    kept = {ids[n] for n, g in group.items() if least[g] == ids[n]}
    seen, out = set(), []
    for d, t, s in rows:
        if d is None or d in kept and (d, t) not in seen:
            seen.add((d, t))
            out.append((d, t, s))
    clean = []
    for d, t, s in out:
        text, n, hit = brute_spans(t, items)
        if not hit or hit <= 0.5 * n:
            clean.append((d, text, s))
    return clean


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small_corpus(make, words, spark, tmp_path_factory):
    rows, labels, items = pipeline_fixture(words)
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = make(rows)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def test_pipeline_by_brute_force(spark, small_corpus, monkeypatch):
    import corpus_pipeline as p
    from tallywren.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CELL", 4)
    path, rows, labels, items = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scorer = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    toxic = lambda r: r[1] is not None and scorer(r[1].encode()) >= toxicity.THRESHOLD
    truth = dict(labels)
    assert sum(toxic(r) == bool(truth.get(r[0], 0)) for r in rows) > 0.97 * len(rows)
    want = brute_pipeline(rows, labels, items, toxic)
    out = p.run(spark, path)
    assert [c for c in out.columns if c not in mixing.OWN] == [c for c in docs.columns if c not in mixing.OWN] and set(mixing.OWN) < set(out.columns)
    got = out.collect()
    sizes = {}
    for _, t, s in want:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    target = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])])})
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.source or "", r.size) for r in got if target[r.source] >= 3 * sizes[r.source]) == sorted(
        (d is None, d or 0, t, s or "", len(t.encode().split())) for d, t, s in want if len((t or "").encode().split()) and target[s] >= 3 * sizes[s]
    )
    assert {(r.doc_id, r.text) for r in got} <= {(d, t) for d, t, _ in want}
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 3
        assert all(0 < r.taken <= 3 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in got if r.source == s)


def test_stages_keep_columns(spark, small_corpus, empty):
    import corpus_pipeline as p

    path, *_ = small_corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, path)
        if name != "source_mixing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert stage(spark, empty, path).count() == 0
    assert mixing.mixed(empty).count() == 0


def test_pipeline_leaves_nothing_behind(spark, sf):
    import os

    import corpus_pipeline as p
    from tallywren.session import shared_dir

    home = shared_dir(spark).removeprefix("file://") + "/tallywren"
    held = set(os.listdir(home)) if os.path.isdir(home) else set()
    out = p.run(spark, sf)
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    left = {x for x in os.listdir(home) if x not in held}
    assert len(left) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert out.where("taken > 3 * size or size = 0").isEmpty() and out.count() > 0
