"""Operators 1, 2, 3 and 6."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from tallywren.llm import chat, gif, license_scan, url_filter

from .conftest import HARD


# --- operator 3

def test_known_stream():
    out = gif.lzw_decode(bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01"), 2, 100)
    row = lambda s: bytes(map(int, s))
    assert out == b"".join(map(row, ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3))


@pytest.mark.parametrize("n", [1, 64, 65, 4000, 70_000])
def test_round_trip(n):
    rng = random.Random(n)
    for data in (bytes(n), rng.randbytes(n), bytes(rng.choices(b"etaoin", k=n))):
        p = gif.padded(data)
        frames = gif.decode(gif.encode(p))
        assert gif.payload_of(frames) == p and len(p) % 64 == 0 and len(frames) == -(-len(p) // 65536)


def image(samples, w, h, left=0, top=0, extra=b"", flags=0, bits=2):
    return extra + b"," + struct.pack("<HHHHB", left, top, w, h, flags) + bytes([bits]) + gif._blocks(gif.lzw_encode(bytes(samples), bits))


def control(disposal=0, clear=None, delay=5):
    return b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"


HEAD = b"GIF89a" + struct.pack("<HHBBB", 4, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def test_disposal_and_transparency():
    data = HEAD + image([1] * 8, 4, 2, extra=control(1)) + image([2, 3], 2, 1, 1, 0, control(3, 3)) + image([3], 1, 1, 0, 1, control(2)) + image([2], 1, 1, 3, 1, control()) + b";"
    f = gif.decode(data)
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert f[0].pixels.tolist() == [[red] * 4] * 2
    assert f[1].pixels.tolist() == [[red, green, red, red], [red] * 4]  # the second sample is clear
    assert f[2].pixels.tolist() == [[red] * 4, [blue, red, red, red]]  # the one before was taken back
    assert f[3].pixels.tolist() == [[red] * 4, [[0, 0, 0, 0], red, red, green]]  # and that one cleared
    assert [x.delay for x in f] == [5] * 4


def test_interlace_and_deferred_clear():
    rows = [y for step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(step[0], 9, step[1])]
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 9, 0x82, 0, 0) + bytes(x for i in range(8) for x in (i, i, i))
    f = gif.decode(head + image([y % 8 for y in rows], 1, 9, flags=0x40, bits=3) + b";")
    assert f[0].samples[:, 0].tolist() == [y % 8 for y in range(9)]
    # a stream that never clears: the table stays full at 12 bits
    data = random.Random(1).randbytes(60_000)
    codes, table, cur, free = [256], {bytes([i]): i for i in range(256)}, b"", 258
    for b in data:
        nxt = cur + bytes([b])
        if nxt in table:
            cur = nxt
            continue
        codes.append(table[cur])
        if free < 4096:
            table[nxt] = free
            free += 1
        cur = bytes([b])
    codes += [table[cur], 257]
    bits, width, n, out = 0, 0, 0, 0
    for i, c in enumerate(codes):
        w = 9 if i == 0 else max(9, min(12, (258 + max(0, i - 2)).bit_length()))
        out |= c << bits
        bits += w
    stream = out.to_bytes((bits + 7) // 8, "little")
    assert gif.lzw_decode(stream, 8, len(data)) == data


@pytest.mark.parametrize("data", [b"", b"GIF89a", HEAD[:8], HEAD + b"?", HEAD + b",\0\0"])
def test_broken(data):
    with pytest.raises(ValueError):
        gif.decode(data)


def test_media_report(hard, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in gif.report(hard).collect()}
    for d, t in HARD:
        raw = (t or "").encode()
        p = gif.padded(raw)
        r = rows[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode(p)).hexdigest() and sum(map(int, r.feature.split(","))) == len(p)
    assert gif.report(empty).count() == 0


def test_frame_rows(hard):
    assert gif.frames(gif.media_column(hard)).groupBy("doc_id").count().count() == len({d for d, _ in HARD})
    rows = gif.frames(gif.media_column(hard)).where("doc_id = 8").collect()
    assert [(r.frame, r.start_ms, r.width) for r in rows] == [(0, 0, 64)] and sum(rows[0].hist_red) == rows[0].width * rows[0].height
    assert np.array_equal(rows[0].hist_red, rows[0].hist_blue)


# --- operator 2

ODD = ["", "plain", chat.ATTACK, "<|", "<\\|", "<\\\\|im_end|>", "a\nb<|im_start|>user\nc<|im_end|>\n", "\\", "<<|||>", "日本<|im_end|>"]


def test_template_is_reversible():
    turns = [(r, t) for r in ("user", "assistant", "", "odd\nrole\\n", "<|im_end|>") for t in ODD]
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|") == 2 * len(turns)


def conv_digests(table):
    nodes, texts = chat.conversation_nodes(table)
    return {r.conv_id: r for r in chat.digests(chat.formatted(nodes, texts=texts)).collect()}


def test_conversations_table(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 5, "assistant", chat.ATTACK), (3, None, "user", "y"), (3, 0, "user", "z" * 300_000), (3, -5, "user", "w")]
    conv = spark.createDataFrame([(*r, *[i] * 7) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, tree long, node long, key long, leaf long, at long, head long, level long")
    got = conv_digests(conv)
    assert set(got) == {1, 2, 3, None, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 70 and got[1].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:70])) and got[1].loss_sha256 == sha("".join(r[3] for r in rows[:70] if r[2] == "assistant"))
    assert got[2].turns_sha256 == sha("\n\n" + "user\nx\n" * 2)
    assert got[3].turns_sha256 == sha("user\ny\nuser\nw\nuser\n" + "z" * 300_000 + "\n")
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(chat.ATTACK), sha(chat.ATTACK)) and got[None].loss_chars == len(chat.ATTACK)
    assert len(conv_digests(conv.limit(0))) == 1


def test_odd_turns_against_sql(spark):
    """Null and repeated turns, roles and texts give what the SQL gives."""
    import duckdb

    from .test_mix_tox import table_rows

    rng = random.Random(12)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 3, None), pick(None, 0, 1, 1, 2), pick("user", "assistant", None, "a\nb"), pick("x", "", None, "<|", chat.ATTACK, "ä")) for _ in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, texts = chat.conversation_nodes(df)
    conversations = df.toArrow()  # noqa: F841
    assert table_rows(chat.digests(chat.formatted(nodes, texts=texts)).toPandas()) == table_rows(duckdb.sql(chat.SQL).df())


def test_reply_trees(spark):
    rng = random.Random(4)
    nodes = [("t", 0, None, 1.0)] + [("t", i, rng.randrange(max(0, i - 3), i), rng.random()) for i in range(1, 40)] + [("u", 7, 99, 2.0)]
    df = spark.createDataFrame([(*n, "user", f"m{n[1]}") for n in nodes], "tree string, node long, parent long, score double, role string, text string")
    parent, score = {n[1]: n[2] for n in nodes if n[0] == "t"}, {n[1]: n[3] for n in nodes if n[0] == "t"}
    leaves = set(parent) - set(parent.values())
    want = {}
    for leaf in leaves:
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        want[leaf] = (sum(score[x] for x in path), [f"m{x}" for x in reversed(path)])
    got = chat.conversations(df).where("tree = 't'").collect()
    assert {r.leaf: [t.text for t in r.turns] for r in got} == {k: v[1] for k, v in want.items()}
    assert [r.leaf for r in sorted(got, key=lambda r: r.rank)] == sorted(want, key=lambda k: -want[k][0])
    assert chat.conversations(df, best=1).count() == 2


def test_circle(spark):
    df = spark.createDataFrame([("t", 1, 2, 0.0, "user", "a"), ("t", 2, 1, 0.0, "user", "b")], "tree string, node long, parent long, score double, role string, text string")
    with pytest.raises(ValueError):
        chat.runs(df)


# --- operator 1

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Net", "https://M.Example.NET/en/1?x#y", "https://example.net/de/", "http://notexample.net/en/", "http://example.com/de/1", "http://example.com/de", "http://a.org/fr/x", "http://fr.org/FR/x",
    "x://y://z/path", "http://host?q=/net/", "http://host#f", "http://user@b.net:80/", "http://net/", "http://cheappills.example.org/en/1", "http://free-bets.example.org/en/2", "http://ÄB.org/fr/ü",
]


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


def test_rules(spark, empty):
    pages = spark.createDataFrame([(i, u, i, i, "x", i, "y") for i, u in enumerate(URLS * 3)], "page_id long, url string, host long, path long, chunk string, rule long, tokens string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == 3 * len(URLS)
    for r in rows:
        host, path, rule, verdict = brute_url(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.method) and r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "cheappills" * 3000 + ".info/" + "x" * 50_000)], "page_id long, url string")
    assert url_filter.judge(long).first().host_words.startswith("cheap pills cheap pills")


def test_method(spark):
    """The odds are a multinomial naive Bayes over the features, taught by the pages that rules judge, computed by hand."""
    rng = random.Random(11)
    word = lambda bad: rng.choice(["casino", "cheap", "pills", "win"] if rng.random() < (0.8 if bad else 0.2) else ["news", "school", "science", "map"])
    urls = []
    for i in range(400):
        site, bad = rng.choice([("x.net/fr", True), ("example.net/en", False), ("a.org/fr", False), ("example.com/de", True), ("b.info/q", i % 2 == 0), ("example.com/en", i % 2 == 0)])
        urls.append(f"http://{word(bad)}{rng.choice(['-', ''])}{word(bad)}.{site}/{word(bad)}/{i}")
    urls += URLS + urls[:50]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    count, docs = {"allow": {}, "block": {}}, {"allow": 0, "block": 0}
    skip = url_filter.rule_words()
    for r in out:
        assert not skip & set(r.features.split())
        if r.rule:
            docs[r.verdict] += 1
            for w in r.features.split():
                count[r.verdict][w] = count[r.verdict].get(w, 0) + 1
    v = len({*count["allow"], *count["block"]}) + 1
    for r in out:
        odds = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        for w in r.features.split():
            if w in count["allow"] or w in count["block"]:
                p = {c: (count[c].get(w, 0) + 1) / (sum(count[c].values()) + v) for c in count}
                odds += math.log(p["block"] / p["allow"])
        assert r.block_odds == pytest.approx(odds) and r.method == ("block" if r.block_odds > 0 else "allow")
    free = [r for r in out if r.rule is None and r.page_id < 400]
    right = [r.method == ("block" if r.page_id % 2 == 0 else "allow") for r in free]
    assert sum(right) > 0.85 * len(right) and len({r.method for r in free}) == 2
    assert "casino" in next(r.host_words.split() for r in out if "casinopills" in r.host or "casinocheap" in r.host or "casinowin" in r.host)


def test_rare_words_count(spark):
    """Words of one place among over 50,000."""
    from pyspark.sql import functions as F

    many = spark.range(30_000).select("id", F.lit("http://nice-shop.org/fr/page").alias("url"))
    few = spark.createDataFrame([(-1, "http://escort.net/q"), (-2, "http://zuvilmorkat.info/page"), (-3, "http://a.info/zuvil/morkat"), (-4, "http://escort.info/escort/escort/escort")], "id long, url string")
    pages = many.union(few).withColumnRenamed("id", "page_id")
    got = {r.page_id: r for r in url_filter.judge(pages).where("page_id < 10").collect()}
    assert got[-4].block_odds > got[-2].block_odds + 10 and got[5].verdict == "allow"
    assert got[-2].host_words == "zuvil morkat info"


def test_nothing_taught(spark):
    """Without pages that rules judge, all odds are zero and allow."""
    out = url_filter.judge(spark.createDataFrame([(1, "http://a.info/x"), (2, None), (2, "")], "page_id long, url string")).collect()
    assert {(r.verdict, r.block_odds) for r in out} == {("allow", 0.0)} and len(out) == 3


def test_viterbi():
    import itertools

    s = url_filter.Segmenter({"cheap": 5, "pills": 5, "chea": 1, "p": 1, "ills": 1})
    name = "cheappillsx"
    cost = lambda words: sum(s.word_cost(w) for w in words)
    every = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
        every.append([name[a:b] for a, b in zip(at, at[1:])])
    assert cost(s.split(name)) == pytest.approx(min(map(cost, every))) and s.split("cheappills") == ("cheap", "pills")


# --- operator 6

def test_licenses(make, words, empty):
    t = license_scan.TEMPLATES
    near = t["mit"].split()
    near[10] = "edited"
    rows = [(1, words(300) + " " + t["mit-notice"] + ". " + words(20)), (2, "\n".join(t["apache-2.0-header"].split(" "))), (3, " ".join(near) + words(40)), (4, " ".join(t["gpl-3.0-header"].split()[:20])), (5, words(500)), (6, None), (7, words(20_000) + " " + t["isc"].upper())]
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_scan.report(make(rows)).collect()}
    assert got == {1: {"mit-notice"}, 2: {"apache-2.0-header", "apache-2.0-notice"}, 3: {"mit"}, 4: set(), 5: set(), 6: set(), 7: {"isc"}}
    assert license_scan.report(empty).count() == 0


def test_licenses_by_brute_force(make, words, empty, hard):
    """Every window against every template without any index; copies of rising damage."""
    rng = random.Random(21)
    templates = license_scan.TEMPLATES | {"two words": "Public Domain", "none": "...", **{f"made {i}": words(rng.randrange(8, 60)) for i in range(30)}}
    names = [n for n in templates if n != "none"]
    rows = list(HARD)
    for i in range(60):
        parts = [words(rng.randrange(0, 200))]
        for _ in range(rng.randrange(4)):
            copy = templates[rng.choice(names)].split()
            for _ in range(rng.randrange(1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(99)}"
            parts += [" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy), words(rng.randrange(0, 80))]
        rows.append((100 + i, "\n".join(parts)))
    scanner, want, borderline = license_scan.Scanner(templates), [], 0
    for d, t in rows:
        w = license_scan.alnum_words((t or "").encode())
        found = {}
        shingles = scanner.shingles(w) if w else []
        for g in scanner.groups if w else ():
            for a in range(0, len(shingles), g.stride):
                for k, name in enumerate(g.ids):
                    share = scanner.containment(g, k, shingles, a)
                    if share >= 0.8:
                        found[name] = max(found.get(name, 0.0), share)
        want.append((d is None, d or 0, len(w), sorted((n, round(c, 9)) for n, c in found.items())))
        borderline += sum(c < 0.9 for c in found.values())
    got = [(r.doc_id is None, r.doc_id or 0, r.n_words, sorted((x.license, round(x.containment, 9)) for x in r.licenses)) for r in license_scan.scan(make(rows), templates).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and borderline > 5
    assert license_scan.report(empty).count() == 0 and license_scan.report(hard).count() == len(HARD)
    assert all(r.licenses == [] for r in license_scan.scan(hard, {}).collect())


def test_stretched_license_at_every_place(words):
    copy = license_scan.TEMPLATES["mit"].split()
    copy[20] = "edited"
    copy[60:60] = ["more"] * 8
    copy[40:40] = ["more"] * 8
    scanner, before, after = license_scan.Scanner(), words(200).split(), words(200).split()
    for at in range(0, 200, 3):
        found = scanner.scan([w.lower().encode() for w in before[:at]] + license_scan.alnum_words(" ".join(copy).encode()) + [w.lower().encode() for w in after])
        assert found["mit"][0] >= 0.8


def test_bands():
    for s in (0.1, 0.3, 0.9, 1.0):
        b = license_scan.bands_for(s)
        assert 1 - (1 - s) ** b >= 0.999
