"""The decision table, scoring and blocking on small hand-made candidates."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallywren.functions import scoring
from tallywren.operators import blocking, policy, ranking
from tallywren.schema import MatchOptions, Thresholds

REC = "id string, ord long, kind string, currency string, norm_ref string, norm_cp string, amount_minor long, fee_minor long, tax_minor long, value_date timestamp"
DAY = datetime(2026, 7, 1)


def rec(i, kind="ORDER", amount=100_000, ref="R2P100001", cp="BLUE TOKAI COFFEE", ccy="INR", day=DAY, fee=0, tax=0):
    return (f"r{i}", i, kind, ccy, ref, cp, amount, fee, tax, day)


def ranked(spark, rows, feature=1.0):
    """rows: (subject, candidate, kind, amount, score)."""
    f = F.struct(*(F.lit(v).alias(n) for n, v in (("reference", feature), ("amount", 1.0), ("date", 1.0), ("counterparty", 1.0), ("cross_source", 1.0))))
    data = [(s, 0, "ORDER", 100_000, 0, 0, "R", DAY, c, i, k, a, 0, 0, "R", DAY, float(x)) for i, (s, c, k, a, x) in enumerate(rows)]
    cols = ", ".join(f"{p}_{n} {t}" for p in "sc" for n, t in (("id", "string"), ("ord", "long"), ("kind", "string"), ("amount_minor", "long"), ("fee_minor", "long"), ("tax_minor", "long"), ("norm_ref", "string"), ("value_date", "timestamp")))
    return ranking.ranked(spark.createDataFrame(data, cols + ", score double").withColumn("features", f))


def decide(spark, rows, **t):
    records = spark.createDataFrame([rec(0)], REC)
    return policy.decide(records, ranked(spark, [("r0", *r) for r in rows]), Thresholds().override(**t)).first()


def test_three_sources(spark):
    d = decide(spark, [("a", "PG_PAYMENT", 100_000, 0.99), ("b", "SETTLEMENT", 100_000, 0.98), ("c", "BANK_STATEMENT", 100_000, 0.97)])
    assert (d.state, d.accepted_ids, d.confidence, d.exception_kind) == ("RESOLVED", ["a", "b", "c"], 0.97, None)


def test_rivals(spark):
    d = decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.90), ("b", "BANK_STATEMENT", 100_000, 0.89)])
    assert (d.state, d.exception_kind, d.accepted_ids, d.ambiguous_ids) == ("EXCEPTION", "AMBIGUOUS_MANY_TO_ONE", [], ["a", "b"])


def test_split(spark):
    d = decide(spark, [("a", "BANK_STATEMENT", 60_000, 0.90), ("b", "BANK_STATEMENT", 40_000, 0.89)])
    assert (d.state, d.accepted_ids) == ("RESOLVED", ["a", "b"])


def test_neither_match_nor_sum(spark):
    d = decide(spark, [(x, "BANK_STATEMENT", 70_000, 0.9 - i / 100) for i, x in enumerate("abc")])
    assert (d.state, len(d.ambiguous_ids)) == ("EXCEPTION", 3)


def test_clear_winner_and_far_runner_up(spark):
    d = decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.99), ("b", "BANK_STATEMENT", 100_000, 0.85)])
    assert (d.state, d.accepted_ids, d.ambiguous_ids) == ("RESOLVED", ["a"], [])


def test_none_low_and_middle(spark):
    assert decide(spark, []).decided_by == "NO_CANDIDATE"
    low = decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.20)])
    assert (low.state, low.decided_by, low.exception_kind) == ("UNRESOLVED", "BELOW_FLOOR", None)
    mid = decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.60), ("b", "BANK_STATEMENT", 100_000, 0.58)])
    assert (mid.state, mid.exception_kind, len(mid.ambiguous_ids)) == ("EXCEPTION", "AMBIGUOUS_MANY_TO_ONE", 2)


def test_bounds(spark):
    assert decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.82)]).state == "RESOLVED"
    assert decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.45)]).state == "EXCEPTION"
    assert decide(spark, [("a", "BANK_STATEMENT", 100_000, 0.85)], resolve=0.95).state == "EXCEPTION"
    with pytest.raises(Exception, match="must lie"):
        Thresholds().override(resolve=1.5)


def score(spark, a, b):
    pairs = blocking.with_records(spark.createDataFrame([("r1", "r2", 1, 2)], "id_l string, id_r string, ord_l long, ord_r long"), spark.createDataFrame([a, b], REC))
    f = pairs.withColumn("features", scoring.features(Thresholds()))
    return f.select("features.*", scoring.gated(scoring.total()).alias("score")).first()


def test_scores(spark):
    a = rec(1)
    assert score(spark, a, rec(2, "SETTLEMENT")).score == 1.0
    assert score(spark, a, rec(2)).score == 0
    assert score(spark, a, rec(2, "SETTLEMENT", ccy="USD")).score == 0
    assert score(spark, a, rec(2, "SETTLEMENT", 97_200)).amount == 0.92
    assert score(spark, a, rec(2, "SETTLEMENT", 40_000)).amount == 0
    assert score(spark, a, rec(2, "SETTLEMENT", day=datetime(2026, 9, 1))).date == 0


def test_blocking(spark):
    keys = [r.key for r in blocking.blocking_keys(spark.createDataFrame([rec(1)], REC)).collect()]
    assert keys[0] == "ref:R2P100001" and keys[1] == "refp:R2P100" and keys[2:4] == ["amt:1151", "amt:1150"] and keys[4].startswith("cpd:")
    bare = blocking.blocking_keys(spark.createDataFrame([rec(1, ref=None, cp=None)], REC)).count()
    assert bare == 2


def test_block_cap_and_order_of_rows(spark):
    rows = [rec(i, "ORDER" if i % 2 else "SETTLEMENT", 100_000 + 37_000 * i, f"R2P{i:06d}", None) for i in range(70)]
    assert blocking.candidate_pairs(spark.createDataFrame(rows, REC), MatchOptions(block_cap=60)).count() == blocking.candidate_pairs(spark.createDataFrame(rows[::-1], REC).repartition(3)).count()
    assert {r.key_kind for r in blocking.skipped_blocks(spark.createDataFrame(rows, REC)).collect()} == {"refp"}


def adjust(spark, a, b, feature):
    r = ranked(spark, [("r0", "x", "SETTLEMENT", b["amount"], 0.6)], feature)
    r = r.withColumn("s_amount_minor", F.lit(a)).withColumn("c_norm_ref", F.lit(b.get("ref", "R"))).withColumn("c_value_date", F.lit(b.get("day", DAY)))
    if "amount_feature" in b:
        r = r.withColumn("features", F.col("features").withField("amount", F.lit(b["amount_feature"])))
    return ranking.adjudicated(r, Thresholds()).first().applied


def test_adjudicator(spark):
    assert adjust(spark, 1_000_000, {"amount": 972_152}, 1.0) == pytest.approx(0.09)
    assert adjust(spark, 100_000, {"amount": 100_000, "ref": "ZZZZZZ"}, 0.1) == pytest.approx(-0.08)
    assert adjust(spark, 100_000, {"amount": 97_640, "day": datetime(2026, 7, 3), "ref": "RX"}, 1.0) == pytest.approx(0.12)


def test_plugged_adjudicator(spark):
    r = ranked(spark, [("r0", "x", "SETTLEMENT", 1, 0.6), ("r0", "y", "SETTLEMENT", 1, 0.5)])
    said = ranking.adjudicated(r, Thresholds(), adjudicator=lambda best: best.where("c_id = 'y'").select("s_id", "c_id", F.lit(0.5).alias("adjustment"))).collect()
    assert {x.c_id: (x.rank, round(x.score, 2)) for x in said} == {"y": (1, 0.62), "x": (2, 0.6)}
