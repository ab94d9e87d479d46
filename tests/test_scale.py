"""What keeps the ledger plans within a disk: parts, slim tables, and the same results from them as from the whole."""

import time

import pytest
from pyspark.sql import functions as F

from tallywren.operators import blocking
from tallywren.plans import reconcile
from tallywren.plans.reconcile import Run
from tallywren.session import materialize_parts
from tallywren.sources import derived, ingest


@pytest.fixture(scope="module")
def records(spark, sf):
    return derived.ledger(spark, sf, 150).cache()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_parts_change_nothing(spark, records, monkeypatch):
    whole = Run(records)
    monkeypatch.setattr(reconcile, "PART_RECORDS", 200)
    monkeypatch.setattr(reconcile, "PART_PAIRS", 400)
    cut = Run(records)
    assert whole.scored.count() > 800 and cut.matchable.count() > 400
    assert rows(cut.pairs, "id_l", "id_r", "score", "blocking_key") == rows(whole.pairs, "id_l", "id_r", "score", "blocking_key")
    columns = ("id", "state", "accepted_ids", "ambiguous_ids", "confidence", "rationale")
    assert rows(cut.decisions, *columns) == rows(whole.decisions, *columns)


def test_block_pairs_are_the_candidate_pairs(records):
    live = ingest.live(records)
    hot = blocking.hot_keys(live, share=1)
    found = blocking.block_pairs(live, hot)
    assert not hot.isEmpty() and found.count() > found.select("id_l", "id_r").distinct().count()
    first = found.groupBy("id_l", "id_r").agg(F.min_by("key", "rank").alias("blocking_key"))
    assert rows(first, "id_l", "id_r", "blocking_key") == rows(blocking.candidate_pairs(live), "id_l", "id_r", "blocking_key")


def test_few_duplicates_are_the_duplicates(records):
    plain = ingest.mark_duplicates(records.drop("duplicate_of_id")).where("duplicate_of_id is not null")
    assert 0 < plain.count() and rows(plain, "id", "duplicate_of_id") == rows(records.where("duplicate_of_id is not null"), "id", "duplicate_of_id")
    assert rows(ingest.mark_few_duplicates(records.drop("duplicate_of_id"), 1), "id", "duplicate_of_id") == rows(records, "id", "duplicate_of_id")


def test_matchable_needs_no_table_of_all_columns(records):
    run = Run(records)
    assert set(run.scored.columns) & {"norm_ref_l", "norm_cp_l", "value_date_l"} == set()
    assert set(run.membership.columns) & {"features", "rationale"} == set()


@pytest.mark.parametrize("strategy", ["fuzzy+adjudicator", "baseline-exact"])
def test_closed_references_are_decided_as_in_the_general_plan(spark, monkeypatch, strategy):
    some = derived.ledger(spark, "/root/testdata/sf0.01", 3000).cache()
    whole = Run(some, strategy)
    assert whole.divided is None
    monkeypatch.setattr(reconcile, "CLOSED_FROM", 0)
    cut = Run(some, strategy)
    rest, own = cut.divided
    assert rest.matchable.count() > 1000 and own.count() > 1000 and own.where("size = 1 and best is not null").count() > 0
    columns = whole.left_over.columns
    assert rows(cut.left_over, *columns) == rows(whole.left_over, *columns)
    for name in ("membership", "match_heads", "exceptions", "placed"):
        a, b = getattr(cut, name), getattr(whole, name)
        assert a.columns == b.columns and rows(a, *a.columns) == rows(b, *b.columns), name


def test_exceptions_need_no_table_of_groups(spark, monkeypatch):
    some = derived.ledger(spark, "/root/testdata/sf0.01", 2000).drop("truth_group_id").cache()
    whole = Run(some)
    assert whole.divided_lone is None
    columns = whole.left_over.columns
    left, seen = rows(whole.left_over, *columns), rows(whole.exception_rows, *whole.exception_rows.columns)
    monkeypatch.setattr(reconcile, "CLOSED_FROM", 0)
    monkeypatch.setattr(reconcile, "PART_RECORDS", 3000)
    cut = Run(some)
    rest, lone = cut.divided_lone
    assert cut.matchable.count() >= 6000 and lone.count() > 100 and lone.where("size > 1 or record_ids is not null").isEmpty()
    assert rows(cut.left_over, *columns) == left and rows(cut.exception_rows, *cut.exception_rows.columns) == seen
    assert "divided" not in vars(cut)


def test_a_part_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {path for path in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in path}

    before = shuffled()
    materialize_parts(spark, (spark.range(1000).repartition("id") for _ in range(2)), "freed")
    until = time.time() + 8
    while time.time() < until and shuffled() - before:
        time.sleep(0.2)
    assert shuffled() - before == set()
