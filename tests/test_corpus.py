"""The seeded corpus end to end against the published figures."""

import pytest

from tallywren.errors import LedgerError
from tallywren.plans import evaluate as ev
from tallywren.plans import scenarios
from tallywren.plans.reconcile import Run
from tallywren.service import LedgerService
from tallywren.sources.corpus import Corpus


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    return str(tmp_path_factory.mktemp("store"))


@pytest.fixture(scope="module")
def service(spark, store):
    s = LedgerService(spark, store)
    made = s.ingest_generated()
    assert made["inserted"] == 736 and made["duplicates"] == 8
    s.reconcile("baseline-exact")
    s.reconcile()
    return s


@pytest.fixture(scope="module")
def compared(service):
    return service.evaluate()


def test_corpus_is_reproducible():
    assert Corpus(7).rows == Corpus(7).rows and Corpus(7).rows != Corpus(8).rows


def test_duplicates_are_kept(service):
    dup = service.records.where("duplicate_of_id is not null")
    assert dup.count() == 8 and dup.where("external_id like '%#dup%'").count() == 8
    assert dup.join(service.records.selectExpr("id as duplicate_of_id"), "duplicate_of_id", "left_anti").isEmpty()


def test_published_figures(compared):
    b, s = compared["baseline"], compared["system"]
    keys = ("matched_records", "false_pairs", "missed_pairs", "exception_count", "unresolved_count")
    assert [b[k] for k in keys] == [615, 0, 432, 113, 101]
    assert [s[k] for k in keys] == [648, 0, 30, 78, 3]
    assert (round(b["recall"], 3), round(b["f1"], 3), round(s["recall"], 3), round(s["f1"], 3)) == (0.596, 0.747, 0.934, 0.966)
    assert {x["shape"]: (x["truth_pairs"], x["true_pairs"], x["exception_pairs"], x["missed_pairs"]) for x in s["per_shape"]} == {
        "clean": (360, 360, 0, 0), "fee-deducted": (340, 340, 0, 0), "split-settlement": (210, 168, 12, 30), "timing-lag": (66, 66, 0, 0),
        "reference-typo": (60, 60, 0, 0), "missing-counterpart": (8, 8, 0, 0), "duplicate": (24, 24, 0, 0), "many-to-one": (30, 0, 30, 0),
    }
    assert compared["regressions"] == [] or all("throughput" in r for r in compared["regressions"])


def test_regressions_are_named(compared):
    assert ev.regressions(compared["baseline"], compared["system"])


def test_row_order_and_partitions_do_not_matter(service):
    run = service.run(baseline=False)[0]
    other = Run(service.records.repartition(7, "external_id"))
    rows = lambda r: {(m.match_id, tuple(m.record_ids), m.confidence) for m in r.matches.collect()}
    assert rows(run) == rows(other)


def test_exceptions(service):
    run = service.run(baseline=False)[0]
    rows = run.exceptions.collect()
    assert any(len(r.recommended_ids) > 1 for r in rows)
    assert all(not r.recommended_ids for r in rows if r.kind == "MISSING_COUNTERPART")
    assert run.matches.where("size > 2").count() > 0
    assert run.candidate_sample().count() == 500


def test_reviews_audit_and_exports(service):
    e = service.exception_queue(limit=1).first()
    service.review(e.exception_id, "APPROVED", "ana")
    for args, code in ((("nope", "APPROVED", "ana"), "EXCEPTION_NOT_FOUND"), ((e.exception_id, "REJECTED", "bo"), "EXCEPTION_ALREADY_RESOLVED"), ((e.exception_id, "MAYBE", "bo"), "VALIDATION_FAILED")):
        with pytest.raises(LedgerError) as err:
            service.review(*args)
        assert err.value.code == code
    name, body = service.export("csv")
    lines = body.split("\r\n")
    assert name.endswith(".csv") and len(lines) == 78 + 2 and lines[0].startswith("exception_id,kind,amount_at_risk_inr") and ",yes," in lines[1] and '"₹' in lines[1]
    assert "## Per defect shape" in service.export("md")[1].replace("### Per", "## Per")
    assert service.audit.verify()["intact"]
    assert service.health()["records"] == 736


def test_service_goes_on_after_a_restart(spark, service, store, compared):
    if service.reviews().isEmpty():
        service.review(service.exception_queue(limit=1).first().exception_id, "APPROVED", "ana")
    again = LedgerService(spark, store)
    assert [r["run_id"] for r in again.runs()] == [r["run_id"] for r in service.runs()] and len(again.runs(1)) == 1
    run, summary = again.run(baseline=False)
    assert summary == service.run(baseline=False)[1] and run.matches.count() == summary["match_count"] and run.exceptions.count() == summary["exception_count"]
    one = service.exception_queue(limit=1).first().exception_id
    with pytest.raises(LedgerError) as err:
        again.review(again.latest_reviews()[0]["exception_id"], "REJECTED", "bo")
    assert err.value.code == "EXCEPTION_ALREADY_RESOLVED" and one == again.exception_queue(limit=1).first().exception_id
    assert again.reviews().count() == service.reviews().count() and again.latest_reviews()[0]["reviewer"] == "ana"
    assert again.latest_evaluations(1)[0]["system"] == compared["system"] and again.cases(again.latest_evaluations(1)[0]["id"]).count() == compared["system"]["false_pairs"]
    assert again.evaluate(with_baseline=False)["f1"] == compared["system"]["f1"]
    money = again.at_risk()
    assert money["open_exceptions"] == money["exceptions"] - again.reviews().count() and money["open_at_risk_minor"] < money["at_risk_minor"]
    assert again.receipts().first().sequence == again.audit.receipts().count() and again.audit.verify()["intact"]
    assert again.match(run.matches.first().match_id).count() > 1


@pytest.mark.parametrize("name", scenarios.NAMES)
def test_scenarios(service, name):
    out = service.demo(name)
    assert out["passed"], out


def test_unknown_scenario(service):
    with pytest.raises(LedgerError):
        service.demo("perpetual-motion")


def test_csv_folder_is_the_csv(service, tmp_path):
    import os

    folder = str(tmp_path / "queue")
    assert service.export("csv", folder=folder)[1] == folder
    body = "".join(open(f"{folder}/{f}", newline="").read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert body == service.export("csv")[1]


def test_logs_are_json(capsys):
    import io
    import json
    import logging

    from tallywren.logs import JsonLines, event

    out = io.StringIO()
    log, handler = logging.getLogger("tallywren-test"), logging.StreamHandler(out)
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    event(log, "upload_complete", logging.WARNING, inserted=3)
    line = json.loads(out.getvalue())
    assert (line["event"], line["level"], line["inserted"]) == ("upload_complete", "warning", 3) and line["timestamp"].endswith("+00:00")


def test_model_adjudicator(spark, service):
    """Valid answers move scores; late, broken and invented ones fall back to the rules, and are counted."""
    import json
    import re
    import time

    from tallywren.operators.ranking import checked_answer, model_adjudicator

    def same(text):
        return json.dumps({"chosen": re.search(r"candidate 1: id=(\S+)", text)[1], "adjustment": 5, "rationale": "first"})

    def odd(text):
        n = sum(map(ord, re.search(r"record: id=(\S+)", text)[1])) % 5
        if n == 0:
            time.sleep(1.5)
        return ["late", "no json", json.dumps({"chosen": "invented", "adjustment": 0.1, "rationale": ""}), json.dumps({"chosen": None, "adjustment": 0.1, "rationale": "unclear"}), same(text)][n]

    assert checked_answer('so: {"chosen": "a", "adjustment": 0.1, "rationale": "x"} ok', {"a"}) == ("a", 0.1)
    for bad in ("", "{}", '{"chosen": "b", "adjustment": 0, "rationale": ""}', '{"chosen": "a", "adjustment": "x", "rationale": ""}', '{"chosen": "a", "adjustment": NaN, "rationale": ""}', '{"chosen": "a", "adjustment": 0}', "[1]"):
        with pytest.raises(LedgerError) as err:
            checked_answer(bad, {"a"})
        assert err.value.code == "ADJUDICATOR_MALFORMED_OUTPUT"
    put = service.run(baseline=False)[1]["adjudicated_count"]
    good = Run(service.records, adjudicator=model_adjudicator(same))
    asked = good.ranks.where("adjudicated and applied <> 0")
    assert good.summary()["fell_back_count"] == 0 and asked.where("applied <> 0.12").isEmpty() and asked.count() == put > 0
    mixed = Run(service.records, adjudicator=model_adjudicator(odd, 0.5))
    n = mixed.ranks.where("fell_back").select("s_id").distinct().count()
    assert 0 < n < put and mixed.ranks.where("fell_back").join(service.run(baseline=False)[0].ranks.selectExpr("s_id", "c_id", "applied as ruled"), ["s_id", "c_id"]).where("applied <> ruled").isEmpty()


def test_two_answers_on_one_pair(service):
    from pyspark.sql import functions as F

    def twice(rows):
        one = rows.where("rank = 1").select("s_id", "c_id")
        return one.withColumn("adjustment", F.lit(0.1)).union(one.withColumn("adjustment", F.lit(-0.02)))

    run = Run(service.records, adjudicator=twice)
    assert run.ranks.count() == 2 * run.pairs.count() and {r.applied for r in run.ranks.where("applied <> 0").collect()} == {-0.02}


def test_chain_over_stretches(spark):
    """Stretches of any width, with gaps between them, give what one window gives."""
    from pyspark.sql import functions as F

    from tallywren.sinks.audit import chained, verify_chain

    rows = chained(spark.range(100).select(F.col("id").alias("sequence"), F.concat(F.lit("p"), "id").alias("payload")), "sequence", "payload").where("sequence not in (30, 31, 50) and sequence not between 60 and 79")
    want = {30 + 2, 51, 80}
    for width in (1, 7, 1000):
        assert {r.sequence for r in verify_chain(rows, stretch=width).where("broken").collect()} == want
    assert verify_chain(rows.limit(0)).count() == 0


def test_tampering_is_found(spark):
    from tallywren.sinks.audit import SCHEMA, AuditLog, payload_hash, verify_chain

    assert payload_hash({"a": 1, "b": 2}) == payload_hash({"b": 2, "a": 1}) != payload_hash({"a": 1, "b": 3})
    log = AuditLog(spark)
    for i in range(4):
        log.append("INGEST", "c", {"n": i})
    rows = [list(r) for r in log._rows]
    rows[1][4] = '{"n":9}'
    del rows[2]
    found = {r.sequence: (r.tampered, r.broken) for r in verify_chain(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()}
    assert found == {1: (False, False), 2: (True, False), 4: (False, True)}


def test_no_truth_is_refused(spark, service):
    from pyspark.sql import functions as F

    bare = Run(service.records.withColumn("truth_group_id", F.lit(None).cast("string")))
    with pytest.raises(LedgerError) as err:
        ev.evaluate(bare)
    assert err.value.code == "EVALUATION_NO_GROUND_TRUTH"


def test_stricter_resolve_does_not_raise_recall(service, compared):
    run = Run(service.records, thresholds=service.run()[0].thresholds.override(resolve=0.97))
    assert ev.metrics(run).first().recall <= compared["system"]["recall"]
