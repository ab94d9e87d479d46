import pytest

from tallywren.errors import LedgerError, as_ledger_error
from tallywren.service import LedgerService
from tallywren.sources import csv_ledger

HEAD = "external_id,reference,amount_minor,currency,value_date,counterparty\n"
GOOD = "BK900001,NEFT/RZP1/HDFC,120000,inr,2026-07-01,Blue Tokai\n"
PROBE = HEAD + GOOD + "BK900002,R,not-a-number,INR,2026-07-01,X\n\nBK900003,R,120000,INR,definitely-not-a-date,X\n,R,120000,INR,2026-07-01,X\nBK900005,R,120000,RUPEES,2026-07-01,X\nBK900006,R,12.5,INR,2026-07-01,X\n"


def test_probe(spark):
    good, bad = csv_ledger.parse_text(spark, PROBE, "BANK_STATEMENT")
    row = good.collect()
    assert len(row) == 1 and row[0].currency == "INR" and row[0].reference == "NEFT/RZP1/HDFC" and row[0].truth_group_id is None and row[0].raw["amount_minor"] == "120000"
    assert {r.line: r.reason for r in bad.collect()} == {3: csv_ledger.REASONS[1], 5: csv_ledger.REASONS[2], 6: csv_ledger.REASONS[0], 7: csv_ledger.REASONS[3], 8: csv_ledger.REASONS[1]}
    _, compact = csv_ledger.parse_text(spark, PROBE, "BANK_STATEMENT", compact_lines=True)
    assert sorted(r.line for r in compact.collect()) == [3, 4, 5, 6, 7]


def test_lenient(spark):
    good, _ = csv_ledger.parse_text(spark, PROBE, "BANK_STATEMENT", lenient=True)
    assert {r.amount_minor for r in good.collect()} == {120000, 12}


@pytest.mark.parametrize("text, code", [("", "INGEST_MALFORMED"), ("external_id,currency\nA,INR\n", "INGEST_MALFORMED"), (HEAD + "x" * 2_000_001, "INGEST_TOO_LARGE"), (HEAD + GOOD * 20_001, "INGEST_TOO_LARGE")])
def test_limits(spark, text, code):
    with pytest.raises(LedgerError) as err:
        csv_ledger.parse_text(spark, text, "ORDER")
    assert err.value.code == code


def test_uploads_drop_redelivered_rows(spark):
    s = LedgerService(spark)
    assert s.ingest_csv(HEAD + GOOD + GOOD, "BANK_STATEMENT")["duplicates"] == 1
    again = s.ingest_csv(HEAD + GOOD + GOOD.replace("900001", "900009"), "BANK_STATEMENT")
    assert (again["inserted"], again["duplicates"]) == (1, 1)
    assert s.sources().first().row_count == 2 and s.health()["records"] == 2
    with pytest.raises(LedgerError):
        s.ingest_csv(HEAD + GOOD, "SHOEBOX")


def test_files(spark, tmp_path):
    """Equal rows of two files are two records, of which the later is marked; partners on equal lines still meet."""
    from tallywren.operators import blocking
    from tallywren.sources import ingest

    (tmp_path / "a.csv").write_text(HEAD + "\n" + GOOD + GOOD.replace("900001", "900002"))
    (tmp_path / "b.csv").write_text(HEAD.upper() + GOOD + "X,R,1,INR,never,X\r\n" + HEAD)
    good, bad = csv_ledger.read_files(spark, str(tmp_path), HEAD.strip(), "BANK_STATEMENT")
    rows = sorted((r.ord, r.external_id) for r in good.collect())
    assert rows == [(3, "BK900001"), (4, "BK900002"), (6, "BK900001")] and good.select("id").distinct().count() == 3
    assert sorted((r.file[-5:], r.line, r.reason) for r in bad.collect()) == [("b.csv", 3, csv_ledger.REASONS[2]), ("b.csv", 4, csv_ledger.REASONS[1])]
    assert [r.ord for r in ingest.mark_duplicates(good).where("duplicate_of_id is not null").collect()] == [6]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "o.csv").write_text(HEAD + "ORD1,RZP1,120000,INR,2026-07-01,Blue Tokai\n")
    orders, _ = csv_ledger.read_files(spark, str(tmp_path / "other"), HEAD.strip(), "ORDER")
    both = ingest.normalized(orders.unionByName(good.withColumn("ord", good.ord + 100)))
    assert blocking.candidate_pairs(both).count() > 0
    (tmp_path / "c.csv").write_text("some,other,header\n" + GOOD)
    with pytest.raises(LedgerError):
        csv_ledger.read_files(spark, str(tmp_path), HEAD.strip(), "ORDER")


def test_large_file_is_split(spark, tmp_path):
    (tmp_path / "big.csv").write_text(HEAD + "".join(GOOD.replace("900001", f"{i:06d}") for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, _ = csv_ledger.read_files(spark, str(tmp_path), HEAD.strip(), "ORDER")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.ord, r.external_id) for r in good.select("ord", "external_id").collect()) == [(i + 2, f"BK{i:06d}") for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_folder_upload(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + GOOD)
    (tmp_path / "b.csv").write_text(HEAD + GOOD + "X,R,1,INR,never,X\n")
    s = LedgerService(spark)
    assert s.ingest_folder(str(tmp_path), HEAD.strip(), "BANK_STATEMENT") == {"inserted": 1, "duplicates": 1, "rejected": 1}


def test_errors():
    assert as_ledger_error(ValueError("x")).status == 500 and LedgerError("RUN_NOT_FOUND", "x").status == 404


def test_stream(spark, tmp_path, sf):
    from tallywren.sources.derived import raw_ledger
    from tallywren.streaming.redelivery import deduplicated

    rows = raw_ledger(spark, sf)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "4000 days").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == rows.select("kind", "external_id").distinct().count() < rows.count()
