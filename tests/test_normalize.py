import pytest
from pyspark.sql import functions as F

from tallywren.functions.money import inr, inr_compact
from tallywren.functions.normalize import cp_similarity, norm_counterparty, norm_reference, ref_similarity, shape_of, slug


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("NEFT/RZP100001/HDFC0001", "R2P100001"), ("  rzp-100001 ", "R2P100001"), ("rzp 100001", "R2P100001"), ("RZP1O0OO1", "R2P100001"), ("///", None), ("", None), (None, None), ("NEFT/BLUE T", "81UET")],
)
def test_reference(spark, raw, want):
    assert one(spark, norm_reference("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("Chaayos Beverages Pvt Ltd", "CHAAYOS"), ("Nykaa E-Retail", "NYKAA E"), ("  ", None), (None, None), ("Co. Ltd", None)])
def test_counterparty(spark, raw, want):
    assert one(spark, norm_counterparty("a"), a=raw) == want


@pytest.mark.parametrize(
    "a, b, want",
    [("RZP100001", "RZP100001", 1.0), ("RZP100001", "RZP10000", 0.9), ("R2P100030", "R2P100089", 0.24), ("AB1", "AB2", 0.0), (None, "X", 0.0), ("", "X", 0.0), ("ABCDE", "ABXDE", 0.8), ("12345", "67890", 0.0)],
)
def test_ref_similarity(spark, a, b, want):
    for x, y in ((a, b), (b, a)):
        assert one(spark, ref_similarity("a", "b"), a=x, b=y) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [("A B", "B C", 1 / 3), ("A", "A", 1.0), (None, "A", 0.0), ("A", "B", 0.0)])
def test_cp_similarity(spark, a, b, want):
    assert one(spark, cp_similarity("a", "b"), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize("minor, want", [(12345678901, "₹12,34,56,789.01"), (-150, "-₹1.50"), (0, "₹0.00"), (100000, "₹1,000.00"), (99, "₹0.99")])
def test_inr(spark, minor, want):
    assert one(spark, inr("a"), a=minor) == want


@pytest.mark.parametrize("minor, want", [(1_500_000_000, "₹1.50 Cr"), (25_000_000, "₹2.50 L"), (10_350_000, "₹1.03 L"), (11_250_000, "₹1.13 L"), (-250_000, "-₹2.5k"), (5_000, "₹50")])
def test_inr_compact(spark, minor, want):
    assert one(spark, inr_compact("a"), a=minor) == want


def test_ids(spark):
    assert one(spark, slug("a"), a="Bank Statement / 7") == "bank-statement-7"
    assert one(spark, shape_of("a"), a="grp_fee-deducted-12") == "fee-deducted"


def test_no_python_on_rows(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(ref_similarity("a", "b"), norm_reference("a"), F.lit(1))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_kind_label(spark):
    from tallywren.functions.normalize import kind_label

    rows = spark.createDataFrame([("BANK_STATEMENT",), ("PG_PAYMENT",)], "kind string").select(kind_label("kind").alias("k"))
    assert [r.k for r in rows.collect()] == ["bank statement", "pg payment"]
