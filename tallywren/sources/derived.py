"""A five-source ledger derived from ``orders`` and ``customer`` with defects chosen by order key.

The defects are written as SQL that Spark and DuckDB both read, so that the same ledger is the
input of the queries and of their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import norm_counterparty, norm_reference

BASE = """
select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as gross, c_name as name, o_orderdate as d,
  concat('RZP', cast(100000000 + o_orderkey as varchar(20))) as ref,
  case when o_orderkey % 10 = 7 then 'missing-counterpart' when o_orderkey % 20 = 3 or o_orderkey % 40 = 9 then 'split-settlement'
    when o_orderkey % 5 = 1 then 'fee-deducted' when o_orderkey % 9 = 4 then 'timing-lag'
    when o_orderkey % 7 in (3, 4) then 'reference-typo' when o_orderkey % 25 = 5 then 'duplicate' else 'clean' end as shape
from orders join customer on o_custkey = c_custkey
"""

FEES = """
select *, cast(floor(gross * 0.02E0 + 0.5E0) as bigint) as fee0, cast(floor(gross * (case when k % 40 = 9 then 0.5E0 else 0.4E0 end) + 0.5E0) as bigint) as part1 from base
"""

NETS = """
select *, cast(floor(fee0 * 0.18E0 + 0.5E0) as bigint) as tax0, concat('grp_', shape, '-', cast(k as varchar(20))) as truth,
  case k % 7 when 1 then concat('NEFT/', ref, '/HDFC') when 2 then lower(ref) when 3 then concat(substring(ref, 1, 6), substring(ref, 8, 20))
    when 4 then substring(ref, 1, 9) when 5 then replace(ref, '0', 'O') else ref end as bankref,
  case when shape = 'timing-lag' then 4 + k % 8 else 2 end as lag
from fees
"""

_ROW = "select k * 10 + {n} as ord, '{kind}' as kind, {ext} as external_id, {ref} as reference, {amount} as amount_minor, {fee} as fee_minor, {tax} as tax_minor, name as counterparty, {date} as value_date, truth as truth_group_id from nets where {where}"


def _parts() -> list[dict]:
    """The rows that an order gives, by ``n``, and the orders that give them."""
    net = "case when shape = 'fee-deducted' then gross - fee0 - tax0 when shape = 'split-settlement' then part1 else gross end"
    settled, split = "shape <> 'missing-counterpart'", "shape = 'split-settlement'"
    fee = "case when shape = 'fee-deducted' then {} else 0 end"
    ext = lambda p: f"concat('{p}', cast(k as varchar(20)))"
    zero = {"fee": "0", "tax": "0"}
    return [
        dict(n=0, kind="ORDER", ext=ext("ORD"), ref="ref", amount="gross", date="d", where="true", **zero),
        dict(n=1, kind="PG_PAYMENT", ext=ext("PAY"), ref="ref", amount="gross", date="d", where=settled, **zero),
        dict(n=2, kind="SETTLEMENT", ext=ext("STL"), ref="ref", amount=net, fee=fee.format("fee0"), tax=fee.format("tax0"), date="d + interval 2 day", where=settled),
        dict(n=3, kind="SETTLEMENT", ext=ext("STM"), ref="ref", amount="gross - part1", date="d + interval 3 day", where=split, **zero),
        dict(n=4, kind="BANK_STATEMENT", ext=ext("BK"), ref="bankref", amount=net, date="d + lag * interval 1 day", where=settled, **zero),
        dict(n=5, kind="BANK_STATEMENT", ext=ext("BM"), ref="ref", amount="gross - part1", date="d + interval 3 day", where=split, **zero),
        dict(n=6, kind="BANK_STATEMENT", ext=ext("BK"), ref="bankref", amount=net, date="d + lag * interval 1 day", where="k % 25 = 5 and " + settled, **zero),
        dict(n=7, kind="INVOICE", ext=ext("INV"), ref="ref", amount="gross", date="d", where="shape = 'fee-deducted'", **zero),
    ]


def _rows() -> str:
    return "\nunion all\n".join(_ROW.format(**p) for p in _parts())


def ledger_sql() -> str:
    """CTEs ``base, fees, nets, rows0`` ending in the stacked five sources."""
    return f"base as ({BASE}), fees as ({FEES}), nets as ({NETS}), rows0 as ({_rows()})"


def raw_ledger(spark: SparkSession, sf_dir: str, max_order: int | None = None) -> DataFrame:
    """The stacked sources, of orders up to ``max_order`` if given; with the normalised reference and counterparty,
    which are those of the order and the customer and so taken once for all rows."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    if max_order is not None:
        orders = orders.where(F.col("o_orderkey") <= max_order)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", norm_counterparty("c_name").alias("norm_cp"))
    base = BASE.replace("c_name as name", "c_name as name, norm_cp").replace("from orders join customer", "from {orders} join {customer}")
    nets = spark.sql(f"with base as ({base}), fees as ({FEES}), nets as ({NETS}) select * from nets", orders=orders, customer=customer)
    nets = nets.withColumns({f"norm_{c}": norm_reference(c) for c in ("ref", "bankref")})
    # One join and one scan for all rows of an order, where a union of selections would make one for each.
    parts = _parts()
    of = lambda value: F.expr("case n " + " ".join(f"when {p['n']} then {value(p)}" for p in parts) + " end")
    rows = nets.withColumn("n", F.explode(F.array(*(F.lit(p["n"]) for p in parts)))).where(of(lambda p: p["where"]))
    return rows.select(
        (F.col("k") * 10 + F.col("n")).alias("ord"), of(lambda p: f"'{p['kind']}'").alias("kind"), of(lambda p: p["ext"]).alias("external_id"), of(lambda p: p["ref"]).alias("reference"), of(lambda p: p["amount"]).alias("amount_minor"),
        of(lambda p: p["fee"]).alias("fee_minor"), of(lambda p: p["tax"]).alias("tax_minor"), F.col("name").alias("counterparty"), of(lambda p: p["date"]).alias("value_date"), F.col("truth").alias("truth_group_id"),
        of(lambda p: f"norm_{p['ref']}").alias("norm_ref"), "norm_cp",
    )


def ledger(spark: SparkSession, sf_dir: str, max_order: int | None = None) -> DataFrame:
    """Records as the engine takes them, with redelivered rows marked."""
    from .ingest import mark_few_duplicates

    rows = raw_ledger(spark, sf_dir, max_order)
    rows = rows.select(
        F.concat(F.lit("rec_"), F.lpad(F.col("ord").cast("string"), 12, "0")).alias("id"), F.col("ord").cast("long").alias("ord"), "kind", "external_id", "reference", "amount_minor",
        F.lit("INR").alias("currency"), F.col("fee_minor").cast("long").alias("fee_minor"), F.col("tax_minor").cast("long").alias("tax_minor"), "counterparty", F.col("value_date").alias("occurred_at"), "value_date", "truth_group_id", "norm_ref", "norm_cp",
    )
    return mark_few_duplicates(rows)


