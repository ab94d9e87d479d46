"""Registered queries of the ledger engine and their DuckDB SQL. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.money import inr, inr_compact
from ..functions.normalize import cp_similarity, norm_counterparty, norm_reference, ref_similarity, shape_of
from ..operators import blocking, ranking
from ..session import materialize, new_path, release, scratch
from ..sinks import audit, export, reviews
from ..sources import csv_ledger, ingest
from ..sources.derived import ledger, raw_ledger
from . import evaluate as ev
from . import oracle as o
from . import views
from .reconcile import Run, accepted_edges, component_of, split_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def run(spark: SparkSession, sf: str, strategy: str = "fuzzy+adjudicator") -> Run:
    return Run(ledger(spark, sf), strategy)


def joined(c):
    return F.array_join(c, ",").alias(c)


def feature_cols(prefix: str = "features"):
    return [F.round(F.col(f"{prefix}.{f}"), 6).alias(a) for f, a in (("reference", "f_ref"), ("amount", "f_amt"), ("date", "f_date"), ("counterparty", "f_cp"))]


SQL_FEATURES = "round(f_ref, 6) as f_ref, round(f_amt, 6) as f_amt, round(f_date, 6) as f_date, round(f_cp, 6) as f_cp"
NAMES = "select c_custkey, c_name || case c_custkey % 4 when 0 then ' Pvt Ltd' when 1 then ', E-Retail' when 2 then '  Services & Co.' else '' end as name from customer"


@query("ledger_union", o.q(o.RECORDS, "select ord::bigint as ord, kind, external_id, reference, amount_minor::bigint as amount_minor, fee_minor::bigint as fee_minor, tax_minor::bigint as tax_minor, counterparty, epoch(value_date)::bigint as value_epoch, truth_group_id from rows0"))
def ledger_union(spark, sf):
    return raw_ledger(spark, sf).select(
        F.col("ord").cast("long").alias("ord"), "kind", "external_id", "reference", "amount_minor", F.col("fee_minor").cast("long").alias("fee_minor"), F.col("tax_minor").cast("long").alias("tax_minor"),
        "counterparty", F.unix_seconds("value_date").alias("value_epoch"), "truth_group_id",
    )


@query("source_counts", o.q(o.RECORDS, "select kind, count(*)::bigint as row_count, 'src_' || lower(replace(kind, '_', '-')) as source_id from rec group by kind"))
def source_counts(spark, sf):
    return ingest.sources(ledger(spark, sf))


@query("norm_reference", o.q(o.RECORDS, "select distinct reference, norm_ref from rec"))
def norm_reference_query(spark, sf):
    return raw_ledger(spark, sf).select("reference", norm_reference("reference").alias("norm_ref")).distinct()


@query("norm_counterparty", f"select c_custkey, name, {o.norm_cp('name')} as norm_cp from ({NAMES})")
def norm_counterparty_query(spark, sf):
    rows = spark.sql(NAMES.replace("from customer", "from {customer}"), customer=spark.read.parquet(f"{sf}/customer.parquet"))
    return rows.withColumn("norm_cp", norm_counterparty("name"))


@query("ref_similarity", o.q(o.RECORDS, f"select a.id as id_l, b.id as id_r, round({o.ref_sim('a.norm_ref', 'b.norm_ref')}, 6) as similarity from live a join live b on a.truth_group_id = b.truth_group_id and a.id < b.id"))
def ref_similarity_query(spark, sf):
    records = ledger(spark, sf)
    rows = ingest.live(records).select("truth_group_id", "id", "norm_ref")
    pairs = rows.join(rows.toDF("truth_group_id", "id2", "ref2"), "truth_group_id").where("id < id2")
    return pairs.select(F.col("id").alias("id_l"), F.col("id2").alias("id_r"), F.round(ref_similarity("norm_ref", "ref2"), 6).alias("similarity"))


@query("cp_jaccard", f"select a.p_partkey, round({o.cp_sim('a.p_name', 'b.p_name')}, 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def cp_jaccard(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", F.round(cp_similarity("p_name", "other"), 6).alias("similarity"))


CSV_HEADER = "external_id,amount_minor,currency,value_date,reference,counterparty"
CSV_LINES = """
select o_orderkey + 1 as line, concat(case when o_orderkey % 11 = 1 then ' ' else concat('UP', cast(o_orderkey as varchar(20))) end, ',', case when o_orderkey % 11 = 2 then 'n/a' when o_orderkey % 11 = 3 then '12.5' else cast(cast(round(o_totalprice * 100) as bigint) as varchar(20)) end,
  ',', case when o_orderkey % 11 = 4 then 'RUPEES' when o_orderkey % 11 = 5 then 'inr' else 'INR' end, ',', case when o_orderkey % 11 = 6 then 'someday' else cast(cast(o_orderdate as date) as varchar(10)) end, ', NEFT/RZP', cast(o_orderkey as varchar(20)), '/HDFC,', o_orderstatus) as text
from orders
"""
CSV_SQL = f"""
with lines as ({CSV_LINES}), cells as (select line, list_transform(string_split(text, ','), lambda x: trim(x)) as c from lines),
parsed as (select line, c[1] as external_id, case when regexp_matches(c[2], '^[+-]?[0-9]+$') then c[2]::bigint end as amount_minor, upper(c[3]) as currency, try_cast(c[4] as date) as d, c[5] as reference from cells)
select line::bigint as line, external_id, coalesce(amount_minor::varchar, '') as amount_minor, currency, coalesce(epoch(d)::bigint::varchar, '') as value_epoch, reference, case when external_id = '' then 'no external_id' when amount_minor is null then 'amount_minor is not an exact integer'
  when d is null then 'value_date is not a date' when length(currency) <> 3 then 'currency is not a three-letter code' end as reject_reason from parsed
"""


@query("csv_accept_reject", CSV_SQL)
def csv_accept_reject(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    lines = spark.sql(CSV_LINES.replace("from orders", "from {orders}"), orders=orders)
    parsed = csv_ledger.parse_lines(lines, CSV_HEADER, "BANK_STATEMENT")
    text = lambda c, name: F.coalesce(c.cast("string"), F.lit("")).alias(name)
    return parsed.select(F.col("line").cast("long").alias("line"), "external_id", text(F.col("amount_minor"), "amount_minor"), "currency", text(F.unix_seconds("value_date"), "value_epoch"), "reference", "reject_reason")


FOLDER_LINES = """
select o_orderkey, o_orderkey % 3 as shard, concat('UP', cast(floor(o_orderkey / 8) as bigint), ',', case when o_orderkey % 11 = 3 then '12.5' else cast(cast(round(o_totalprice * 100) as bigint) as varchar(20)) end, ',INR,',
  cast(cast(o_orderdate as date) as varchar(10)), ',R', cast(o_orderkey as varchar(20)), ',', o_orderstatus) as text from orders
"""
FOLDER_SQL = f"""
with lines as ({FOLDER_LINES.replace("cast(floor(o_orderkey / 8) as bigint)", "cast(floor(o_orderkey / 8) as bigint)::varchar")}),
numbered as (select *, row_number() over (partition by shard order by o_orderkey) + 1 as line from lines),
sizes as (select shard, count(*) + 1 as n from lines group by shard),
placed as (select numbered.*, line + coalesce((select sum(n) from sizes where sizes.shard < numbered.shard), 0) as ord from numbered)
select ord::bigint as ord, string_split(text, ',')[1] as external_id, string_split(text, ',')[2]::bigint as amount_minor, string_split(text, ',')[5] as reference,
  row_number() over (partition by string_split(text, ',')[1] order by ord) > 1 as redelivered from placed where string_split(text, ',')[2] <> '12.5'"""


@query("csv_folder", FOLDER_SQL)
def csv_folder(spark, sf):
    """Orders written as three CSV files and read back: order and redelivery go over all files."""
    path = new_path(spark, "csv")
    lines = spark.sql(FOLDER_LINES.replace("from orders", "from {orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    heads = lines.select("shard").distinct().select(F.lit(None).cast("long").alias("o_orderkey"), "shard", F.lit(CSV_HEADER).alias("text"))
    # One file for each shard, so one task writes it; reading splits it again.
    lines.select(F.col("o_orderkey").cast("long"), "shard", "text").union(heads).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("o_orderkey")).select("shard", "text").write.partitionBy("shard").text(path)
    good, _ = csv_ledger.read_files(spark, path, CSV_HEADER, "ORDER")
    marked = ingest.mark_duplicates(good)
    return marked.select("ord", "external_id", "amount_minor", "reference", F.col("duplicate_of_id").isNotNull().alias("redelivered"))


@query("dedup_mark", o.q(o.RECORDS, "select id, kind, external_id, duplicate_of_id from rec"))
def dedup_mark(spark, sf):
    return ledger(spark, sf).select("id", "kind", "external_id", "duplicate_of_id")


@query("load_anti_join", o.q(o.RECORDS, """
select id from rec where kind = 'BANK_STATEMENT' and duplicate_of_id is null
  and external_id not in (select external_id from rec where kind = 'BANK_STATEMENT' and ord % 3 = 0)"""))
def load_anti_join(spark, sf):
    bank = ledger(spark, sf).where("kind = 'BANK_STATEMENT'")
    return ingest.load(bank.where("ord % 3 = 0"), bank)[0].select("id")


@query("blocking_keys", o.q(o.KEYS, "select id, pos::int as pos, key from keys"))
def blocking_keys(spark, sf):
    return blocking.blocking_keys(ingest.live(ledger(spark, sf))).select("id", "pos", "key")


@query("block_stats", o.q(o.KEYS, "select key, n::bigint as n from blocks"))
def block_stats(spark, sf):
    return blocking.block_stats(blocking.blocking_keys(ingest.live(ledger(spark, sf)))).select("key", "n")


@query("skipped_blocks", o.q(o.KEYS, f"select string_split(key, ':')[1] as key_kind, count(*)::bigint as blocks, sum(n)::bigint as members from blocks where n > {o.CAP} group by 1"))
def skipped_blocks(spark, sf):
    return blocking.skipped_blocks(ingest.live(ledger(spark, sf)))


@query("candidate_pairs", o.q(o.PAIRS, "select id_l, id_r, blocking_key from pairs"))
def candidate_pairs(spark, sf):
    return blocking.candidate_pairs(ingest.live(ledger(spark, sf))).select("id_l", "id_r", "blocking_key")


@query("pair_scores", o.q(o.SCORED, f"select id_l, id_r, score, {SQL_FEATURES} from fuzzy"))
def pair_scores(spark, sf):
    return run(spark, sf).pairs.select("id_l", "id_r", "score", *feature_cols())


@query("baseline_pairs", o.q(o.SCORED, "select id_l, id_r, score from exact"))
def baseline_pairs(spark, sf):
    return run(spark, sf, "baseline-exact").pairs.select("id_l", "id_r", "score")


@query("baseline_join", o.q(o.RECORDS, "select a.id as id_l, b.id as id_r from live a join live b on a.norm_ref = b.norm_ref and a.amount_minor = b.amount_minor and a.currency = b.currency and a.kind <> b.kind and a.ord < b.ord"))
def baseline_join(spark, sf):
    """The exact join itself, without blocks."""
    rows = ingest.live(ledger(spark, sf)).select("norm_ref", "amount_minor", "currency", "id", "ord", "kind")
    other = rows.select("norm_ref", "amount_minor", "currency", F.col("id").alias("id_r"), F.col("ord").alias("o2"), F.col("kind").alias("k2"))
    return rows.join(other, ["norm_ref", "amount_minor", "currency"]).where("kind <> k2 and ord < o2").select(F.col("id").alias("id_l"), "id_r")


@query("ranked_topk", o.q(o.FUZZY, "select s_id, c_id, rank::int as rank, score from first_ranks where rank <= 4"))
def ranked_topk(spark, sf):
    return run(spark, sf, "fuzzy").ranks.where("rank <= 4").select("s_id", "c_id", "rank", "score")


@query("adjudication", o.q(o.ADJUDICATED, "select s_id, c_id, round(applied, 4) as applied, round(score, 4) as score, rank::int as rank from ranks where adjudicated"))
def adjudication(spark, sf):
    return run(spark, sf).by_subject(lambda _, ranks: ranks.where("adjudicated").select("s_id", "c_id", F.round("applied", 4).alias("applied"), F.round("score", 4).alias("score"), "rank"), "adjudication")


DECISION = "select id, state, exception_kind, decided_by, confidence, accepted_ids, ambiguous_ids, adjudicated from dec"


def _decisions(r: Run) -> DataFrame:
    return r.decisions.select("id", "state", "exception_kind", "decided_by", "confidence", joined("accepted_ids"), joined("ambiguous_ids"), "adjudicated")


@query("decisions", o.q(o.decisions(o.FUZZY), DECISION))
def decisions(spark, sf):
    return _decisions(run(spark, sf, "fuzzy"))


@query("decisions_adjudicated", o.q(o.decisions(o.ADJUDICATED), DECISION))
def decisions_adjudicated(spark, sf):
    return _decisions(run(spark, sf))


@query("exception_kinds", o.q(o.decisions(o.ADJUDICATED), "select state, exception_kind, decided_by, count(*)::bigint as records, sum(amount_minor)::bigint as amount_minor from dec group by all"))
def exception_kinds(spark, sf):
    return run(spark, sf).decisions.groupBy("state", "exception_kind", "decided_by").agg(F.count("*").alias("records"), F.sum("amount_minor").alias("amount_minor"))


EXPLAIN = """
select id, (case when b_ref = 1 then 'reference identical' when b_ref > 0.7 then printf('reference similar (%.2f)', b_ref + case when (b_ref * 8) % 2 = 1 then 1e-9 else 0 end) when b_ref > 0 then printf('reference weak (%.2f)', b_ref + case when (b_ref * 8) % 2 = 1 then 1e-9 else 0 end) else 'no usable reference' end || '; '
  || case when b_amt = 1 then 'amount exact' when b_amt > 0.85 then 'amount differs by an explainable fee' when b_amt > 0 then printf('amount differs beyond the fee tolerance (%.2f)', b_amt + case when (b_amt * 8) % 2 = 1 then 1e-9 else 0 end) else 'amount unexplainable' end || '; '
  || case when b_date > 0.8 then 'same-day or next-day' when b_date > 0 then 'within the lag window' else 'outside the date window' end || '; '
  || case when b_cp = 1 then 'same counterparty' when b_cp > 0.5 then 'counterparty similar' else 'counterparty differs' end || '.') as explanation from dec where best_id is not null"""


@query("explain_features", o.q(o.decisions(o.FUZZY), EXPLAIN))
def explain_features(spark, sf):
    return run(spark, sf, "fuzzy").decisions.where("best_id is not null").select("id", scoring.explain().alias("explanation"))


@query("components_baseline", o.q(o.components(o.BASELINE, False), "select ord::bigint as ord, comp::bigint as comp from comp"))
def components_baseline(spark, sf):
    return run(spark, sf, "baseline-exact").components.select("ord", "comp")


@query("components_fuzzy", o.q(o.components(o.FUZZY, False), "select ord::bigint as ord, comp::bigint as comp from comp1"))
def components_fuzzy(spark, sf):
    r = run(spark, sf, "fuzzy")
    return component_of(r.matchable, accepted_edges(r.decisions, r.matchable))


@query("split_merge", o.q(o.components(o.ADJUDICATED, True), "select distinct greatest(a, b)::bigint as hi, least(a, b)::bigint as lo from links"))
def split_merge(spark, sf):
    r = run(spark, sf)
    edges = split_edges(r.matchable, r.first_components, r.thresholds)
    return edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()


GROUPS = o.groups(o.ADJUDICATED, True)
BASE_GROUPS = o.groups(o.BASELINE, False)


@query("match_groups", o.q(GROUPS, "select match_id, record_ids, confidence, decided_by, adjudicated, amount_delta_minor, sources, size from mat"))
def match_groups(spark, sf):
    return run(spark, sf).match_heads.select("match_id", joined("record_ids"), "confidence", "decided_by", "adjudicated", "amount_delta_minor", "sources", "size")


@query("match_groups_baseline", o.q(BASE_GROUPS, "select match_id, record_ids, confidence, decided_by, adjudicated, amount_delta_minor, sources, size from mat"))
def match_groups_baseline(spark, sf):
    return run(spark, sf, "baseline-exact").match_heads.select("match_id", joined("record_ids"), "confidence", "decided_by", "adjudicated", "amount_delta_minor", "sources", "size")


@query("match_sides", o.q(GROUPS, """
select match_id, coalesce(sum(l.amount_minor) filter (where l.kind in ('ORDER', 'PG_PAYMENT', 'INVOICE')), 0)::bigint as book_minor, coalesce(sum(l.amount_minor) filter (where l.kind in ('SETTLEMENT', 'BANK_STATEMENT')), 0)::bigint as bank_minor,
  sum(fee_minor + tax_minor)::bigint as declared_fees_minor, (coalesce(sum(l.amount_minor) filter (where l.kind in ('ORDER', 'PG_PAYMENT', 'INVOICE')), 0) - coalesce(sum(l.amount_minor) filter (where l.kind in ('SETTLEMENT', 'BANK_STATEMENT')), 0) - sum(fee_minor + tax_minor))::bigint as residual_minor
from mem join live l on mem.id = l.id group by match_id"""))
def match_sides(spark, sf):
    r = run(spark, sf)
    return views.match_sides(r.membership, r.records)


EXC = "select exception_id, kind, record_ids, recommended_ids, confidence, amount_at_risk_minor from exc"


def _exceptions(df: DataFrame) -> DataFrame:
    return df.select("exception_id", "kind", joined("record_ids"), joined("recommended_ids"), "confidence", "amount_at_risk_minor")


@query("exceptions", o.q(GROUPS, EXC))
def exceptions(spark, sf):
    return _exceptions(run(spark, sf).exceptions)


@query("exceptions_baseline", o.q(BASE_GROUPS, EXC))
def exceptions_baseline(spark, sf):
    return _exceptions(run(spark, sf, "baseline-exact").exceptions)


@query("exception_queue_topk", o.q(GROUPS, EXC + " order by amount_at_risk_minor desc, exception_id limit 20"))
def exception_queue_topk(spark, sf):
    return _exceptions(views.queue(run(spark, sf).exceptions))


@query("at_risk_by_kind", o.q(GROUPS, "select kind, count(*)::bigint as exceptions, sum(amount_at_risk_minor)::bigint as amount_minor from exc group by kind"))
def at_risk_by_kind(spark, sf):
    return views.at_risk_by_kind(run(spark, sf).exceptions)


@query("unresolved", o.q(GROUPS, "select id, decided_by from lef where not coalesce(state = 'EXCEPTION' and exception_kind is not null, false)"))
def unresolved(spark, sf):
    return run(spark, sf).unresolved.select("id", "decided_by")


@query("residual_ambiguity", o.q(GROUPS, "select id, ambiguous_ids, confidence from dec where state = 'RESOLVED' and ambiguous_ids <> ''"))
def residual_ambiguity(spark, sf):
    return run(spark, sf).residual_ambiguity().select("id", joined("ambiguous_ids"), "confidence")


@query("group_size_hist", o.q(GROUPS, "select size, count(*)::bigint as matches from mat group by size"))
def group_size_hist(spark, sf):
    return views.group_sizes(run(spark, sf).match_heads)


@query("confidence_hist", o.q(GROUPS, "select floor(confidence * 20) / 20 as band, count(*)::bigint as matches from mat group by 1 order by 1 desc limit 10"))
def confidence_hist(spark, sf):
    return views.confidence_bands(run(spark, sf).match_heads)


@query("candidate_sample", o.q(o.SCORED, "select id_l, id_r, blocking_key, score from fuzzy order by block_rank, ord_l, ord_r limit 500"))
def candidate_sample(spark, sf):
    return run(spark, sf, "fuzzy").candidate_sample().select("id_l", "id_r", "blocking_key", "score")


@query("member_candidates", o.q(GROUPS, "select id_l, id_r, score from fuzzy where id_l in (select id from mem) or id_r in (select id from mem)"))
def member_candidates(spark, sf):
    r = run(spark, sf)
    return views.member_candidates(r.pairs, r.membership)


@query("overview", o.q(GROUPS, """
select (select count(*) from rec)::bigint as records, (select count(*) from rec where duplicate_of_id is not null)::bigint as duplicates, (select count(*) from mat)::bigint as matches, (select coalesce(sum(abs(amount_delta_minor)), 0) from mat)::bigint as settled_minor,
  count(*)::bigint as exceptions, coalesce(sum(amount_at_risk_minor), 0)::bigint as at_risk_minor, coalesce(sum(amount_at_risk_minor) filter (where kind = 'MISSING_COUNTERPART'), 0)::bigint as missing_minor, count(*) filter (where contains(recommended_ids, ','))::bigint as multi_candidate from exc"""))
def overview(spark, sf):
    r = run(spark, sf)
    return views.overview(r.records, r.match_heads, r.exceptions)


@query("truth_pairs", o.q(o.RECORDS, "select a.id as id_l, b.id as id_r, a.truth_group_id from live a join live b on a.truth_group_id = b.truth_group_id and a.id < b.id"))
def truth_pairs(spark, sf):
    return ev.truth_pairs(ledger(spark, sf))


CLS, BASE_CLS = o.classified(o.ADJUDICATED, True), o.classified(o.BASELINE, False)


@query("pair_classification", o.q(CLS, "select id_l, id_r, confidence, outcome from cls"))
def pair_classification(spark, sf):
    return ev.classified(run(spark, sf)).select("id_l", "id_r", "confidence", "outcome")


@query("metrics", o.q(CLS, o.METRICS))
def metrics(spark, sf):
    return ev.metrics(run(spark, sf))


@query("metrics_baseline", o.q(BASE_CLS, o.METRICS))
def metrics_baseline(spark, sf):
    return ev.metrics(run(spark, sf, "baseline-exact"))


@query("per_shape", o.q(CLS, o.SHAPES))
def per_shape(spark, sf):
    return ev.per_shape(run(spark, sf))


@query("compare_baseline", f"select s.shape, s.recall as system_recall, b.recall as baseline_recall, b.recall > s.recall + 0.01 as regression from ({o.q(CLS, o.SHAPES)}) s join ({o.q(BASE_CLS, o.SHAPES)}) b on s.shape = b.shape")
def compare_baseline(spark, sf):
    system = run(spark, sf)
    paths = [new_path(spark, "shapes") for _ in range(2)]
    for r, path in zip((system, system.beside("baseline-exact")), paths):
        with scratch(spark):
            ev.per_shape(r).write.parquet(path)
        release(spark)
    a, b = (spark.read.parquet(path) for path in paths)
    both = a.select("shape", F.col("recall").alias("system_recall")).join(b.select("shape", F.col("recall").alias("baseline_recall")), "shape")
    return both.withColumn("regression", F.col("baseline_recall") > F.col("system_recall") + 0.01)


@query("calibration", o.q(CLS, """
select printf('%.1f', floor(confidence * 10) / 10) || '–' || printf('%.1f', floor(confidence * 10) / 10 + 0.1) as bucket, count(*)::bigint as pairs, count(*) filter (where outcome = 'TRUE_MATCH')::bigint as true_pairs,
  round(count(*) filter (where outcome = 'TRUE_MATCH')::double / count(*), 4) as observed_precision from cls where confidence is not null group by 1"""))
def calibration(spark, sf):
    return ev.calibration(run(spark, sf))


@query("false_match_cases", o.q(CLS, "select id_l, id_r, confidence from cls where outcome = 'FALSE_MATCH'"))
def false_match_cases(spark, sf):
    return ev.classified(run(spark, sf)).where("outcome = 'FALSE_MATCH'").select("id_l", "id_r", "confidence")


@query("shape_counts", o.q(o.RECORDS, "select regexp_replace(replace(truth_group_id, 'grp_', ''), '-[0-9]+$', '') as shape, count(distinct truth_group_id)::bigint as groups, count(*)::bigint as records from rec group by 1"))
def shape_counts(spark, sf):
    return ledger(spark, sf).groupBy(shape_of("truth_group_id").alias("shape")).agg(F.count_distinct("truth_group_id").alias("groups"), F.count("*").alias("records"))


@query("money_text", """
with m as (select o_orderkey, case when o_orderkey % 5 = 0 then -1 else 1 end * cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 3 = 0 then 1000 else 1 end as minor from orders), w as (select *, (abs(minor) // 100) as whole from m)
select o_orderkey, case when minor < 0 then '-' else '' end || '₹' || case when whole < 1000 then whole::varchar else ltrim(regexp_replace(lpad((whole // 1000)::varchar, 12, ' '), '([ 0-9]{2})', '\\1,', 'g'), ' ,') || lpad((whole % 1000)::varchar, 3, '0') end || '.' || lpad((abs(minor) % 100)::varchar, 2, '0') as inr,
  case when minor < 0 then '-' else '' end || '₹' || case when whole >= 10000000 then printf('%.2f Cr', whole / 10000000.0::double + case when (whole / 10000000.0::double * 8) % 2 = 1 then 1e-9 else 0 end) when whole >= 100000 then printf('%.2f L', whole / 100000.0::double + case when (whole / 100000.0::double * 8) % 2 = 1 then 1e-9 else 0 end) when whole >= 1000 then printf('%.1fk', whole / 1000.0::double + case when (whole / 1000.0::double * 4) % 2 = 1 then 1e-9 else 0 end) else whole::varchar end as compact from w""")
def money_text(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    minor = F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1) * F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderkey") % 3 == 0, 1000).otherwise(1)
    return orders.select("o_orderkey", minor.alias("minor")).select("o_orderkey", inr("minor").alias("inr"), inr_compact("minor").alias("compact"))


@query("audit_chain_verify", """
with c as (select event_id, user_id, props, sha256(props) as h, lag(sha256(props)) over (partition by user_id order by event_id) as prev from events),
f as (select event_id, user_id, h, case when event_id % 50 = 7 then props || ' ' else props end as props, case when event_id % 40 = 9 then 'none' else prev end as prev, lag(h) over (partition by user_id order by event_id) as actual from c)
select event_id, sha256(props) <> h as tampered, prev is distinct from actual as broken from f""")
def audit_chain_verify(spark, sf):
    """One chain for each user, with payloads edited and links broken by id."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("props").alias("payload"))
    kept = audit.chained(events, "event_id", "payload", "user_id")
    harmed = kept.withColumn("payload", F.when(F.col("event_id") % 50 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))).withColumn("previous_hash", F.when(F.col("event_id") % 40 == 9, F.lit("none")).otherwise(F.col("previous_hash")))
    return audit.verify_chain(harmed, "event_id", "user_id").select("event_id", "tampered", "broken")


def _reviewable(spark, sf) -> DataFrame:
    """What reviews need of the exceptions, of a run whose records do not carry the held-out truth."""
    r = Run(ledger(spark, sf).drop("truth_group_id"))
    return materialize(r.exception_rows.select("exception_id", "kind", "amount_at_risk_minor"), "reviewable")


@query("review_rollup", o.q(GROUPS, """
select count(*)::bigint as reviews, count(*) filter (where right(exception_id, 1) in ('0', '1', '2'))::bigint as approved, count(*) filter (where right(exception_id, 1) = '4')::bigint as rejected, count(*) filter (where right(exception_id, 1) not in ('0', '1', '2', '4'))::bigint as escalated,
  coalesce(sum(amount_at_risk_minor), 0)::bigint as reviewed_amount_minor from exc where kind <> 'MISSING_COUNTERPART'"""))
def review_rollup(spark, sf):
    rows = _reviewable(spark, sf)
    digit = F.substring("exception_id", -1, 1)
    made = rows.where("kind <> 'MISSING_COUNTERPART'").select("exception_id", F.when(digit.isin("0", "1", "2"), "APPROVED").when(digit == "4", "REJECTED").otherwise("ESCALATED").alias("outcome"))
    return reviews.rollup(made, rows)


@query("open_exceptions", o.q(GROUPS, "select exception_id, kind from exc where not (kind = 'MISSING_COUNTERPART')"))
def open_exceptions(spark, sf):
    rows = _reviewable(spark, sf)
    made = rows.where("kind = 'MISSING_COUNTERPART'").select("exception_id", F.lit("APPROVED").alias("outcome"), F.concat(F.lit("rev_"), "exception_id").alias("review_id"), F.lit(1).alias("sequence"))
    return reviews.with_reviews(rows, made).where("resolved_by_review_id is null").select("exception_id", "kind")


@query("open_at_risk", o.q(GROUPS, """
select count(*)::bigint as exceptions, coalesce(sum(amount_at_risk_minor), 0)::bigint as at_risk_minor, count(*) filter (where kind <> 'MISSING_COUNTERPART')::bigint as open_exceptions,
  coalesce(sum(amount_at_risk_minor) filter (where kind <> 'MISSING_COUNTERPART'), 0)::bigint as open_at_risk_minor from exc"""))
def open_at_risk(spark, sf):
    """Money at risk with every missing counterpart reviewed twice."""
    rows = run(spark, sf).exceptions
    made = rows.where("kind = 'MISSING_COUNTERPART'").select("exception_id")
    return views.at_risk(rows, made.union(made))


@query("exception_export", o.q(GROUPS, """
select e.exception_id, e.kind, e.amount_at_risk_minor, printf('%.4f', e.confidence) as engine_confidence, s.kind as record_source, s.external_id as record_external_id, coalesce(s.reference, '') as record_reference,
  strftime(s.value_date, '%Y-%m-%d') as record_value_date, coalesce((select string_agg(r.external_id, ' | ' order by i) from (select unnest(string_split(e.recommended_ids, ',')) as x, generate_subscripts(string_split(e.recommended_ids, ','), 1) as i) u join rec r on r.id = u.x), '') as recommended_external_ids
from exc e join rec s on s.id = e.record_ids"""))
def exception_export(spark, sf):
    r = run(spark, sf)
    return export.exception_rows(r.exceptions, r.records).select("exception_id", "kind", "amount_at_risk_minor", "engine_confidence", "record_source", "record_external_id", "record_reference", "record_value_date", "recommended_external_ids")


@query("adjudication_rules", o.q(o.FUZZY, f"""
select s_id, c_id, {o.ADJUST} as adjustment from (select *, ({' or '.join(f'abs(floor(greatest(s_am, c_am)::double * {r}::double * 1.18::double + 0.5) - abs(s_am - c_am)) <= 200' for r in ranking.FEE_RATES)}) as exists_fee,
  floor(abs(epoch_us(s_vd) - epoch_us(c_vd))::double / 8.64e10 + 0.5) as cyc from first_ranks where rank = 1)"""))
def adjudication_rules(spark, sf):
    """The rules' opinion on every record's best candidate."""
    return ranking.rules_adjudicator(run(spark, sf, "fuzzy").ranks)
