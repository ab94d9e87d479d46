"""DuckDB SQL that computes the ledger queries another way, as a chain of CTEs."""

from __future__ import annotations

from ..functions.normalize import BANK_RE, CHANNEL_RE, COMPANY_RE, LOOKALIKES
from ..schema import Thresholds
from ..sources.derived import ledger_sql

T = Thresholds()
CAP = 60


def norm_ref(c: str) -> str:
    up = rf"upper(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
    bare = rf"regexp_replace(regexp_replace(regexp_replace({up}, '{CHANNEL_RE}', ''), '{BANK_RE}', ''), '[^A-Z0-9]', '', 'g')"
    return f"translate(nullif({bare}, ''), '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')"


def norm_cp(c: str) -> str:
    up = rf"regexp_replace(upper(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '[^A-Z0-9\s]', ' ', 'g')"
    return rf"nullif(trim(regexp_replace(regexp_replace({up}, '{COMPANY_RE}', ' ', 'g'), '\s+', ' ', 'g')), '')"


def ref_sim(a: str, b: str) -> str:
    digits = f"list_sum([case when {a}[i] = {b}[i] then 0 when regexp_matches({a}[i], '[0-9]') and regexp_matches({b}[i], '[0-9]') then 1 else 1000 end for i in range(1, length({a}) + 1)])"
    return f"""case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0::double when {a} = {b} then 1.0::double when least(length({a}), length({b})) < 4 then 0.0::double
      when length({a}) = length({b}) and {digits} between 1 and 3 then 0.3::double * (1 - {digits}::double / (length({a}) + 1))
      when contains({a}, {b}) or contains({b}, {a}) then 0.9::double * (least(length({a}), length({b}))::double / greatest(length({a}), length({b}))) + 0.1::double
      else greatest(0.0::double, 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end"""


def cp_sim(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    return f"""case when coalesce({a}, '') = '' or coalesce({b}, '') = '' then 0.0::double when {a} = {b} then 1.0::double
      else len(list_distinct(list_intersect({x}, {y})))::double / len(list_distinct(list_concat({x}, {y}))) end"""


RECORDS = f"""{ledger_sql()},
rec0 as (select 'rec_' || lpad(ord::varchar, 12, '0') as id, *, 'INR' as currency, {norm_ref('reference')} as norm_ref, {norm_cp('counterparty')} as norm_cp from rows0),
rec as (select *, nullif(first_value(id) over (partition by kind, external_id order by ord), id) as duplicate_of_id from rec0),
live as (select * from rec where duplicate_of_id is null)"""

KEYS = f"""{RECORDS},
keys as (select id, ord, kind, currency, unnest(ks) as key, generate_subscripts(ks, 1) - 1 as pos from (select *, list_filter([
    'ref:' || norm_ref, case when length(norm_ref) >= 6 then 'refp:' || substr(norm_ref, 1, 6) end, 'amt:' || bucket::varchar, 'amt:' || (bucket - 1)::varchar,
    'cpd:' || norm_cp || ':' || floor(floor(epoch(value_date) / 86400) / 3)::bigint::varchar], lambda x: x is not null) as ks
  from (select *, floor(ln(greatest(1, amount_minor)::double) * 100 + 0.5)::bigint as bucket from live))),
blocks as (select key, count(*) as n, min(ord * 10 + pos) as rank from keys group by key)"""

PAIRS = f"""{KEYS},
kept as (select k.*, b.rank from keys k join blocks b on k.key = b.key where b.n between 2 and {CAP}),
pairs as (select a.id as id_l, b.id as id_r, arg_min(a.key, a.rank) as blocking_key, min(a.rank) as block_rank
  from kept a join kept b on a.key = b.key and a.ord < b.ord and a.kind <> b.kind and a.currency = b.currency group by a.id, b.id)"""

SCORED = f"""{PAIRS},
sides as (select p.*, l.ord as ord_l, r.ord as ord_r, l.kind as kind_l, r.kind as kind_r, l.norm_ref as nr_l, r.norm_ref as nr_r, l.norm_cp as nc_l, r.norm_cp as nc_r, l.amount_minor as am_l, r.amount_minor as am_r,
    (l.fee_minor + l.tax_minor) as ft_l, (r.fee_minor + r.tax_minor) as ft_r, l.value_date as vd_l, r.value_date as vd_r
  from pairs p join live l on p.id_l = l.id join live r on p.id_r = r.id),
gaps as (select *, abs(am_l - am_r)::double as gap, greatest(greatest(ft_l, ft_r)::double, greatest(am_l, am_r)::double * {T.fee_tolerance}::double) + {T.rounding_slack_minor}::double as fee,
    abs(epoch_us(vd_l) - epoch_us(vd_r))::double / 8.64e10 as days from sides),
feats as (select *, {ref_sim('nr_l', 'nr_r')} as f_ref, {cp_sim('nc_l', 'nc_r')} as f_cp,
    case when gap = 0 then 1.0::double when gap <= fee then 0.92::double when gap <= fee * 3 then 0.92::double * (1 - (gap - fee) / (fee * 2)) else 0.0::double end as f_amt,
    case when days <= {T.date_window_days} then 1 - (days / {T.date_window_days}::double) * 0.6::double else 0.0::double end as f_date from gaps),
fuzzy as (select *, round(f_ref * 0.44::double + f_amt * 0.31::double + f_date * 0.11::double + f_cp * 0.14::double, 4) as score from feats where round(f_ref * 0.44::double + f_amt * 0.31::double + f_date * 0.11::double + f_cp * 0.14::double, 4) > 0),
exact as (select *, 1.0::double as score from feats where nr_l = nr_r and am_l = am_r)"""


def ranks(scored: str) -> str:
    half = "select id_{a} as s_id, ord_{a} as s_ord, am_{a} as s_am, ft_{a} as s_ft, nr_{a} as s_nr, vd_{a} as s_vd, id_{b} as c_id, ord_{b} as c_ord, kind_{b} as c_kind, am_{b} as c_am, nr_{b} as c_nr, vd_{b} as c_vd, score, f_ref, f_amt, f_date, f_cp from " + scored
    return f"""{SCORED},
views as ({half.format(a='l', b='r')} union all {half.format(a='r', b='l')}),
first_ranks as (select *, row_number() over (partition by s_id order by score desc, c_ord) as rank from views)"""


ADJUST = f"""round(
  (case when exists_fee and s_am <> c_am then 0.09 when s_am <> c_am and f_amt < 0.5 then -0.06 else 0 end
  + case when cyc in (1, 2, 3, 7) then 0.04 when cyc > 10 then -0.05 else 0 end
  + case when s_nr <> c_nr and (starts_with(s_nr, c_nr) or starts_with(c_nr, s_nr)) then 0.07 else 0 end
  + case when f_ref < 0.3 and f_cp >= 0.99 then -0.08 else 0 end)::double, 4)"""


def adjusted() -> str:
    fee = " or ".join(f"abs(floor(greatest(s_am, c_am)::double * {r}::double * 1.18::double + 0.5) - abs(s_am - c_am)) <= 200" for r in (0.018, 0.02, 0.0236, 0.025))
    return f"""{ranks('fuzzy')},
opinions as (select *, ({fee}) as exists_fee, floor(abs(epoch_us(s_vd) - epoch_us(c_vd))::double / 8.64e10 + 0.5) as cyc, max(score) over (partition by s_id) as top0 from first_ranks),
applied as (select *, top0 >= {T.floor} and top0 < {T.resolve} as adjudicated, case when rank = 1 and top0 >= {T.floor} and top0 < {T.resolve} then greatest(-0.12::double, least(0.12::double, {ADJUST})) else 0.0::double end as applied from opinions),
ranks as (select * exclude (rank, score), case when applied <> 0 then greatest(0.0::double, least(1.0::double, score + applied)) else score end as score,
  row_number() over (partition by s_id order by case when applied <> 0 then greatest(0.0::double, least(1.0::double, score + applied)) else score end desc, rank) as rank from applied)"""


def plain(scored: str) -> str:
    return f"{ranks(scored)},\nranks as (select *, false as adjudicated from first_ranks)"


def decisions(ranked: str) -> str:
    return f"""{ranked},
gapped as (select *, score >= {T.resolve} as strong, greatest(s_ft::double, s_am * {T.fee_tolerance}::double) + {T.rounding_slack_minor}::double as g, max(score) over (partition by s_id) as best from ranks),
tops as (select *, max(score) filter (where strong) over k as top, min(rank) filter (where strong) over k as top_rank, count(*) filter (where strong) over k as n_strong from gapped window k as (partition by s_id, c_kind)),
ties as (select *, strong and top - score < {T.ambiguity_margin} as tied from tops),
sums as (select *, count(*) filter (where tied) over k as n_tied, sum(c_am) filter (where tied) over k as tied_sum, bool_and(abs(c_am - s_am) <= g) filter (where tied) over k as each from ties window k as (partition by s_id, c_kind)),
marks as (select *, abs(tied_sum - s_am) <= g and not each as split, best - score < {T.ambiguity_margin} as near from sums),
flags as (select *, coalesce(strong and (n_strong = 1 or (n_tied < 2 and rank = top_rank) or (n_tied >= 2 and tied and split)), false) as accepted, coalesce(tied and n_strong > 1 and n_tied >= 2 and not split, false) as rival from marks),
each_s as (select s_id, string_agg(c_id, ',' order by rank) filter (where accepted) as acc, count(*) filter (where accepted) as n_acc, string_agg(c_id, ',' order by rank) filter (where rival) as amb,
    string_agg(c_id, ',' order by rank) filter (where near) as nears, count(*) filter (where near) as n_near, min(score) filter (where accepted) as least, max(score) as best, arg_min(c_id, rank) as best_id,
    arg_min(f_ref, rank) as b_ref, arg_min(f_amt, rank) as b_amt, arg_min(f_date, rank) as b_date, arg_min(f_cp, rank) as b_cp, bool_or(adjudicated) as adjudicated from flags group by s_id),
dec as (select l.id, l.ord, l.kind, l.amount_minor, case when s_id is null then 'UNRESOLVED' when n_acc > 0 then 'RESOLVED' when amb is not null then 'EXCEPTION' when best < {T.floor} then 'UNRESOLVED' else 'EXCEPTION' end as state,
    case when s_id is null then 'MISSING_COUNTERPART' when n_acc > 0 then case when amb is not null then 'AMBIGUOUS_MANY_TO_ONE' end when amb is not null then 'AMBIGUOUS_MANY_TO_ONE' when best < {T.floor} then null
      when n_near > 1 then 'AMBIGUOUS_MANY_TO_ONE' when b_amt < 0.5 then 'AMOUNT_MISMATCH_BEYOND_FEE' when b_date = 0 then 'TIMING_BEYOND_WINDOW' when b_ref < 0.4 then 'REFERENCE_UNRECOGNIZED' else 'LOW_CONFIDENCE' end as exception_kind,
    case when s_id is null then 'NO_CANDIDATE' when n_acc > 0 then 'ABOVE_RESOLVE_THRESHOLD' when amb is not null then 'MUTUALLY_EXCLUSIVE_CANDIDATES' when best < {T.floor} then 'BELOW_FLOOR' else 'BELOW_RESOLVE_THRESHOLD' end as decided_by,
    round(case when s_id is null then 0.0 when n_acc > 0 then least else best end, 4)::double as confidence, coalesce(acc, '') as accepted_ids,
    coalesce(case when n_acc > 0 or amb is not null then amb when best < {T.floor} then '' else nears end, '') as ambiguous_ids, best_id, b_ref, b_amt, b_date, b_cp, coalesce(adjudicated, false) as adjudicated
  from live l left join each_s on l.id = s_id)"""


def components(ranked: str, split: bool) -> str:
    base = f"""{decisions(ranked)},
arcs as (select s_ord as a, c_ord as b from flags where accepted union select c_ord, s_ord from flags where accepted),
reach as (select ord as a, ord as b from live union select r.a, e.b from reach r join arcs e on r.b = e.a),
comp1 as (select a as ord, min(b) as comp from reach group by a)"""
    if not split:
        return base + ",\ncomp as (select * from comp1)"
    return base + f""",
money as (select comp, arg_min(amount_minor, l.ord) filter (where kind in ('ORDER', 'PG_PAYMENT')) as gross, max(amount_minor) filter (where kind in ('SETTLEMENT', 'BANK_STATEMENT')) as net
  from live l join comp1 c on l.ord = c.ord group by comp),
bearing as (select distinct norm_ref, c.comp, gross, net from live l join comp1 c on l.ord = c.ord join money m on m.comp = c.comp where norm_ref is not null),
wholes as (select w.norm_ref, w.comp as whole from bearing w join bearing p on w.norm_ref = p.norm_ref and w.comp <> p.comp and p.net is not null
  where w.gross is not null group by w.norm_ref, w.comp, w.gross having count(*) >= 2 and abs(sum(p.net) - w.gross) <= w.gross * {T.fee_tolerance}::double + {T.rounding_slack_minor}),
links as (select whole as a, p.comp as b from wholes w join bearing p on w.norm_ref = p.norm_ref and p.net is not null and p.comp <> whole),
arcs2 as (select a, b from links union select b, a from links),
reach2 as (select distinct comp as a, comp as b from comp1 union select r.a, e.b from reach2 r join arcs2 e on r.b = e.a),
comp2 as (select a, min(b) as comp from reach2 group by a),
comp as (select c.ord, d.comp from comp1 c join comp2 d on c.comp = d.a)"""


def groups(ranked: str, split: bool) -> str:
    return f"""{components(ranked, split)},
grp as (select comp from comp group by comp having count(*) >= 2),
mem as (select 'mch_' || lpad(c.comp::varchar, 14, '0') as match_id, d.* from comp c join grp g on c.comp = g.comp join dec d on d.ord = c.ord),
mat as (select match_id, string_agg(id, ',' order by ord) as record_ids, min(confidence) as confidence, arg_min(decided_by, ord) as decided_by, bool_or(adjudicated) as adjudicated,
    (max(amount_minor) - min(amount_minor))::bigint as amount_delta_minor, count(distinct kind)::bigint as sources, count(*)::bigint as size from mem group by match_id),
lef as (select * from dec where id not in (select id from mem)),
exc as (select 'exc_' || lpad(ord::varchar, 14, '0') as exception_id, exception_kind as kind, id as record_ids,
    case when ambiguous_ids <> '' then ambiguous_ids else coalesce(best_id, '') end as recommended_ids, confidence, amount_minor as amount_at_risk_minor
  from lef where (state = 'EXCEPTION' and exception_kind is not null) or decided_by = 'NO_CANDIDATE')"""


def classified(ranked: str, split: bool) -> str:
    return f"""{groups(ranked, split)},
tru as (select a.id as id_l, b.id as id_r from live a join live b on a.truth_group_id = b.truth_group_id and a.id < b.id),
pro as (select a.id as id_l, b.id as id_r, m.confidence from mem a join mem b on a.match_id = b.match_id and a.id < b.id join mat m on m.match_id = a.match_id),
que as (select distinct least(record_ids, x) as id_l, greatest(record_ids, x) as id_r from (select record_ids, unnest(string_split(recommended_ids, ',')) as x from exc where recommended_ids <> '')),
cls as (select coalesce(t.id_l, p.id_l) as id_l, coalesce(t.id_r, p.id_r) as id_r, p.confidence,
    case when p.id_l is not null and t.id_l is not null then 'TRUE_MATCH' when p.id_l is not null then 'FALSE_MATCH' when q.id_l is not null then 'CORRECT_EXCEPTION' else 'MISSED' end as outcome
  from tru t full join pro p on t.id_l = p.id_l and t.id_r = p.id_r left join que q on q.id_l = coalesce(t.id_l, p.id_l) and q.id_r = coalesce(t.id_r, p.id_r)),
shp as (select c.*, regexp_replace(replace(a.truth_group_id, 'grp_', ''), '-[0-9]+$', '') as shape_l, regexp_replace(replace(b.truth_group_id, 'grp_', ''), '-[0-9]+$', '') as shape_r
  from cls c join live a on a.id = id_l join live b on b.id = id_r)"""


def q(ctes: str, select: str) -> str:
    return f"with recursive {ctes}\n{select}"


FUZZY, ADJUDICATED, BASELINE = plain("fuzzy"), adjusted(), plain("exact")
METRICS = """
select (select count(*) from live)::bigint as record_count, (select count(distinct id) from mem)::bigint as matched_records, round((select count(distinct id) from mem)::double / (select count(*) from live), 4) as match_rate,
  (t + m + e)::bigint as truth_pairs, (t + f)::bigint as proposed_pairs, t::bigint as true_pairs, f::bigint as false_pairs, m::bigint as missed_pairs, e::bigint as exception_pairs,
  round(case when t + f = 0 then 0 else t::double / (t + f) end, 4) as precision, round(case when t + m + e = 0 then 0 else t::double / (t + m + e) end, 4) as recall,
  round(case when t = 0 then 0 else 2.0 * t / (2 * t + f + m + e) end, 4)::double as f1, round(case when t + f = 0 then 0 else f::double / (t + f) end, 4) as false_match_rate,
  (select count(*) from exc)::bigint as exception_count, (select count(*) from lef where not coalesce(state = 'EXCEPTION' and exception_kind is not null, false))::bigint as unresolved_count,
  (select coalesce(sum(amount_at_risk_minor), 0) from exc)::bigint as amount_in_exceptions_minor, round(coalesce(ct, 0), 4) as mean_confidence_true, round(coalesce(cf, 0), 4) as mean_confidence_false
from (select count(*) filter (where outcome = 'TRUE_MATCH') as t, count(*) filter (where outcome = 'FALSE_MATCH') as f, count(*) filter (where outcome = 'MISSED') as m, count(*) filter (where outcome = 'CORRECT_EXCEPTION') as e,
  avg(confidence) filter (where outcome = 'TRUE_MATCH') as ct, avg(confidence) filter (where outcome = 'FALSE_MATCH') as cf from cls)"""

SHAPES = """
select shape, (t + e + m)::bigint as truth_pairs, t::bigint as true_pairs, f::bigint as false_pairs, e::bigint as exception_pairs, m::bigint as missed_pairs, round(case when t + e + m = 0 then 0 else t::double / (t + e + m) end, 4) as recall
from (select v.shape, count(*) filter (where outcome = 'TRUE_MATCH') as t, count(*) filter (where outcome = 'FALSE_MATCH') as f, count(*) filter (where outcome = 'CORRECT_EXCEPTION') as e, count(*) filter (where outcome = 'MISSED') as m
  from (values ('clean'), ('fee-deducted'), ('split-settlement'), ('timing-lag'), ('reference-typo'), ('missing-counterpart'), ('duplicate'), ('many-to-one')) v(shape)
  left join shp on v.shape = shape_l or (outcome = 'FALSE_MATCH' and v.shape = shape_r) group by v.shape)"""
