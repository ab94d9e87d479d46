"""Records whose candidates all bear their own reference: scored, ranked, decided and grouped where their reference stands.

A reference is *closed* if its block is at most ``block_cap`` large and no other block that gives pairs holds another reference beside
it. Its records then have candidates among themselves only, and so have their groups and splits: one shuffle by the reference
brings together all that a decision needs. All others are open and go through the general plan; no pair links the two.

The arithmetic is that of ``scoring``, ``ranking``, ``policy`` and ``split_edges`` for equal references, on columns of whole batches;
``tests/test_scale.py`` holds it against the general plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import WEIGHTS
from ..schema import MatchOptions, Thresholds
from .blocking import SIDES, all_keys
from .ranking import CYCLE_DAYS, FEE_RATES, FEE_SLACK, GST, LIMIT

FEATURES = "struct<reference: double, amount: double, date: double, counterparty: double, cross_source: double>"
SCHEMA = f"""id string, ord long, kind string, amount_minor long, comp long, size long, decided_by string, confidence double, adjudicated boolean,
best struct<rank: int, c_id: string, score: double, features: {FEATURES}>, ambiguous array<string>, near array<string>,
record_ids array<string>, least double, any_adjudicated boolean, amount_delta_minor long, sources long"""
DECIDED = ("NO_CANDIDATE", "ABOVE_RESOLVE_THRESHOLD", "MUTUALLY_EXCLUSIVE_CANDIDATES", "BELOW_FLOOR", "BELOW_RESOLVE_THRESHOLD")
NEEDED = ("id", "ord", "kind", "currency", "amount_minor", "fee_minor", "tax_minor", "value_date")


def block_facts(records: DataFrame, hot: DataFrame, options: MatchOptions) -> DataFrame:
    """``(key, n, mixed)`` of the blocks that are not hot: members, and whether they bear several references and sources. References are
    told apart by 64-bit hashes. Blocks that change nothing, within one reference and the cap, are left out."""
    keys = records.select(F.xxhash64("norm_ref").alias("r"), F.xxhash64("kind").alias("k"), F.explode(all_keys(options)).alias("key")).where("key is not null").join(hot, "key", "left_anti")
    each = keys.groupBy("key").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "rk" for f in (F.min, F.max)))
    mixed = (F.col("min_r") != F.col("max_r")) & (F.col("min_k") != F.col("max_k"))
    return each.select("key", "n", mixed.alias("mixed")).where((F.col("n") > options.block_cap) | mixed)


def open_references(records: DataFrame, hot: DataFrame, facts: DataFrame, options: MatchOptions) -> DataFrame:
    """References that are not closed: of oversized blocks of their own, in a block with others, or on a record that lacks a value."""
    cap = options.block_cap
    large = hot.select("key").union(facts.where(F.col("n") > cap).select("key")).where(F.col("key").startswith("ref:")).select(F.expr("substring(key, 5)").alias("norm_ref"))
    # By hashes of the keys: one that coincides opens a reference without need, which changes no result.
    shared = facts.where(F.col("mixed") & (F.col("n") <= cap)).select(F.xxhash64("key").alias("h")).hint("shuffle_hash")
    rows = records.where("norm_ref is not null")
    lacking = rows.where(" or ".join(("norm_ref = ''", *(f"{c} is null" for c in NEEDED)))).select("norm_ref")
    # A reference's own block holds no other, and hot blocks give no pairs.
    keys = rows.select("norm_ref", F.explode(F.slice(all_keys(options), 2, 99)).alias("key")).where("key is not null").join(hot, "key", "left_anti")
    among = keys.select("norm_ref", F.xxhash64("key").alias("h")).join(shared, "h", "left_semi").select("norm_ref")
    return large.union(lacking).union(among).distinct()


def round4(x: np.ndarray) -> np.ndarray:
    """Half up to four places of the shortest decimal, as Spark rounds."""
    y = x * 1e4
    low = np.floor(y)
    out = np.floor(y + 0.5) / 1e4
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    d = column.dictionary_encode()
    return pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _names_alike(a: np.ndarray, b: np.ndarray, names: list) -> np.ndarray:
    """The Jaccard similarity of names by their codes; null or empty names have none."""
    out = np.where((a == b) & (a >= 0), 1.0, 0.0)
    if "" in names:
        out[a == names.index("")] = 0.0
    other = np.flatnonzero((a != b) & (a >= 0) & (b >= 0))
    seen: dict[tuple[int, int], float] = {}
    for i in other:
        at = (int(a[i]), int(b[i]))
        if at not in seen:
            x, y = names[at[0]], names[at[1]]
            p, q = set(x.split(" ")), set(y.split(" "))
            seen[at] = len(p & q) / len(p | q) if x and y else 0.0
        out[i] = seen[at]
    return out


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label that edges ``a, b`` reach from each of ``n`` nodes."""
    label = label.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if np.array_equal(before, label):
            break
    return label


def _lists(values: pa.Array, rows: np.ndarray, take: np.ndarray, n: int, some: np.ndarray | None = None) -> pa.Array:
    """A list for each of ``n`` rows, of ``values`` at ``take``; ``rows`` ascend. Rows outside ``some`` are null."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    mask = None if some is None else pa.array(~some)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(take)), mask=mask)


def decide_batch(t: pa.Table, th: Thresholds, adjudicate: bool, baseline: bool, may_resolve: bool, ungrouped: bool = False) -> pa.RecordBatch:
    """Rows of whole references, sorted by reference and order, to rows of ``SCHEMA``; with ``ungrouped`` only records of no group."""
    t = t.combine_chunks()
    col = {c: t.column(c).chunk(0) for c in t.column_names}
    n = t.num_rows
    ids = col["id"]
    ord_, am = col["ord"].to_numpy(), col["amount_minor"].to_numpy()
    charge = col["fee_minor"].to_numpy() + col["tax_minor"].to_numpy()
    when = col["value_date"].cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()
    ref, _ = _codes(col["norm_ref"])
    kind, kinds = _codes(col["kind"])
    money, _ = _codes(col["currency"])
    cp, names = _codes(col["norm_cp"])
    head = np.flatnonzero(np.r_[True, ref[1:] != ref[:-1]])
    count = np.diff(np.r_[head, n])
    start, many = np.repeat(head, count), np.repeat(count, count)

    s = np.repeat(np.arange(n), many)
    c = np.repeat(start, many) + np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
    fits = (kind[s] != kind[c]) & (money[s] == money[c]) & (ord_[s] != ord_[c])
    if baseline:
        fits &= am[s] == am[c]
    s, c = s[fits], c[fits]
    gap = np.abs(am[s] - am[c])
    far, gross = gap.astype(float), np.maximum(am[s], am[c]).astype(float)
    fee = np.maximum(np.maximum(charge[s], charge[c]).astype(float), gross * th.fee_tolerance) + th.rounding_slack_minor
    with np.errstate(divide="ignore", invalid="ignore"):
        f_amt = np.where(far == 0, 1.0, np.where(far <= fee, 0.92, np.where(far <= fee * 3, 0.92 * (1 - (far - fee) / (fee * 2)), 0.0)))
    days = np.abs(when[s] - when[c]) / 8.64e10
    window = th.date_window_days
    f_date = np.where(days <= window, 1 - (days / window) * 0.6, 0.0) if window else np.where(days == 0, 1.0, 0.0)
    f_cp = _names_alike(cp[s], cp[c], names)
    w = list(WEIGHTS.values())
    score = np.ones(len(s)) if baseline else round4(1.0 * w[0] + f_amt * w[1] + f_date * w[2] + f_cp * w[3])

    def ranked(*keys: np.ndarray) -> None:
        """Deals the pairs anew by subject and the keys."""
        nonlocal s, c, score, gap, gross, days, f_amt, f_date, f_cp, applied, rank
        o = np.lexsort((*reversed(keys), s))
        s, c, score, gap, gross, days, f_amt, f_date, f_cp, applied = (x[o] for x in (s, c, score, gap, gross, days, f_amt, f_date, f_cp, applied))
        firsts = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(firsts)
        rank = np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)])) + 1

    applied, rank = np.zeros(len(s)), np.zeros(len(s), np.int64)
    ranked(-score, ord_[c])
    put = np.zeros(n, bool)
    if adjudicate:
        one = rank == 1
        put[s[one]] = (score[one] >= th.floor) & (score[one] < th.resolve)
        told = np.flatnonzero(one & put[s])
        g, d = gross[told], np.floor(days[told] + 0.5)
        owed = np.zeros(len(told), bool)
        for r in FEE_RATES:
            owed |= np.abs(np.floor(g * r * (1 + GST) + 0.5) - gap[told]) <= FEE_SLACK
        said = np.where(owed & (gap[told] > 0), 0.09, np.where((gap[told] > 0) & (f_amt[told] < 0.5), -0.06, 0.0)) + np.where(np.isin(d, CYCLE_DAYS), 0.04, np.where(d > 10, -0.05, 0.0))
        applied[told] = np.clip(round4(said), -LIMIT, LIMIT)
        moved = np.clip(score + applied, 0.0, 1.0)
        if not may_resolve:
            moved = np.where(score < th.resolve, np.minimum(moved, th.resolve - 1e-4), moved)
        score = np.where(applied != 0, moved, score)
        if len(told):
            ranked(-score, rank)

    k = len(kinds) + 1
    by = s * k + kind[c]
    strong = score >= th.resolve
    top, top_rank = np.full(n * k, -1.0), np.full(n * k, 1 << 40)
    np.maximum.at(top, by[strong], score[strong])
    np.minimum.at(top_rank, by[strong], rank[strong])
    n_strong = np.bincount(by[strong], minlength=n * k)
    tied = strong & (top[by] - score < th.ambiguity_margin)
    n_tied = np.bincount(by[tied], minlength=n * k)
    tied_sum = np.zeros(n * k, np.int64)
    np.add.at(tied_sum, by[tied], am[c][tied])
    slack = np.maximum(charge.astype(float), am * th.fee_tolerance) + th.rounding_slack_minor
    alone = np.ones(n * k, bool)
    np.logical_and.at(alone, by[tied], (np.abs(am[c] - am[s]) <= slack[s])[tied])
    split = (np.abs(tied_sum[by] - am[s]) <= slack[s]) & ~alone[by]
    accepted = strong & ((n_strong[by] == 1) | ((n_tied[by] < 2) & (rank == top_rank[by])) | ((n_tied[by] >= 2) & tied & split))
    ambiguous = tied & (n_strong[by] > 1) & (n_tied[by] >= 2) & ~split
    best = np.full(n, -1.0)
    np.maximum.at(best, s, score)
    near = best[s] - score < th.ambiguity_margin

    # Groups: what acceptance joins, then the splits.
    comp = _components(n, s[accepted], c[accepted], ord_)
    if not baseline:
        comp = _with_splits(comp, head, count, ord_, am, kind, kinds, th)
    o = np.lexsort((ord_, comp))
    at = np.flatnonzero(np.r_[True, comp[o][1:] != comp[o][:-1]])
    sizes = np.diff(np.r_[at, n])
    size = np.empty(n, np.int64)
    size[o] = np.repeat(sizes, sizes)

    some, rivals, lone = np.zeros(n, bool), np.zeros(n, bool), best < 0
    some[s[accepted]], rivals[s[ambiguous]] = True, True
    least = np.full(n, np.inf)
    np.minimum.at(least, s[accepted], score[accepted])
    first = rank == 1
    best_score, best_at = np.zeros(n), np.full(n, -1)
    best_score[s[first]], best_at[s[first]] = score[first], np.flatnonzero(first)
    low = best_score < th.floor
    decided = np.select([lone, some, rivals, low], [0, 1, 2, 3], 4)
    confidence = round4(np.where(lone, 0.0, np.where(some, least, best_score)))

    single = size == 1
    shown = np.flatnonzero(single & ~lone)
    pick = best_at[shown]
    place = np.full(n, -1)
    place[shown] = np.arange(len(shown))
    features = pa.StructArray.from_arrays([pa.array(x) for x in (np.ones(len(pick)), f_amt[pick], f_date[pick], f_cp[pick], np.ones(len(pick)))], ["reference", "amount", "date", "counterparty", "cross_source"])
    bests = pa.StructArray.from_arrays([pa.array(rank[pick].astype(np.int32)), ids.take(pa.array(c[pick])), pa.array(score[pick]), features], ["rank", "c_id", "score", "features"])
    listed = lambda flag: _lists(ids, s[flag & single[s]], c[flag & single[s]], n)

    leads = np.zeros(n, bool)
    of = o[at]
    leads[of] = (sizes > 1) & (not ungrouped)
    lead_rows = np.flatnonzero(leads)
    run_of = np.empty(n, np.int64)
    run_of[of] = np.arange(len(at))
    runs = run_of[lead_rows]
    spans = np.repeat(at[runs], sizes[runs]) + np.arange(sizes[runs].sum()) - np.repeat(np.cumsum(sizes[runs]) - sizes[runs], sizes[runs])
    over = lambda f, x: f.reduceat(x[o], at) if n else x
    sources = np.zeros(n, np.int64)
    of_run = np.empty(n, np.int64)
    of_run[o] = np.repeat(np.arange(len(at)), sizes)
    sources = np.bincount(np.unique(of_run * k + kind) // k, minlength=len(at))[of_run]
    spread = (over(np.maximum, am) - over(np.minimum, am))[of_run]
    out = pa.RecordBatch.from_arrays(
        [
            ids, col["ord"], col["kind"], col["amount_minor"], pa.array(comp), pa.array(size), pa.array(DECIDED).take(pa.array(decided)), pa.array(confidence), pa.array(put & ~lone),
            bests.take(pa.array(place, mask=place < 0)), listed(ambiguous), listed(near),
            _lists(ids, np.repeat(lead_rows, sizes[runs]), o[spans], n, leads), pa.array(over(np.minimum, confidence)[of_run]), pa.array(over(np.logical_or, put)[of_run]), pa.array(spread), pa.array(sources),
        ],
        ["id", "ord", "kind", "amount_minor", "comp", "size", "decided_by", "confidence", "adjudicated", "best", "ambiguous", "near", "record_ids", "least", "any_adjudicated", "amount_delta_minor", "sources"],
    )
    return out.filter(pa.array(single)) if ungrouped else out


def _with_splits(comp, head, count, ord_, am, kind, kinds, th) -> np.ndarray:
    """The components of each reference with the parts of a split joined to their whole, as ``split_edges`` has them."""
    order = np.array([x in ("ORDER", "PG_PAYMENT") for x in kinds])[kind]
    paid = np.array([x in ("SETTLEMENT", "BANK_STATEMENT") for x in kinds])[kind]
    low, high = np.minimum.reduceat(comp, head), np.maximum.reduceat(comp, head)
    out = comp.copy()
    for g in np.flatnonzero((low != high) & (count > 2)):
        rows = range(head[g], head[g] + count[g])
        gross: dict[int, tuple[int, int]] = {}
        net: dict[int, int] = {}
        comps = set()
        for i in rows:
            x, a = int(comp[i]), int(am[i])
            comps.add(x)
            if order[i] and (x not in gross or ord_[i] < gross[x][0]):
                gross[x] = (int(ord_[i]), a)
            if paid[i]:
                net[x] = max(net.get(x, a), a)
        total, up = sum(net.values()), {x: x for x in comps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, (_, a) in gross.items():
            parts, rest = len(net) - (x in net), total - net.get(x, 0)
            if parts >= 2 and abs(rest - a) <= a * th.fee_tolerance + th.rounding_slack_minor:
                for y in net:
                    p, q = root(x), root(y)
                    up[max(p, q)] = min(p, q)
        for i in rows:
            out[i] = root(int(comp[i]))
    return out


def decide_closed(records: DataFrame, th: Thresholds, options: MatchOptions, adjudicate: bool, baseline: bool, ungrouped: bool = False) -> DataFrame:
    """One row of ``SCHEMA`` for each record of closed references: decision and group; lists and the best candidate only for
    records of no group, and the group's own values where it leads. With ``ungrouped`` records of groups are left out. A Python worker
    holds some ten thousand records at a time."""
    may_resolve = options.adjudicator_may_resolve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = batch.column("norm_ref")
            # The last reference of a batch may go on in the next.
            ends = ref.slice(0, batch.num_rows - 1), ref.slice(1)
            turns = np.flatnonzero(pc.not_equal(*ends).to_numpy(zero_copy_only=False))
            if rest and ref[0] != rest[-1].column("norm_ref")[rest[-1].num_rows - 1]:
                turns = np.r_[-1, turns]
            if not len(turns):
                rest.append(batch)
                continue
            cut = int(turns[-1]) + 1
            whole = [*rest, batch.slice(0, cut)]
            rest = [batch.slice(cut)]
            yield decide_batch(pa.Table.from_batches(whole), th, adjudicate, baseline, may_resolve, ungrouped)
        if rest:
            yield decide_batch(pa.Table.from_batches(rest), th, adjudicate, baseline, may_resolve, ungrouped)

    return records.select(*SIDES).repartition("norm_ref").sortWithinPartitions("norm_ref", "ord").mapInArrow(run, SCHEMA)
