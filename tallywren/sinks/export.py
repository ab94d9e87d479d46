"""Exports: the exception queue as CSV, the sign-off report as Markdown, and run tables as Parquet."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import inr
from ..plans.reconcile import Run

# The queue's columns.
COLUMNS = (
    "exception_id", "kind", "amount_at_risk_inr", "amount_at_risk_minor", "engine_confidence", "candidates_offered", "record_source", "record_external_id", "record_reference", "record_amount_inr",
    "record_value_date", "recommended_external_ids", "recommended_sources", "reviewed", "explanation",
)
EOL = "\r\n"


def csv_cell(c):
    """Quoted if a delimiter, quote or line break is in it."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def exception_rows(exceptions: DataFrame, records: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """One row for each exception with the columns of the queue; recommended records keep their order and
    missing ones are left out."""
    subject = records.select(F.col("id").alias("sid"), F.col("kind").alias("s_kind"), F.col("external_id").alias("s_ext"), F.col("reference").alias("s_ref"), F.col("amount_minor").alias("s_amount"), "value_date")
    offered = (
        exceptions.select("exception_id", F.posexplode("recommended_ids").alias("pos", "rid"))
        .join(records.select(F.col("id").alias("rid"), F.col("external_id").alias("ext"), F.col("kind").alias("k")), "rid")
        .groupBy("exception_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ext", "k"))).alias("o"))
    )
    rows = exceptions.withColumn("sid", F.get("record_ids", F.lit(0))).join(subject, "sid", "left").join(offered, "exception_id", "left")
    if reviews is not None:
        rows = rows.join(reviews.select("exception_id", F.lit(True).alias("seen")).distinct(), "exception_id", "left")
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("boolean"))
    names = lambda f: F.coalesce(F.array_join(F.transform("o", lambda x: x[f]), " | "), F.lit(""))
    return rows.select(
        "exception_id", "kind", inr("amount_at_risk_minor").alias("amount_at_risk_inr"), "amount_at_risk_minor", F.format_string("%.4f", "confidence").alias("engine_confidence"), F.size("recommended_ids").alias("candidates_offered"),
        F.coalesce("s_kind", F.lit("")).alias("record_source"), F.coalesce("s_ext", F.lit("")).alias("record_external_id"), F.coalesce("s_ref", F.lit("")).alias("record_reference"),
        F.coalesce(inr("s_amount"), F.lit("")).alias("record_amount_inr"), F.coalesce(F.date_format("value_date", "yyyy-MM-dd"), F.lit("")).alias("record_value_date"),
        names("ext").alias("recommended_external_ids"), names("k").alias("recommended_sources"), F.when(F.col("seen"), "yes").otherwise("no").alias("reviewed"), "explanation",
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """The rows as CSV lines, most money first."""
    return rows.orderBy(F.desc("amount_at_risk_minor"), "exception_id").select(F.concat_ws(",", *(csv_cell(F.col(c)) for c in COLUMNS)).alias("value"))


def csv_name(run: Run) -> str:
    return f"exceptions-{run.run_id}.csv"


def exceptions_csv(run: Run, reviews: DataFrame | None = None) -> tuple[str, str]:
    """File name and body. The queue is for people; one that does not fit the driver goes through ``write_csv``."""
    body = [",".join(COLUMNS), *(r.value for r in csv_lines(exception_rows(run.exceptions, run.records, reviews)).collect())]
    return csv_name(run), EOL.join(body) + EOL


def write_csv(run: Run, path: str, reviews: DataFrame | None = None) -> None:
    """The queue in a folder of files that make one CSV if they are joined in order of their names: the header is the first line of the first."""
    rows = exception_rows(run.exceptions, run.records, reviews)
    lines = rows.select(F.lit(1).alias("part"), F.col("amount_at_risk_minor").alias("minor"), "exception_id", F.concat_ws(",", *(csv_cell(F.col(c)) for c in COLUMNS)).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, None, None, ",".join(COLUMNS))], "part int, minor long, exception_id string, value string")
    lines.union(head).orderBy("part", F.desc("minor"), "exception_id").select("value").write.mode("overwrite").option("lineSep", EOL).text(path)


def _money(minor: int) -> str:
    whole, paise = divmod(abs(minor), 100)
    head, tail = str(whole)[:-3], str(whole)[-3:]
    groups = []
    while head:
        groups.insert(0, head[-2:])
        head = head[:-2]
    return ("-" if minor < 0 else "") + "₹" + ",".join([*groups, tail]) + f".{paise:02d}"


def report(run: Run, summary: dict, comparison: dict | None = None, reviews: DataFrame | None = None, now: datetime | None = None) -> tuple[str, str]:
    """The sign-off report: what needs a person first, then what was done, then how good it was."""
    kinds = run.exceptions.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount_at_risk_minor").alias("amount")).orderBy(F.desc("amount"), "kind").collect()
    many = run.exceptions.where(F.size("recommended_ids") > 1).count()
    seen = reviews.select("exception_id").distinct().count() if reviews is not None else 0
    n = summary["record_count"]
    table = lambda head, rows: [f"| {' | '.join(head)} |", "|" + "|".join(["---", *["---:"] * (len(head) - 1)]) + "|", *(f"| {' | '.join(map(str, r))} |" for r in rows), ""]
    out = [
        "# Reconciliation report", "", f"**Run** `{run.run_id}` — {summary['label']}", "", f"Generated {(now or datetime.now(timezone.utc)):%Y-%m-%d %H:%M:%S} UTC.", "",
        "## Open work", "",
        f"- **{summary['exception_count'] - seen} open exceptions**, holding **{_money(sum(k.amount for k in kinds))}**.",
        f"- {many} of them offer several candidates that cannot be told apart.", f"- {summary['unresolved_count']} records had no candidate worth offering.", "",
        "## Exceptions by kind", "", *table(["Kind", "Count", "Amount at risk"], [(f"`{k.kind}`", k.n, _money(k.amount)) for k in kinds]),
        "## What the run did", "",
        *table(["Measure", "Value"], [
            ("Records reconciled", n), ("Candidate pairs scored", f"{summary['candidate_count']:,}"), ("Match groups resolved", summary["match_count"]), ("Exceptions raised", summary["exception_count"]),
            ("Unresolved records", summary["unresolved_count"]), ("Duration", f"{summary['duration_ms']} ms"), ("Throughput", f"{round(summary['records_per_second']):,} records/sec"), ("Adjudicator", summary["adjudicator"]),
        ]),
        f"All pairs would have been {n * (n - 1) // 2:,} comparisons; blocking left {summary['candidate_count']:,}.", "",
        "### Thresholds used", "", *table(["Threshold", "Value"], [(f"`{k}`", v) for k, v in summary["thresholds"].items()]),
    ]
    if comparison:
        a, b = comparison["baseline"], comparison["system"]
        rows = [("Match rate", *(f"{x['match_rate'] * 100:.1f}%" for x in (a, b)))]
        rows += [(name, *(f"{x[key]:.3f}" for x in (a, b))) for name, key in (("Precision", "precision"), ("Recall", "recall"), ("F1", "f1"))]
        rows += [(name, a[key], b[key]) for name, key in (("False matches", "false_pairs"), ("Missed pairs", "missed_pairs"), ("Unresolved records", "unresolved_count"))]
        out += ["## Measured against held-out truth", "", "The unit is a pair of records; a true pair sent to the queue is a correct exception, not a miss.", "", *table(["Measure", "Exact-join baseline", "This run"], rows)]
        shapes = [(s["shape"], s["truth_pairs"], s["true_pairs"], s["false_pairs"], s["exception_pairs"], s["missed_pairs"], f"{s['recall']:.3f}") for s in b["per_shape"]]
        out += ["### Per defect shape", "", *table(["Shape", "Truth pairs", "Recovered", "False", "To a person", "Lost", "Recall"], shapes)]
        out += ["### Where the baseline wins", "", *([f"- {r}" for r in comparison["regressions"]] or ["Nothing on this run."]), ""]
        out += ["### Confidence calibration", "", *table(["Band", "Pairs", "Correct", "Observed precision"], [(c["bucket"], c["pairs"], c["true_pairs"], f"{c['observed_precision']:.3f}") for c in b["calibration"]])]
        out += [f"Mean confidence on correct pairs {b['mean_confidence_true']:.3f}, on wrong pairs {b['mean_confidence_false']:.3f}.", ""]
    else:
        out += ["## Measured against held-out truth", "", "No evaluation was made of this run, so no precision or recall is reported.", ""]
    out += ["## Limits of this report", "", "- Candidates are kept as a capped sample of the run.", "- Figures over generated records say little about other ledgers.", ""]
    return f"reconciliation-report-{run.run_id}.md", "\n".join(out)
