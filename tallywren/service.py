"""The engine as a service object: ingest, reconcile, list, evaluate, review, audit, export, health.

All that it knows lies in ``store``, a folder of Parquet tables to which it only appends, so that another service over the
same folder goes on where this one ended. Without one the tables lie in the session's shared folder.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LedgerError
from .logs import event, get_logger
from .plans import evaluate as ev
from .plans import scenarios, views
from .plans.reconcile import Run
from .schema import KINDS, MatchOptions, Thresholds
from .session import materialize, new_path
from .sinks import export
from .sinks.audit import AuditLog
from .sinks.reviews import ReviewDesk
from .sinks.store import Store
from .sources import corpus, csv_ledger, ingest

log = get_logger()


class LedgerService:
    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark = spark
        self.store = Store(spark, store or new_path(spark, "store"))
        self.audit = AuditLog(spark, f"{self.store.path}/audit")
        self._loaded: dict[str, Run] = {}

    @property
    def records(self) -> DataFrame | None:
        """All stored records, or None before the first."""
        return self.store.records() if self.store.has("records") else None

    def _stored(self) -> DataFrame:
        if not self.store.has("records"):
            raise LedgerError("RECORD_NOT_FOUND", "Nothing has been ingested.")
        return self.store.records()

    def _next(self) -> int:
        """The first place in record order that is free."""
        top = self.store.records().agg(F.max("ord")).first()[0]
        return 0 if top is None else top + 1

    def use(self, records: DataFrame) -> None:
        """Adds records that are normalised and marked already."""
        self.store.add_records(records)

    def ingest_generated(self, seed: int = corpus.DEFAULT_SEED) -> dict:
        rows = corpus.corpus_records(self.spark, seed)
        if self.store.has("records"):
            rows = rows.withColumn("ord", F.col("ord") + self._next()).join(self.store.records().select("kind", "external_id"), ["kind", "external_id"], "left_anti")
        rows = materialize(rows, "corpus")
        out = {"inserted": rows.count(), "duplicates": rows.where("duplicate_of_id is not null").count(), "seed": seed}
        self.store.add_records(rows)
        self.audit.append("INGEST", f"seed-{seed}", out)
        event(log, "ingest_complete", **out)
        return out

    def ingest_csv(self, text: str, kind: str, origin: str = "upload", lenient: bool = False) -> dict:
        """Redelivered rows are dropped and counted; rejected rows come back with their lines."""
        if kind not in KINDS:
            raise LedgerError("SOURCE_NOT_FOUND", f"unknown source kind {kind}")
        good, bad = csv_ledger.parse_text(self.spark, text, kind, lenient)
        out = self._add_upload(good, kind, origin)
        out["skipped"] = [r.asDict() for r in bad.orderBy("line").collect()]  # at most an upload's rows
        self.audit.append("INGEST_UPLOAD", origin, {"kind": kind, "inserted": out["inserted"], "duplicates": out["duplicates"], "rejected": len(out["skipped"])})
        return out

    def ingest_folder(self, path: str, header: str, kind: str, lenient: bool = False) -> dict:
        """Large files in parallel; rejected rows are only counted."""
        good, bad = csv_ledger.read_files(self.spark, path, header, kind, lenient)
        out = self._add_upload(good, kind, path) | {"rejected": bad.count()}
        self.audit.append("INGEST_UPLOAD", path, {"kind": kind, **out})
        return out

    def _add_upload(self, good: DataFrame, kind: str, origin: str) -> dict:
        rows = ingest.mark_duplicates(ingest.normalized(good.withColumn("ord", F.col("ord") + self._next())))
        fresh, counts = ingest.load(self.store.records(), rows)
        fresh, n = materialize(fresh, "upload"), counts.first()
        self.store.add_records(fresh.withColumn("duplicate_of_id", F.lit(None).cast("string")))
        event(log, "upload_complete", kind=kind, origin=origin, inserted=n.inserted, duplicates=n.duplicates)
        return {"inserted": n.inserted, "duplicates": n.duplicates}

    def sources(self) -> DataFrame:
        return ingest.sources(self._stored())

    def reconcile(self, strategy: str = "fuzzy+adjudicator", label: str | None = None, options: MatchOptions = MatchOptions(), adjudicator=None, **thresholds) -> dict:
        records, upto = self._stored(), self._next()
        run_id = f"run_{len(self.runs(1 << 20)) + 1:06d}"
        r = Run(records, strategy, Thresholds().override(**thresholds), options, label, run_id, adjudicator)
        summary = r.summary()
        self.store.add_run(r)
        self.store.add("runs", "rnr", run_id, "baseline" if r.baseline else "system", {"summary": summary, "upto": upto})
        self._loaded[run_id] = r
        self.audit.append("RECONCILE_RUN", run_id, {k: v for k, v in summary.items() if k not in ("duration_ms", "records_per_second")})
        if summary["fell_back_count"]:
            event(log, "adjudicator_fell_back", logging.WARNING, run_id=run_id, subjects=summary["fell_back_count"])
        event(log, "reconcile_complete", **summary)
        return summary

    def runs(self, limit: int = 40) -> list[dict]:
        """Summaries of the latest runs."""
        return [r["summary"] for r in self.store.latest("runs", limit)]

    def run(self, run_id: str | None = None, baseline: bool | None = None) -> tuple[Run, dict]:
        """A run by id, or the latest; ``baseline`` picks among the latest of that sort."""
        kind = None if run_id or baseline is None else "baseline" if baseline else "system"
        found = self.store.latest("runs", 1, run_id, kind)
        if not found:
            raise LedgerError("RUN_NOT_FOUND", f"No reconciliation run {run_id or ''}.")
        summary, upto = found[0]["summary"], found[0]["upto"]
        if summary["run_id"] not in self._loaded:
            records = self._stored().where(F.col("ord") < upto)
            self._loaded[summary["run_id"]] = self.store.load_run(Run(records, summary["strategy"], Thresholds().override(**summary["thresholds"]), label=summary["label"], run_id=summary["run_id"]))
        return self._loaded[summary["run_id"]], summary

    def matches(self, run_id: str | None = None, limit: int = 100) -> DataFrame:
        return self.run(run_id)[0].matches.orderBy("match_id").limit(views.capped(limit, 100, 500))

    def match(self, match_id: str, run_id: str | None = None) -> DataFrame:
        """A match's members with their records."""
        r = self.run(run_id)[0]
        found = r.members.where(F.col("match_id") == match_id).select("match_id", "id").join(r.records, "id")
        if found.isEmpty():
            raise LedgerError("MATCH_NOT_FOUND", f"No match {match_id}.")
        return found

    def exception_queue(self, run_id: str | None = None, limit: int = 200, kind: str | None = None) -> DataFrame:
        return views.queue(self.run(run_id)[0].exceptions, views.capped(limit, 200, 1000), kind)

    def evaluate(self, run_id: str | None = None, with_baseline: bool = True) -> dict:
        """Metrics of a run, kept with its false matches as cases."""
        r, s = self.run(run_id)
        if not with_baseline:
            out = ev.evaluate(r)
        else:
            try:
                b, bs = self.run(baseline=True)
            except LedgerError:
                self.reconcile("baseline-exact")
                b, bs = self.run(baseline=True)
            out = ev.compare(r, b, (s["records_per_second"], bs["records_per_second"]))
        made = self.store.add("evaluations", "evr", r.run_id, "comparison" if with_baseline else "run", out)
        self.store.append("evaluation_cases", ev.cases(r).select(F.lit(made).alias("evaluation_id"), F.lit(r.run_id).alias("run_id"), "truth_group_id", "outcome", "confidence", "detail"))
        event(log, "evaluation_complete", evaluation_id=made, run_id=r.run_id, **{k: (out["system"] if with_baseline else out)[k] for k in ("precision", "recall", "f1")})
        return out | {"evaluation_id": made}

    def latest_evaluations(self, limit: int = 10) -> list[dict]:
        return self.store.latest("evaluations", limit)

    def cases(self, evaluation_id: str) -> DataFrame:
        return self.store.read("evaluation_cases", "evaluation_id string, run_id string, truth_group_id string, outcome string, confidence double, detail string").where(F.col("evaluation_id") == evaluation_id)

    def desk(self, run_id: str | None = None) -> ReviewDesk:
        r = self.run(run_id)[0]
        return ReviewDesk(self.spark, r.exceptions, self.audit, self.store, r.run_id)

    def review(self, exception_id: str, outcome: str, reviewer: str, note: str = "", run_id: str | None = None) -> str:
        made = self.desk(run_id).review(exception_id, outcome, reviewer, note)
        event(log, "review_recorded", review_id=made, exception_id=exception_id, outcome=outcome)
        return made

    def reviews(self, run_id: str | None = None) -> DataFrame:
        return self.desk(run_id).reviews()

    def latest_reviews(self, limit: int = 60) -> list[dict]:
        """The latest reviews of all runs."""
        return self.store.latest("reviews", limit)

    def receipts(self, limit: int = 60) -> DataFrame:
        return self.audit.latest(limit)

    def at_risk(self, run_id: str | None = None) -> dict:
        """The run's money in all and in open exceptions."""
        return views.at_risk(self.run(run_id)[0].exceptions, self.reviews(run_id)).first().asDict()

    def export(self, fmt: str, run_id: str | None = None, folder: str | None = None) -> tuple[str, str]:
        """``csv`` or ``md`` of a run, by default the latest that is no baseline, as name and body. With a ``folder`` the CSV is
        written there by the executors, and its body is the folder's name."""
        r, s = self.run(run_id) if run_id else self.run(baseline=False)
        reviews = self.reviews(r.run_id)
        if fmt == "csv" and folder:
            export.write_csv(r, folder, reviews)
            out = export.csv_name(r), folder
        elif fmt == "csv":
            out = export.exceptions_csv(r, reviews)
        elif fmt == "md":
            comparison = next(iter(self.store.latest("evaluations", 1, r.run_id, "comparison")), None)
            out = export.report(r, s, comparison, reviews)
        else:
            raise LedgerError("VALIDATION_FAILED", "format must be csv or md")
        self.audit.append("EXPORT", r.run_id, {"format": fmt, "filename": out[0]})
        return out

    def demo(self, scenario: str) -> dict:
        """One of the named scenarios over the latest run, with whether it passed."""
        return scenarios.play(self, scenario)

    def health(self) -> dict:
        runs = self.runs(1 << 20)
        return {"ok": True, "records": self.store.records().count(), "runs": len(runs), "matches": sum(s["match_count"] for s in runs)}
