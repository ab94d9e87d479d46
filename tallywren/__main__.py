"""Command line: ``python -m tallywren generate|reconcile|evaluate|export [options]``."""

from __future__ import annotations

import argparse
import json

from .service import LedgerService
from .session import get_session
from .sources.corpus import DEFAULT_SEED
from .sources.derived import ledger


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tallywren")
    p.add_argument("command", choices=("generate", "reconcile", "evaluate", "export"))
    p.add_argument("--seed", type=int, default=DEFAULT_SEED)
    p.add_argument("--tables", help="a folder with orders.parquet and customer.parquet, instead of the seeded corpus")
    p.add_argument("--baseline", action="store_true")
    p.add_argument("--no-adjudicator", action="store_true")
    p.add_argument("--format", choices=("csv", "md"), default="md")
    p.add_argument("--store", help="a folder to which run tables and receipts are appended")
    a = p.parse_args(argv)
    service = LedgerService(get_session(), a.store)
    if a.tables:
        service.use(ledger(service.spark, a.tables))
        made = {"records": service.health()["records"]}
    else:
        made = service.ingest_generated(a.seed)
    if a.command == "generate":
        print(json.dumps(made))
        return
    summary = service.reconcile("baseline-exact" if a.baseline else "fuzzy" if a.no_adjudicator else "fuzzy+adjudicator")
    if a.command == "reconcile":
        print(json.dumps(summary))
    elif a.command == "evaluate":
        print(json.dumps(service.evaluate()))
    else:
        service.evaluate(summary["run_id"])
        print(service.export(a.format, summary["run_id"])[1])


if __name__ == "__main__":
    main()
