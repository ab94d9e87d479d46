"""Errors with a code and the HTTP status a service would answer with."""

from __future__ import annotations

# The codes of the API and their statuses.
STATUS = {
    "SOURCE_NOT_FOUND": 404,
    "RECORD_NOT_FOUND": 404,
    "RUN_NOT_FOUND": 404,
    "MATCH_NOT_FOUND": 404,
    "EXCEPTION_NOT_FOUND": 404,
    "EXCEPTION_ALREADY_RESOLVED": 409,
    "INGEST_TOO_LARGE": 413,
    "INGEST_MALFORMED": 400,
    "INGEST_UNSUPPORTED_TYPE": 415,
    "ADJUDICATOR_UNAVAILABLE": 503,
    "ADJUDICATOR_TIMEOUT": 504,
    "ADJUDICATOR_MALFORMED_OUTPUT": 502,
    "EVALUATION_NO_GROUND_TRUTH": 409,
    "VALIDATION_FAILED": 400,
    "NOT_FOUND": 404,
    "INTERNAL": 500,
}


class LedgerError(Exception):
    def __init__(self, code: str, message: str, **details):
        if code not in STATUS:
            raise ValueError(f"unknown code {code}")
        super().__init__(message)
        self.code, self.status, self.details = code, STATUS[code], details


def as_ledger_error(error: BaseException) -> LedgerError:
    return error if isinstance(error, LedgerError) else LedgerError("INTERNAL", str(error) or "Unexpected failure.")
