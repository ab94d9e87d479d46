"""Log lines as one JSON object each. Payloads and records are never logged, only counts and ids."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        fields = record.__dict__.get("fields") or {}
        return json.dumps({"timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "event": record.getMessage(), **fields}, default=str)


def get_logger(name: str = "tallywren") -> logging.Logger:
    log = logging.getLogger(name)
    if not any(isinstance(h.formatter, JsonLines) for h in log.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.propagate = False
    return log


def event(log: logging.Logger, name: str, level: int = logging.INFO, **fields) -> None:
    log.log(level, name, extra={"fields": fields})
