"""Process log: one JSON object a line, keys in order."""

from __future__ import annotations

import json
import logging
import time
from contextlib import contextmanager

_OWN = set(logging.LogRecord("", 0, "", 0, "", (), None).__dict__)


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        more = {k: v for k, v in record.__dict__.items() if k not in _OWN and k not in ("message", "asctime")}
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        return json.dumps(more | {"at": stamp, "level": record.levelname, "logger": record.name, "text": record.getMessage()}, sort_keys=True, default=str)


def configure(path: str | None = None, verbose: bool = False) -> logging.Logger:
    """To a file or standard error; a second call replaces the first one's handlers."""
    log = logging.getLogger("tandemframe")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handler = logging.FileHandler(path, encoding="utf-8") if path else logging.StreamHandler()
    handler.setFormatter(JsonLines())
    log.addHandler(handler)
    log.setLevel(logging.DEBUG if verbose else logging.INFO)
    return log


@contextmanager
def timed(stage: str, **what):
    """Logs the seconds that a stage took, however it ends."""
    began = time.perf_counter()
    try:
        yield
    finally:
        logging.getLogger("tandemframe").info("done", extra={"stage": stage, "seconds": round(time.perf_counter() - began, 3), **what})
