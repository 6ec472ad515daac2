"""What the engine and its streams say, in a file on the driver."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

LOGGER = logging.getLogger("parlance")


def log_to(path: str, level: int = logging.DEBUG) -> logging.Handler:
    """Appends to a file, whose folder is made; the same file a second time changes nothing. LOGGER.removeHandler ends it."""
    file = Path(path).absolute()
    for known in LOGGER.handlers:
        if isinstance(known, logging.FileHandler) and Path(known.baseFilename) == file:
            return known
    file.parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(file, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-7s %(name)s %(message)s"))
    LOGGER.addHandler(handler)
    LOGGER.setLevel(level)
    return handler


class StreamLog(StreamingQueryListener):
    """A line for each start, end and batch that had rows; what ended a stream is an error."""

    def onQueryStarted(self, event) -> None:
        LOGGER.info("stream %s (%s) started", event.name or "unnamed", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            state = sum(s.numRowsTotal for s in p.stateOperators)
            LOGGER.info("stream %s batch %d: %d rows in %d ms, %d rows of state", p.name or "unnamed", p.batchId, p.numInputRows, p.batchDuration, state)

    def onQueryIdle(self, event) -> None:
        LOGGER.debug("stream %s idle", event.id)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            LOGGER.error("stream %s ended: %s", event.id, event.exception)
        else:
            LOGGER.info("stream %s ended", event.id)


def log_streams(spark: SparkSession) -> StreamLog:
    """Logs the session's streams until spark.streams.removeListener."""
    listener = StreamLog()
    spark.streams.addListener(listener)
    return listener
