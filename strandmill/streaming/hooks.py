"""Hooks around the batches of a stream: a listener that calls some functions and lets none of them stop another."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class Hooks(StreamingQueryListener):
    """``started(run)``, ``batch(run, number, rows)`` and ``ended(run, error)``, of as many objects as there are; a missing one is left out."""

    def __init__(self, *hooks: object) -> None:
        self.hooks, self.over = hooks, threading.Event()

    def _tell(self, name: str, *args) -> None:
        for hook in self.hooks:
            call: Callable | None = getattr(hook, name, None)
            try:
                if call:
                    call(*args)
            except Exception:
                log.exception("hook %s of %s failed", name, type(hook).__name__)

    def onQueryStarted(self, event) -> None:
        self._tell("started", str(event.runId))

    def onQueryProgress(self, event) -> None:
        self._tell("batch", str(event.progress.runId), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell("ended", str(event.runId), event.exception)
        self.over.set()


@contextmanager
def hooked(spark: SparkSession, *hooks: object, wait: float = 60.0):
    """Within, every query tells the hooks; at the end the listener waits for what a query has still to tell."""
    listener = Hooks(*hooks)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.over.wait(wait)
    finally:
        spark.streams.removeListener(listener)
