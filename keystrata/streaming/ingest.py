"""Streams of changes into a keyed table: every micro-batch is one WAL."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keystrata.sources.store import KeyedTable


def ingest(stream: DataFrame, table: KeyedTable, checkpoint: str, source: str = "stream", every: str | None = None) -> StreamingQuery:
    """Start writing a stream (``key, kind, value, seq``) to a table.

    The number of the last batch applied is part of the manifest version that made it visible, so a batch
    repeated after a failure is recognised and skipped. ``every`` sets the interval; without it the
    stream runs until its present input is done. Flushing and compacting are not the batches' business:
    see ``Maintenance``.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, number: table.write(batch, source, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Maintenance:
    """Flushes memory and runs compactions beside the batches of a table, polling its manifest.

    ``stop`` drains: it flushes what memory has reached its size (all of it with ``everything``), finishes
    the compaction at work and leaves no thread. An error ends the service and is raised by ``stop``.
    """

    def __init__(self, table: KeyedTable, every: float = 5.0):
        self.table, self.every = table, every
        self._stop, self._error = threading.Event(), None
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Maintenance:
        self.table.compactor().start(self.every)
        self._thread.start()
        return self

    def _loop(self) -> None:
        try:
            while not self._stop.wait(self.every):
                self.table.flush_memory(force=False)
        except Exception as error:  # noqa: BLE001
            self._error = error

    def stop(self, everything: bool = False) -> None:
        self._stop.set()
        self._thread.join()
        self.table.compactor().stop()
        if self._error is not None:
            raise self._error
        self.table.flush_memory(force=everything)
        self.table.compactor().run_once()
