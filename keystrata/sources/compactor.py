"""Running compactions beside the writer of a table."""

from __future__ import annotations

import queue
import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.operators.compaction import LEVEL0_LIMIT, Compaction, CompactionRefused, finish, schedule, sources, submit
from keystrata.operators.entries import latest, live
from keystrata.sources.manifest import Fenced, FencedManifest, ManifestStore
from keystrata.sources.tables import TableStore


class Compactor:
    """Schedules, runs and commits compactions of one table under an epoch of its own.

    It works from the stored manifest alone, so it may run in another process than the writer. A job
    reads its sources and writes new tables; a manifest version then takes the sources away and puts the
    run in. The change is made to the manifest of that moment: tables the writer flushed meanwhile stay in
    front, and if a source is gone the job's output is left to nobody. A later compactor fences this one.
    """

    def __init__(self, spark: SparkSession, root: str, tables: TableStore | None = None, limit: int = LEVEL0_LIMIT):
        self.spark, self.limit = spark, limit
        self.tables = tables or TableStore(spark, root)
        self.held = FencedManifest(ManifestStore(spark, root), "compactor")
        self.busy: frozenset[int] = frozenset()
        self._results: queue.Queue = queue.Queue()
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    def run(self, job: Compaction) -> int:
        """Submit, execute and commit one job; returns the id of the run made."""
        state = self.held.refresh()
        self.busy = submit(state, job, self.busy)
        try:
            made = self.execute(job, sources(state, job))
            self.held.update(lambda m: finish(m, job, made))
        finally:
            self.busy -= {job.destination}
        return job.destination

    def execute(self, job: Compaction, newest_first):
        """Merge tables, the newest that has a key winning, into tables cut by bytes; tombstones stay unless the job drops them."""
        every = [self.tables.read([t.table_id for t in files]).withColumn("source", F.lit(-i)) for i, files in enumerate(newest_first)]
        merged = latest(reduce(DataFrame.unionByName, every), rank=["source", "seq"]).drop("source")
        return self.tables.write(live(merged) if job.drop_tombstones else merged)

    def run_once(self) -> list[int]:
        """Run what is due now; the ids of the runs made."""
        return [self.run(job) for job in schedule(self.held.refresh(), self.busy, self.limit)]

    def start(self, every: float = 5.0) -> None:
        """Poll the manifest every so many seconds and run what is due, until ``stop``."""
        if self._thread is not None:
            return
        self._stop.clear()

        def loop() -> None:
            while True:
                try:
                    for run in self.run_once():
                        self._results.put(run)
                except CompactionRefused as refused:  # the table moved on; what is due is asked again
                    self._results.put(refused)
                except Fenced as fenced:
                    self._results.put(fenced)
                    return
                if self._stop.wait(every):
                    return

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def next_result(self, timeout: float | None = None):
        """The next run made in the background, or what stopped it; None if there is none in time."""
        try:
            return self._results.get(timeout=timeout) if timeout is not None else self._results.get_nowait()
        except queue.Empty:
            return None

    def stop(self) -> None:
        """Finish the job at work and end the background loop."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None
