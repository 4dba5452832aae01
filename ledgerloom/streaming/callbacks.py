"""What a run tells while it works: figures of each micro-batch and plan, and the edge where a batch is done.

Figures are observed metrics: Spark gathers them with the rows, in the same pass. A listener
turns them into rows of a table, each micro-batch once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

ROWS = "query string, batch long, name string, figures string"
#: Figures of documents by their state.
FIGURES: dict[str, Callable[[], Column]] = {"documents": lambda: F.count(F.lit(1)),
    "failed": lambda: F.count_if(F.col("status") == "failed"), "processed": lambda: F.count_if(F.col("status") == "processed")}


def observed(rows: DataFrame, name: str, figures: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Rows as they are, their figures told under a name."""
    return rows.observe(name, *[f().alias(k) for k, f in (figures or FIGURES).items()])


def measured(rows: DataFrame, figures: dict[str, Callable[[], Column]] | None = None) -> tuple[DataFrame, Observation]:
    """For a batch plan: rows, and an observation that has their figures once an action has run."""
    seen = Observation()
    return rows.observe(seen, *[f().alias(k) for k, f in (figures or FIGURES).items()]), seen


class Listener(StreamingQueryListener):
    """Keeps the figures of micro-batches until ``write`` puts them into a table; a failure in a callback stops no stream."""

    def __init__(self, on_batch: Callable[[str, int, str, dict], None] | None = None):
        self.rows: dict[tuple[str, int, str], str] = {}
        self.ended: dict[str, str | None] = {}
        self.on_batch, self.lock = on_batch, threading.Lock()

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.id), None)

    def onQueryIdle(self, event) -> None:
        """Nothing to tell."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            key, figures = (p.name or str(p.id), p.batchId, name), row.asDict()
            with self.lock:
                again = key in self.rows
                self.rows[key] = json.dumps(figures, default=str, sort_keys=True)
            if self.on_batch is not None and not again:
                try:
                    self.on_batch(*key, figures)
                except Exception:  # noqa: BLE001, S110  a callback must not stop the stream
                    pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def write(self, spark: SparkSession, path: str) -> int:
        """Appends the rows gathered so far, which are then forgotten; how many."""
        with self.lock:
            rows, self.rows = self.rows, {}
        if rows:
            spark.createDataFrame([(*k, v) for k, v in sorted(rows.items())], ROWS).write.mode("append").parquet(path)
        return len(rows)


def newly_done(before: DataFrame, after: DataFrame) -> DataFrame:
    """(batch_id): batches in which something was open before and nothing is now; each once, as a change of state is."""
    open_in = lambda docs: docs.groupBy("batch_id").agg(F.count_if(F.col("overall_state") == "processing").alias("open"))
    was, now = open_in(before).filter("open > 0").select("batch_id"), open_in(after).filter("open = 0").select("batch_id")
    return now.join(was, "batch_id", "left_semi")
