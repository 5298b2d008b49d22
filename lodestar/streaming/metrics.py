"""Counts that come with a job that runs anyway, and the progress of streams as a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "query string, run_id string, batch_id long, at string, input_rows long, rows_per_second double, state_rows long, late_rows long"


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and the observation that has its ``metrics`` (aggregates by name) once one action on it has run; no job of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


class ProgressTable(StreamingQueryListener):
    """Collects a row for each batch of the session's streams; ``write`` appends them to a table. Rows are a few numbers a batch."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        rate = p.processedRowsPerSecond
        row = (p.name or str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(rate) if rate == rate else 0.0, sum(a for a, _ in state), sum(b for _, b in state))
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def write(self, spark: SparkSession, at: str) -> int:
        """Appends what has come since the last call to Parquet under ``at``; how many rows it was."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS).write.mode("append").parquet(at)
        return len(rows)
