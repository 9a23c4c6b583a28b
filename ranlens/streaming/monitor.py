"""State of the running streams."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ranlens.sources.tables import append

HISTORY_SCHEMA = (
    "query string, query_id string, run_id string, batch_id long, started_at string, processed_rows long, source_rows long, "
    "rows_per_sec double, state_rows long, late_rows long, watermark string"
)
PROGRESS_SCHEMA = "query string, status string, input_rows_per_sec double, processed_rows long"


def rows_read(progress: dict) -> int:
    """Rows a batch has read: as counted in the query, else as its sources report them.

    A source that a query uses twice reports its rows twice.
    """
    for metrics in (progress["observedMetrics"] or {}).values():
        for name in ("rows", "events"):
            if name in metrics.asDict():
                return int(metrics[name])
    return int(progress["numInputRows"] or 0)


def _row(query: StreamingQuery) -> tuple[str, str, float, int]:
    name, progress = query.name or str(query.id), query.lastProgress
    if not progress:
        return name, "starting", 0.0, 0
    reported, rows = int(progress["numInputRows"] or 0), rows_read(progress)
    rate = float(progress["inputRowsPerSecond"] or 0.0) * (rows / reported if reported else 1.0)
    return name, query.status["message"], rate, rows


def progress_frame(spark: SparkSession) -> DataFrame:
    """One row per active query: name, status, input rate and rows of the last batch."""
    return spark.createDataFrame([_row(query) for query in spark.streams.active], PROGRESS_SCHEMA)


class ProgressHistory(StreamingQueryListener):
    """Appends the progress of every batch of every query to a table; ``progress_frame`` has the last batch of live queries only.

    Rows are gathered and written together: ``flush`` writes what is there, and so does every ``rows``-th batch. Take the
    listener off with ``close``.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 100):
        self.spark, self.path, self.rows = spark, path, rows
        self._waiting: list[tuple] = []
        self._lock = Lock()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = [m.asDict() for m in (p.observedMetrics or {}).values()]
        counted = next((int(m[name]) for m in observed for name in ("rows", "events") if name in m), p.numInputRows)
        state = p.stateOperators
        row = (
            p.name or str(p.id), str(p.id), str(p.runId), p.batchId, p.timestamp, int(counted), int(p.numInputRows),
            float(p.processedRowsPerSecond or 0.0), sum(o.numRowsTotal for o in state), sum(o.numRowsDroppedByWatermark for o in state),
            (p.eventTime or {}).get("watermark"),
        )
        with self._lock:
            self._waiting.append(row)
            full = len(self._waiting) >= self.rows
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> None:
        with self._lock:
            rows, self._waiting = self._waiting, []
        if rows:
            append(self.spark.createDataFrame(rows, HISTORY_SCHEMA).coalesce(1), self.path)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    def read(self) -> DataFrame:
        """A row a batch; of a batch that was reported twice (it ran again after a crash) the last."""
        last = Window.partitionBy("query_id", "batch_id").orderBy(F.desc("started_at"))
        rows = self.spark.read.schema(HISTORY_SCHEMA).parquet(self.path)
        return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def stop_all(spark: SparkSession) -> None:
    for query in spark.streams.active:
        query.stop()
