"""The bronze to silver to gold streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ranlens.functions.timing import utc_date
from ranlens.operators.latest import latest_per_key
from ranlens.operators.rollups import minute_rollup
from ranlens.operators.silver import bronze_to_silver
from ranlens.operators.violations import sla_violations
from ranlens.operators.windows import cell_kpis, slice_kpis
from ranlens.session import shared_folder
from ranlens.settings import TRIGGER_INTERVAL, WATERMARK_DELAY, WINDOW_DURATION
from ranlens.sources.payloads import events_of, failures_of, observed_payloads
from ranlens.sources.tables import TABLES, TableSpec, ensure_table, read_table, stream_table, write_batch
from ranlens.sources.writes import Cut, Position, completed_writes, newest_event, store, stored
from ranlens.streaming.late import LateMerge

GOLD: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cell_kpis": cell_kpis,
    "slice_kpis": slice_kpis,
    "sla_violations": sla_violations,
}

LATEST_CELLS = TableSpec(TABLES["cell_kpis"].schema, comment="The newest closed window of each cell")


def as_timedelta(interval: str) -> timedelta:
    """A number and a unit, as in the settings of windows and delays."""
    number, unit = interval.split()
    return timedelta(**{unit.rstrip("s") + "s": float(number)})


DELAY = as_timedelta(WATERMARK_DELAY)


def observed_ingest(bronze: DataFrame, name: str = "ingest") -> DataFrame:
    """The same rows, with event and anomaly counts of each batch in the query progress."""
    return bronze.observe(
        name, F.count("*").alias("events"), F.count_if(F.col("is_anomaly") == "true").alias("anomalies")
    )


def observed_rows(df: DataFrame, name: str = "read") -> DataFrame:
    """The same rows, counted in the query progress once, however often the query uses its source."""
    return df.observe(name, F.count("*").alias("rows"))


def default_checkpoint(spark: SparkSession, name: str, path: str) -> str:
    """A folder for a query and its table, where all executors find it."""
    return f"{shared_folder(spark)}/streams/{name}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"


def start_append(
    df: DataFrame,
    path: str,
    name: str,
    checkpoint: str | None = None,
    spec: TableSpec | None = None,
    trigger: str | None = TRIGGER_INTERVAL,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Append a stream to a table, exactly once across restarts, beside batch jobs and other streams.

    Each batch is written by ``write_batch`` under the name of the query and its id, which Spark makes once and
    keeps in the checkpoint: a stream that goes on is the same writer, one with a new checkpoint is a new writer,
    also where an old one was deleted. ``trigger`` is a processing-time interval; ``None`` reads what is there and
    stops. Progress and state are kept in ``checkpoint``, one folder per query and table, by
    default under the cluster's shared folder.
    """
    checkpoint = checkpoint or default_checkpoint(df.sparkSession, name, path)
    return _start(df, name, checkpoint, trigger, lambda batch, write: write_batch(batch, path, write, spec, fmt))


def _start(
    df: DataFrame, name: str, checkpoint: str, trigger: str | None, put: Callable[[DataFrame, str], None], mode: str = "append"
) -> StreamingQuery:
    """Start a stream whose batches are ``put`` under a name each, which is the same when a batch runs again."""
    identity: Future[str] = Future()

    def write(batch: DataFrame, batch_id: int) -> None:
        put(batch, f"{name}-{identity.result()}-{batch_id}")

    stream = df.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    stream = stream.trigger(processingTime=trigger) if trigger else stream.trigger(availableNow=True)
    query = stream.start()
    identity.set_result(query.id)
    return query


@dataclass(frozen=True)
class Medallion:
    """The four streams between the tables under ``base``.

    Silver feeds the gold streams, each with its own progress, so a slow one does
    not hold up the others. ``max_files_per_trigger`` limits the bronze stream only:
    a silver batch is several files of the same period, and reading them in turns
    would let the first one advance the watermark past the rows of the others.
    """

    spark: SparkSession
    base: str
    checkpoints: str | None = None
    fmt: str = "parquet"
    max_files_per_trigger: int | None = None
    tables: dict[str, TableSpec] = field(default_factory=lambda: TABLES)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def create_tables(self, database: str | None = None) -> None:
        """Create the empty tables, registered in ``database`` when one is named."""
        for table, spec in self.tables.items():
            ensure_table(self.spark, self.path(table), spec, f"{database}.{table}" if database else None, self.fmt)

    def stream(self, table: str, where: Column | None = None) -> DataFrame:
        """The rows a table gets; ``where`` may test the columns of its directories, too."""
        limit, spec = self.max_files_per_trigger if table == "bronze" else None, self.tables[table]
        rows = stream_table(self.spark, self.path(table), spec.scan_schema, self.fmt, limit)
        return (rows if where is None else rows.where(where)).select(*spec.schema.names)

    def read(self, table: str, where: Column | None = None) -> DataFrame:
        """The rows a table has; ``where`` may test the columns of its directories, too."""
        spec = self.tables[table]
        rows = read_table(self.spark, self.path(table), spec.scan_schema, self.fmt)
        return (rows if where is None else rows.where(where)).select(*spec.schema.names)

    def start(self, table: str, df: DataFrame, trigger: str | None = TRIGGER_INTERVAL) -> StreamingQuery:
        checkpoint = f"{self.checkpoints}/{table}" if self.checkpoints else None
        return start_append(df, self.path(table), table, checkpoint, self.tables[table], trigger, self.fmt)

    def start_bronze(self, judged: DataFrame, trigger: str | None = TRIGGER_INTERVAL) -> StreamingQuery:
        """Judged payloads (see ``sources.payloads``) to bronze and quarantine, each batch read and parsed once for both."""
        checkpoint = f"{self.checkpoints}/bronze" if self.checkpoints else default_checkpoint(self.spark, "bronze", self.path("bronze"))

        def put(batch: DataFrame, write: str) -> None:
            parts = {"bronze": events_of, "quarantine": failures_of}
            batch = batch.persist()
            try:
                for table, part in parts.items():
                    write_batch(part(batch), self.path(table), write, self.tables[table], self.fmt)
            finally:
                batch.unpersist()

        return _start(observed_payloads(judged), "bronze", checkpoint, trigger, put)

    def start_silver(self, bronze: DataFrame | None = None, trigger: str | None = TRIGGER_INTERVAL) -> StreamingQuery:
        """Bronze to silver; ``bronze`` may be any stream of bronze events, such as a topic."""
        source = self.stream("bronze") if bronze is None else bronze
        return self.start("silver", bronze_to_silver(observed_ingest(source)), trigger)

    def start_gold(
        self, trigger: str | None = TRIGGER_INTERVAL, since: Position | None = None
    ) -> list[StreamingQuery]:
        """The three gold streams. ``since`` leaves to ``backfill_gold`` what that hand-off holds.

        Without it the first batch of each stream is all of silver, which suits a new table. A stream that goes on
        needs the same hand-off again; ``hand_off`` keeps it.
        """
        return [self.start(table, self._gold_after(table, since), trigger) for table in GOLD]

    def start_rollup(self, trigger: str | None = TRIGGER_INTERVAL) -> StreamingQuery:
        """Silver to the minute roll-up."""
        return self.start("minute_rollup", minute_rollup(observed_rows(self.stream("silver"))), trigger)

    def start_latest_cells(self, trigger: str | None = TRIGGER_INTERVAL) -> StreamingQuery:
        """The gold cell table to ``latest_cells``: a cell's row again whenever a newer window of it closes.

        The state is one row per cell and base station, and a batch writes the cells that changed.
        """
        spec = self.tables["cell_kpis"]
        newest = F.max_by(F.struct(*spec.schema.names), "window_end").alias("row")
        rows = self.stream("cell_kpis").groupBy("cell_id", "gnb_id").agg(newest).select("row.*")
        checkpoint = f"{self.checkpoints}/latest_cells" if self.checkpoints else default_checkpoint(self.spark, "latest_cells", self.path("latest_cells"))

        def put(batch: DataFrame, write: str) -> None:
            write_batch(batch, self.path("latest_cells"), write, LATEST_CELLS, self.fmt)

        return _start(rows, "latest_cells", checkpoint, trigger, put, "update")

    def latest_cells(self) -> DataFrame:
        """The rows of each cell's newest closed window, from what the stream kept of them."""
        kept = read_table(self.spark, self.path("latest_cells"), LATEST_CELLS.scan_schema, self.fmt)
        # A batch with an older window of a cell only gives the cell's row once more.
        newest = latest_per_key(kept.select(*LATEST_CELLS.schema.names), ["cell_id"], "window_end")
        return newest.dropDuplicates(["cell_id", "gnb_id", "window_end"])

    def hand_off(self) -> Position:
        """Where the back-fill ends and the streams begin: by the writes silver has, not by the time of their events.

        It is made once and kept beside silver; later calls give the same.
        """
        kept = f"{self.path('silver')}/_handoff"
        if (text := stored(self.spark, kept)) is None:
            cut = Cut.of(completed_writes(self.spark, self.path("silver")))
            store(self.spark, kept, Position(cut, newest_event(self.read("silver", cut.holds()))).to_json())
            text = stored(self.spark, kept)
        return Position.from_json(text)

    def backfill_gold(self, since: Position | None = None) -> None:
        """Write to the gold tables, as a job, what the writes of the hand-off give: violations, and windows closed by their events.

        It may run again: what it wrote before is kept or replaced.
        """
        since = since or self.hand_off()
        if since.newest is None:
            return
        silver = self.read("silver", since.cut.holds())
        for table, derive in GOLD.items():
            rows = derive(silver)
            if "window_end" in rows.columns:
                rows = rows.where(F.col("window_end") <= F.lit(since.closed_until(DELAY)))
            write_batch(rows, self.path(table), "backfill", self.tables[table], self.fmt)

    @property
    def _late(self) -> LateMerge:
        return LateMerge(self.spark, self.base, self.tables, GOLD, DELAY, self.fmt)

    def merge_late(self) -> int:
        """Keep the events that came too late for their windows, and make these windows anew; gives how many changed."""
        return self._late.run()

    def late_events(self) -> DataFrame:
        return self._late.late_events()

    def gold(self, table: str) -> DataFrame:
        """A gold table, with the windows that were made anew in place of what the stream emitted."""
        return self._late.gold(table)

    def _gold_after(self, table: str, since: Position | None) -> DataFrame:
        """A gold table's rows of the writes that come after a hand-off, of which windows left open by it are a part.

        Such windows get all their events: those of the hand-off's last minute, or whatever the duration is, are read again.
        """
        if since is None or since.newest is None:
            return GOLD[table](observed_rows(self.stream("silver")))
        fresh = ~since.cut.holds()
        if table == "sla_violations":
            return GOLD[table](observed_rows(self.stream("silver", fresh)))
        closed = since.closed_until(DELAY)
        begin = closed - as_timedelta(WINDOW_DURATION)
        again = F.col("event_timestamp") > F.lit(begin)
        if day := self._day_column():
            again = again & (F.col(day) >= utc_date(F.lit(begin)))
        rows = observed_rows(self.stream("silver", fresh | again))
        return GOLD[table](rows).where(F.col("window_end") > F.lit(closed))

    def _day_column(self) -> str | None:
        """The directory level for days, if silver has one."""
        spec = self.tables["silver"]
        return next((c for c in spec.partition_by if c not in spec.schema.names), None)

    def start_all(self, trigger: str = TRIGGER_INTERVAL) -> list[StreamingQuery]:
        """All four streams, running until stopped."""
        return [self.start_silver(trigger=trigger), *self.start_gold(trigger)]

    def run_available(self, bronze: DataFrame | None = None) -> None:
        """Process what has arrived, silver before gold, and return."""
        self.start_silver(bronze, trigger=None).awaitTermination()
        for query in self.start_gold(trigger=None):
            query.awaitTermination()
