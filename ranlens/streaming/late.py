"""Late events: kept in a side table, and the windows they belong to made anew.

A windowed stream drops an event whose windows it has emitted already. ``merge_late`` finds such events by what was
written: an event is late for a window if events written before it had closed that window. They are kept in the table
``late_events``. The windows of late events are aggregated again from silver, from their own events only, and those whose number of events
differs from what gold has become revisions, in a table beside the gold table. A reader takes a window's newest revision
instead of its gold row (``current``), so no row is changed in place.

Each merge has a number and covers the writes up to a cut, which is stored before it begins. A merge that was
interrupted runs again with the same cut and replaces what it wrote. Windows that gold has not closed yet wait for a later merge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ranlens.functions.timing import utc_date
from ranlens.schemas import SILVER
from ranlens.settings import WINDOW_DURATION, WINDOW_SLIDE
from ranlens.sources.tables import TableSpec, read_table, write_batch
from ranlens.sources.writes import Cut, Position, Write, completed_writes, exists, newest_event, store, stored

#: What a window is of, by gold table.
KEYS = {"cell_kpis": ("cell_id", "gnb_id"), "slice_kpis": ("slice_id", "slice_type")}
TIMES = ("window_start", "window_end")
REVISION = "revision"
#: Writers beside each other leave no order of their writes; those completed this much later still count as earlier.
TOLERANCE = timedelta(minutes=10)


def revisions_spec(gold: TableSpec) -> TableSpec:
    schema = T.StructType([*gold.schema.fields, T.StructField(REVISION, T.LongType())])
    return TableSpec(schema, gold.partition_by, gold.day_of, f"{gold.comment}, made anew for late events")


LATE_EVENTS = TableSpec(SILVER, ("event_date",), "event_timestamp", "Events that came after their windows were closed")


def same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    """Equality of columns, NULL being equal to NULL."""
    return reduce(and_, [left[n].eqNullSafe(right[n]) for n in names])


def current(gold: DataFrame, revisions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of a gold table, each window's newest revision in place of its row."""
    names = (*TIMES, *keys)
    newest = Window.partitionBy(*names).orderBy(F.desc(REVISION))
    revised = revisions.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").select(*gold.columns)
    return gold.join(revised, same(gold, revised, names), "left_anti").unionByName(revised)


def lateness(writes: list[Write], newest: dict[str, datetime], before: datetime | None) -> dict[str, datetime]:
    """For each write, the newest event time among the writes that may have been read before it.

    Writes of one stream are in order; of different writers, those completed up to TOLERANCE later count, too.
    """
    tolerance = int(TOLERANCE / timedelta(milliseconds=1))
    bounds: dict[str, datetime] = {}
    own: dict[str, datetime] = {}  # by writer, the newest time of its earlier batches
    best: list[tuple[datetime, str]] = []  # the newest times of two writers, of all writes completed so far and a little later
    ahead = 0
    for write in writes:
        while ahead < len(writes) and writes[ahead].completed <= write.completed + tolerance:
            if (time := newest.get(writes[ahead].name)) is not None:
                newest_of = {w: t for t, w in reversed(best)}
                newest_of[writes[ahead].writer] = max(time, newest_of.get(writes[ahead].writer, time))
                best = sorted(((t, w) for w, t in newest_of.items()), reverse=True)[:2]
            ahead += 1
        seen = [t for t, w in best if w != write.writer] + [t for t in (before, own.get(write.writer)) if t]
        if seen:
            bounds[write.name] = max(seen)
        if (time := newest.get(write.name)) is not None:
            own[write.writer] = max(time, own.get(write.writer, time))
    return bounds


@dataclass(frozen=True)
class LateMerge:
    """The merge of a silver table's late events into its windowed gold tables."""

    spark: SparkSession
    base: str
    specs: dict[str, TableSpec]
    derive: dict[str, Callable[[DataFrame], DataFrame]]
    delay: timedelta
    fmt: str = "parquet"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _table(self, table: str, spec: TableSpec, where: Column | None = None) -> DataFrame:
        rows = read_table(self.spark, self.path(table), spec.scan_schema, self.fmt)
        return (rows if where is None else rows.where(where)).select(*spec.schema.names)

    def late_events(self) -> DataFrame:
        if not exists(self.spark, self.path("late_events")):
            return self.spark.createDataFrame([], SILVER)
        return self._table("late_events", LATE_EVENTS)

    def gold(self, table: str) -> DataFrame:
        """A gold table with its revisions."""
        gold, name = self._table(table, self.specs[table]), f"{table}_revisions"
        if table not in KEYS or not exists(self.spark, self.path(name)):
            return gold
        return current(gold, self._table(name, revisions_spec(self.specs[table])), KEYS[table])

    def _state(self, number: int, part: str) -> str:
        return f"{self.path('silver')}/_late/{number}/{part}"

    def run(self) -> int:
        """One merge; gives the number of windows made anew in all tables."""
        number = 1
        while stored(self.spark, self._state(number, "done")) is not None:
            number += 1
        silver = self.path("silver")
        handed = stored(self.spark, f"{silver}/_handoff")
        text = stored(self.spark, self._state(number - 1, "cut")) if number > 1 else handed
        before = Position.from_json(text) if text else Position(Cut({}, ()), None)
        everything = completed_writes(self.spark, silver)
        if stored(self.spark, self._state(number, "cut")) is None:
            cut = Cut.of(everything)
            fresh = newest_event(self._table("silver", self.specs["silver"], cut.holds() & ~before.cut.holds()))
            newest = max((t for t in (fresh, before.newest) if t), default=None)
            store(self.spark, self._state(number, "cut"), Position(cut, newest).to_json())
        now = Position.from_json(stored(self.spark, self._state(number, "cut")))
        writes = [w for w in everything if now.cut.has(w) and not before.cut.has(w)]
        late = self._late_rows(writes, before)
        if late is not None:
            write_batch(late.drop("_bound"), self.path("late_events"), f"merge_{number}", LATE_EVENTS, self.fmt)
        revised = sum(self._merge(table, late, number) for table in KEYS)
        store(self.spark, self._state(number, "done"), "done")
        return revised

    def _late_rows(self, writes: list[Write], before: Position) -> DataFrame | None:
        """The rows of writes that hold any late event, reduced to the late ones, each with the time up to which windows were closed."""
        if not writes:
            return None
        spec = self.specs["silver"]
        fresh = Cut.of(writes).holds() & ~before.cut.holds()
        rows = read_table(self.spark, self.path("silver"), spec.scan_schema, self.fmt).where(fresh)
        spans = rows.groupBy("written_by").agg(F.min("event_timestamp").alias("least"), F.max("event_timestamp").alias("newest"))
        spans = {r.written_by: r for r in spans.collect()}  # a row a write, as many as there are marks
        bounds = lateness(writes, {name: r.newest for name, r in spans.items()}, before.newest)
        late = {n: b - self.delay for n, b in bounds.items() if n in spans and spans[n].least < b - self.delay}
        if not late:
            return None
        limits = self.spark.createDataFrame(list(late.items()), "written_by string, _bound timestamp")
        found = rows.where(F.col("written_by").isin(list(late))).join(limits, "written_by")
        # The first window of an event to end is the first to be closed.
        ends = F.window("event_timestamp", WINDOW_SLIDE).end
        return found.where(ends <= F.col("_bound")).select(*spec.schema.names, "_bound")

    def _merge(self, table: str, late: DataFrame | None, number: int) -> int:
        """Write the revisions of one gold table, and the windows that wait; gives the number of revisions."""
        keys = KEYS[table]
        names = (*TIMES, *keys)
        window = F.window("event_timestamp", WINDOW_DURATION, WINDOW_SLIDE)
        parts = []
        if late is not None:
            touched = late.select(window.alias("w"), *keys, "_bound").where(F.col("w.end") <= F.col("_bound"))
            parts.append(touched.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys))
        waiting = f"{self.path('silver')}/_late/{number - 1}/{table}_waiting"
        if exists(self.spark, waiting):
            parts.append(self.spark.read.parquet(waiting))
        if not parts:
            return 0
        own = f"{self.path('silver')}/_late/{number}/{table}"
        windows = reduce(DataFrame.unionByName, parts).dropDuplicates()
        windows.write.mode("overwrite").parquet(f"{own}_windows")
        windows = self.spark.read.parquet(f"{own}_windows")
        gold = self.gold(table)
        closed = gold.agg(F.max("window_end")).first()[0]
        is_closed = F.col("window_end") <= F.lit(closed) if closed else F.lit(False)
        windows.where(~is_closed).write.mode("overwrite").parquet(f"{own}_waiting")
        windows = windows.where(is_closed)
        fresh = self._made_anew(table, windows)
        counts = gold.select(*names, F.col("event_count").alias("_counted"))
        differ = fresh.join(counts, same(fresh, counts, names), "left").where("_counted IS NULL OR _counted <> event_count")
        revised = differ.select(*(fresh[c] for c in fresh.columns)).withColumn(REVISION, F.lit(number).cast("long"))
        name, write = f"{table}_revisions", f"merge_{number}"
        spec = revisions_spec(self.specs[table])
        revised.write.mode("overwrite").parquet(f"{own}_revised")
        revised = self.spark.read.schema(spec.schema).parquet(f"{own}_revised")
        if n := revised.count():
            write_batch(revised, self.path(name), write, spec, self.fmt)
        return n

    def _made_anew(self, table: str, windows: DataFrame) -> DataFrame:
        """The rows of those windows from all their events in silver."""
        keys = KEYS[table]
        first, last = windows.agg(F.min("window_start"), F.max("window_end")).first()
        inside = (F.col("event_timestamp") >= F.lit(first)) & (F.col("event_timestamp") < F.lit(last))
        if "event_date" in self.specs["silver"].partition_by:
            inside = inside & F.col("event_date").between(utc_date(F.lit(first)), utc_date(F.lit(last)))
        events = self._table("silver", self.specs["silver"], inside).withColumn("_at", F.window("event_timestamp", WINDOW_SLIDE).start)
        steps = F.sequence("window_start", F.expr(f"window_end - INTERVAL {WINDOW_SLIDE}"), F.expr(f"INTERVAL {WINDOW_SLIDE}"))
        panes = windows.select(F.explode(steps).alias("_at"), *keys).dropDuplicates()
        events = events.join(panes, same(events, panes, ("_at", *keys)), "left_semi").drop("_at")
        rows = self.derive[table](events)
        return rows.join(windows, same(rows, windows, (*TIMES, *keys)), "left_semi")
