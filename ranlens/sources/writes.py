"""Which writes a table is made of: names, marks of completed writes, and cuts between them.

Each write is a directory ``written_by=<name>`` on the table's last level and, once complete, an empty file
``_batches/<name>``. A stream's writes are ``<writer>-<batch>`` and complete in order; a job's are one name each.
A cut names completed writes, so both sides of it are fixed whatever is written later and however late its events are.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The directory level that names the write.
WRITE = "written_by"
BATCH = re.compile(r"(.+)-([0-9]+)")


def job_name() -> str:
    """A new name for what a batch job writes."""
    return f"job_{uuid.uuid4().hex}"


def mark_of(spark: SparkSession, path: str, write: str):
    """The mark of a write as a Hadoop path, and its file system."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches/{write}")
    return mark, mark.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Write:
    """A completed write: its name, and when it was completed (milliseconds since 1970)."""

    name: str
    completed: int

    @property
    def writer(self) -> str:
        """The stream that wrote it; a job is a writer of its own."""
        batch = BATCH.fullmatch(self.name)
        return batch[1] if batch else self.name

    @property
    def batch(self) -> int:
        batch = BATCH.fullmatch(self.name)
        return int(batch[2]) if batch else 0


def completed_writes(spark: SparkSession, path: str) -> list[Write]:
    """All completed writes of a table, oldest first. The list grows with the number of writes, not with their rows."""
    folder, files = mark_of(spark, path, "")
    if not files.exists(folder):
        return []
    found = [Write(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(folder)]
    return sorted(found, key=lambda w: (w.completed, w.writer, w.batch))


@dataclass(frozen=True)
class Cut:
    """A set of completed writes: of streams up to a batch each, and of jobs by name."""

    streams: dict[str, int]
    jobs: tuple[str, ...]

    @classmethod
    def of(cls, writes: list[Write]) -> Cut:
        streams: dict[str, int] = {}
        for w in writes:
            if w.writer != w.name:
                streams[w.writer] = max(w.batch, streams.get(w.writer, 0))
        return cls(streams, tuple(sorted(w.name for w in writes if w.writer == w.name)))

    def has(self, write: Write) -> bool:
        return write.name in self.jobs or (write.writer != write.name and write.batch <= self.streams.get(write.writer, -1))

    def holds(self, column: str = WRITE) -> Column:
        """Whether a row's write belongs to the cut: a test of the directory alone, so files of the other side are not opened."""
        name = F.col(column)
        test = name.isin(list(self.jobs)) if self.jobs else F.lit(False)
        for writer, last in self.streams.items():
            batch = F.regexp_extract(name, rf"^{re.escape(writer)}-([0-9]+)$", 1).try_cast("bigint")
            test = test | (batch <= last)
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Position:
    """A cut of a table and the newest event time in it; kept as JSON text."""

    cut: Cut
    newest: datetime | None

    def closed_until(self, delay: timedelta) -> datetime | None:
        """Windows that end by then are closed by the events of the cut."""
        return self.newest and self.newest - delay

    def to_json(self) -> str:
        newest = self.newest and self.newest.astimezone(timezone.utc).isoformat()
        return json.dumps({"streams": self.cut.streams, "jobs": self.cut.jobs, "newest": newest})

    @classmethod
    def from_json(cls, text: str) -> Position:
        kept = json.loads(text)
        newest = kept["newest"] and datetime.fromisoformat(kept["newest"]).astimezone().replace(tzinfo=None)
        return cls(Cut(kept["streams"], tuple(kept["jobs"])), newest)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def store(spark: SparkSession, path: str, text: str) -> None:
    """Keep a text in a new folder; a folder that is complete is never written again."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("ignore" if exists(spark, f"{path}/_SUCCESS") else "overwrite").text(path)


def stored(spark: SparkSession, path: str) -> str | None:
    """The text kept in a folder, if it was written to its end."""
    return spark.read.text(path).first()[0] if exists(spark, f"{path}/_SUCCESS") else None


def newest_event(rows: DataFrame, column: str = "event_timestamp") -> datetime | None:
    return rows.agg(F.max(column)).first()[0]
