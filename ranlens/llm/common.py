"""What several operators share: words, tables in the shared folder, bounded slices of Arrow batches."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ranlens.session import shared_folder

#: A word: what stands between spaces, tabs and line ends of ASCII.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Characters of text that are worked on at once in a task.
SLICE_CHARS = 1_000_000
#: By application, the driver's folder from which its workers are sent the package; gone when the driver ends.
SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of that name lies, on this machine."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a Parquet table in the folder all executors share, and read from there.

    This cuts the lineage: a lost executor costs no more than the tasks it held. The tables of an
    application lie in one folder named after it. ``superseded`` removes one that a later round replaces, and
    ``remove_tables`` all of them, once the results that read them are stored.
    """
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def tables_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def superseded(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table._written_to)


def remove_tables(spark: SparkSession) -> None:
    """Remove all tables that operators of this application wrote for themselves; results not stored by then are lost."""
    removed(spark, tables_folder(spark))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, in case they cannot import it by themselves."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in SHIPPED or not package.is_dir():
        return
    SHIPPED[context.applicationId] = folder = tempfile.TemporaryDirectory()
    path = f"{folder.name}/ranlens-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)


def mapped(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package in the workers.

    Both the virtual machine and the worker hold whole batches, which the session bounds by rows and bytes; ``slices``
    cuts them for the work on them.
    """
    ship(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds one row, or texts of ``chars`` bytes at most.

    A worker lives on after its task, so what Arrow has set aside is given back in the end.
    """
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        begin = total = 0
        for row, length in enumerate(lengths):
            if total and total + (length or 0) > chars:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += length or 0
        if begin < len(lengths):
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


def of_fixed_width(values: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary array whose values all have one width, a row a value, without a copy."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, width)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
