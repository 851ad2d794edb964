"""Small helpers the operators share: shared folders, text blocks, byte columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles at once; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20


#: Scratch folders of this process that may still be there.
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession, name: str, scratch: bool = True) -> str:
    """A new folder below ``spark.checkpoint.dir``; ``sweep`` deletes those that are scratch.

    The setting is read from the session.  Only where it is unset and all runs
    in this process, as in tests, a local folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stocklink-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scratch:
        _SCRATCH.append(path)
    return path


#: On a local file system each file that Hadoop creates starts ``chmod`` three times, and for its checksums is a second file; a raw one
#: starts it twice.  While a process starts, its executor's memory counts twice.  Parquet's own checksums are read instead.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name, scratch)
    df.write.options(**_RAW).parquet(path)
    back = spark.read.schema(df.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(path)
    back._written_to = path
    return back


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables that ``written`` made (or folders), once all that reads them has been written itself."""
    for t in tables:
        name = t if isinstance(t, str) else t._written_to
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in _SCRATCH:
            _SCRATCH.remove(name)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch folders.  For the beginning of a step whose input is stored elsewhere, when no earlier result is read any more."""
    discard(spark, *_SCRATCH)


def checkpoint_dir_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable with the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column as Python strings, nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


#: What a worker keeps from one task to the next; an operator that doesn't use it clears it, since workers serve all operators.
KEPT: dict = {}


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of about ``limit`` bytes of the column ``text``, so that what Python holds doesn't follow the batch size.

    At the end, memory that isn't used goes back to the system.
    """
    if not keep:
        KEPT.clear()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for a, b in blocks(sizes, limit):
            yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive ranges of about ``limit`` bytes, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes of an Arrow batch between the JVM and Python: its buffers lie outside the heap and stay allocated.
ARROW_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; sets the session's Arrow batches to ``ARROW_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
