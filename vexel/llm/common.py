"""What the operators of this subpackage share: column names, tables in the shared folder, sizes of partitions."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def by_value(*names: str) -> None:
    """Workers need not have this package on their path: its functions travel with the tasks."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names, one for each stem, that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__vx_{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a local one if there are no other machines, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vexel-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it again: the lineage ends here and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vexel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables that ``settled`` has written so far."""
    return list(_WRITTEN)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes such tables; only for when nothing will read them any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def octets(text: str | Column) -> Column:
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")


def word_count(text: str | Column) -> Column:
    """Tokens of a text for planning: runs of characters other than ASCII white space; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def batches_of(stream: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key``: tables that hold whole runs of equal keys.

    Runs are handed on as soon as a batch ends them, many in one table, so that
    the memory needed is that of a batch and of the longest run.
    """
    held: list[pa.RecordBatch] = []
    for batch in stream:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        last = column[-1]
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != column[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        same = 0
        n = batch.num_rows
        lo, hi = 0, n  # the first row of the last run
        value = last.as_py()
        while lo < hi:
            mid = (lo + hi) // 2
            if column[mid].as_py() == value:
                hi = mid
            else:
                lo = mid + 1
        same = lo
        if same:
            yield pa.Table.from_batches([*held, batch.slice(0, same)])
            held = []
        held.append(batch.slice(same))
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most so many rows and, unless a row alone has more, bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and (held + size > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if len(sizes) > at:
        yield batch.slice(at)


def temp_dir() -> str:
    """A task's own scratch folder, in Spark's local directories where they are known; the task removes it."""
    roots = [r for r in (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",") if r]
    return tempfile.mkdtemp(prefix="vexel-task-", dir=roots[0] if roots and os.path.isdir(roots[0]) else None)


Registry = dict[str, Callable[[SparkSession, str], DataFrame]]
