"""What the operators share: tables in the shared folder, the package on the executors, column names."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}  # folders of local sessions that named none


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if context.applicationId not in _SHIPPED and root.is_dir():
        package = Path(__file__).resolve().parents[1].name
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package}", "zip", root, package))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='llm-')}"
    return _LOCAL[app]


class Scratch:
    """Intermediate tables of one job, written to the shared folder; each write cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.serial = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.serial += 1
        path = f"{self.path}/{self.serial:03d}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            self._delete(table.scratch_path)

    def free_shuffles(self) -> None:
        """Spark deletes the shuffle files of finished plans once the driver has collected them."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Delete all tables of the job, once what was made of them has been written."""
        self._delete(self.path)


def small_parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in parts of which each has at most `most` bytes of a string or binary column, or one row.

    A worker that makes Python objects of a part at a time holds no whole batch of them.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def fresh_name(taken: Iterable[str], base: str) -> str:
    """A column name that no column has yet (Spark compares names without case)."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base += "_"
    return base
