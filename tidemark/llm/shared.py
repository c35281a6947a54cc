"""Session-level helpers: shared storage, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long that may be broadcast: about 16 MB once in a hash relation.
BROADCAST_ROWS = 500_000
_own: list[str] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a local one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # no other job waits for the mark
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut``. Nothing that still has to be computed may read them; other tables are left alone."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches hold whole texts, so fewer rows than Spark's default of 10,000 go into one."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage after many jobs: Spark removes the shuffle files and broadcasts of plans that are gone only once the driver's collectors have run."""
    gc.collect()
    spark._jvm.System.gc()
    give_back()


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def frees(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, which Spark keeps for other tasks, gives freed memory back to the system."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` (narrow) rows; else a shuffled join serves."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """Column names that begin with ``names`` and that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return tuple(out)


def columns_like(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
