"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that may be sent to every executor in one broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the one in ``spark.checkpoint.dir``; only where that is unset and all tasks run in this
    process (tests) a temporary folder takes its place. On a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="matchbench-")
        _own_dirs[app] = path
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/matchbench/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files survive lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def give_back() -> None:
    """Return freed memory to the system. Workers stay for later tasks, and what one task needed would count
    against the executor while JVM stages run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back when its task ends. Arrow's own allocators keep
    freed memory for long, so batches come from the system's."""

    def inner(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, lists by eight bytes an element (lists of
    texts by their texts), anything else eight."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            total = total + F.coalesce(F.octet_length(F.array_join(c, "12345678")), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType):
            total = total + 8 * F.coalesce(F.size(c), F.lit(0)) * (3 if isinstance(f.dataType.elementType, T.StructType) else 1) + 8
        else:
            total = total + 8
    return total.cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df``, a written table, for broadcast when it is counted to have at most ``rows`` rows and ``most`` bytes."""
    r = df.agg(F.count("*").alias("n"), F.sum(row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= rows and (r["b"] or 0) <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate results that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_mb_{name}"
        while new in taken:
            new += "_"
        taken.add(new)
        out.append(new)
    return out
