"""What the training-data operators share: the shared work folder, the data splits and the loader."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_tracked: list[list[str]] = []


@contextmanager
def cleared(spark: SparkSession):
    """Deletes at its end the work tables made within; yields their list, from which those to keep are taken out."""
    _tracked.append([])
    try:
        yield _tracked[-1]
    finally:
        for path in _tracked.pop():
            drop_path(spark, path)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
    for made in _tracked[-1:]:
        made.append(path)
    return path


def persist(df: DataFrame, name: str, compression: str = "snappy", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    ``by`` are columns whose values get folders of their own, which may be deleted one by one.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).partitionBy(*(by or [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table that is no longer read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that ``persist`` returned."""
    drop_path(df.sparkSession, df._tessera_path)


#: Rows and bytes of one Arrow batch: texts may be very long, and a worker holds a batch in several forms.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package, and keep their batches small.

    A cluster whose executors do not share the folder gets the package with --py-files. A batch size
    that the session has smaller is left as it is.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, most)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of ``schema``. ``createDataFrame`` would start Python workers of another kind to read none."""
    return spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in schema.split(", "))])


_owner: tuple[str, Callable[[], None]] = ("", lambda: None)


def remember(name: str, forget: Callable[[], None]) -> None:
    """Let a worker remember for ``name`` what ``forget`` drops; what it remembered for another name goes.

    Workers serve all stages of an application, so each stage's words would stay beside the next one's.
    """
    global _owner
    if _owner[0] != name:
        _owner[1]()
        _owner = (name, forget)
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def fold(column: str, n: int, k: int) -> Column:
    """Whether crc32 of the column as text leaves remainder ``k`` modulo ``n``; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n == k, F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores where a column is called so."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Hot keys that a join may have: a table of them, two numbers each, is sent to all tasks.
HOT_KEYS = 200_000


def hot_rows(rows: int, least: int = 1000) -> int:
    """From how many rows on a key is hot: one in ``HOT_KEYS`` of all, so that no more than these are."""
    return max(least, -(-rows // HOT_KEYS))


def salted_join(fact: DataFrame, dim: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``fact`` joined with the one row that ``dim`` has of a key, where no task gets all rows of a hot key.

    ``hot`` (``key``, parts) lists the hot keys; their rows are dealt over ``parts`` salts by the hash
    of the expression ``by``, and their row of ``dim`` is repeated that often.
    """
    parts, salt = (free_name(x, [*fact.columns, *dim.columns]) for x in ("parts", "salt"))
    hot = F.broadcast(hot.select(key, F.col("parts").alias(parts)))
    left = fact.join(hot, key, "left").withColumn(salt, F.expr(f"coalesce(pmod(xxhash64({by}, 17), {parts}), 0L)")).drop(parts)
    right = dim.join(hot, key, "left").withColumn(salt, F.explode(F.expr(f"sequence(0L, coalesce({parts}, 1L) - 1)"))).drop(parts)
    return left.join(right, [key, salt], how).drop(salt)


def slots(spark: SparkSession) -> int:
    """Partitions for a stage that must not depend on the data's own partitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
