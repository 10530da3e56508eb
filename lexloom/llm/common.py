"""Helpers shared by the training-data operators: scratch tables, shingles, small SQL idioms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OPEN: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master, as in tests, may fall back to a folder of its own; a cluster
    without the setting is an error, since a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom_ckpt_"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


BATCH_BYTES, DEFAULT_BATCH_BYTES = "4m", "67108864b"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's limit for Arrow batches from its default to BATCH_BYTES: batches of very
    long texts would crowd the workers. The setting stays, as plans run later."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def tidied(run):
    """A function over batches that hands freed memory back to the system when its task ends, as
    workers live on and serve other stages."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _OPEN:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; scratch is then left to the folder's owner
            return


atexit.register(_sweep)


class Scratch:
    """Written intermediate tables. A written table cuts the lineage, survives a lost
    executor, and is read again with column pruning."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/lexloom-{uuid.uuid4().hex}"
        self.n = 0
        _OPEN.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # what was shuffled for a written table is of no more use: its files go at once
        conf, was = self.spark.conf, self.spark.conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.select("*").write.option("compression", "zstd").parquet(path)  # a plan takes the setting when it is made
        finally:
            conf.set(CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of ``save`` that nothing reads any more."""
        for f in df.inputFiles()[:1]:
            _delete(self.spark, f.rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
