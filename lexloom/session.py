"""Session settings, loaders and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_file_order(df: DataFrame) -> DataFrame:
    """A table of files with row_at, which orders its rows as they are stored, however they are dealt to tasks."""
    return df.withColumn("row_at", F.struct("_metadata.file_path", "_metadata.row_index"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session may set one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom_ckpt_"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: what is left belongs to the folder's owner
            return


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage of iterative plans and
    survives lost executors. What was shuffled for it is of no more use, and its files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(*tables: DataFrame) -> None:
    """Deletes tables of ``settled`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            if not path.rsplit("/", 1)[1].startswith("settled-"):
                raise ValueError(f"not a settled table: {path}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
