"""Text files in whole versions: a commit writes all files of a new version beside the old one, and then
moves one pointer over. Readers see the old files or the new ones, never some of both; a job that fails
before the move leaves the old version in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.store import numbered_rows

POINTER = "current"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def point_to(spark: SparkSession, root: str, version: str) -> None:
    """Writes the pointer aside and renames it over the old one, which file systems do at once."""
    conf = spark._jsc.hadoopConfiguration()
    new, old = _path(spark, f"{root}/.{POINTER}-{version}"), _path(spark, f"{root}/{POINTER}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, old, how)


def current(spark: SparkSession, root: str) -> str | None:
    """The version that readers see; None before the first commit."""
    p = _path(spark, f"{root}/{POINTER}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def commit_files(lines: DataFrame, root: str) -> str:
    """Writes the files' lines (file, line_no, text) as the next version and makes it current. A file is
    a folder of parts in the order of its lines, so a large one is the work of several tasks."""
    spark, version = lines.sparkSession, uuid.uuid4().hex
    rows = lines.select("file", "line_no", "text").repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    rows.select("file", "text").write.partitionBy("file").text(f"{root}/{version}")
    point_to(spark, root, version)
    return version


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, line_no, text) of the current version, lines numbered from 1 in each file."""
    rows = spark.read.schema("value string, file string").text(f"{root}/{current(spark, root)}")
    rows = rows.select("file", F.col("value").alias("text"), F.struct("file", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place"))
    rows = numbered_rows(rows, F.col("place"))
    first = rows.groupBy("file").agg(F.min("row_no").alias("first"))
    return rows.join(first, "file").select("file", (F.col("row_no") - F.col("first") + 1).alias("line_no"), "text")
