"""Following the edit log: counts by user, and windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import shared_dir


def follow(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of an append-only folder of Parquet files, or of one file of that name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def edit_counts(edits: DataFrame, user: str = "user_id") -> DataFrame:
    return edits.groupBy(user).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` behind the newest are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table. Output and
    progress go to the shared folder; complete results replace each other by batch."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
