"""Sharding by jump consistent hashing: a row's shard follows from its key and the number of
shards alone, without a ring table; one more shard takes only its own share of the rows.

Slots inside a shard are gapless from 0. They are numbered in cells of bounded size, each
numbered on its own and shifted by the counts of the cells before it, so no shard is sorted in
one task.

Defined results: a null doc_id has the key of empty text; a null text has no bytes and the
checksum of empty text; repeated rows take the same shard and a slot each; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

CELL_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys, all keys at once."""
    key = keys.astype(np.uint64).copy()
    now = np.full(len(key), -1, np.int64)
    nxt = np.zeros(len(key), np.int64)
    live = np.arange(len(key)) if shards > 0 else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            now[live] = nxt[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            nxt[live] = ((now[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            live = live[nxt[live] < shards]
    return now


def jump_udf(shards: int):
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return F.pandas_udf(run, "int")


def stable_key(doc_id: Column, first: int = 1) -> Column:
    """60 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), first, 15), 16, 10).cast("long")


def shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard among one more."""
    scratch = Scratch(docs.sparkSession)
    cells = max(1, -(-docs.count() // (n * CELL_ROWS)))
    keyed = lambda d: d.withColumn("key", stable_key(F.col("doc_id"))).withColumn("cell", F.pmod(stable_key(F.col("doc_id"), 17), F.lit(cells)))
    ids = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"))).withColumn("shard", jump_udf(n)("key"))
    count = scratch.save(ids.groupBy("shard", "cell").agg(F.count("*").alias("n")))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.save(count.select("shard", "cell", F.coalesce(first, F.lit(0)).alias("start")))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = keyed(rows).withColumn("shard", jump_udf(n)("key")).withColumn("grown_shard", jump_udf(n + 1)("key")).drop("key")
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).join(starts, ["shard", "cell"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
