"""A typed table store over DataFrames: keyed tables with total, partial and multi-valued
indexes, read through comprehension-like steps and changed by whole-table transforms.

An index is an expression: a total index is a join key, a partial one drops nulls, a multi-valued one is
the exploded bridge table. Changes return a new store, so a plan that reads the old one stays valid;
``commit`` writes tables by directory. Indexes whose expression is given as text last: they are written as
tables of their rows, bucketed and sorted by the index value, with their definition beside them, so that a
lookup in a reopened store reads one bucket, and two of them meet without an exchange.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    """kind: total, partial (nulls have no entry) or multi (each distinct element has one). expr: a SQL
    expression, which can be kept, or a function that gives a column."""

    table: str
    expr: str | Callable[[], Column]
    kind: str = "total"

    def value(self) -> Column:
        return F.expr(self.expr) if isinstance(self.expr, str) else self.expr()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    foreign: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # name: child table, child column, parent table
    read_only: bool = False
    kept: dict[str, str] = field(default_factory=dict)  # indexes that lie on disk: their tables in the catalogue

    # definition
    def create_table(self, name: str, schema: str, rows: DataFrame | None = None) -> Store:
        rows = self.spark.createDataFrame([], schema) if rows is None else rows
        return replace(self, tables=self.tables | {name: rows})

    def with_index(self, name: str, index: Index) -> Store:
        return replace(self, indexes=self.indexes | {name: index})

    def with_foreign_key(self, name: str, child: str, column: str, parent: str) -> Store:
        return replace(self, foreign=self.foreign | {name: (child, column, parent)})

    # reading
    def scan(self, table: str) -> DataFrame:
        return self.tables[table]

    def at(self, table: str, *keys: int) -> DataFrame:
        return self.tables[table].filter(F.col("id").isin(*keys))

    def between(self, table: str, low: int, high: int) -> DataFrame:
        """Closed range of keys, in key order."""
        return self.tables[table].filter(F.col("id").between(low, high)).orderBy("id")

    def entries(self, index: str) -> DataFrame:
        """(value, id) of every index entry."""
        ix = self.indexes[index]
        rows = self.tables[ix.table]
        if ix.kind == "multi":
            return rows.select(F.explode(F.array_distinct(ix.value())).alias("value"), "id")
        rows = rows.select(ix.value().alias("value"), "id")
        return rows.filter("value is not null") if ix.kind == "partial" else rows

    def keys(self, index: str, value) -> DataFrame:
        """Keys alone; columns that the index doesn't name are never read."""
        return self.entries(index).filter(F.col("value") == F.lit(value)).select("id")

    def lookup(self, index: str, value) -> DataFrame:
        ix = self.indexes[index]
        if index in self.kept:
            return self.spark.table(self.kept[index]).filter(F.col("value") == F.lit(value)).drop("value")
        rows = self.tables[ix.table]
        if ix.kind == "multi":
            return rows.filter(F.array_contains(ix.value(), value))
        return rows.filter(ix.value() == F.lit(value))

    def join_index(self, left: DataFrame, on: Column, index: str, how: str = "inner") -> DataFrame:
        """Each row of left with the rows that the index has under ``on``: the index nested loop as a hash join."""
        ix = self.indexes[index]
        hits = self.entries(index).join(self.tables[ix.table], "id").withColumnRenamed("id", f"{ix.table}_id")
        return left.join(hits, on == hits["value"], how)

    def indexed(self, index: str) -> DataFrame:
        """The rows of an index with their value; from disk, by buckets of it, where it lies there."""
        if index in self.kept:
            return self.spark.table(self.kept[index])
        ix = self.indexes[index]
        value = F.explode(F.array_distinct(ix.value())) if ix.kind == "multi" else ix.value()
        rows = self.tables[ix.table].select(value.alias("value"), "*")
        return rows if ix.kind == "total" else rows.filter("value is not null")

    def joined_counts(self, index: str, other: str) -> DataFrame:
        """(id, n): how many rows of the other index each row of the first meets by value. The other's rows are counted once
        a value, in its buckets, so no pairs are listed however many rows a value has."""
        counts = self.indexed(other).groupBy("value").agg(F.count("*").alias("n"))
        return self.indexed(index).select("value", "id").join(counts.hint("merge"), "value").groupBy("id").agg(F.sum("n").alias("n"))

    # changing
    def _changed(self, table: str, rows: DataFrame) -> Store:
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        stale = {n for n, ix in self.indexes.items() if ix.table == table}
        return replace(self, tables=self.tables | {table: rows}, kept={n: t for n, t in self.kept.items() if n not in stale})

    def insert(self, table: str, rows: DataFrame) -> Store:
        """Rows without keys; keys follow the largest one, in an order of the whole row.
        Numbering needs no single task: counts per partition shift the numbers inside it."""
        old = self.tables[table]
        top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        cols = [c for c in old.columns if c != "id"]
        numbered = numbered_rows(rows.select(*cols), F.to_json(F.struct(*cols))).withColumn("id", F.col("row_no") + top).select(*old.columns)
        return self._changed(table, old.unionByName(numbered))

    def upsert(self, table: str, rows: DataFrame) -> Store:
        old = self.tables[table]
        return self._changed(table, old.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(*old.columns)))

    def update(self, table: str, where: Column, **sets: Column) -> Store:
        old = self.tables[table]
        return self._changed(table, old.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in sets.items()}))

    def delete(self, table: str, keys: DataFrame) -> Store:
        return self._changed(table, self.tables[table].join(keys.select("id"), "id", "left_anti"))

    def violations(self) -> DataFrame:
        """Rows that break a foreign key: (constraint, id, value)."""
        out = self.spark.createDataFrame([], "constraint string, id long, value long")
        for name, (child, column, parent) in self.foreign.items():
            rows = self.tables[child].filter(F.col(column).isNotNull()).select("id", F.col(column).cast("long").alias("value"))
            rows = rows.join(self.tables[parent].select(F.col("id").alias("value")), "value", "left_anti")
            out = out.unionByName(rows.select(F.lit(name).alias("constraint"), F.col("id").cast("long").alias("id"), "value"))
        return out

    def commit(self, root: str, buckets: int = 16) -> None:
        """Every table as Parquet; a table is replaced by one committed write. Then the indexes with a
        SQL expression in so many buckets, and last of all the definitions of indexes and foreign keys."""
        for name, rows in self.tables.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}")
        lasting = {n: ix for n, ix in self.indexes.items() if isinstance(ix.expr, str)}
        written = Store.open(self.spark, root, list(self.tables))
        for name, ix in lasting.items():
            rows = replace(written, indexes={name: ix}).indexed(name).repartition(buckets, "value")
            w = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "value").sortBy("value")
            w.option("path", f"{root}/index-{name}").saveAsTable(_catalogued(root, name))
        definition = {"buckets": buckets, "tables": list(self.tables), "indexes": {n: [ix.table, ix.expr, ix.kind] for n, ix in lasting.items()}, "foreign": self.foreign}
        self.spark.createDataFrame([(json.dumps(definition),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/definition")

    @staticmethod
    def open(spark: SparkSession, root: str, names: list[str], read_only: bool = True) -> Store:
        """The named tables alone, without indexes."""
        return Store(spark, {n: spark.read.parquet(f"{root}/{n}") for n in names}, read_only=read_only)

    @staticmethod
    def reopen(spark: SparkSession, root: str, read_only: bool = True) -> Store:
        """All tables of a commit with its indexes and foreign keys; the indexes are read from disk."""
        d = json.loads(spark.read.text(f"{root}/definition").first()[0])
        out = Store.open(spark, root, d["tables"], read_only)
        for name in d["indexes"]:
            table, path = _catalogued(root, name), f"{root}/index-{name}"
            if not spark.catalog.tableExists(table):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
                spark.sql(f"CREATE TABLE {table} ({columns}) USING PARQUET CLUSTERED BY (value) SORTED BY (value) INTO {d['buckets']} BUCKETS LOCATION '{path}'")
        indexes = {n: Index(*ix) for n, ix in d["indexes"].items()}
        return replace(out, indexes=indexes, foreign={n: tuple(f) for n, f in d["foreign"].items()}, kept={n: _catalogued(root, n) for n in indexes})


def _catalogued(root: str, index: str) -> str:
    return f"lexloom_{hashlib.md5(root.encode()).hexdigest()[:16]}_{index}"


def numbered_rows(rows: DataFrame, order: Column) -> DataFrame:
    """Rows with row_no from 1 in the given order, without one task for all: a range partitioning,
    numbers inside the partitions, and the counts of the partitions before."""
    from pyspark.sql import Window

    from lexloom.session import settled

    placed = settled(rows.withColumn("order_", order).repartitionByRange("order_").withColumn("part_", F.spark_partition_id()))
    counts = placed.groupBy("part_").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(counts.select("part_", before.alias("before_")))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part_").orderBy("order_"))
    return placed.withColumn("inside_", inside).join(shift, "part_").withColumn("row_no", (F.col("inside_") + F.col("before_")).cast("long")).drop("order_", "part_", "inside_", "before_")


def carried_on(rows: DataFrame, order: str, values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the last value that is not null in the rows before (null without one).
    Range partitions are swept one by one; what each passes on to the next is one row a partition."""
    from pyspark.sql import Window

    from lexloom.session import settled

    placed = settled(rows.withColumns({f"{n}_own": v for n, v in values.items()}).repartitionByRange(order).withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({n: F.last(f"{n}_own", ignorenulls=True).over(before) for n in values})
    tails = placed.groupBy("part_").agg(*[F.max_by(f"{n}_own", F.when(F.col(f"{n}_own").isNotNull(), F.col(order))).alias(f"{n}_tail") for n in values])
    over = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    tails = F.broadcast(tails.select("part_", *[F.last(f"{n}_tail", ignorenulls=True).over(over).alias(f"{n}_tail") for n in values]))  # one row a partition
    out = placed.join(tails, "part_")
    return out.withColumns({n: F.coalesce(n, f"{n}_tail") for n in values}).drop("part_", *[f"{n}_own" for n in values], *[f"{n}_tail" for n in values])


# folds over query results
def sum_rows(rows: DataFrame, value: Column) -> DataFrame:
    return rows.agg(F.sum(value).alias("total"))


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def group_rows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values of each key as a sorted list."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(f"{value}s"))


def group_rows_with(rows: DataFrame, key: str, value: Column, having: Callable[[Column], Column] | None = None) -> DataFrame:
    out = rows.groupBy(key).agg(F.sum(value).alias("total"))
    return out.filter(having(F.col("total"))) if having else out


def fold_rows(rows: DataFrame, key: str, order: str, value: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A left fold of each group's values in the given order."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(key).agg(seq.alias("seq_")).select(key, F.aggregate("seq_", start, step).alias("folded"))


def first_row(rows: DataFrame, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(1)
