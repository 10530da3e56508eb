"""Sets of integers as sorted disjoint closed ranges, as rows (id, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(ranges: DataFrame) -> DataFrame:
    """Union of each id's ranges; overlapping and adjacent ones become one."""
    w = Window.partitionBy("id").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.filter("lo <= hi").withColumn("new", F.when(top.isNull() | (F.col("lo") > top + 1), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("id", "lo", "hi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(a.select("id", "lo", "hi").unionByName(b.select("id", "lo", "hi")))


def _covered(ranges: DataFrame, need: DataFrame) -> DataFrame:
    """(id, lo, hi): the stretches between borders that as many ranges (id, lo, hi) cover as need(id, n) says."""
    borders = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("step")))
    steps = ranges.select("id", F.explode(borders).alias("x")).select("id", "x.*").groupBy("id", "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy("id").orderBy("at")
    runs = steps.select("id", "at", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("at").over(w).alias("next"))
    return normalise(runs.join(need, "id").filter("depth = n").select("id", F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common part of two normalised sets of each id, by one sweep over the borders of both."""
    from lexloom.session import settled

    # written: a union of two sides that are both dealt by id, each in its own number of partitions, can't be planned
    both = settled(a.select("id", "lo", "hi")).unionByName(settled(b.select("id", "lo", "hi")))
    return _covered(both, both.select("id").distinct().withColumn("n", F.lit(2)))


def intersection_of_all(ranges: DataFrame) -> DataFrame:
    """(grp, lo, hi): what all normalised sets (grp, id, lo, hi) of a group share."""
    n = ranges.groupBy(F.col("grp").alias("id")).agg(F.count_distinct(ranges["id"]).alias("n"))
    return _covered(ranges.select(F.col("grp").alias("id"), "lo", "hi"), n).withColumnRenamed("id", "grp")


def size(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("size"))


def from_points(points: DataFrame) -> DataFrame:
    """Ranges of the points (id, x)."""
    return normalise(points.select("id", F.col("x").alias("lo"), F.col("x").alias("hi")))


def range_join(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points (x) inside ranges (lo, hi), as an equi-join over bins. A range goes to bins of at least its own width, a power
    of four, so it touches two at most; a point goes to its bin of each width that occurs, some thirty at most."""
    bits = F.length(F.bin(F.col("hi") - F.col("lo")))
    r = ranges.filter("lo <= hi").withColumn("level_", (F.floor((bits + 1) / 2) * 2).cast("int"))
    levels = [x[0] for x in r.select("level_").distinct().collect()]
    bin_ = lambda x, level: F.call_function("shiftright", x.cast("long"), level)
    r = r.withColumn("bin_", F.explode(F.array_distinct(F.array(bin_(F.col("lo"), F.col("level_")), bin_(F.col("hi"), F.col("level_"))))))
    p = points.withColumn("level_", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin_", bin_(F.col("x"), F.col("level_")))
    return p.join(r, ["level_", "bin_"]).filter("x between lo and hi").drop("level_", "bin_")


def labels(edges: DataFrame, nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, lo, hi): the closure of each node as ranges over pre-order labels.

    A node's label is its rank when nodes are sorted by their way down from a root through
    least parents, so that a subtree of that tree is one range; further parents of shared
    subtrees add ranges. The ranges are exact, whatever the labels."""
    from lexloom.operators.store import numbered_rows

    one = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    label = numbered_rows(tree_paths(one, nodes), F.col("path")).select(F.col("id").alias("node"), F.col("row_no").alias("x"))
    under = reach.select(F.col("anc").alias("id"), F.col("src").alias("node")).unionByName(nodes.select("id", F.col("id").alias("node")))
    return from_points(under.join(label, "node").select("id", "x"))


def tree_paths(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, path): keys from the root down, for a forest (child, parent), by pointer doubling. Keys
    are padded to the longest one, so paths sort as keys do; a cycle is an error."""
    from lexloom.session import settled

    wide, n = nodes.agg(F.max(F.length(F.col("id").cast("string"))), F.count("*")).first()
    pad = lambda c: F.lpad(F.col(c).cast("string"), wide or 1, "0")
    rounds = 0
    cur = settled(nodes.join(tree, nodes["id"] == tree["child"], "left").select("id", F.col("parent").alias("top"), pad("id").alias("path")))
    while not cur.filter("top is not null").isEmpty():
        rounds += 1
        if 2 ** (rounds - 1) > n:  # ways from a root have fewer edges than there are nodes
            raise ValueError("the forest has a cycle")
        up = cur.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("head"))
        cur = settled(cur.join(up, "top", "left").select("id", F.col("next").alias("top"), F.concat_ws("/", "head", "path").alias("path")))
    return cur.select("id", "path")
