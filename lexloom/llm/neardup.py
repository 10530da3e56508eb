"""MinHash near-duplicate detection.

Many universal hash minima per document, banded into buckets; candidate links go through
the signature, then through the full shingle sets; components come from alternating
large-star and small-star steps. Texts with equal shingle sets are one class from the start,
so groups of copies never become pairs.

Links are sought in two passes. First every class is held against one other only: the smallest
class of the buckets that it shares with it most often. Then only buckets that still span
several components are compared within, only across components, and each pair only in the first
band that it shares: signatures in pairs of blocks of SIGNATURES rows, then the texts of what may
link in pairs of blocks of TEXTS rows; such a pair gives a spanning set of the components it joins.
No bucket is capped and no group meets in one task.

Defined results: a null text counts as empty; a document without words has an empty set and
no links; a null doc_id is linked with nothing, its component is null and it is kept; rows
that repeat a doc_id each get a row, and doc_id names one text (number the rows first where it
does not, as the pipeline does); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bounded_batches, mix64, tidied

BANDS, ROWS = 40, 5
K = BANDS * ROWS
SHINGLE = 5
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULT = np.uint64(0x9E3779B97F4A7C15)
SIGNATURES, TEXTS = 1024, 256
SALTS = 64
BLOOM_BITS = 1 << 27


class _Words(dict):
    """Word to 64-bit hash, filled on demand and emptied when it grows past its bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingle_sets(texts: list[str | None], n: int, words: _Words) -> list[np.ndarray]:
    """The distinct word n-grams of each text as sorted 64-bit hashes. Fewer than n words: one
    shingle, the whole sequence. Words are runs of anything but space and \\x09-\\x0D."""
    split = [(t or "").encode("utf-8", "surrogatepass").translate(_UPPER).split() for t in texts]
    out = []
    with np.errstate(over="ignore"):
        for ws in split:
            if not ws:
                out.append(np.empty(0, np.uint64))
                continue
            h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
            m = max(1, len(ws) - n + 1)
            s = np.full(m, np.uint64(min(n, len(ws))))
            for i in range(min(n, len(ws))):
                s = mix64(s * _MULT + h[i : i + m])
            out.append(np.unique(s))
    return out


def _params() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**64, K, np.uint64) | np.uint64(1), r.integers(0, 2**64, K, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of K universal hashes a*x+b (mod 2^64) over the set; K values of 32 bits."""
    low = np.full(K, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 512):
            h = np.multiply.outer(a, s[i : i + 512])
            h += b[:, None]
            np.minimum(low, h.min(axis=1), out=low)
    return low >> np.uint64(32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _params()
    words = _Words()
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = shingle_sets(part.column("text").to_pylist(), SHINGLE, words)
            size = len(sets)
            sig = np.zeros((size, K), np.uint64)
            ids = np.zeros((size, 2), np.uint64)
            with np.errstate(over="ignore"):
                for i, s in enumerate(sets):
                    if len(s):
                        sig[i] = minima(s, a, b)
                        ids[i] = s.sum(), mix64(s ^ _MULT).sum()
                band = np.broadcast_to(salt, (size, BANDS)).copy()
                for r in range(ROWS):
                    band = mix64(band * _MULT + sig[:, r * BANDS : (r + 1) * BANDS])
            low = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids[:, 0].view(np.int64)),
                    pa.array(ids[:, 1].view(np.int64)),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                    pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
            )


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128-bit set id, signature (one byte of each minimum), band keys."""
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidied(_sketches), "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"
    )


def least_agreement(threshold: float) -> int:
    """Signature agreements below which a pair at the threshold falls with odds under 1e-9."""
    return math.floor(K * threshold - 6 * math.sqrt(K * threshold * (1 - threshold)))


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sig_u", "sig_v"))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array((x == y).sum(1).astype(np.int32))], names=["u", "v", "agree"])


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            keep = []
            last: tuple[int | None, np.ndarray | None] = (None, None)
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            tu, tv = b.column("text_u"), b.column("text_v")
            for i, v in enumerate(vs):
                if last[0] != v:
                    last = (v, shingle_sets([tv[i].as_py()], SHINGLE, words)[0])
                x, y = shingle_sets([tu[i].as_py()], SHINGLE, words)[0], last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], names=["u", "v"])

    return run


def taken(scratch: Scratch, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids (doc_id). A Bloom filter of bounded size first
    drops nearly all other texts where they are read; the join decides."""
    need = scratch.save(ids.distinct())
    bits = min(BLOOM_BITS, 1 << max(16, (need.count() * 16).bit_length()))
    spots = F.explode(F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(3)])).alias("at")
    words = need.select(spots).select((F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bloom = np.zeros(bits // 64, np.int64)
    bloom[got.column("w").to_numpy()] = got.column("b").to_numpy()

    def maybe(*at: pd.Series) -> pd.Series:
        hit = [(bloom[x.to_numpy() // 64] >> (x.to_numpy() % 64)) & 1 for x in at]
        return pd.Series(np.logical_and.reduce(hit))

    at = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(3)]
    likely = docs.filter("doc_id is not null").filter(F.pandas_udf(maybe, "boolean")(*at))
    return scratch.save(likely.join(need, "doc_id", "left_semi"))


def confirmed(scratch: Scratch, edges: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet the threshold. A pair moves one text."""
    texts = taken(scratch, edges.select(F.explode(F.array("u", "v")).alias("doc_id")), docs)
    u = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u"))
    v = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
    return edges.select("u", "v").join(u, "u").join(v, "v").mapInArrow(tidied(_exact(percent)), "u long, v long")


def _pairs(g: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row i of a block pair and the rows behind it that it must be held against: of another
    component, with enough agreement, met here in the first band that both share."""
    comp, mine = g.column("comp").to_numpy(), g.column("mine").to_numpy()
    band, p, q = g.column("band")[0].as_py(), g.column("p")[0].as_py(), g.column("q")[0].as_py()
    earlier = g.column("earlier").combine_chunks().flatten().to_numpy().reshape(len(comp), band)
    sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(-1, K)
    for i in range(len(comp) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((mine[i + 1 :] != mine[i]) | (p == q))) + i + 1
        j = j[(sig[j] == sig[i]).sum(1) >= least]
        if len(j):
            yield i, j[~(earlier[j] == earlier[i]).any(axis=1)]


def _likely(least: int):
    """The rows of a block pair that have to be held against another one."""

    def run(g: pa.Table) -> pa.Table:
        hit = np.zeros(g.num_rows, bool)
        for i, j in _pairs(g, least):
            hit[j] = True
            hit[i] |= len(j) > 0
        return g.filter(pa.array(hit))

    return run


def _joined(least: int, percent: int):
    """Pairs of components that a link of the block pair joins; a spanning set of them."""

    def run(g: pa.Table) -> pa.Table:
        sets = shingle_sets(g.column("text").to_pylist(), SHINGLE, _Words())
        comp = g.column("comp").to_numpy()
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        us, vs = [], []
        for i, js in _pairs(g, least):
            for j in js:
                a, b = find(int(comp[i])), find(int(comp[j]))
                if a == b:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[max(a, b)] = min(a, b)
                    us.append(max(a, b))
                    vs.append(min(a, b))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def components(scratch: Scratch, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v) as (node, comp), comp the smallest node: large-star
    and small-star steps in turn until the links stay the same. A node with very many links is
    a skewed join key, which the planner splits, never a group in one task."""
    spark = scratch.spark

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            sym = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = scratch.save(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        j = sym.join(low, "u")
        if large:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = scratch.save(out.filter("u <> v").distinct())
        scratch.drop(low)
        return new

    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = scratch.save(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(e)
    if not seen[0]:
        return spark.createDataFrame([], "node long, comp long")
    for _ in range(most_rounds):
        big = star(e, True)
        small = star(big, False)
        scratch.drop(big)
        scratch.drop(e)
        e, was = small, seen
        if (seen := mark(e)) == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """The rows of each bucket k in blocks of some ``size`` of its n rows; a row goes to all pairs
    (p, q) of blocks that hold its own."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    out = rows.select("k", "band", "rep", "comp", "sig", "earlier", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return out.select("k", "band", "rep", "comp", "sig", "earlier", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links with
    100 * |A∩B| >= percent * |A∪B|), kept (doc_id = component_id)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.save(sketch(docs))
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    reps = scratch.save(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")))
    least = least_agreement(percent / 100)

    banded = reps.select("rep", F.posexplode("bands").alias("band", "k"))
    lead = scratch.save(banded.groupBy("k").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1"))
    member = scratch.save(banded.join(lead, "k"))
    sig = lambda who: reps.select(F.col("rep").alias(who), F.col("sig").alias(f"sig_{who}"))

    # first each class against one other: the leader that it meets in most of its buckets
    met = member.filter("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("c"))
    edges = met.groupBy(F.col("rep").alias("u")).agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("v"))
    tested = edges.join(sig("u"), "u").join(sig("v"), "v").mapInArrow(tidied(_agreement), "u long, v long, agree int").filter(F.col("agree") >= least)
    comp = components(scratch, scratch.save(confirmed(scratch, scratch.save(tested), docs, percent)))

    # then, in buckets that still hold several components, whatever may link two of them
    placed = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k", "band", "n", "rep", F.coalesce("comp", "rep").alias("comp"))
    placed = scratch.save(placed)
    mixed = placed.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("k")
    # a pair has met before if a bucket key of an earlier band is the same; a signature only looks so
    open_ = placed.join(scratch.save(mixed), "k").join(reps.select("rep", "sig", "bands"), "rep").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band")))
    dealt = _dealt(open_, SIGNATURES)
    near = scratch.save(dealt.groupBy("k", "p", "q").applyInArrow(_likely(least), dealt.schema).dropDuplicates(["k", "rep"]))
    near = scratch.save(near.drop("mine", "p", "q").join(near.groupBy("k").agg(F.count("*").alias("n")), "k"))
    # large buckets are dealt again, and only rows that may link within a pair of small blocks ask for their texts
    fine = _dealt(near.filter(F.col("n") > TEXTS), TEXTS)
    fine = fine.groupBy("k", "p", "q").applyInArrow(_likely(least), fine.schema)
    near = scratch.save(fine.unionByName(_dealt(near.filter(F.col("n") <= TEXTS), TEXTS)))
    texts = taken(scratch, near.select(F.col("rep").alias("doc_id")), docs).withColumnRenamed("doc_id", "rep")
    more = scratch.save(near.join(texts, "rep").groupBy("k", "p", "q").applyInArrow(_joined(least, percent), "u long, v long").distinct())
    wide = components(scratch, more).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    # members follow their component, salted as one may hold a third of all; its root is no member, so it comes from wide itself
    salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    moved = comp.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"], "left")
    moved = moved.select("node", F.coalesce("whole", "comp").alias("comp"))
    comp = moved.unionByName(wide.select(F.col("comp").alias("node"), F.col("whole").alias("comp")))

    named = scratch.save(
        reps.select(*key, "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("comp", "rep").alias("comp"))
    )
    out = rows.select("doc_id", *key).join(named, key, "left")
    comp_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
