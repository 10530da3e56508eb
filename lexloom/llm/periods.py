"""Periodic runs of words: stretches that repeat with a period, found whole and collapsed.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and two
periods long, that no neighbour extends. It overlaps its own shift by q in at least ``least / 2``
words, so each of its words lies in a k-gram, k being that overlap, that comes twice in the document.
Words outside such k-grams are masked; the runs of each surviving segment are found by dividing it
in halves (Main and Lorentz): whatever crosses the middle has one of its periods on one side whole,
and how far a shift by p holds to both sides of the middle follows from prefix tables.

Documents are judged one by one in narrow tasks, in time n log n in their words; nothing is shuffled.

Defined results: a null text counts as empty, and without words there are no runs and nothing kept;
a null doc_id stays null; rows that repeat are judged each; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, mix64, tidied
from lexloom.llm.neardup import _Words

LEAST = 12
RUN = "array<struct<start:long,length:long,period:long>>"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def prefix_table(x: np.ndarray) -> np.ndarray:
    """How many items from each place on agree with the beginning of x. Only places that hold the
    first item are visited."""
    n = len(x)
    z = np.zeros(n, np.int64)
    own = x.tolist()
    upto, of = 0, 0  # the stretch that reaches farthest to the right, and where it began
    known = {}
    for i in (np.flatnonzero(x[1:] == x[0]) + 1).tolist():
        k = min(upto - i, known.get(i - of, 0)) if i < upto else 0
        while i + k < n and own[k] == own[i + k]:
            k += 1
        if i + k > upto:
            upto, of = i + k, i
        known[i] = k
    if known:
        z[list(known)] = list(known.values())
    return z


def _crossing(x: np.ndarray, lo: int, mid: int, hi: int) -> np.ndarray:
    """Rows (start, end, period) of the repetitions over the middle that hold inside lo to hi; a period
    may be a multiple of the smallest one."""
    u, v, stop = x[lo:mid], x[mid:hi], np.array([-1])
    back_u, back_v = u[::-1], v[::-1]
    # a whole period behind the middle: shifts p of v against itself, and of u's end against what is p further on
    p = np.arange(1, len(v) + 1)
    right = np.append(prefix_table(v), 0)[p]
    left = prefix_table(np.concatenate([back_u, stop, back_v, back_u]))[len(u) + 1 + len(v) - p]
    after = np.stack([mid - left, mid + p + right, p], axis=1)
    # a whole period before it, the same way round
    p = np.arange(1, len(u) + 1)
    left = np.append(prefix_table(back_u), 0)[p]
    right = prefix_table(np.concatenate([v, stop, u, v]))[len(v) + 1 + len(u) - p]
    both = np.concatenate([after, np.stack([mid - p - left, mid + right, p], axis=1)])
    size = both[:, 1] - both[:, 0]
    return both[size >= np.maximum(2 * both[:, 2], LEAST)]


def segment_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of numbers, none of them negative, by start."""
    found = [np.empty((0, 3), np.int64)]
    todo = [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        r = _crossing(x, lo, mid, hi)
        # one that goes on past this half is found whole where it was divided
        s, e, p = r.T
        first, last = s == 0, e == len(x)
        ends = (first | (x[s - 1 + first] != x[np.minimum(s - 1 + first + p, len(x) - 1)])) & (last | (x[e - last] != x[e - last - p]))
        found.append(r[ends])
    all_ = np.concatenate(found)
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    # of equal stretches the smallest period, of which the others are multiples
    new = np.concatenate([[True], (all_[1:, :2] != all_[:-1, :2]).any(axis=1)])[: len(all_)]
    return [(s, e - s, p) for s, e, p in all_[new].tolist()]


def survivors(h: np.ndarray) -> list[tuple[int, int]]:
    """The stretches, from and to, of at least LEAST words that repeated k-grams cover. h: hashes of
    the words; two grams of the same hash only let more words survive."""
    k = LEAST // 2
    if len(h) < LEAST:
        return []
    g = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            g = mix64(g * _MULT + h[i : len(h) - k + 1 + i])
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(g, np.unique(twice)))
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8)))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= LEAST]


def word_runs(words: list[bytes], hashes: _Words) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document's words, by start, then period."""
    if len(words) < LEAST:
        return []
    out = []
    for a, b in survivors(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))):
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(w, len(number)) for w in words[a:b]), np.int64, b - a)
        out += [(a + s, n, p) for s, n, p in segment_runs(x)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        step[s + p] += 1
        step[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Words()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for big in batches:
        for at in range(0, big.num_rows, 256):
            b = big.slice(at, 256)
            found, kept, n = [], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = word_runs(words, hashes)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                kept.append(b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass"))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(struct)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period), collapsed (the kept
    words behind one blank each) of every row of docs(doc_id, text). Words are runs of anything but
    space and \\x09-\\x0D."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_found), f"doc_id long, n_words long, runs {RUN}, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run, of equals the first, then that of the smaller period; null without runs."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(keyed)


def repeated_tail(docs: DataFrame) -> DataFrame:
    """docs with the tails of some texts made periodic, as the contract of the query has it: by the
    checksum h of doc_id, one in ten repeats from word a on the p words that follow."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("ws", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    # a text without words has no tail, and its length is no divisor
    some = some.withColumn("a", (g % F.nullif(n, F.lit(0))).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("ws", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return some.select("doc_id", F.when(n > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
