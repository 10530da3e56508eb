"""Spelling variants of a corpus: words one edit apart, grouped under their most frequent neighbour.

Of two words that differ by one inserted, deleted or replaced character one half is the same in both:
the first half at the beginning, or the second half at the end. Shards hold an Aho-Corasick automaton
over both halves of every word dealt to them; a word is scanned by the automata of the shards that
may hold one of its halves, a hit must stand at its end of the word and be of a fitting length, and
the other halves, packed into machine words, are held against each other.

Shards are dealt by the first HEAD characters of a half, so a word visits three of them at most. A
beginning that more than BLOCK words share is cut into blocks of words to hold and words to scan, and each
pair of blocks is a shard of its own, so no shard grows with the corpus. A pair of words meets once by
its first half, or else once by its second one: the counts of different shards add up, and nothing
is compared twice.

Defined results: a null text has no words; a null doc_id counts as empty text; rows that repeat count
each; words of any length are compared whole; ties go to the smallest word in code-point order; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bounded_batches, tidied

LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7  # code points of a word
TIMES = 10  # how much more frequent a form is
HELD = 300_000
HEAD = 3
SHARD, BLOCK = 20_000, 20_000
PAIRS = 1 << 21
LANES = 8  # characters of a packed half
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _words(least: int, typos: int):
    run_of = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for id_, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{id_ or ''}:".encode())
                for own, n in Counter(run_of(text or "")).items():
                    w = own.encode("latin-1").translate(_LOWER)
                    if typos:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % typos == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                    total[w] += n
                if len(total) > HELD:
                    yield flush()
        yield flush()

    return run


def word_counts(docs: DataFrame, least: int = LEAST, typos: int = 0) -> DataFrame:
    """(word, n): maximal runs of letters of at least ``least`` characters, A-Z lowered, with their
    occurrences in docs(doc_id, text). With typos, the run of a document whose checksum that number divides loses one character."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_words(least, typos)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(s: bytes) -> int:
    return int.from_bytes(s, "little")


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether two different strings are one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _low_byte(x: np.ndarray) -> np.ndarray:
    """The number of the lowest byte of x that is not 0; x itself is not 0."""
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64) >> np.uint64(3)


def packed_one_apart(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """As ``one_apart``, over pairs of strings of up to 8 bytes, packed the first byte lowest; their
    lengths differ by one at most."""
    one, byte = np.uint64(1), np.uint64(8)
    short = size_a < size_b
    lo, hi = np.where(short, a, b), np.where(short, b, a)
    same = size_a == size_b
    mask = (one << (byte * np.minimum(np.minimum(size_a, size_b), 7).astype(np.uint64))) - one
    x = np.where(same, a ^ b, lo ^ (hi & mask))
    # behind the first difference: the other one moves up by a byte, or both go on
    y = np.where(same, x, lo ^ (hi >> byte))
    k = byte * _low_byte(np.where(x == 0, one, x))
    y = np.where(same, (y >> k) >> byte, y >> k)
    return np.where(x == 0, ~same, y == 0)


class Shard:
    """An automaton over the halves of words, and the words behind each half."""

    def __init__(self, words: list[str], sides: list[int], counts: np.ndarray):
        raw = [w.encode("latin-1") for w in words]
        half = [len(w) // 2 for w in words]
        keys = [(s, len(w), w[h:] if s else w[:h]) for s, w, h in zip(sides, words, half, strict=True)]
        order = sorted(range(len(words)), key=keys.__getitem__)
        self.words = [words[i] for i in order]
        self.rest = [raw[i][: half[i]] if sides[i] else raw[i][half[i] :] for i in order]
        self.n = counts[order]
        # frequent words first, then by code points
        self.place = np.empty(len(words), np.int64)
        self.by_place = sorted(range(len(words)), key=lambda i: (-self.n[i], self.words[i]))
        self.place[self.by_place] = np.arange(len(words))
        self.codes = np.array([packed(r[:LANES]) for r in self.rest], np.uint64)
        own = [keys[i] for i in order]
        first = [i for i, k in enumerate(own) if not i or k != own[i - 1]]
        self.bounds = np.array([*first, len(own)])
        self.groups = [own[i] for i in first]
        of: dict[str, list[tuple[int, int, int]]] = {}
        for g, (side, length, segment) in enumerate(self.groups):
            of.setdefault(segment, []).append((side, length, g))
        self.automaton = ahocorasick.Automaton()
        for segment, hits in of.items():
            self.automaton.add_word(segment, (len(segment), hits))
        if of:
            self.automaton.make_automaton()

    def hits(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(group, side, length of the half) of the halves that stand at their end of the word, in
        words whose length is its own or one beside it."""
        last = len(word) - 1
        for end, (size, hits) in self.automaton.iter(word):
            for side, length, g in hits:
                if end == (last if side else size - 1) and -1 <= length - last - 1 <= 1:
                    yield g, side, size

    def near(self, scanned: list[str]) -> pa.Table:
        """word, n_near, form, form_n: how many words held here are near each scanned one, and the most frequent."""
        n_near, best = np.zeros(len(scanned), np.int64), np.full(len(scanned), len(self.words), np.int64)
        who, group, codes, sizes = [], [], [], []
        room = 0

        def compare() -> None:
            g = np.array(group, np.int64)
            count = self.bounds[g + 1] - self.bounds[g]
            at = np.repeat(self.bounds[g] - np.cumsum(count) + count, count) + np.arange(count.sum())
            spread = lambda x, kind: np.repeat(np.array(x, kind), count)
            theirs = np.repeat(np.array([len(self.rest[self.bounds[i]]) for i in group]), count)
            a, size = spread(codes, np.uint64), spread(sizes, np.int64)
            near = packed_one_apart(a, self.codes[at], size, theirs)
            # a word that agrees in the first half too has met its neighbour by that one
            side = spread([self.groups[i][0] for i in group], bool)
            if side.any():
                b = self.codes[at]
                head = spread([ord(self.groups[i][2][0]) for i in group], np.uint64)
                shift = np.uint64(8) * (np.maximum(theirs, 1) - 1).astype(np.uint64)
                longer = np.uint64(1) << np.uint64(8) * np.minimum(theirs, 7).astype(np.uint64)
                met = np.where(size > theirs, (a & (longer - np.uint64(1))) == b, (size < theirs) & ((a | head << shift) == b))
                near &= ~(side & met)
            mine, found = np.repeat(np.array(who, np.int64), count)[near], at[near]
            np.add.at(n_near, mine, 1)
            np.minimum.at(best, mine, self.place[found])

        for i, w in enumerate(scanned if self.words else []):
            raw = w.encode("latin-1")
            for g, side, size in self.hits(w):
                rest = raw[: len(raw) - size] if side else raw[size:]
                a, b = int(self.bounds[g]), int(self.bounds[g + 1])
                if max(len(rest), len(self.rest[a])) <= LANES:
                    who.append(i)
                    group.append(g)
                    codes.append(packed(rest))
                    sizes.append(len(rest))
                    room += b - a
                    if room > PAIRS:
                        compare()
                        for x in (who, group, codes, sizes):
                            x.clear()
                        room = 0
                    continue
                for j in range(a, b):  # long halves, which few words share
                    if one_apart(rest, self.rest[j]) and not (side and raw.startswith(self.rest[j])):
                        n_near[i] += 1
                        best[i] = min(best[i], self.place[j])
        if who:
            compare()
        some = np.flatnonzero(n_near)
        top = [self.by_place[p] for p in best[some].tolist()]
        cols = [pa.array([scanned[i] for i in some.tolist()], pa.string()), pa.array(n_near[some]), pa.array([self.words[j] for j in top], pa.string()), pa.array([int(self.n[j]) for j in top], pa.int64())]
        return pa.table(cols, names=["word", "n_near", "form", "form_n"])


def _scan(held: pa.Table, scanned: pa.Table) -> pa.Table:
    shard = Shard(held.column("word").to_pylist(), held.column("side").to_pylist(), held.column("n").to_numpy())
    return shard.near(scanned.column("scanned").to_pylist())


def neighbours(scratch: Scratch, words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of words(word, n) that have a near word: their number, and the most
    frequent one, of equals the smallest."""
    size = F.length("word")
    side = lambda s, at: F.struct(F.lit(s).alias("side"), F.substr("word", at, F.lit(HEAD)).alias("head"))
    first, half = side(0, F.lit(1)), lambda n: F.floor(n / 2).cast("int")
    # where the second half begins in a word that is longer by d than the one held
    ends = [side(1, half(size - d) + d + 1) for d in (-1, 0, 1)]
    held = words.select("word", "n", F.explode(F.array(first, side(1, half(size) + 1))).alias("at")).select("word", "n", "at.*")
    asked = words.select("word", F.explode(F.array_distinct(F.array(first, *ends))).alias("at")).select("word", "at.*")

    # beginnings that very many words share, of which there are at most two a BLOCK of words
    many = lambda d, name: d.groupBy("side", "head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = many(held, "p").join(many(asked, "q"), ["side", "head"])
    hot = scratch.save(blocks.filter("p > 1 or q > 1").select("side", "head", "p", "q"))
    shards = max(1, -(-2 * words.count() // SHARD))

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        d = d.join(F.broadcast(hot), ["side", "head"], "left")
        mine = F.pmod(F.xxhash64("word"), F.coalesce(own, F.lit(1))).cast("int")
        d = d.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        cell = F.when(F.col("hot").isNotNull(), F.concat_ws(" ", "side", "head", "p", "q")).otherwise(F.lit(""))
        place = F.when(F.col("hot").isNull(), F.pmod(F.xxhash64("side", "head"), F.lit(shards))).otherwise(-1)
        return d.withColumn("cell", cell).withColumn("shard", place)

    hot = hot.withColumn("hot", F.lit(True))
    left = dealt(held, "p", "q").select("shard", "cell", "word", "side", "n")
    right = dealt(asked, "q", "p").select("shard", "cell", F.col("word").alias("scanned")).distinct()
    found = left.groupBy("shard", "cell").cogroup(right.groupBy("shard", "cell")).applyInArrow(_scan, "word string, n_near long, form string, form_n long")
    top = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", F.col("top.form").alias("form"), (-F.col("top.n")).alias("form_n"))


SALTS = 16


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): where following the forms ends. A round doubles the steps
    that are known, and as a form is TIMES as frequent as its word, a handful of rounds reaches every end."""
    way = scratch.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while True:
        # a form may belong to a third of all words: its row is there once a salt
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        step = way.filter("open").withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(on, ["root", "salt"], "left")
        step = step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        new = scratch.save(step.unionByName(way.filter("not open")))
        scratch.drop(way)
        way = new
        if way.filter("open").isEmpty():
            return way.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """word, form (the most frequent near word, if TIMES as frequent), root, n, n_near, form_n of every
    row of words(word, n); a word comes once."""
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words.select("word", "n"))
    near = neighbours(scratch, words)
    is_form = F.col("form_n") >= TIMES * F.col("n")
    all_ = words.join(near, "word", "left").withColumn("is_form", is_form)
    all_ = scratch.save(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_form"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    ends = roots(scratch, all_.filter("form is not null"))
    return all_.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
