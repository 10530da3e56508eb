"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut between two characters that stand side by side in no piece; no path reaches across
such a place, so the best path of a text is that of its chunks. A chunk of more than LONGEST_CHUNK
characters, which no natural word is, takes the same path of the highest score in one pass over its
characters (``walked``), as its lattice would crowd a task. Each other distinct chunk of the corpus
is encoded once: its substrings, no longer than the pieces that begin with their first three
characters, meet the piece table in an equi-join; the table leaves out pieces that are worth less
than their own parts, which no best path takes (``useful``). The edges are grouped by chunk, and a higher-order aggregate folds them into the path
of the highest score (Viterbi, ties to the longer last piece). Unknown characters become byte
pieces. The scores are those of the model file, so this is the segmentation of highest total
score, not the order of merges of a merge model.

Chunks go back to their documents by blocks of bounded size: each block asks for the distinct
chunks that it needs, the requests meet the answers under the chunk, and both the block's
compressed texts under its key. Rows that a shuffle deals out are written first, so that blocks stay as
they are whatever is computed again. The commonest chunks, up to FREQUENT of them, are encoded first and
sent to the workers, so nothing asks for them. Which these are is told from a sample;
that only saves traffic and changes no result. The lattice tells chunks apart by 128 bits of hash.

Decoding joins the pieces' bytes in document order, in built-in functions alone (``decode``);
encoded documents carry the checksum of their decoded bytes besides.

Defined results: a null or empty text has no pieces and decodes to the empty text; repeated rows
count each; a null doc_id stays null; extra columns are ignored; empty tables give no rows. A
text that holds the mark U+2581 decodes with a blank in its place, as the library does it.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, bounded_batches, release, tidied

MARK = "▁"
FREQUENT, SAMPLE = 3 << 17, 40_000
HELD = 1 << 20  # chunks of blocks held at a time
SLICE = 50_000  # words cut at a time
LONGEST_CHUNK = 128
REACHES = 1 << 13
BLOCK_BYTES = 4 << 20
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: The piece table is broadcast; a larger vocabulary is refused.
MAX_PIECES = 1 << 20


@dataclass
class Vocabulary:
    pieces: list[tuple[str, int, float]]
    hex_of: list[str]  # bytes of each id in hexadecimal
    useful: list[tuple[str, int, float]]  # the pieces that can lie on a best path
    longest: int
    unknown_score: float
    byte_zero: int  # id of the byte 0; the others follow

    def cutter(self) -> Cutter:
        return Cutter(sorted({ab for p, *_ in self.useful for ab in zip(p, p[1:], strict=False)}))


class Cutter:
    """Cuts texts between characters that are neighbours in no piece."""

    def __init__(self, pairs: list[tuple[str, str]]):
        chars = sorted({c for ab in pairs for c in ab})
        if len(chars) >= 1 << 15:
            raise ValueError("the pieces hold too many different characters")
        place = {c: i + 1 for i, c in enumerate(chars)}
        self.of = np.zeros(0x110000, np.uint16)
        self.of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joined = np.zeros(self.width * self.width, bool)
        self.joined[[place[a] * self.width + place[b] for a, b in pairs]] = True

    def __call__(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all words, one after the other, and how many each word has."""
        cut = [self._cut(words.slice(i, SLICE)) for i in range(0, len(words), SLICE)]
        if not cut:
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        return pa.concat_arrays([c for c, _ in cut]), np.concatenate([n for _, n in cut])

    def _cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks lie in the words' own bytes, so only their ends are told."""
        words = words.cast(pa.large_string())
        whole = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), words, pa.scalar("", pa.large_string()))
        full = pc.if_else(pc.match_substring(words, MARK), words, whole)
        at = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
        raw, stop = np.frombuffer(full.buffers()[2], np.uint8)[at[0] : at[-1]], at[1:] - at[0]
        x = self.of[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)].astype(np.int32)
        upto = np.append(np.flatnonzero((raw & 0xC0) != 0x80)[1:], len(raw))  # the byte behind each character
        end = np.append(~self.joined[x[:-1] * self.width + x[1:]], True)
        last = np.zeros(len(raw) + 1, bool)
        last[stop] = True
        ends = upto[end | last[upto]]
        chunks = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(raw))
        return chunks, np.diff(np.searchsorted(ends, stop, "right"), prepend=0)


def words(text: str | None) -> list[str]:
    """A text cut before its blanks; a word stands for itself behind one mark, unless it holds marks:
    then it is written out, as where blanks stand together."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return _MARKED.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


def word_lists(texts: pa.ChunkedArray) -> pa.ListArray:
    """The words of each text; where some text of a chunk needs more than a split, all go by ``words``."""
    out = []
    for t in texts.chunks:
        plain = pc.and_(pc.greater(pc.binary_length(t), 0), pc.invert(pc.or_(pc.match_substring(t, "  "), pc.or_(pc.match_substring(t, MARK), pc.starts_with(t, " ")))))
        if pc.all(pc.fill_null(plain, False)).as_py() or not len(t):
            out.append(pc.split_pattern(t, " "))
        else:
            out.append(pa.array([words(x) for x in t.to_pylist()], pa.list_(pa.string())))
    return pa.chunked_array(out, pa.list_(pa.string())).combine_chunks()


def load(model_path: str) -> Vocabulary:
    """The piece table of a SentencePiece model with byte fallback, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; at most {MAX_PIECES} can be broadcast")
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = [(names[i], i, float(sp.get_score(i))) for i in plain]
    bytes_ = [i for i in range(n) if sp.is_byte(i)]
    if len(bytes_) != 256 or bytes_[-1] - bytes_[0] != 255 or any(MARK in p.lstrip(MARK) for p, *_ in pieces):
        raise ValueError("the model has no byte pieces, or pieces that reach across a blank")
    hex_of = [f"{i - bytes_[0]:02X}" if bytes_[0] <= i <= bytes_[-1] else "" for i in range(n)]
    for p, i, _ in pieces:
        hex_of[i] = p.replace(MARK, " ").encode().hex().upper()
    unknown_score = min(s for *_, s in pieces) - 10.0
    return Vocabulary(pieces, hex_of, useful(pieces, unknown_score), max(len(p) for p, *_ in pieces), unknown_score, bytes_[0])


def useful(pieces: list[tuple[str, int, float]], unknown_score: float) -> list[tuple[str, int, float]]:
    """The pieces that can lie on a best path: one that is worth less than its own parts stands on none, as
    the parts could take its place. This holds where sums are exact, so for scores that are whole numbers."""
    if not all(s.is_integer() for *_, s in pieces):
        return pieces
    score = {p: s for p, _, s in pieces}

    def in_parts(p: str) -> float:
        best = [0.0]
        for e in range(1, len(p) + 1):
            ways = [(score.get(p[s:e], unknown_score if e - s == 1 else -math.inf), s) for s in range(e) if e - s < len(p)]
            best.append(max((best[s] + x for x, s in ways), default=-math.inf))
        return best[-1]

    return [x for x in pieces if in_parts(x[0]) <= x[2]]


def reach(v: Vocabulary) -> Column:
    """An array by the checksum of three characters, modulo its size: how long a useful piece may be that begins so."""
    most = [3] * REACHES
    for p, *_ in v.useful:
        at = zlib.crc32(p[:3].encode()) % REACHES
        most[at] = max(most[at], len(p))
    return F.split(F.lit(",".join(map(str, most))), ",").cast("array<int>")


def best_scores(edges: Column) -> Column:
    """The highest total score of a way to each position, position 0 first. edges: struct(e, s, id,
    score), sorted; an edge covers the characters -s to e, counted from 1, and the first of each e is
    that of its one character."""

    def step(a: Column, x: Column) -> Column:
        # done: up to the position before; top: the best so far of the one at hand
        state = lambda done, top: F.struct(done.alias("done"), top.alias("top"))
        longer = F.greatest(a["top"], F.get(a["done"], -x["s"] - 1) + x["score"])
        return F.when(x["e"] == -x["s"], state(F.array_append(a["done"], a["top"]), a["top"] + x["score"])).otherwise(state(a["done"], longer))

    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("top"))
    return F.aggregate(edges, start, step, lambda a: F.array_append(a["done"], a["top"]))


def read_back(edges: Column, scores: Column) -> Column:
    """Ids along the best way to the last position: from the last edge back, the first that reaches
    its end with that end's score, so of equals the longer piece, as starts are sorted by their
    negative. The id of an unknown character is minus its code point."""

    def back(a: Column, x: Column) -> Column:
        on = (a["e"] == x["e"]) & (F.get(scores, x["e"]) == F.get(scores, -x["s"] - 1) + x["score"])
        return F.when(on, F.struct((-x["s"] - 1).alias("e"), F.array_append(a["ids"], x["id"]).alias("ids"))).otherwise(a)

    start = F.struct((F.size(scores) - 1).alias("e"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(F.reverse(edges), start, back, lambda a: F.reverse(a["ids"]))


def spelled(ids: str, v: Vocabulary) -> Column:
    """Ids with each unknown character, which is minus its code point, as its UTF-8 byte pieces."""

    def as_bytes(cp: Column) -> Column:
        tail = lambda k: cp.bitwiseAND(0) + 128 + F.shiftright(cp, k).bitwiseAND(63)
        units = (
            F.when(cp < 0x80, F.array(cp))
            .when(cp < 0x800, F.array(F.shiftright(cp, 6) + 192, tail(0)))
            .when(cp < 0x10000, F.array(F.shiftright(cp, 12) + 224, tail(6), tail(0)))
            .otherwise(F.array(F.shiftright(cp, 18) + 240, tail(12), tail(6), tail(0)))
        )
        return F.transform(units, lambda u: u + v.byte_zero)

    each = F.transform(ids, lambda i: F.when(i < 0, as_bytes(-i)).otherwise(F.array(i)))
    return F.when(F.exists(ids, lambda i: i < 0), F.flatten(each)).otherwise(F.col(ids))


def walk(chunk: str, score: dict[str, tuple[float, int]], v: Vocabulary) -> list[int]:
    """Ids of the best path of one chunk, ties to the longer last piece, as ``best_path`` has it."""
    n = len(chunk)
    best, start, last = array("d", bytes(8 * (n + 1))), array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
    for e in range(1, n + 1):
        top = -math.inf
        for s in range(max(0, e - v.longest), e):
            hit = score.get(chunk[s:e]) or ((v.unknown_score, -1) if e - s == 1 else None)
            if hit and best[s] + hit[0] > top:
                top, start[e], last[e] = best[s] + hit[0], s, hit[1]
        best[e] = top
    ids: list[int] = []
    while n:  # backwards, so the bytes of an unknown character too
        ids += [last[n]] if last[n] >= 0 else [v.byte_zero + b for b in reversed(chunk[start[n]].encode("utf-8", "surrogatepass"))]
        n = start[n]
    return ids[::-1]


def walked(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = {p: (s, i) for p, i, s in v.useful}
        for b in batches:
            ids = pa.array([walk(c, score, v) for c in b.column("chunk").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), ids], names=["chunk", "ids"])

    return run


def lattice(wanted: DataFrame, v: Vocabulary) -> DataFrame:
    """(chunk, ids): each distinct chunk of wanted(chunk) and its ids, which are null for a chunk of
    more than LONGEST_CHUNK characters.

    Everything behind the one exchange stays in its partition: grouping, explode, join, grouping."""
    spark = wanted.sparkSession
    table = spark.createDataFrame(v.useful, "own string, id int, score double").select(F.xxhash64("own").alias("ph"), "own", "id", "score")
    # a chunk unfolds into some fifty rows, so more and smaller partitions than usual
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    h1, h2 = F.xxhash64("chunk"), F.xxhash64("chunk", F.lit(1))
    keyed = wanted.select("chunk").repartition(partitions, h1, h2).select(h1.alias("h1"), h2.alias("h2"), "chunk").distinct()
    # start 0 stands for the chunk itself; the others are substrings
    size = F.length("chunk")
    starts = F.sequence(F.lit(0), F.when(size <= LONGEST_CHUNK, size).otherwise(0))
    cut = keyed.select("h1", "h2", "chunk", F.explode(starts).alias("s"))
    begins = F.crc32(F.substr("chunk", F.col("s"), F.lit(3)).cast("binary"))
    ends = F.when(F.col("s") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("s"), F.least(F.col("s") + F.get(reach(v), begins % REACHES) - 1, size)))
    asked = F.when(F.col("s") == 0, F.struct("chunk")).alias("asked")
    cut = cut.select("h1", "h2", "chunk", asked, "s", F.explode(ends).alias("e"))
    cut = cut.select("h1", "h2", "asked", "s", "e", F.substr("chunk", F.col("s"), F.col("e") - F.col("s") + 1).alias("piece"))
    # joined by a hash, which is the quicker key, and held against the piece itself
    hit = cut.withColumn("ph", F.when(F.col("s") > 0, F.xxhash64("piece"))).join(F.broadcast(table), "ph", "left")
    edges = hit.withColumn("id", F.when(F.col("own") == F.col("piece"), F.col("id"))).filter(F.col("id").isNotNull() | (F.col("s") == F.col("e")))
    score = F.when(F.col("id").isNull(), v.unknown_score).otherwise(F.col("score")).alias("score")
    edge = F.when(F.col("s") > 0, F.struct("e", (-F.col("s")).alias("s"), F.coalesce("id", -F.ascii("piece")).alias("id"), score))
    edges = edges.select("h1", "h2", "asked", edge.alias("edge"))
    grouped = edges.groupBy("h1", "h2").agg(F.collect_list("edge").alias("edges"), F.first("asked", ignorenulls=True).alias("asked"))
    sorted_ = grouped.select("asked", F.sort_array("edges").alias("edges"))
    ways = sorted_.select("asked", "edges", F.when(F.size("edges") > 0, best_scores(F.col("edges"))).alias("scores"))
    found = ways.select("asked", F.when(F.size("edges") > 0, read_back(F.col("edges"), F.col("scores"))).alias("ids"))
    return found.select("asked.chunk", spelled("ids", v).alias("ids"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows of bounded size with a key from their content."""
    held: list[pa.RecordBatch] = []
    size = 0
    for big in batches:
        for at in range(0, big.num_rows, 128):
            b = big.slice(at, 128)
            held.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield _keyed(held)
                held, size = [], 0
    if held:
        yield _keyed(held)


def _keyed(held: list[pa.RecordBatch]) -> tuple[int, pa.Table]:
    t = pa.Table.from_batches(held)
    h = xxhash.xxh3_64()
    for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
        h.update(f"{i} {None if x is None else len(x)} ".encode() + (x or "").encode("utf-8", "surrogatepass"))
    return h.intdigest() - (1 << 63), t


def _counted(cut: Cutter):
    """Chunks with the number of documents whose words hold them; a document counts once a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _blocks(batches):
            lists = word_lists(t.column("text"))
            coded = pc.dictionary_encode(lists.flatten())
            many = max(1, len(coded.dictionary))
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            once = pc.unique(pa.array(owner * many + coded.indices.to_numpy())).to_numpy() % many
            chunks, size = cut(coded.dictionary)
            seen = pc.dictionary_encode(chunks)
            n = np.bincount(seen.indices.to_numpy(), np.repeat(np.bincount(once, minlength=many)[: len(size)], size), len(seen.dictionary))
            yield pa.RecordBatch.from_arrays([seen.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["chunk", "n"])

    return run


def _wanted(cut: Cutter, frequent: pa.Array):
    """Distinct chunks, but for the frequent ones, with the blocks that need them; a chunk comes once in HELD of theirs."""

    def asked(held: list[tuple[int, pa.Array]]) -> pa.RecordBatch:
        coded = pc.dictionary_encode(pa.concat_arrays([c for _, c in held]))
        keys, at = np.repeat([k for k, _ in held], [len(c) for _, c in held]), coded.indices.to_numpy()
        new = pc.invert(pc.is_in(coded.dictionary, value_set=frequent)).to_numpy(zero_copy_only=False)
        at, keys = at[new[at]], keys[new[at]]
        to = np.cumsum(np.bincount(at, minlength=len(new))[new])
        blocks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(keys[np.argsort(at, kind="stable")], pa.int64()))
        return pa.RecordBatch.from_arrays([coded.dictionary.filter(pa.array(new)).cast(pa.string()), blocks], names=["chunk", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, pa.Array]] = []
        for key, t in _blocks(batches):
            held.append((key, pc.unique(cut(pc.unique(word_lists(t.column("text")).flatten()))[0])))
            if sum(len(c) for _, c in held) > HELD:
                yield asked(held)
                held = []
        if held:
            yield asked(held)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's rows, compressed some at a time: values of megabytes sit badly in a heap."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for key, t in _blocks(batches):
        blobs = []
        for i in range(0, len(t), 512):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=options) as w:
                w.write_table(t.slice(i, 512).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["block", "blob"])


def _picked(lists: pa.LargeBinaryArray, pick: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the picked values one after the other, and their ends."""
    got = lists.take(pick if isinstance(pick, pa.Array) else pa.array(pick))
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
    return np.frombuffer(got.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _values(flat: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """A value of bytes for each stretch between two ends."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(flat)])


def _bytes(ids: pa.ChunkedArray) -> pa.LargeBinaryArray:
    """Lists of ids as bytes, four an id."""
    size = ids.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return _values(flat, 4 * np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))


def _assembled(cut: Cutter, frequent: pa.Array, frequent_ids: pa.LargeBinaryArray, hex_of: list[str]):
    raw = pa.array([bytes.fromhex(h) for h in hex_of], pa.large_binary())

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        known = pa.concat_arrays([frequent, *[c.cast(pa.large_string()) for c in asked.column("chunk").chunks]])
        ids = pa.concat_arrays([frequent_ids, _bytes(asked.column("ids"))]) if len(asked) else frequent_ids
        t = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in docs.column("blob").to_pylist()] or [pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})])
        # each distinct word of the block once, then the documents as runs of words
        lists = word_lists(t.column("text"))
        coded = pc.dictionary_encode(lists.flatten())
        chunks, counts = cut(coded.dictionary)
        # one look-up a block, as it makes a table of all that is known
        place = pc.index_in(chunks, value_set=known)
        if place.null_count:
            raise RuntimeError("a block asks for chunks that it did not name before")
        flat, to = _picked(ids, place)
        to = to[np.concatenate([[0], np.cumsum(counts)])]
        read, read_to = _picked(raw, flat.view(np.int32))
        own, own_to = _picked(_values(flat, to), coded.indices)
        # the documents' bytes are those of their words, each word's those of its ids
        back, back_to = _picked(_values(read, read_to[to // 4]), coded.indices)
        n = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)])
        at = back_to[n]
        decoded = [zlib.crc32(back[a + (a < b) : b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        crc = [zlib.crc32(x.as_buffer() or b"") for x in t.column("text").cast(pa.binary())]
        lists = pa.ListArray.from_arrays(pa.array(own_to[n] // 4, pa.int32()), pa.array(own.view(np.int32)))
        result = pa.table({"doc_id": t.column("doc_id"), "ids": lists, "text_crc32": pa.array(crc, pa.int64()), "decoded_crc32": pa.array(decoded, pa.int64())})
        del t, known, ids, flat, read, own, back, coded, chunks, place, counts
        release()
        return result

    return run


def commonest(scratch: Scratch, rows: DataFrame, cut: Cutter, v: Vocabulary) -> pa.Table:
    """(chunk, ids) of at most FREQUENT chunks, those of most documents in a sample of one in five, or
    of about SAMPLE if that is fewer. Long ones are left out."""
    every = max(5, rows.count() // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(every)) == 0).mapInArrow(tidied(_counted(cut)), "chunk string, n long")
    some = scratch.save(some.filter(F.length("chunk") <= LONGEST_CHUNK).groupBy("chunk").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = 1 << 30, 0
    for r in sorted(some.groupBy(level.alias("level")).count().collect(), reverse=True):
        if total + r["count"] > FREQUENT:
            break
        total, least = total + r["count"], r["level"]
    return lattice(some.filter(level >= least), v).toArrow()


def shuffled(rows: DataFrame) -> bool:
    """Whether an exchange deals the rows out. Blocks follow from how rows lie in their partitions, and a partition
    behind an exchange may come back in another order when an executor is lost; files are read alike each time."""
    return "Exchange" in rows._jdf.queryExecution().executedPlan().toString()


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, ids (array of piece ids), text_crc32 (of the text's UTF-8 bytes), decoded_crc32 (of
    the bytes of the ids' pieces, without the blank that leads every text)."""
    scratch, cut = Scratch(docs.sparkSession), v.cutter()
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if shuffled(rows):
        rows = scratch.save(rows)
    got = commonest(scratch, rows, cut, v)
    frequent = got.column("chunk").combine_chunks().cast(pa.large_string())
    wanted = scratch.save(rows.mapInArrow(tidied(_wanted(cut, frequent)), "chunk string, blocks array<long>"))
    near = scratch.save(lattice(wanted.filter(F.length("chunk") <= LONGEST_CHUNK), v))
    far = wanted.filter(F.length("chunk") > LONGEST_CHUNK).select("chunk").distinct().mapInArrow(tidied(walked(v)), "chunk string, ids array<int>")
    coded = near.unionByName(scratch.save(far))
    answers = wanted.join(coded, "chunk").select(F.explode("blocks").alias("block"), "chunk", "ids")
    packed = rows.mapInArrow(tidied(_packed), "block long, blob binary")
    run = _assembled(cut, frequent, _bytes(got.column("ids")), v.hex_of)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, ids array<int>, text_crc32 long, decoded_crc32 long")


def decode(ids: Column, v: Vocabulary) -> Column:
    """The text of an array of piece ids."""
    table = F.split(F.lit(",".join(v.hex_of)), ",")
    raw = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.when(F.startswith(raw, F.lit(" ")), F.substr(raw, F.lit(2))).otherwise(raw)


def encoded(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, text_crc32, round_trip (whether the decoded ids give the text)."""
    out = encode(docs, load(model_path))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_crc32", (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))
