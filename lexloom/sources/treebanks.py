"""Treebank files as a data source for ``spark.read`` and ``spark.readStream``: plain files are cut in
ranges of bytes, compressed ones in groups of their blocks, so one large file is the work of many tasks.

    register(spark)
    spark.read.format("treebank").option("path", folder).load()
    spark.readStream.format("treebank").option("path", folder).load()

Rows are tokens: (file, sent, pos, ten columns), sent being the byte (decompressed) at which the sentence
begins, so (file, sent, pos) is a key that does not depend on how files are cut. Comments, multiword
ranges and lines without ten fields drop out, as in ``resources.conllu``; pos counts all lines of a sentence.
Options: path (a file or a folder; names that begin with . or _ are left out), split (bytes a task, 64 MB).

A sentence belongs to the range in which the blank line before it begins; the beginning of a file counts
as one. A reader skips to the first line that begins inside its range and reads past the end to close its
last sentence. A compressed file with one block only, as xz writes without -T, is one task.

A stream takes every file of the folder once, however late it arrives and whatever its date; files are
whole when they appear (moved in place). Its offset names the folder's files, so a folder of more than
``MOST_FILES`` is an error; files that are done may be moved away."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
SCHEMA = "file string, sent long, pos int, " + ", ".join(f"{c} string" for c in FIELDS)
ARROW = pa.schema([("file", pa.string()), ("sent", pa.int64()), ("pos", pa.int32()), *((c, pa.string()) for c in FIELDS)])
SPLIT, STEP, ROWS, MOST_FILES = 64 << 20, 1 << 20, 10_000, 100_000
XZ = b"\xfd7zXZ\x00"


@dataclass(frozen=True)
class Block:
    """Where a compressed block lies: the flags of its stream, its first byte, its length with padding, and
    the decompressed byte at which it begins."""

    flags: bytes
    at: int
    length: int
    start: int


@dataclass
class Range(InputPartition):
    """Bytes first to last (decompressed) of a file, and the blocks that hold them, if it is compressed."""

    file: str
    first: int
    last: int
    blocks: tuple[Block, ...] | None = None


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def xz_blocks(f, size: int) -> tuple[list[Block], int]:
    """The blocks of all streams of a file and its decompressed length, from the indexes at the streams' ends."""
    streams, end = [], size
    while end > 0:
        f.seek(end - 12)
        foot = f.read(12)
        if foot[-4:] == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        if foot[-2:] != b"YZ" or zlib.crc32(foot[4:10]) != int.from_bytes(foot[:4], "little"):
            raise ValueError("no whole xz file")
        length = (int.from_bytes(foot[4:8], "little") + 1) * 4
        f.seek(end - 12 - length)
        index = f.read(length)
        if zlib.crc32(index[:-4]) != int.from_bytes(index[-4:], "little"):
            raise ValueError("the index of an xz file is damaged")
        n, at = _varint(index, 1)
        sizes = []
        for _ in range(n):
            packed, at = _varint(index, at)
            plain, at = _varint(index, at)
            sizes.append((-(-packed // 4) * 4, plain))
        end -= 12 + length + sum(p for p, _ in sizes) + 12
        streams.append((foot[8:10], end + 12, sizes))
    blocks, start = [], 0
    for flags, at, sizes in reversed(streams):
        for length, plain in sizes:
            blocks.append(Block(flags, at, length, start))
            at, start = at + length, start + plain
    return blocks, start


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Spark writes local addresses with one slash."""
    return pafs.FileSystem.from_uri("file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path)


def _opened(path: str):
    fs, p = _system(path)
    return fs.open_input_file(p)


def _files(path: str) -> list[str]:
    """The files behind a path, in the order of their names."""
    path = path.rstrip("/")
    fs, p = _system(path)
    head = path[: len(path) - len(p)] if path.endswith(p) else ""
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(p)) if info.type == pafs.FileType.Directory else [info]
    return sorted(head + i.path for i in found if i.type == pafs.FileType.File and i.size and i.base_name[0] not in "._")


def _ranges(file: str, split: int) -> Iterator[Range]:
    with _opened(file) as f:
        size = f.size()
        if f.read(len(XZ)) != XZ:
            for at in range(0, size, split):
                yield Range(file, at, min(at + split, size))
            return
        blocks, total = xz_blocks(f, size)
    at = 0
    while at < len(blocks):
        to = at + 1
        while to < len(blocks) and blocks[to].start - blocks[at].start < split:
            to += 1
        yield Range(file, blocks[at].start, blocks[to].start if to < len(blocks) else total, tuple(blocks[at:to]))
        at = to


def _onwards(r: Range, f) -> Iterator[Block]:
    """The range's blocks, then those behind them, for which the index is read only if they are asked for."""
    yield from r.blocks
    yield from (b for b in xz_blocks(f, f.size())[0] if b.start >= r.last)


def _bytes(r: Range) -> Iterator[bytes]:
    """The file from the range's first byte on, a step at a time."""
    with _opened(r.file) as f:
        if r.blocks is None:
            f.seek(r.first)
            while part := f.read(STEP):
                yield part
            return
        for b in _onwards(r, f):
            d = lzma.LZMADecompressor(lzma.FORMAT_XZ)
            d.decompress(XZ + b.flags + zlib.crc32(b.flags).to_bytes(4, "little"))
            f.seek(b.at)
            left = b.length
            while left or not d.needs_input:
                packed = f.read(min(STEP, left)) if d.needs_input else b""
                left -= len(packed)
                if part := d.decompress(packed, STEP):
                    yield part


def _lines(r: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) from the range's first byte on; where that is inside a line, its rest comes first."""
    rest, at = [], r.first
    for part in _bytes(r):
        *whole, tail = part.split(b"\n")
        for line in whole:
            line = b"".join([*rest, line]) if rest else line
            rest = []
            yield at, line
            at += len(line) + 1
        if tail:
            rest.append(tail)
    if rest:
        yield at, b"".join(rest)


def sentences(r: Range) -> Iterator[tuple[int, list[bytes]]]:
    """(first byte, lines) of the sentences of a range. A line that begins at the very border counts to the range
    before, as its reader cannot tell whether the byte before it ends a line."""
    lines, mine = _lines(r), r.first == 0
    if not mine:
        next(lines, None)
    start, held = 0, []
    for at, line in lines:
        line = line.removesuffix(b"\r")
        if line.strip():
            if mine:
                start = start if held else at
                held.append(line)
            continue
        if held:
            yield start, held
            held = []
        if at > r.last:
            return
        mine = True
    if held:
        yield start, held


def tokens(r: Range) -> Iterator[pa.RecordBatch]:
    cols: list[list] = [[] for _ in ARROW.names]
    for sent, lines in sentences(r):
        for pos, line in enumerate(lines):
            f = line.decode("utf-8", "replace").split("\t")
            if len(f) == len(FIELDS) and f[0].isascii() and f[0].isdigit():
                for c, v in zip(cols, (r.file, sent, pos, *f), strict=True):
                    c.append(v)
        if len(cols[0]) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW.types, strict=True)], schema=ARROW)
            cols = [[] for _ in ARROW.names]
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW.types, strict=True)], schema=ARROW)


class _Folder:
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the treebank source needs a path")
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        if self.split < 1:
            raise ValueError("split must be positive")

    def cut(self, files: list[str]) -> list[Range]:
        return [r for f in files for r in _ranges(f, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return tokens(partition)


class TreebankReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.cut(_files(self.path))


class TreebankStream(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        if len(files) > MOST_FILES:
            raise ValueError(f"the folder holds {len(files)} files, more than {MOST_FILES}")
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        done = set(start["files"])
        return self.cut([f for f in end["files"] if f not in done])

    def commit(self, end: dict) -> None:
        pass


class Treebank(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treebank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreebankReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreebankStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Treebank)
