"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pieces by the byte-level pattern; the symbols of a piece, one a byte at first,
stand in a linked list, and a heap holds the adjacent pairs that a merge rule knows. The pair of
the lowest rank, the leftmost of equals, is popped and merged until none is left: the count is the
number of initial symbols less the number of merges. No token identifier is made.

Everything is narrow: a task counts its own texts, and remembers the counts of up to REMEMBERED
distinct pieces. Only the merge rules travel, at most MAX_MERGES of them.

Defined results: a null or empty text has no bytes and no tokens; a null doc_id stays null; rows
that repeat are counted each; a piece of any length is merged whole, in time n log n; empty tables
give no rows; extra columns are ignored. A special token of the file inside a text counts as one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, tidied

MAX_MERGES = 1 << 20
REMEMBERED = 500_000
#: Fixed value: the pattern of byte-level vocabularies that cuts texts into pieces.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of Unicode, as the pattern means it; the four separators U+001C to U+001F are none.
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


@dataclass
class Merges:
    byte_symbol: list[int]  # symbol of each byte
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray  # symbol that the merge of each rank makes
    special: list[str]
    newer: str  # letters and numbers of later Unicode versions than the library's

    def table(self) -> dict[int, tuple[int, int]]:
        """Pair of symbols, as one number, to its rank and the symbol that it makes."""
        keys = (self.left.astype(np.int64) << 32 | self.right).tolist()
        return {k: (rank, m) for rank, (k, m) in reversed(list(enumerate(zip(keys, self.made.tolist(), strict=True))))}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others
    for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def load(path: str) -> Merges:
    """The merge rules of a byte-level vocabulary file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or d["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only byte-level merge vocabularies without a prefix blank are counted")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"]):
        raise ValueError("special tokens must be plain strings")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(pairs) > MAX_MERGES:
        raise ValueError(f"{len(pairs)} merge rules; at most {MAX_MERGES} are sent to the workers")
    ids = model["vocab"]
    left, right, made = (np.array(x, np.int64) for x in zip(*[(ids[a], ids[b], ids[a + b]) for a, b in pairs], strict=True))
    return Merges([ids[c] for c in byte_letters()], left, right, made, [t["content"] for t in d["added_tokens"]], newer_letters())


def newer_letters() -> str:
    """Characters that the pattern's classes take in here, but that the library's older tables do not
    know. Only those that Python's own tables have no category for are in question."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    word = regex.compile(r"[\p{L}\p{N}]")
    late = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and word.match(c)]
    return "".join(c for c in late if len(cut("." + c)) == 1)


def merged_count(piece: bytes, symbol: list[int], rules: dict[int, tuple[int, int]]) -> int:
    """Symbols left of one piece. after and before link the living symbols; an entry of the heap is
    rank and place in one number, and is out of date where the pair at its place has another rank."""
    n = len(piece)
    if n < 2:
        return n
    own = [symbol[b] for b in piece]
    get = rules.get
    # the rank of the pair that starts at each place, -1 without one
    rank = [-1] * n
    heap = []
    for i in range(n - 1):
        rule = get(own[i] << 32 | own[i + 1])
        if rule:
            rank[i] = rule[0]
            heap.append(rule[0] << 40 | i)
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFFFF, top >> 40
        if rank[i] != r:
            continue
        j = after[i]
        own[i] = rules[own[i] << 32 | own[j]][1]
        rank[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            rule = get(own[i] << 32 | own[k])
            if rule:
                rank[i] = rule[0]
                heappush(heap, rule[0] << 40 | i)
            else:
                rank[i] = -1
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            rule = get(own[h] << 32 | own[i])
            if rule:
                rank[h] = rule[0]
                heappush(heap, rule[0] << 40 | h)
            else:
                rank[h] = -1
    return left


class _Counts(dict):
    """Piece to its count, filled on demand and emptied when it grows past its bound."""

    def __init__(self, m: Merges):
        super().__init__()
        self.symbol, self.rules = m.byte_symbol, m.table()

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = merged_count(piece.encode("utf-8", "surrogatepass"), self.symbol, self.rules)
        if len(piece) < 64:
            self[piece] = n
        return n


def piece_pattern(without: str = "") -> regex.Pattern:
    """The pattern with the white space of Unicode; characters in without are no letters or numbers."""
    out = PIECE.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
    if not without:
        return regex.compile(out)
    less = "".join(sorted(without))
    starts = [i for i, c in enumerate(less) if not i or ord(c) != ord(less[i - 1]) + 1]
    ranges = "".join(f"{less[i]}-{less[j - 1]}" for i, j in zip(starts, [*starts[1:], len(less)], strict=True))
    for c in (r"\p{L}", r"\p{N}"):
        out = out.replace(c, f"[{c}--[{ranges}]]")
    return regex.compile(out, regex.V1)


def _counted(m: Merges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, plain, rare, newer = _Counts(m), piece_pattern().findall, None, frozenset(m.newer)
        cut = regex.compile("|".join(map(regex.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
        for b in batches:
            sizes, counts = [], []
            for text in b.column("text").to_pylist():
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                find = plain
                if text and not text.isascii() and not newer.isdisjoint(text):
                    find = rare = rare or piece_pattern(m.newer).findall
                parts = cut.split(text) if text and cut else [text or ""]
                counts.append(len(parts) - 1 + sum(sum(map(of.__getitem__, find(p))) for p in parts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, m: Merges) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row of docs(doc_id, text)."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_counted(m)), "doc_id long, n_bytes long, n_tokens long")
