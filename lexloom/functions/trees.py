"""Abstract syntax trees as text: parsing, printing, numbering, functions, subtrees.

Tables of trees are made where the expressions lie: a worker reads each by itself, in one pass over its tokens, so
nothing is sent or sorted. Quoted text is one token, whatever it holds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

_TOKEN = re.compile(r"""\s*(?:(\()|(\))|("(?:\\.|[^"\\])*")|(\?\d*)|(\\[^>]*->)|([^\s()"]+))""")


@dataclass(frozen=True)
class Tree:
    fun: str
    args: tuple[Tree, ...] = ()

    def __str__(self) -> str:
        return " ".join([self.fun, *(f"({a})" if a.args else str(a) for a in self.args)])

    def nodes(self) -> Iterator[Tree]:
        """In pre-order; the place is the node's id."""
        todo = [self]
        while todo:
            t = todo.pop()
            yield t
            todo += reversed(t.args)


def parse(text: str) -> Tree:
    """Application by juxtaposition, brackets, string and number literals, metavariables, lambdas."""
    stack: list[list[Tree]] = [[]]
    at = 0
    text = text.strip()

    def close(parts: list[Tree]) -> Tree:
        if not parts:
            raise ValueError("empty expression")
        head, rest = parts[0], tuple(parts[1:])
        return Tree(head.fun, head.args + rest) if rest else head

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unreadable at {at}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) < 2:
                raise ValueError("unbalanced brackets")
            t = close(stack.pop())
            stack[-1].append(t)
        else:
            stack[-1].append(Tree(m[0].strip()))
    if len(stack) != 1:
        raise ValueError("unbalanced brackets")
    return close(stack[0])


def functions(expr: Column) -> Column:
    """All function names of an expression, in order and with repetitions; literals,
    metavariables and lambdas are none."""
    bare = F.regexp_replace(F.regexp_replace(expr, r'"(\\.|[^"\\])*"', " "), r"\\[^>]*->", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"[^\s()]+"), F.lit(0)), lambda x: ~x.rlike(r"^(\?\d*|-?\d+(\.\d+)?)$"))


# the same tokens for Java; possessive repetitions, as others recurse
_QUOTED = r'"(?:\\.|[^"\\]++)*+"'
_TOKENS = rf'[()]|{_QUOTED}|\?\d*+|\\[^>]*->|[^\s()"]++'


# for Python: a dot that stops at all of Java's ends of lines
_WORD = re.compile(_TOKENS.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]"), re.ASCII)
NODE = "fid int, last int, level int, parent int, pos int, fun string"


def nodes_of(text: str) -> list[tuple[int, int, int, int | None, int, str]]:
    """(fid, last, level, parent, pos, fun) of an expression's nodes in pre-order, in one pass over its tokens; none if it
    can't be read. A bracket that opens in the place of a head belongs to the expression around it."""
    funs: list[str] = []
    last: list[int] = []
    place: list[tuple[int, int | None, int]] = []
    args: list[int] = []
    heads: list[int | None] = [None]  # the functions of the brackets that are open
    flat: list[bool] = []
    first, at = True, 0
    for m in _WORD.finditer(text):
        if text[at : m.start()].strip(" \t\n\x0b\f\r"):
            return []
        at, tok = m.end(), m[0]
        if tok == "(":
            flat.append(first)
            if not first:
                heads.append(None)
            first = True
        elif tok == ")":
            if first or not flat:
                return []
            if not flat.pop():
                last[heads.pop()] = len(funs) - 1
        else:
            up = (heads[-2] if len(heads) > 1 else None) if first else heads[-1]
            n = len(funs)
            place.append((len(heads) - first, up, args[up] if up is not None else 0))
            if up is not None:
                args[up] += 1
            if first:
                heads[-1] = n
            funs.append(tok)
            last.append(n)
            args.append(0)
        first = tok == "("
    if flat or not funs or text[at:].strip(" \t\n\x0b\f\r"):
        return []
    last[heads[0]] = len(funs) - 1
    return [(n, last[n], *place[n], funs[n]) for n in range(len(funs))]


def node_table(exprs: DataFrame, key: list[str], expr: str = "expr") -> DataFrame:
    """key, fid (number in pre-order), last (that of the last node below), level, parent, pos (among its
    arguments), fun: a row a node of each expression; what can't be read has none. key tells expressions apart.
    An expression is read by itself, where it lies: nothing is sent or sorted."""
    return read_where_they_lie(exprs, key, expr, NODE, nodes_of)


def read_where_they_lie(exprs: DataFrame, key: list[str], expr: str, schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """key and the rows that ``read`` makes of each expression."""
    rows = exprs.select(*key, F.col(expr).cast("string").alias("expr_"))
    own = StructType.fromDDL(schema)
    out = StructType([rows.schema[k] for k in key] + list(own))
    types = [pa.int32() if isinstance(f.dataType, IntegerType) else pa.string() for f in own]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                found = [read(x) if x is not None else [] for x in batch.column(batch.num_columns - 1).to_pylist()]
                at = pa.array([i for i, got in enumerate(found) for _ in got], pa.int64())
                flat = list(zip(*(n for got in found for n in got), strict=True)) or [()] * len(types)
                cols = [pa.array(c, t) for c, t in zip(flat, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(len(key))] + cols, names=out.names)

    return rows.mapInArrow(made, out)


def _printed(nodes: list[tuple], at: int) -> str | None:
    """The subtree at a number in plain brackets."""
    if not 0 <= at < len(nodes):
        return None
    to, top = nodes[at][1], nodes[at][2]
    out = []
    for n, last, level, _, _, fun in nodes[at : to + 1]:
        ends = max(level - nodes[n + 1][2], 0) if n < to else max(level - top - 1, 0)
        out.append(("(" if last > n > at else "") + fun + ")" * ends)
    return " ".join(out)


def subexpressions(exprs: DataFrame, key: list[str], wanted: DataFrame, expr: str = "expr") -> DataFrame:
    """wanted(key, fid) with sub, the subtree at that pre-order number in plain brackets; null without one.
    The numbers wanted of an expression meet it as one row, and only their subtrees are written."""
    asked = wanted.groupBy(*key).agg(F.collect_list(F.struct(*(c for c in wanted.columns if c not in key))).alias("asked_"))
    j = asked.join(exprs.select(*key, F.col(expr).cast("string").alias("expr_")), key, "left")

    @F.pandas_udf("array<string>")
    def written(texts: pd.Series, fids: pd.Series) -> pd.Series:
        read = (nodes_of(x) if x is not None else [] for x in texts)
        return pd.Series([[_printed(nodes, n) if n is not None else None for n in map(_whole, ns)] for nodes, ns in zip(read, fids, strict=True)])

    j = j.withColumn("subs_", written("expr_", F.transform("asked_", lambda x: x["fid"].cast("long"))))
    rows = j.select(*key, F.explode(F.arrays_zip("asked_", "subs_")).alias("x_"))
    return rows.select(*(F.col(c) if c in key else F.col("x_.asked_")[c].alias(c) for c in wanted.columns), F.col("x_.subs_").alias("sub"))


def _whole(x) -> int | None:
    return None if x is None or x != x else int(x)


def _stopped(segments: Column, opening: str, closing: str, stop: str, strict: bool) -> Column:
    """How many segments stand before the first ``stop`` outside brackets; null where none is in place.
    strict: brackets must close, and the end of the text stops too."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("at"), F.lit(False).alias("bad"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x.isin(*opening), 1).when(x.isin(*closing), -1).otherwise(0)
        bad = a["bad"] | (x == '"') | (F.lit(strict) & (depth < 0))
        over = F.lit(strict) & (a["depth"] == 0) | F.lit(not strict) & (a["depth"] <= 0)
        next_ = F.struct(depth.alias("depth"), (a["i"] + 1).alias("i"), F.when((x == stop) & over, a["i"]).otherwise(F.lit(-1)).alias("at"), bad.alias("bad"))
        return F.when((a["at"] >= 0) | a["bad"], a).otherwise(next_)

    def end(a: Column) -> Column:
        at_end = F.when(F.lit(strict) & (a["depth"] == 0), a["i"])
        return F.when(~a["bad"], F.when(a["at"] >= 0, a["at"]).otherwise(at_end))

    return F.aggregate(segments, start, step, end)


def cut(block: Column) -> Column:
    """The first balanced expression behind ``abs`` in an edited block of several lines; null if
    unbalanced. It ends before a line that names a field, or at the end."""
    begin, mark = r"(?s)(?:^|\n)abs[:*^]\s*(.*)$", "\ue000"
    body = F.regexp_replace(F.translate(F.regexp_extract(block, begin, 1), mark, ""), r"\n(?=\s*(?:\w+:|\z))", mark)
    segments = F.regexp_extract_all(body, F.lit(rf'{_QUOTED}|[()]|{mark}|[^"(){mark}]++|"'), F.lit(0))
    text = F.array_join(F.slice(segments, F.lit(1), _stopped(segments, "(", ")", mark, True)), "")
    return F.when(block.rlike(begin), F.trim(F.regexp_replace(text, rf"[\s{mark}]+", " ")))


def definitions(source: Column, fun: Column) -> Column:
    """The right side of ``lin fun = ... ;`` up to the semicolon outside brackets and strings. As the
    line must follow a line feed, the first line of a file never matches."""
    begin = F.concat(F.lit("\nlin "), fun, F.lit(" ="))
    at = F.call_function("locate", begin, source)
    rest = F.when((at > 0) & (fun != ""), F.regexp_replace(F.substr(source, at + F.length(begin)), r"^\s+", ""))
    segments = F.regexp_extract_all(rest, F.lit(rf'{_QUOTED}|[()\[\]{{}};]|[^"()\[\]{{}};]++|"'), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(segments, F.lit(1), _stopped(segments, "([{", ")]}", ";", False)), ""), r"\s+$", "")
