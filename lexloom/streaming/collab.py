"""Collaborative documents: operational transforms and the update stream.

A change list runs over a document's characters: an int skips so many, (n, text) takes n
characters out and puts text in. ``after`` rewrites changes made at the same time as others so
that they apply behind them; insertions at one place keep the earlier writer first.

The stream is one state a document: its number of updates and the updates themselves, a row each. A push at
an old version is rebased on what it has not seen, and one at an unknown version is rejected, as a row of its own."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

Change = int | tuple[int, str]


def decode(wire: list) -> list[Change]:
    """int: skip; [n, lines...]: n out, the lines joined by line feeds in."""
    return normal([c if isinstance(c, int) else (c[0], "\n".join(c[1:])) for c in wire])


def encode(changes: list[Change]) -> list:
    return [c if isinstance(c, int) else [c[0], *(c[1].split("\n") if c[1] else [])] for c in changes]


def normal(changes: list[Change]) -> list[Change]:
    """Neighbouring skips and neighbouring changes joined; empty ones dropped."""
    out: list[Change] = []
    for c in changes:
        if c == 0 or c == (0, ""):
            continue
        if out and isinstance(c, int) and isinstance(out[-1], int):
            out[-1] += c
        elif out and not isinstance(c, int) and not isinstance(out[-1], int):
            out[-1] = (out[-1][0] + c[0], out[-1][1] + c[1])
        else:
            out.append(c)
    return out


def apply(changes: list[Change], doc: str) -> str:
    out, at = [], 0
    for c in changes:
        if isinstance(c, int):
            out.append(doc[at : at + c])
            at += c
        else:
            out.append(c[1])
            at += c[0]
    return "".join([*out, doc[at:]])


def _pieces(changes: list[Change]) -> tuple[dict[int, str], list[tuple[int, int]], int]:
    """Insertions by place, deleted ranges, and the length covered."""
    puts: dict[int, str] = {}
    outs: list[tuple[int, int]] = []
    at = 0
    for c in changes:
        if isinstance(c, int):
            at += c
        else:
            if c[1]:
                puts[at] = puts.get(at, "") + c[1]
            if c[0]:
                outs.append((at, at + c[0]))
            at += c[0]
    return puts, outs, at


def after(mine: list[Change], theirs: list[Change], mine_first: bool = False) -> list[Change]:
    """``mine`` as it applies once ``theirs`` has been applied. Insertions at one place: theirs
    stand first, unless mine_first.

    Places are cut at all borders of both lists; each stretch is then kept, taken out by mine,
    or gone already."""
    puts, outs, end = _pieces(mine)
    their_puts, their_outs, their_end = _pieces(theirs)
    borders = sorted({0, end, their_end, *puts, *their_puts, *(x for r in outs + their_outs for x in r)})
    inside = lambda rs, a: any(s <= a < e for s, e in rs)
    out: list[Change] = []
    for a, b in zip(borders, [*borders[1:], None], strict=True):
        put, their = puts.get(a, ""), len(their_puts.get(a, ""))
        out += [(0, put), their] if mine_first else [their, (0, put)]
        if b is not None and not inside(their_outs, a):
            out.append((b - a, "") if inside(outs, a) else b - a)
    out = normal(out)
    return out[:-1] if out and isinstance(out[-1], int) else out


def rebase(updates: list[list[Change]], seen_since: list[list[Change]]) -> list[list[Change]]:
    """Updates made without knowing ``seen_since``, rewritten to follow it; each is rewritten against
    it as it looks after the ones before."""
    out = []
    others = [list(x) for x in seen_since]
    for u in updates:
        moved = []
        for o in others:
            moved.append(after(o, u, mine_first=True))
            u = after(u, o)
        out.append(u)
        others = moved
    return out


class Document:
    """Version and updates of one document, as kept in the stream's state."""

    def __init__(self, log: list[dict] | None = None):
        self.log = log or []

    def push(self, version: int, updates: list[dict]) -> list[dict]:
        """updates: clientID and changes on the wire; returns what was appended."""
        if not 0 <= version <= len(self.log):
            raise ValueError(f"unknown version {version}")
        since = [decode(u["changes"]) for u in self.log[version:]]
        moved = rebase([decode(u["changes"]) for u in updates], since)
        new = [{"clientID": u["clientID"], "changes": encode(c)} for u, c in zip(updates, moved, strict=True)]
        self.log += new
        return new

    def pull(self, version: int) -> list[dict]:
        return self.log[version:]

    def text(self, base: str = "") -> str:
        for u in self.log:
            base = apply(decode(u["changes"]), base)
        return base


OUT = "doc_id string, seq long, version long, client string, changes string, rejected string"
COLUMNS = ["doc_id", "seq", "version", "client", "changes", "rejected"]


def accepted(doc_id: str, doc: Document, r) -> list[tuple]:
    """Rows of one push: one an update, or one that says why it was rejected."""
    n = len(doc.log)
    try:
        new = doc.push(int(r.version), json.loads(r.updates))
    except (ValueError, TypeError, KeyError) as e:
        return [(doc_id, r.seq, None, None, None, refusal(e))]
    return [(doc_id, r.seq, n + i + 1, u["clientID"], json.dumps(u["changes"]), None) for i, u in enumerate(new)]


def refusal(e: Exception) -> str:
    return "unknown version" if "unknown version" in str(e) else "unreadable"


class Documents(StatefulProcessor):
    """One state a document: a map of its updates by version, of which a push adds its own and reads only
    those that it has not seen, and their number."""

    def init(self, handle) -> None:
        self.log = handle.getMapState("log", "version long", "client string, changes string")
        self.size = handle.getValueState("size", "n long")

    def _push(self, doc_id: str, r, n: int) -> list[tuple]:
        try:
            version, updates = int(r.version), [(u["clientID"], decode(u["changes"])) for u in json.loads(r.updates)]
            if not 0 <= version <= n:
                raise ValueError(f"unknown version {version}")
            since = [decode(json.loads((self.new.get(v) or self.log.getValue((v,)))[1])) for v in range(version + 1, n + 1)]
            moved = rebase([c for _, c in updates], since)
        except (ValueError, TypeError, KeyError) as e:
            return [(doc_id, r.seq, None, None, None, refusal(e))]
        out = []
        for (client, _), changes in zip(updates, moved, strict=True):
            n += 1
            wire = json.dumps(encode(changes))
            self.new[n] = (client, wire)
            self.log.updateValue((n,), self.new[n])
            out.append((doc_id, r.seq, n, client, wire, None))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = n = (self.size.get() or (0,))[0]
        self.new: dict[int, tuple[str, str]] = {}  # this batch's, which need not be asked of the state
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)):
            for x in self._push(key[0], r, n):
                n += x[2] is not None
                yield Row(**dict(zip(COLUMNS, x, strict=True)))
        if n > was:
            self.size.update((n,))


NULLABLE = {"seq": "Int64", "version": "Int64"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def push_stream(pushes: DataFrame) -> DataFrame:
    """A stream of pushes (doc_id, seq, version, updates as JSON) to the stream of accepted, rebased
    updates and rejected pushes, as ``push_batch`` has them. Pushes of a micro-batch go by seq, and batches as they come."""
    return pushes.groupBy("doc_id").transformWithState(Documents(), OUT, "append", "none")


def drained(stream: DataFrame, root: str) -> None:
    """Takes a push stream on over all that is there now: its rows are appended under root/out, its state and progress stand
    under root/progress, so a later call goes on where this one ended."""
    conf = stream.sparkSession.conf
    was = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # states of several variables need it; a running query keeps what it began with
    try:
        w = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
        w.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(PROVIDER, was)


def pull_from_state(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """What each reader (doc_id, reader, version) has not seen, read from the stream's state itself:
    (doc_id, version, client, changes, reader)."""
    conf = spark.conf
    was = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        state = spark.read.format("statestore").option("stateVarName", "log").load(f"{root}/progress")
    finally:
        conf.set(PROVIDER, was)
    log = state.select(F.col("key.doc_id").alias("doc_id"), F.col("user_map_key.version").alias("version"), "user_map_value.*")
    return pull(log, known)


def push_batch(pushes: DataFrame) -> DataFrame:
    """The same over a finished log of pushes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc, rows = Document(), []
        for r in frame.sort_values("seq").itertuples():
            rows += accepted(r.doc_id, doc, r)
        return pd.DataFrame(rows, columns=COLUMNS).astype(NULLABLE)

    return pushes.groupBy("doc_id").applyInPandas(run, OUT)


def pull(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """The updates that each reader (doc_id, reader, version) has not seen."""
    return accepted.join(known.withColumnRenamed("version", "known"), "doc_id").filter("version > known").drop("known")
