"""Dependency forests from syntax trees, by the pragmas of each function.

A pragma per argument says what becomes of it: head (with an optional label for the function's own
word), a label for a modifier, rel for a modifier that is labelled by its own head, skip, or
anchor: the argument hangs on the head as it is. A function without pragmas has its first
argument as head and the others as ``dep``. Leaves are words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import trees
from lexloom.functions.trees import Tree

Pragma = tuple[str, str | None]


def convert(tree: Tree, pragmas: dict[str, list[Pragma]]) -> list[tuple[int, str, int, str]]:
    """(node, fun, head, label) of the words, by pre-order number from 1; head 0 for roots."""
    words: dict[int, str] = {}
    edges: dict[int, tuple[int, str]] = {}
    number = {id(t): i for i, t in enumerate(tree.nodes(), 1)}

    def go(t: Tree) -> tuple[int | None, list[tuple[int, str]]]:
        """The head word and what still waits for one."""
        if not t.args:
            words[number[id(t)]] = t.fun
            return number[id(t)], []
        rules = pragmas.get(t.fun) or [("head", None), *[("mod", "dep")] * (len(t.args) - 1)]
        head, waiting = None, []
        for a, (kind, label) in zip(t.args, [*rules, *[("mod", "dep")] * len(t.args)], strict=False):
            if kind == "skip":
                continue
            own, more = go(a)
            waiting += more
            if kind == "head" and head is None:
                head = own
            elif own is not None:
                waiting.append((own, "rel" if kind == "rel" else "anchor" if kind == "anchor" else label or "dep"))
        if head is None and waiting:
            head = waiting.pop(0)[0]
        if head is not None:
            edges.update({w: (head, lab) for w, lab in waiting})
            waiting = []
        return head, waiting

    go(tree)
    return [(w, f, *edges.get(w, (0, "root"))) for w, f in sorted(words.items())]


MOST_FUNCTIONS = 1_000_000  # of a grammar, all of which a worker holds


def words_of(nodes: list[tuple], pragmas: dict[str, list[Pragma]]) -> list[tuple[int, str, int, str]]:
    """``convert`` over the rows of ``trees.nodes_of``, without recursion: the kind of each argument is known going down,
    its head word going up."""
    kinds: list[Pragma] = [("head", None)] * len(nodes)
    skipped = [False] * len(nodes)
    for fid, _, _, parent, pos, _ in nodes:
        if parent is not None:
            rules = pragmas.get(nodes[parent][5])
            kinds[fid] = (rules[pos] if pos < len(rules) else ("mod", "dep")) if rules else ("head", None) if pos == 0 else ("mod", "dep")
            skipped[fid] = skipped[parent] or kinds[fid][0] == "skip"
    args: list[list[tuple[int, int]]] = [[] for _ in nodes]  # (argument, its head word), the last first
    edges: dict[int, tuple[int, str]] = {}
    for fid, last, _, parent, _, _ in reversed(nodes):
        if skipped[fid]:
            continue
        word = fid
        if last > fid:
            own = args[fid][::-1]
            if not own:
                continue
            at = next((i for i, (a, _) in enumerate(own) if kinds[a][0] == "head"), 0)
            word = own[at][1]
            for i, (a, w) in enumerate(own):
                if i != at:
                    kind, label = kinds[a]
                    edges[w] = (word + 1, kind if kind in ("rel", "anchor") else label or "dep")
        if parent is not None:
            args[parent].append((fid, word))
    return [(fid + 1, fun, *edges.get(fid, (0, "root"))) for fid, last, _, _, _, fun in nodes if last == fid and not skipped[fid]]


def to_dependencies(exprs: DataFrame, key: list[str], pragmas: DataFrame, expr: str = "expr") -> DataFrame:
    """key, node, fun, head, label: the words of each expression, by pre-order number from 1, as ``convert``
    has them; an expression that can't be read has none. pragmas(fun, pragmas), a row a function: they are
    as many as a grammar has functions and go to the workers; more than MOST_FUNCTIONS are an error.
    An expression is read and turned by itself, where it lies, so nothing is sent or sorted."""
    rows = pragmas.limit(MOST_FUNCTIONS + 1).collect()
    if len(rows) > MOST_FUNCTIONS:
        raise ValueError("more functions than a grammar has")
    rules = {r.fun: [(p.kind, p.label) for p in r.pragmas] for r in rows if r.pragmas}
    return trees.read_where_they_lie(exprs, key, expr, "node int, fun string, head int, label string", lambda text: words_of(trees.nodes_of(text), rules))


def deprel_arguments(args: DataFrame, pragmas: DataFrame) -> DataFrame:
    """Pragmas zipped with the arguments by position: args(expr_id, fid, fun, pos, arg)."""
    p = pragmas.select("fun", F.posexplode("pragmas").alias("pos", "pragma"))
    return args.join(p, ["fun", "pos"])
