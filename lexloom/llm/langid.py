"""Language ID: interpolated Kneser-Ney character models, one a language.

Counts of character 4-grams inside words (a blank marks both ends) are gathered from every
training document. The lower orders hold Kneser-Ney continuation counts. All languages share
sorted hash arrays, one for each order, with a column of log-probabilities a language. A
document goes to the language with the lowest cross-entropy a symbol.

Rejection is calibrated on held-out training documents, one in FOLD by a hash of the text: a model
of the others measures their excess e = cross-entropy / mu - 1 over what its language costs on the
training counts. What longer texts spread by is kappa, and u = e / (kappa + 1 / sqrt(n)) compares
texts of any length n. The tail of u, taken as exponential, is followed to odds of ODDS; beyond that
even the best language is rejected. The final model learns from all training documents.

Every distinct 4-gram of each language is kept with its count, as two numbers of 42 bits. The driver
builds the arrays and each worker holds them, so both need memory in proportion to the distinct grams.

Defined results: a null text, or one without a letter (of a Unicode letter category), gets ``und``
with score 0, and so does everything when nothing can be learned; with no held-out text nothing with
letters is rejected; ties go to the first language by name; rows with null lang teach nothing;
repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, mix64, tidied

ORDER = 4
FOLD, ODDS = 8, 1e-6
CACHE = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def letters(token: str) -> str:
    """The token's runs of letters in lower case, each with a blank behind; '' without letters."""
    runs = _LETTERS.findall(token.lower())
    if not all(map(str.isalpha, runs)):  # \w also has numerals that are no digits, such as a half
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return "".join(f"{w} " for w in runs)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the cleaned tokens, led by blanks: code points, where each predicted symbol
    stands, and the token that it belongs to."""
    pad = " " * (ORDER - 1)
    text = pad + pad.join(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    return points, at, owner


def clean_context(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ORDER code points ending at ``at``; what stands before a blank counts as blanks."""
    rows = np.stack([points[at - k] for k in range(ORDER - 1, -1, -1)], axis=1)
    for k in range(ORDER - 2, 0, -1):  # a blank inside the context hides what is before it
        rows[:, :k][rows[:, k] == 32] = 32
    return rows


def hashes(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), np.uint64(rows.shape[1]))
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            h = mix64(h * _P + rows[:, k].astype(np.uint64))
    return h


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, held, hi, lo, n): counts of 4-grams, two code points in each of hi and lo."""
    seen: dict[tuple[str, bool], Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, held), tokens in seen.items():
            cleaned = [(letters(t), n) for t, n in tokens.items()]
            cleaned = [x for x in cleaned if x[0]]
            for i in range(0, len(cleaned), 100_000):
                part = cleaned[i : i + 100_000]
                points, at, owner = codes([w for w, _ in part])
                rows = clean_context(points, at)
                weight = np.array([n for _, n in part], np.int64)[owner]
                _, first, back = np.unique(hashes(rows), return_index=True, return_inverse=True)
                n = np.bincount(back, weights=weight).astype(np.int64)
                rows = rows[first].astype(np.int64)
                cols = [pa.array([lang] * len(n)), pa.array([held] * len(n)), *(pa.array(rows[:, k] << 21 | rows[:, k + 1]) for k in (0, 2)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "held", "hi", "lo", "n"])
        seen.clear()

    for b in batches:
        for lang, held, text in zip(*(b.column(c).to_pylist() for c in ("lang", "held", "text")), strict=True):
            tokens = seen.setdefault((lang, held), Counter())
            size -= len(tokens)
            tokens.update(text.split())
            size += len(tokens)
            if size > CACHE:
                yield from flush()
                size = 0
    yield from flush()


@dataclass
class Model:
    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # of each order: sorted hashes, probabilities a language (discounted part)
    back: list[tuple[np.ndarray, np.ndarray]]  # of each history length: sorted hashes, weight of the lower order a language
    full: tuple[np.ndarray, np.ndarray]  # sorted hashes of the highest order, cost in nats a language
    uniform: float
    mu: np.ndarray  # mean cost of a symbol in the language's own counts
    kappa: float = 0.0
    limit: float = math.inf  # largest u that is accepted

    def _find(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        return i, (keys[i] == h) if len(keys) else np.zeros(len(h), bool)

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """Interpolated probability of each row's last symbol in each language."""
        p = np.full((len(rows), len(self.langs)), self.uniform)
        for k in range(1, ORDER + 1):
            own, weight = np.zeros_like(p), np.ones_like(p)
            i, ok = self._find(self.grams[k - 1][0], hashes(rows[:, ORDER - k :]))
            own[ok] = self.grams[k - 1][1][i[ok]]
            i, ok = self._find(self.back[k - 1][0], hashes(rows[:, ORDER - k : ORDER - 1]))
            weight[ok] = self.back[k - 1][1][i[ok]]
            p = own + weight * p
        return p

    def cost(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats in each language, and symbols, of each cleaned token."""
        points, at, owner = codes(words)
        rows = clean_context(points, at)
        i, ok = self._find(self.full[0], hashes(rows))
        c = np.empty((len(rows), len(self.langs)))
        c[ok] = self.full[1][i[ok]]
        if not ok.all():
            c[~ok] = -np.log(self.chance(rows[~ok]))
        return np.stack([np.bincount(owner, c[:, j], len(words)) for j in range(c.shape[1])], axis=1), np.bincount(owner, minlength=len(words))


def build(langs: list[str], lang_of: np.ndarray, rows: np.ndarray, n: np.ndarray) -> Model | None:
    """Kneser-Ney tables from counts n of rows of ORDER code points, each with its language's index."""
    if not len(n):
        return None
    uniform = 1.0 / (len(np.unique(rows[:, -1])) + 1)

    def wide(keys: np.ndarray, lang: np.ndarray, value: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray]:
        u, i = np.unique(keys, return_inverse=True)
        m = np.full((len(u), len(langs)), empty)
        m[i, lang] = value
        return u, m

    grams, back = [], []
    level_rows, level_lang, level_n = rows, lang_of, n
    for k in range(ORDER, 0, -1):
        own, hist = hashes(level_rows), hashes(level_rows[:, :-1])
        frame = pd.DataFrame({"lang": level_lang, "hist": hist, "n": level_n})
        ones = frame.groupby("lang")["n"].agg(n1=lambda x: (x == 1).sum(), n2=lambda x: (x == 2).sum())
        discount = ((ones["n1"] + 0.5) / (ones["n1"] + 2 * ones["n2"] + 1)).clip(0.1, 0.9)
        total = frame.groupby(["lang", "hist"])["n"].agg(["sum", "size"]).reset_index()
        d = frame["lang"].map(discount).to_numpy()
        tot = frame.merge(total, on=["lang", "hist"], how="left")["sum"].to_numpy()
        grams.insert(0, wide(own, level_lang, np.maximum(level_n - d, 0) / tot, 0.0))
        weight = total["lang"].map(discount).to_numpy() * total["size"].to_numpy() / total["sum"].to_numpy()
        back.insert(0, wide(total["hist"].to_numpy(), total["lang"].to_numpy(), weight, 1.0))
        if k > 1:  # continuation counts: in how many distinct contexts the shorter gram was seen
            short = level_rows[:, 1:]
            f = pd.DataFrame({"lang": level_lang, "h": hashes(short), "i": np.arange(len(short))})
            g = f.groupby(["lang", "h"])["i"].agg(["first", "size"]).reset_index()
            level_rows, level_lang, level_n = short[g["first"].to_numpy()], g["lang"].to_numpy(), g["size"].to_numpy(np.float64)
    model = Model(langs, grams, back, (np.empty(0, np.uint64), np.empty((0, len(langs)))), uniform, np.zeros(len(langs)))
    keys, first = np.unique(hashes(rows), return_index=True)
    costs = -np.log(model.chance(rows[first]))
    model.full = (keys, costs)
    each = costs[np.searchsorted(keys, hashes(rows)), lang_of]
    for j in range(len(langs)):
        w = np.where(lang_of == j, n, 0)
        model.mu[j] = (w * each).sum() / w.sum() if w.any() else np.inf
    return model


def tail(e: np.ndarray, n: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """kappa and limit from excesses e of texts of n symbols, each seen count times."""

    def quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
        order = np.argsort(x)
        return float(x[order][np.searchsorted(np.cumsum(w[order]), q * w.sum())])

    long = n >= quantile(n, count, 0.5)
    kappa = max(0.01, (quantile(e[long], count[long], 0.75) - quantile(e[long], count[long], 0.25)) / 1.349)
    u = e / (kappa + 1 / np.sqrt(n))
    p = max(1 / (count.sum() + 1), 1e-3)
    middle = quantile(u, count, 0.5)
    return kappa, middle + (quantile(u, count, 1 - p) - middle) * math.log(ODDS) / math.log(p)


def _excess(model: Model):
    """(n, e, count) of texts, n in quarters of its binary logarithm and e in hundredths, so few distinct rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, bins = Costs(model), Counter()
        for b in _parts(batches):
            ce, n = costs(b.column("text").to_pylist())
            ce, n = ce[n > 0], n[n > 0]
            best = ce.argmin(axis=1)
            e = ce[np.arange(len(n)), best] / model.mu[best] - 1
            bins.update(zip(np.round(4 * np.log2(n)).astype(int).tolist(), np.ceil(100 * e).astype(int).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in bins], pa.int64()) for i in (0, 1)] + [pa.array(list(bins.values()), pa.int64())], names=["n", "e", "count"])

    return run


def fit(docs: DataFrame, training: Column) -> Model | None:
    """A model of every training document's text, its rejection calibrated."""
    rows = bounded_batches(docs).filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(FOLD)) == 0)
    counts = rows.mapInArrow(tidied(_counts), "lang string, held boolean, hi long, lo long, n long").groupBy("lang", "held", "hi", "lo").agg(F.sum("n").alias("n"))
    t = counts.toArrow()
    if not t.num_rows:
        return None
    coded = t.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    lang_of = np.array([langs.index(x) for x in names])[coded.indices.to_numpy()]
    held, hi, lo, n = (t.column(c).to_numpy() for c in ("held", "hi", "lo", "n"))
    grams = np.stack([hi >> 21, hi & 0x1FFFFF, lo >> 21, lo & 0x1FFFFF], axis=1).astype(np.uint32)
    del t, hi, lo
    order = np.lexsort((held, hashes(grams), lang_of))  # one order whatever the partitions gave
    lang_of, held, grams, n = lang_of[order], held[order], grams[order], n[order].astype(np.float64)
    known = sorted({*lang_of[~held].tolist()})
    part = build([langs[i] for i in known], np.searchsorted(known, lang_of[~held]), grams[~held], n[~held])
    new = np.append(True, (lang_of[1:] != lang_of[:-1]) | (grams[1:] != grams[:-1]).any(axis=1))
    model = build(langs, lang_of[new], grams[new], np.add.reduceat(n, np.flatnonzero(new)))
    if part:
        bins = rows.filter("held").select("text").mapInArrow(tidied(_excess(part)), "n long, e long, count long")
        got = bins.groupBy("n", "e").agg(F.sum("count").alias("count")).toArrow()
        if got.num_rows:
            k, e, count = (got.column(c).to_numpy() for c in ("n", "e", "count"))
            model.kappa, model.limit = tail(e / 100, 2.0 ** (k / 4), count)
    return model


class Costs:
    """Cross-entropies of texts; the costs of tokens are kept, up to CACHE of them and a batch's."""

    def __init__(self, model: Model | None):
        self.model, self.size = model, len(model.langs) if model else 0
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, self.size + 1))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol in each language (rows: texts), and the symbols of each text."""
        docs = [(t or "").split() for t in texts]
        if len(self.place) > CACHE:
            self.place, self.table = {}, self.table[:0]
        new = list({t for d in docs for t in d if t not in self.place})
        if new:
            words = [letters(t) for t in new]
            cost = np.zeros((len(new), self.size + 1))
            has = [i for i, w in enumerate(words) if w]
            if has and self.model:
                cost[has, : self.size], cost[has, self.size] = self.model.cost([words[i] for i in has])
            elif has:
                cost[has, self.size] = [len(words[i]) for i in has]
            self.place.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, cost])
        total = np.zeros((len(docs), self.size + 1))
        for i, d in enumerate(docs):
            total[i] = self.table[np.fromiter(map(self.place.__getitem__, d), np.int64, len(d))].sum(axis=0)
        n = total[:, self.size]
        return total[:, : self.size] / np.maximum(n, 1)[:, None], n


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)


def _predict(model: Model | None, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(model)
        for b in _parts(batches):
            pred, score, entropy, ok = [], [], [], []
            for ce, n in zip(*costs(b.column("text").to_pylist()), strict=True):
                if not n or not model:
                    pred.append("und"), score.append(0.0), entropy.append(None), ok.append(False)
                    continue
                j = int(ce.argmin())
                # neighbouring symbols say the same in part: evidence grows with the root of the length
                odds = np.exp(-(ce - ce[j]) * 4 * math.sqrt(n))
                pred.append(model.langs[j]), score.append(float(1 / odds.sum())), entropy.append(float(ce[j]))
                ok.append(bool(ce[j] / model.mu[j] - 1 <= model.limit * (model.kappa + 1 / math.sqrt(n))))
            cols = [*(b.column(c) for c in carry), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*carry, "lang_pred", "score", "cross_entropy", "accepted"])

    return run


_SCHEMA = "lang_pred string, score double, cross_entropy double, accepted boolean"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a symbol, null for ``und``), accepted."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_predict(model, ["doc_id"])), f"doc_id long, {_SCHEMA}")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are not rejected, with the language found as their lang."""
    types = {"doc_id": "long", "text": "string", "source": "string", "n_chars": "long"}
    rows = bounded_batches(docs).select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))
    out = rows.mapInArrow(tidied(_predict(model, list(types))), ", ".join(f"{c} {t}" for c, t in types.items()) + f", {_SCHEMA}")
    return out.filter("accepted").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")
