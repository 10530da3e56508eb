"""Personal data: pattern rules, and a character-level bidirectional LSTM with CRF transitions.

The rules give the base spans (email, ip, card, phone) and always stay. The tagger is trained in
numpy from labelled spans that are written by rule from a fixed seed, and adds spans that the
rules miss: national telephone numbers, spelled-out or spaced addresses, other separators.

The tagger reads windows of WIN characters that start at every HOP-th character of the whole text;
each character takes its tag from the window where it stands furthest from an edge. A tagged span
is added if it touches no base span, is at most LONGEST characters long, and keeps to what its kind
allows (``plausible``): numbers of digits, signs, checksums. All that is allowed holds a digit, an
at sign or a spelled-out one, so windows whose characters lie further than LONGEST from any such
place cannot change the result; they are not decoded, and a test holds this against decoding all.

Defined results: a null text counts as empty and has no spans; equal spans of different kinds
are listed in the order of KINDS; a null doc_id stays null; repeated rows count each; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, tidied

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WIN, HOP, LONGEST = 128, 64, 64
TRAIN_WIN = 64
EMBED, HIDDEN = 10, 24
ALPHABET = 100

# The base patterns. The lookbehinds only skip starts that can't match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TRIGGER = re.compile(r"[0-9@]+|[\[({]\s?at\s?[\])}]|\bdot\b", re.I)
_AT = re.compile(r"\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s?@\s?", re.I)
_DOT = re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s+dot\s+|\s\.\s", re.I)
_SPELLED = re.compile(r"\s+at\s+", re.I)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9-]{2,}(?:\.[A-Za-z0-9-]{2,})+")
_FOUR = re.compile(r"([0-9]{1,3})(\.|-|_| |\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s+dot\s+|\s?\.\s?)([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})", re.I)
_GROUPS = re.compile(r"[0-9]+(?:[ ./_-]{1,2}[0-9]+)+")
_DIAL = re.compile(r"(?:\+|00?|\()[0-9]+\)?(?:[ ./-]{0,2}\(?[0-9]+\)?)+|(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rules, by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def char_ids(text: str) -> np.ndarray:
    """0: padding; then printable ASCII, other blanks, other letters, the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 31, np.where(points < 32, 97, np.where(points < 0x2000, 98, 99)))


class Tagger:
    """Emissions from two LSTMs, scored as a linear-chain CRF."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.p = {"E": g(ALPHABET, EMBED), "out": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "T": g(TAGS, TAGS) * 0.1}
        for d in "fb":
            self.p |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        # an inside tag only follows its own kind
        self.bar = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            self.bar[:, 2 + 2 * k] = -1e4
            self.bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.first = np.where(np.isin(np.arange(TAGS), [2 + 2 * k for k in range(len(KINDS))]), -1e4, 0).astype(np.float32)

    def _run(self, x: np.ndarray, d: str, trace: list | None) -> np.ndarray:
        """x: (steps, rows, EMBED), already in reading order."""
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        H = HIDDEN
        for t in range(len(x)):
            a = z[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * H], -30, 30)))
            g = np.tanh(a[:, 3 * H :])
            was, c = c, s[:, H : 2 * H] * c + s[:, :H] * g
            th = np.tanh(c)
            if trace is not None:
                trace.append((s, g, was, th, h))
            h = s[:, 2 * H :] * th
            out[t] = h
        return out

    def emit(self, ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """(rows, steps) to (steps, rows, TAGS)."""
        x = self.p["E"][ids.T]
        tf, tb = ([], []) if trace is not None else (None, None)
        h = np.concatenate([self._run(x, "f", tf), self._run(x[::-1], "b", tb)[::-1]], axis=2)
        if trace is not None:
            trace.update(x=x, f=tf, b=tb, h=h)
        return h @ self.p["out"] + self.p["ob"]

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradient."""
        tr: dict = {}
        e = self.emit(ids, tr)
        steps, rows, _ = e.shape
        y = tags.T
        trans = self.p["T"] + self.bar
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.first
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        logz = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - logz[None, :, None])
        at = np.arange(rows)
        gold = sum(e[t, at, y[t]] for t in range(steps)) + self.first[y[0]] + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        dT = np.zeros_like(self.p["T"])
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - logz[:, None, None])
            dT += pair.sum(0)
            np.add.at(dT, (y[t - 1], y[t]), -1)
        for t in range(steps):
            de[t, at, y[t]] -= 1
        de = (de / rows).astype(np.float32)
        g = {"T": dT / rows, "out": np.einsum("tri,trj->ij", tr["h"], de), "ob": de.sum((0, 1))}
        dh = de @ self.p["out"].T
        dx = np.zeros_like(tr["x"])
        H = HIDDEN
        for d, part in (("f", dh[:, :, :H]), ("b", dh[::-1, :, H:])):
            x = tr["x"] if d == "f" else tr["x"][::-1]
            dz = np.empty((steps, rows, 4 * H), np.float32)
            nh, nc = np.zeros((rows, H), np.float32), np.zeros((rows, H), np.float32)
            gw = np.zeros_like(self.p[f"h{d}"])
            for t in range(steps - 1, -1, -1):
                s, gg, was, th, hp = tr[d][t]
                a = part[t] + nh
                i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
                c = nc + a * o * (1 - th * th)
                dz[t] = np.concatenate([c * gg * i * (1 - i), c * was * f * (1 - f), a * th * o * (1 - o), c * i * (1 - gg * gg)], axis=1)
                nc, nh = c * f, dz[t] @ self.p[f"h{d}"].T
                gw += hp.T @ dz[t]
            g |= {f"h{d}": gw, f"x{d}": np.einsum("tri,trj->ij", x, dz), f"c{d}": dz.sum((0, 1))}
            back = dz @ self.p[f"x{d}"].T
            dx += back if d == "f" else back[::-1]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T, dx)
        return float((logz - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02) -> float:
        r = np.random.default_rng(5)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for n in range(1, steps + 1):
            pick = r.integers(0, len(ids), batch)
            loss, g = self.gradient(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, n / 20) * (1 - n / (steps + 1))
            for k in self.p:
                x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        return loss

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """As ``emit``, for decoding: what a character brings to the gates is looked up."""
        H = HIDDEN
        half = np.r_[np.full(3 * H, 0.5, np.float32), np.ones(H, np.float32)]  # a sigmoid is a tanh of half its input
        out = np.broadcast_to(self.p["ob"], (ids.shape[1], len(ids), TAGS)).astype(np.float32)
        for d, order in (("f", range(ids.shape[1])), ("b", range(ids.shape[1] - 1, -1, -1))):
            table, w = (self.p["E"] @ self.p[f"x{d}"] + self.p[f"c{d}"]) * half, self.p[f"h{d}"] * half
            part = self.p["out"][:H] if d == "f" else self.p["out"][H:]
            h = c = np.zeros((len(ids), H), np.float32)
            for t in order:
                a = h @ w
                a += table[ids[:, t]]
                np.tanh(a, out=a)
                g = a[:, : 3 * H]
                g *= 0.5
                g += 0.5
                c = g[:, H : 2 * H] * c + g[:, :H] * a[:, 3 * H :]
                h = g[:, 2 * H :] * np.tanh(c)
                out[t] += h @ part
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags, (rows, steps)."""
        e = self.emissions(ids)
        trans = self.p["T"] + self.bar
        # a path that leaves "outside" gains at most this by its transitions; where no character makes up for it, all is outside
        gain = 2 * max(0.0, float(trans.max() - trans[0, 0])) + 1e-3
        open_ = np.flatnonzero(((e[:, :, 1:].max(axis=2) - e[:, :, 0]) > -gain).any(axis=0))
        out = np.zeros(ids.shape, np.int64)
        if len(open_):
            out[open_] = self._viterbi(np.ascontiguousarray(e[:, open_].transpose(0, 2, 1)), trans)
        return out

    def _viterbi(self, e: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """e: (steps, TAGS, rows)."""
        steps, _, rows = e.shape
        best, back = e[0] + self.first[:, None], np.zeros((steps, TAGS, rows), np.int8)
        for t in range(1, steps):
            top = best[0] + trans[0][:, None]
            for i in range(1, TAGS):
                w = best[i] + trans[i][:, None]
                back[t][w > top] = i
                np.maximum(top, w, out=top)
            best = top + e[t]
        out, at = np.empty((rows, steps), np.int64), np.arange(rows)
        out[:, -1] = best.argmax(0)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][out[:, t], at]
        return out


def labelled(n: int, seed: int = 3) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts with labelled spans, written by rule: all kinds among words, plain numbers, keys and versions."""
    r = random.Random(seed)
    part = lambda: r.choice("b c d f g h j k l m n p r s t v w st tr ch br pl".split()) + r.choice("a e i o u ou ea é ü".split()) + r.choice(["", "n", "r", "s", "t", "l", "ng"])
    word = lambda: r.choice(["a", "the", "is", "to", "de", "und", "la", "of", "or", "and", "in", *("".join(part() for _ in range(r.randint(1, 3))) for _ in range(12))])
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: re.sub("[éü]", "e", "".join(part() for _ in range(r.randint(1, 3))))

    def card() -> str:
        body = (r.choice(["4", "5", "37", "6011"]) + num(15))[:15]
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["", " ", "-", ".", "/", "  "]).join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        local = name() + r.choice(["", ".", ".", "_", "-"]) + r.choice(["", name(), name(), num(2)])
        host = name() + r.choice(["", name(), "-" + name(), num(1)])
        end = r.choice(["com", "org", "net", "de", "edu", "co.uk"])
        at, dot = r.choice([("@", ".")] * 5 + [(" @ ", "."), (" @ ", " . "), (" [at] ", "."), ("[at]", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), (" {at} ", " {dot} ")])
        spelled = local.replace(".", dot) if dot.strip().lower() == "dot" else local
        return spelled.rstrip("._-") + at + (host + "." + end).replace(".", dot)

    def ip() -> str:
        sep = r.choice([".", ".", ".", "-", " . ", "[.]", "(.)", " dot ", "[dot]", "_"])
        return sep.join(str(r.choice([10, 127, 192, 168, 172, r.randint(0, 255), r.randint(0, 255), r.randint(0, 9)])) for _ in range(4))

    def phone() -> str:
        cc, area, trunk = r.choice(["1", "44", "49", "33", "34", "39", "7", "91", "351"]), num(r.randint(2, 4)), "0" + str(r.randint(1, 9)) + num(r.randint(1, 3))
        body = r.choice([num(r.randint(6, 8)), f"{num(3)} {num(4)}", f"{num(4)} {num(4)}", f"{num(2)} {num(2)} {num(3)}", f"{num(3)}-{num(4)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}"])
        return r.choice([
            f"+{cc} ({num(3)}) {num(3)}-{num(4)}", f"+{num(11)}", f"+{cc} {num(3)} {num(3)} {num(4)}", f"00{cc} {area} {body}", f"00{cc}-{area}-{num(7)}",
            f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}",
            f"{trunk} {body}", f"{trunk}-{body}", f"{trunk}/{body}", f"({trunk}) {body}", f"{trunk} / {body}", " ".join(["0" + num(1), *(num(2) for _ in range(4))]), f"0{num(4)} {num(6)}",
        ])

    make = [email, ip, card, phone]
    other = [
        lambda: num(r.randint(1, 10)),
        lambda: f"{num(1)}.{num(r.randint(1, 4))}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))),
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: r.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(4)}-{num(4)}"]),
        lambda: f"version {num(1)}.{num(2)}.{num(1)}",
        lambda: f"${num(2)},{num(3)}.{num(2)}",
        lambda: f"@{name()}",
        lambda: r.choice([f"{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}"]),
        lambda: " ".join(num(r.choice([1, 2, 4])) for _ in range(r.randint(2, 5))),
        lambda: r.choice([f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(r.randint(12, 24))}", f"-{num(2)}.{num(6)}", f"{num(1)},{num(3)},{num(3)}", f"{num(2)}-{num(2)}", f"#{num(5)}", f"{num(3)}%"]),
        lambda: r.choice(["at", "dot", f"at {name()}", f"at {name()}.com", f"the dot {name()}", f"at {num(2)}", f"{name()} dot"]),
        lambda: "https://" + name() + ".com/" + name() + "/" + num(4),
    ]
    texts, spans = [], []
    for _ in range(n):
        text, own = "", []
        while len(text) < TRAIN_WIN:
            x = r.random()
            if x < 0.16:
                k = r.choice([0, 0, 1, 2, 3, 3])
                piece = make[k]()
                text += r.choice(["", "", "", "", "(", "tel: ", "mail: ", "<", '"', "at ", "call "])
                own.append((len(text), len(text) + len(piece), k))
                piece += r.choice(["", "", "", ",", ".", ")", ";", "?", '"'])
            else:
                piece = r.choice(other)() if x < 0.34 else word() + r.choice(["", "", "", "", ".", ",", ":"])
                piece = piece[:1].upper() + piece[1:] if r.random() < 0.15 else piece
            text += piece + r.choice([" ", " ", " ", " ", "\n"])
        texts.append(text)
        spans.append(own)
    return texts, spans


@functools.lru_cache(maxsize=1)
def trained(steps: int = 1200) -> Tagger:
    r = random.Random(17)
    texts, spans = labelled(12000)
    ids, tags = np.zeros((len(texts), TRAIN_WIN), np.int64), np.zeros((len(texts), TRAIN_WIN), np.int64)
    for i, (t, own) in enumerate(zip(texts, spans, strict=True)):
        at = r.randint(0, max(0, len(t) - TRAIN_WIN))
        whole = np.zeros(len(t), np.int64)
        for s, e, k in own:
            whole[s:e] = 2 + 2 * k
            whole[s] = 1 + 2 * k
        end = at + (TRAIN_WIN if r.random() < 0.6 else r.randint(8, TRAIN_WIN))  # some texts end here, and padding follows
        row, tag = char_ids(t)[at:end], whole[at:end]
        if tag[0] and tag[0] % 2 == 0:  # cut in the middle of a span: it begins here
            tag[0] -= 1
        ids[i, : len(row)], tags[i, : len(row)] = row, tag
    tagger = Tagger()
    tagger.train(ids, tags, steps)
    return tagger


def _zone(i: int) -> int:
    """The window in which character i stands furthest from an edge."""
    return max(0, (i - (WIN - HOP) // 2) // HOP)


def places(text: str) -> list[int]:
    """The windows, by number, that decide on characters within LONGEST + 1 of a place of interest."""
    out: list[int] = []
    last = _zone(len(text) - 1)
    for m in _TRIGGER.finditer(text):
        lo, hi = _zone(m.start() - LONGEST - 1), min(last, _zone(m.end() + LONGEST))
        out.extend(range(max(lo, out[-1] + 1) if out else lo, hi + 1))
    return out


def plausible(kind: int, s: str) -> bool:
    """Whether a tagged span keeps to what its kind allows; each of them holds a match of _TRIGGER."""
    if len(s) > LONGEST:
        return False
    digits = "".join(_DIGITS.findall(s))
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", s))
        if "@" not in plain and _DOT.search(s):  # a bare "at" only counts beside a spelled-out dot
            plain = _SPELLED.sub("@", plain)
        return bool(_ADDRESS.fullmatch(plain))
    if kind == 1:
        m = _FOUR.fullmatch(s)
        return bool(m) and len(digits) >= 5 and all(int(m[i]) <= 255 for i in (1, 3, 4, 5))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(_GROUPS.fullmatch(s) or s == digits)
    return 9 <= len(digits) <= 15 and s != digits and bool(_DIAL.fullmatch(s))


def reconciled(text: str, windows: list[int], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans over the whole text from the windows' tags; what no window decides on is outside."""
    out: list[tuple[int, int, int]] = []
    for k, row in zip(windows, tags, strict=True):
        if not row.any():
            continue
        lo, hi = (k * HOP + (WIN - HOP) // 2 if k else 0), min(len(text), k * HOP + (WIN + HOP) // 2)
        own = row[lo - k * HOP : hi - k * HOP]
        for i in np.flatnonzero(own).tolist():
            tag, at = int(own[i]), lo + i
            kind = (tag - 1) // 2
            if tag % 2 == 0 and out and out[-1][1] == at and out[-1][2] == kind:
                out[-1] = (out[-1][0], at + 1, kind)
            else:
                out.append((at, at + 1, kind))
    return out


def find(texts: list[str | None], tagger: Tagger, everywhere: bool = False) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text; ``everywhere`` decodes all windows, to the same end."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    windows = [(list(range(_zone(len(t) - 1) + 1)) if t and everywhere else places(t)) for t in texts]
    rows = [(i, k) for i, own in enumerate(windows) for k in own]
    tags = np.zeros((len(rows), WIN), np.int8)
    for at in range(0, len(rows), 512):
        ids = np.zeros((min(512, len(rows) - at), WIN), np.int64)
        for j, (i, k) in enumerate(rows[at : at + 512]):
            x = char_ids(texts[i][k * HOP : k * HOP + WIN])
            ids[j, : len(x)] = x
        tags[at : at + len(ids)] = tagger.decode(ids)
    out, at = [], 0
    for t, own, ks in zip(texts, base, windows, strict=True):
        more = [x for x in reconciled(t, ks, tags[at : at + len(ks)]) if plausible(x[2], t[x[0] : x[1]])]
        at += len(ks)
        if more and own:
            starts = sorted(own)
            more = [(s, e, k) for s, e, k in more if not any(s < y and x < e for x, y, _ in starts)]
        out.append((own, more))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each run of overlapping spans becomes the mark of its first kind."""
    if not spans:
        return text
    out, at, end, kind = [], 0, -1, 0
    merged: list[list[int]] = []
    for s, e, k in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, end, kind in merged:
        out += [text[at:s], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def _detect(tagger: Tagger, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                texts = b.column("text").to_pylist()
                rows = []
                for t, (base, more) in zip(texts, find(texts, tagger), strict=True):
                    n = [sum(k == x for *_, k in base) for x in range(len(KINDS))]
                    rows.append([*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)] + [redact(t, base + more)] * keep)
                names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * keep
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                if keep:
                    own = {n: b.column(n) for n in b.schema.names if n != "text"}
                    yield pa.RecordBatch.from_arrays([*own.values(), *cols[:-1], cols[-1]], names=[*own, *names, "text"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *names])

    return run


_SCHEMA = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added), n_added."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(_detect(trained(), False)), f"doc_id long, {_SCHEMA}")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark of its kind; n_chars follows the text."""
    names = ["doc_id", "lang", "source", "n_chars"]
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    done = rows.mapInArrow(tidied(_detect(trained(), True)), f"doc_id long, lang string, source string, n_chars long, {_SCHEMA}, text string")
    n = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return done.select("doc_id", "text", *names[1:3], n.alias("n_chars"))
