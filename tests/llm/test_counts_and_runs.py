"""Token counts, spelling variants and periodic runs against plain versions; edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import bpe, periods, queries, spelling
from lexloom.llm.neardup import _Words
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, None), (None, "a text without any identifier", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "wordless " * 30000, "en", "s", 1), (4, "x" * 100000, None, "s", 1), (5, " \n\t ", "de", "s", 4)]
    clash = {"n": 1, "word": "clash", "h": "clash", "runs": 2, "ws": 3, "a": 4, "p": 5}
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(v).alias(k) for k, v in clash.items()])


# 11
@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), bpe.load(path)


def counted(merges, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [n for b in bpe._counted(merges)(iter([batch])) for n in b.column("n_tokens").to_pylist()]


def test_counts_of_all_kinds_of_characters(library):
    """Blocks of characters of all planes between letters, digits, blanks and quotes."""
    theirs, merges = library
    texts = []
    for first in range(0, 0x110000, 16):
        for c in (first, first + 7, first + 13):
            if not 0xD800 <= c < 0xE000:
                texts.append(f"a{chr(c)}1 {chr(c)}.{chr(c)} {chr(c)}{chr(c)}'s {chr(c)}")
    texts += [f"a{c}1 {c}.{c} {c}{c}'" for c in merges.newer[::50]]
    assert counted(merges, texts) == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_random_and_long_texts(library):
    theirs, merges = library
    r = random.Random(3)
    parts = [*"aabbc  \n\t'’éß19½.,日🙂\x1c՘", "<|endoftext|>", "'re", " the", "ing", "_", "--"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    texts += ["a" * 50000, "ab" * 30000, " " * 5000, "\n" * 3000, "<|endoftext|>" * 3 + "x <|endoftext|> y", "日本" * 9000]
    assert counted(merges, texts) == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_cache_is_emptied(library, monkeypatch):
    theirs, merges = library
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert counted(merges, ["one two three four five one two"]) == [len(theirs.encode("one two three four five one two").ids)]


def test_token_counts_over_the_table(spark, library):
    theirs, _ = library
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(got) == len(text)
    for g in got:
        n = len(theirs.encode(text[g.doc_id] or "", add_special_tokens=False).ids)
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len((text[g.doc_id] or "").encode()), n, n > 512)


def test_token_counts_odd_rows(spark, odd, library):
    theirs, merges = library
    got = Counter((g.doc_id, g.n_bytes, g.n_tokens) for g in bpe.count_tokens(odd, merges).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(theirs.encode(r.text or "").ids)) for r in odd.collect())
    assert got == want
    assert bpe.count_tokens(odd.limit(0), merges).count() == 0


def test_other_vocabularies_are_refused():
    public = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError):
        bpe.load(public.path("word_bpe_49k.json"))


# 12
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        k = [v for v in n if near(w, v)]
        top = min(k, key=lambda v: (-n[v], v), default=None)
        out[w] = (top if top and n[top] >= 10 * n[w] else None, len(k))
    full = {}
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, n[w], k, n[form] if form else None)
    return full


def some_words(r, many):
    ws = {"".join(r.choice("abé") for _ in range(r.randint(7, 10))) for _ in range(many)}
    long_ = "".join(r.choice("abcd") for _ in range(34))
    for w in [*sorted(ws)[: many // 2], *[long_] * 20]:
        i = r.randrange(len(w))
        ws.add(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abÿ") + w[i:], w[:i] + "z" + w[i + 1 :]]))
    return {w: r.randint(2, 9) * 10 ** r.randint(0, 4) for w in sorted(ws) if len(w) >= 7}


@pytest.mark.parametrize("block,shard,pairs", [(20_000, 20_000, 1 << 21), (40, 60, 500)])
def test_variants_against_all_pairs(spark, monkeypatch, block, shard, pairs):
    """With small blocks every beginning is hot and cut in blocks of words to hold and words to scan."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "SHARD", shard)
    n = some_words(random.Random(block), 400)
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert len(got) == len(n)
    assert {g.word: (g.form, g.root, g.n, g.n_near, g.form_n) for g in got} == plain_variants(n)


@given(st.text("abz\xe9\xff", max_size=8), st.text("abz\xe9\xff", max_size=8))
@settings(max_examples=500, deadline=None)
def test_packed_halves(a, b):
    x, y = a.encode("latin-1"), b.encode("latin-1")
    if abs(len(x) - len(y)) <= 1:
        as_ = lambda v, kind: np.array([v], kind)
        got = spelling.packed_one_apart(as_(spelling.packed(x), np.uint64), as_(spelling.packed(y), np.uint64), as_(len(x), np.int64), as_(len(y), np.int64))
        assert bool(got[0]) == near(a, b) == spelling.one_apart(x, y)


def test_word_counts(spark, odd):
    texts = ["Übergang übergang ÜBERGANG Over_WRITTEN overwritten×overwritten", "short words", "overwritten " * 5, None, ""] * 40
    want = Counter()
    for i, t in enumerate(texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    got = {r.word: r.n for r in spelling.word_counts(docs(spark, *texts), typos=31).collect()}
    assert got == {w: n for w, n in want.items() if n}
    odd_words = {r.word: r.n for r in spelling.word_counts(odd).collect()}
    assert odd_words == {"without": 1, "identifier": 1, "wordless": 30000, "x" * 100000: 1}
    assert {r.word: r.n_near for r in spelling.variants(spelling.word_counts(odd)).collect()} == dict.fromkeys(odd_words, 0)
    assert spelling.variants(spelling.word_counts(odd.limit(0))).count() == 0


# 13
def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 14), st.integers(0, 40), st.integers(0, 50))
@settings(max_examples=400, deadline=None)
def test_runs_of_short_texts(w, q, at, more):
    w = [b"%d" % x for x in w]
    if len(w) > at + q:
        w = w[: at + q] + [w[at + i % q] for i in range(more)] + w[at + q :]
    runs = periods.word_runs(w, _Words())
    assert runs == plain_runs(w)
    assert periods.kept_words(w, runs) == plain_collapsed(w, runs)


def test_runs_of_fibonacci_and_square_rich_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    for w in (b, ["x"] * 500, list("ab" * 200 + "c" + "ab" * 200), list("aab" * 90 + "aabaac" * 60)):
        raw = [x.encode() for x in w]
        assert periods.word_runs(raw, _Words()) == plain_runs(raw)


def test_periodic_rows(spark, odd):
    line = [f"w{i}" for i in range(7)]
    texts = [" ".join(["start", *line * 3, "end"]), "\n".join(line), " ".join(["no"] * 11), " ".join(["no"] * 12), None, "  a b"]
    got = {g.doc_id: g for g in periods.periodic_runs(docs(spark, *texts)).collect()}
    assert [(r.start, r.length, r.period) for r in got[0].runs] == [(1, 21, 7)] and got[0].collapsed == " ".join(["start", *line, "end"])
    assert got[1].runs == [] and got[1].collapsed == " ".join(line) and got[2].runs == []
    assert [(r.start, r.length, r.period) for r in got[3].runs] == [(0, 12, 1)] and got[3].collapsed == "no"
    assert (got[4].n_words, got[4].collapsed) == (0, "") and got[5].n_words == 2
    rows = Counter((g.doc_id, g.n_words, len(g.runs), len(g.collapsed)) for g in periods.periodic_runs(odd).collect())
    assert rows == Counter([(1, 0, 0, 0), (None, 5, 0, 29), (2, 0, 0, 0), (2, 0, 0, 0), (3, 30000, 1, 8), (4, 1, 0, 100000), (5, 0, 0, 0)])
    assert periods.periodic_runs(odd.limit(0)).count() == 0


def test_periodic_query_on_texts_with_repeated_tails(spark):
    """All of the contract over the table, odd rows besides, by plain Python."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {g.doc_id: g for g in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    changed = 0
    for r in table.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            changed += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and x.collapsed_sha256 == sha(" ".join(plain_collapsed(w, runs)))
    assert changed > 5


def test_repeated_tails_of_odd_rows(spark, odd):
    got = periods.periodic_runs(periods.repeated_tail(odd)).collect()
    assert Counter(g.doc_id for g in got) == Counter(r.doc_id for r in odd.collect())


@pytest.mark.parametrize("text", ["", " \n\t ", None])
def test_repeated_tails_of_texts_without_words(spark, text):
    """An id whose tail would be repeated, over a text that has no words."""
    picked = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = spark.createDataFrame([(i, text) for i in picked], "doc_id long, text string")
    got = periods.periodic_runs(periods.repeated_tail(rows)).collect()
    assert sorted((g.doc_id, g.n_words, g.runs, g.collapsed) for g in got) == [(i, 0, [], "") for i in picked]
