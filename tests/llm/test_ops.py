"""The training-data operators: brute-force versions, round trips, held-out accuracy, edge rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import chat, decontam, langid, media, neardup, pieces, pii, quality, queries, sharding, urlfilter
from lexloom.llm.common import crc_mod
from tests.conftest import SF, duck_rows, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(1, None, None, None, None), (None, "a text without id", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30000, "en", "s", 150000), (4, "x" * 100000, None, "s", 1), (5, " \n\t ", "de", "s", 4)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("h", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_forms(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols, want = duck_rows(queries.ORACLES[name])
    assert sorted(df.columns) == cols and rows_of(df) == want


# 9
def shingles(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            texts.append(r.choice([" ", "\n"]).join(t) if r.random() < 0.9 else " ".join(t).upper())
    texts += ["", None, "  ", "one", "One", "one two"]
    monkeypatch.setattr(neardup, "SIGNATURES", 3)  # several blocks even in small buckets
    monkeypatch.setattr(neardup, "TEXTS", 2)
    for percent in (80, 85):
        got = neardup.near_duplicates(docs(spark, *texts), percent).collect()
        want = brute_components(list(enumerate(texts)), percent)
        assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
        assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_no_link_is_lost_just_above_the_threshold(spark):
    """Pairs of texts whose only link lies at 0.80 to 0.82, and others just below, all by themselves."""
    r = random.Random(8)
    texts = []
    for i in range(2000):
        base = [f"w{i}x{j}" for j in range(r.randint(90, 104))]
        edit = list(base)
        for j in (20, r.randint(30, 80)):
            edit[j] = "new" + edit[j]
        texts += [" ".join(base), " ".join(edit)]
    got = {g.doc_id: g.component_id for g in neardup.near_duplicates(docs(spark, *texts), 80).collect()}
    near = 0
    for i in range(0, len(texts), 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        linked = 100 * len(a & b) >= 80 * len(a | b)
        near += linked
        assert (got[i], got[i + 1]) == (i, i if linked else i + 1)
    assert 1200 < near < 1700


def test_near_duplicates_chain_of_edited_copies(spark):
    """The second pass joins components of several classes: the larger root must follow its members."""
    texts = []
    for c in range(4):
        base = [f"w{c}x{i}" for i in range(404)]
        edited = lambda m: " ".join("new" + w if i % 40 == 20 and i < 40 * m else w for i, w in enumerate(base))  # noqa: E731, B023
        # 0.798 between the first and the second, 0.818 and 0.975 from the third to them
        texts += [edited(0), edited(9), edited(8), edited(9)]
    got = neardup.near_duplicates(docs(spark, *texts), 80).collect()
    want = brute_components(list(enumerate(texts)), 80)
    assert {i // 4 * 4 for i in want} == {c for _, c in want.values()}
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
    assert [g.doc_id for g in got if g.kept] == [g.doc_id for g in got if g.doc_id % 4 == 0]


def test_pairs_are_compared_in_the_first_band_they_share():
    """Once each, also where an earlier band agrees in the signature's bytes but not in its key."""
    r = random.Random(6)
    texts = []
    for i in range(1500):
        base = [f"w{i}x{j}" for j in range(84)]
        texts += [" ".join(base), " ".join("new" + w if j in (20, r.randrange(30, 80)) else w for j, w in enumerate(base))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(neardup._sketches(iter([batch])))
    least, misled = neardup.least_agreement(0.8), 0
    for i in range(0, len(texts), 2):
        two = rows.slice(i, 2)
        keys = np.array(two.column("bands").to_pylist())
        sig = np.frombuffer(b"".join(two.column("sig").to_pylist()), np.uint8).reshape(2, -1)
        shared = np.flatnonzero(keys[0] == keys[1])
        if not len(shared) or (sig[0] == sig[1]).sum() < least:
            continue
        looks = np.flatnonzero((sig[0] == sig[1]).reshape(neardup.ROWS, neardup.BANDS).all(axis=0))
        misled += looks[0] < shared[0]
        met = []
        for band in shared:
            part = pa.table({"comp": [0, 1], "mine": [0, 0], "band": [band] * 2, "p": [0, 0], "q": [0, 0], "sig": two.column("sig"), "earlier": pa.array([k[:band] for k in keys])})
            met += [int(band)] * sum(len(j) for _, j in neardup._pairs(part, least))
        assert met == [shared[0]]
    assert misled


def test_components_of_a_chain(spark):
    from lexloom.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.comp for r in neardup.components(Scratch(spark), links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}


def test_near_duplicates_odd_rows(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 7 and all(g.kept for g in got)
    assert [g.component_id for g in got if g.doc_id is None] == [None]
    assert {g.n_shingles for g in got if g.doc_id == 3} == {1}
    assert neardup.near_duplicates(none).count() == 0


# 1
def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([1, 1, 1, 1.0]), np.array([0, 1, 0, 1.0])), [0, 0.5, 0.5, 1])


def test_isotonic_against_brute_force():
    """Pooling gives the greatest of the least means over all intervals around a bin."""
    r = np.random.default_rng(1)
    for _ in range(40):
        n = r.integers(1, 9, 12).astype(float)
        y = np.minimum(n, r.integers(0, 9, 12))
        mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(quality.isotonic(n, y), want)


def test_quality_against_one_matrix(spark):
    """Partition sums give the ridge solution of the whole matrix, and its features the Gaussian kernel."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["good", "bad", "long-word", "1", "x!"]) for _ in range(r.randint(1, 60))) for _ in range(240)]
    y = [float("good" in t) for t in texts]
    stats = quality.document_statistics(docs(spark, *texts).repartition(7))
    model = quality.fit(stats.join(spark.createDataFrame(list(enumerate(y)), "doc_id long, y double"), "doc_id").select("x", "y"))
    x = np.array([quality.statistics(t) for t in texts])
    z = quality.features(x, x.mean(0), np.where(x.std(0) < 1e-9, 1, x.std(0)), model.w, model.phase)
    penalty = np.eye(z.shape[1]) * quality.RIDGE
    penalty[-1, -1] = 1e-6
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ np.array(y))
    assert np.allclose(z @ beta, model.raw(x), atol=1e-6)
    norm = np.clip((x - model.mean) / model.scale, -6, 6)
    for i, j in ((0, 1), (5, 9), (30, 200)):
        kernel = np.exp(-((norm[i] - norm[j]) ** 2).sum() / (4 * quality.N_STATS))
        assert abs(z[i, :-1] @ z[j, :-1] - kernel) < 0.2
    order = np.argsort(model.raw(x))
    assert (np.diff(model.score(x)[order]) >= -1e-12).all()


def test_quality_held_out(spark):
    out = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out")
    n, ok = out.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50 and ok >= 0.97 * n


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (9, 1)], "doc_id long, quality int")
    held = crc_mod(F.col("doc_id"), 4) == 2
    got = quality.score(odd, labels, held).collect()
    assert len(got) == 7 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    assert quality.score(none, labels, held).count() == 0
    assert {g.score for g in quality.score(odd, labels.limit(0), held).collect()} == {0.5}


# 5
def test_kneser_ney_sums_to_one(spark):
    d = spark.createDataFrame([(1, "abba cab bad dab " * 9, "x", "s", 1), (2, "ebbe feb bed " * 9, "y", "s", 1)], DOCS)
    m = langid.fit(d, F.lit(True))
    letters = sorted({c for t in ("abba cab bad dab", "ebbe feb bed") for c in t})
    for hist in ("   ", "  a", "bad", "zzz"):
        rows = np.array([[ord(c) for c in hist + x] for x in letters], np.uint32)
        total = m.chance(rows).sum(axis=0) + m.uniform * 0
        assert np.all(total < 1 + 1e-9) and np.all(total > 0.7)


def slow_kneser_ney(words, alphabet):
    """Interpolated Kneser-Ney with dictionaries: the probability of the last character of a string of four."""
    from collections import Counter

    pad = lambda w: "   " + w + " "
    counts = {4: Counter(pad(w)[i : i + 4] for w in words for i in range(len(w) + 1))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n1, n2 = (sum(x == v for x in c.values()) for v in (1, 2))
        discount[k] = min(0.9, max(0.1, (n1 + 0.5) / (n1 + 2 * n2 + 1)))

    def p(g):
        if not g:
            return 1 / (alphabet + 1)
        k, c = len(g), counts[len(g)]
        own = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        return max(c[g] - discount[k], 0) / total + discount[k] * len(own) / total * p(g[1:])

    return p


def test_kneser_ney_against_brute_force(spark):
    words = {"x": ("abba cab bad dab a " * 3 + "ada acda bb").split(), "y": ("ebbe feb bed " * 2 + "fed be").split()}
    d = spark.createDataFrame([(i, " ".join(w), k, "s", 1) for i, (k, w) in enumerate(words.items())], DOCS)
    m = langid.fit(d, F.lit(True))
    letters = sorted({c for w in words.values() for x in w for c in x} | {" "})
    for j, k in enumerate(m.langs):
        p = slow_kneser_ney(words[k], len(letters))
        for hist in ("   ", "  a", " ba", "bad", "abb", "zzz", "  b", "feb"):
            got = m.chance(np.array([[ord(c) for c in hist + x] for x in letters], np.uint32))[:, j]
            assert np.allclose(got, [p(hist + x) for x in letters])
    text = "bad dab zebra ½ ² 12"
    want = [-sum(math.log(slow_kneser_ney(words[k], len(letters))(("   " + w + " ")[i : i + 4])) for w in ("bad", "dab", "zebra") for i in range(len(w) + 1)) / 14 for k in m.langs]
    g = langid.identify(docs(spark, text), m).first()
    assert g.lang_pred == m.langs[int(np.argmin(want))] and math.isclose(g.cross_entropy, min(want))


def test_numerals_are_no_letters(spark):
    m = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    got = langid.identify(docs(spark, "½ ² ⅷ ٣", "①②③", "½a", "日本"), m).orderBy("doc_id").collect()
    assert [g.lang_pred == "und" for g in got] == [True, True, False, False] and got[0].score == 0


def test_rejection_follows_held_out_texts():
    r = np.random.default_rng(5)
    n = 2.0 ** r.integers(5, 14, 5000)
    e = 0.05 * r.standard_normal(5000) + r.standard_normal(5000) / np.sqrt(n)
    kappa, limit = langid.tail(e, n, np.ones(5000, np.int64))
    assert 0.03 < kappa < 0.08 and (e <= limit * (kappa + 1 / np.sqrt(n))).all()
    assert limit * (kappa + 1 / np.sqrt(1000)) < 1  # a text that costs twice as much goes


def test_language_keeps_every_gram(spark):
    r = random.Random(3)
    text = " ".join("".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(4)) for _ in range(6000))
    grams = {(("   " + w + " ")[i : i + 4]) for w in text.split() for i in range(5)}
    m = langid.fit(docs(spark, text), F.lit(True))
    rows = np.array([[ord(c) for c in g] for g in sorted(grams)], np.uint32)
    assert len(grams) > 20_000 and set(m.full[0]) == set(langid.hashes(rows))


def test_language_held_out(spark):
    out = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, ok, acc = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.count_if("accepted")).first()
    assert ok >= 0.98 * n and acc == n


def test_language_rejects_another_script(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.fit(d, F.lit(True))
    got = langid.identify(docs(spark, "съешь ещё этих мягких французских булок да выпей чаю " * 5, "12 34 !!", None), m).orderBy("doc_id").collect()
    assert [g.accepted for g in got] == [False, False, False] and [g.lang_pred for g in got][1:] == ["und", "und"]


def test_language_odd_rows(spark, odd, none):
    m = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    got = langid.identify(odd, m).collect()
    assert len(got) == 7 and {g.lang_pred for g in got if g.doc_id in (1, 2, 5)} == {"und"}
    assert langid.fit(none, F.lit(True)) is None
    assert {g.lang_pred for g in langid.identify(odd, None).collect()} == {"und"}


# 3
def test_media_payload_round_trip(spark, odd, none):
    for codec in ("mulaw", "alaw", "ima_adpcm"):
        for g in media.media_columns(odd, codec).collect():
            tag, rate, data = media.read_wav(g.media)
            assert tag == media.TAGS[codec] and len(data) == g.payload_bytes and len(data) % 64 == 0 and len(data) > 0
            assert hashlib.sha256(data).hexdigest() == g.payload_sha256 and hashlib.sha256(g.media).hexdigest() == g.media_sha256
            assert zlib.crc32(data[-64:]) == g.tail_crc32 and len(g.media) == g.media_bytes
            tag, rate, pcm = media.read_wav(g.pcm)
            assert (tag, rate) == (1, media.RATE_OUT)
    assert media.media_columns(none).count() == 0
    texts = [f"text {i} " + "é" * i for i in range(60)] + [f"text {i} " + "é" * i for i in range(60)]
    got = {g.doc_id: g for g in media.media_columns(docs(spark, *texts)).collect()}
    assert {g.codec for g in got.values()} == set(media.CODECS)
    for i, t in enumerate(texts):
        g = got[i]
        tag, rate, data = media.read_wav(g.media)
        assert data == t.encode() + bytes(-len(t.encode()) % 64) and tag == media.TAGS[g.codec]
        samples = slow_pcm(g.codec, data)
        wide = [x for a, b in zip(samples, [*samples[1:], samples[-1]], strict=True) for x in (a, (a + b) >> 1)]
        assert media.read_wav(g.pcm)[2] == np.array(wide, np.int16).tobytes() and (len(g.pcm), zlib.crc32(g.pcm)) == (g.pcm_bytes, g.pcm_crc32)
        flips = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:], strict=False))
        assert g.feature == f"{g.codec}@8000 {max(map(abs, samples))}:{sum(x * x for x in samples) // len(samples)}:{flips}"
        assert (g.media, g.pcm) == (got[i % 60].media, got[i % 60].pcm)
    g = media.media_columns(docs(spark, "é" * 40)).first()
    assert g.n_bytes == 80 and g.payload_sha256 == hashlib.sha256(("é" * 40).encode() + bytes(48)).hexdigest()


def test_codec_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    # fixed points of the two standards
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_pcm(codec, data):
    """Samples one by one: the two laws by their formulas, ADPCM block by block."""
    out = []
    if codec != "ima_adpcm":
        for byte in data:
            if codec == "mulaw":
                u = ~byte & 255
                size = (((u & 15) * 2 + 33) << ((u >> 4) & 7)) * 4 - 132
                out.append(-size if u & 128 else size)
            else:
                u = byte ^ 0x55
                seg, low = (u >> 4) & 7, u & 15
                size = (low * 2 + 1) * 8 if seg == 0 else ((low * 2 + 33) << (seg - 1)) * 8
                out.append(size if u & 128 else -size)
        return out
    for b in range(len(data) // 64):
        block = list(data[64 * b : 64 * b + 64])
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = step >> 3
                move += step if code & 4 else 0
                move += step >> 1 if code & 2 else 0
                move += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.MOVES[code & 7])))
                out.append(value)
    return out


def test_adpcm_against_one_block_at_a_time():
    data = np.random.default_rng(1).integers(0, 256, 64 * 5, np.uint8)
    assert media.adpcm_decode(data).reshape(-1).tolist() == slow_pcm("ima_adpcm", data.tobytes())


# 4
def brute_base(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0], flags=re.A)
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=600, deadline=None)
@given(st.text("a.@-_%+1 25(", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_tagger_gradient():
    t = pii.Tagger(2)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 99, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 0, 0, 0, 0], [5, 6, 6, 0, 7, 8]])
    _, g = t.gradient(ids, tags)
    for k, at in (("xf", (2, 5)), ("hb", (3, 40)), ("out", (7, 2)), ("T", (1, 2)), ("E", (int(ids[0, 1]), 3))):
        t.p[k] = t.p[k].astype(np.float64)
        keep = t.p[k][at]
        t.p[k][at] = keep + 1e-3
        up, _ = t.gradient(ids, tags)
        t.p[k][at] = keep - 1e-3
        down, _ = t.gradient(ids, tags)
        t.p[k][at] = keep
        assert math.isclose((up - down) / 2e-3, g[k][at], rel_tol=0.05, abs_tol=2e-3)


def test_tagger_finds_what_rules_miss():
    """Labelled spans of a held-out seed that no rule finds: recall, and precision of what is added."""
    texts, spans = pii.labelled(1500, seed=77)
    hit = total = added = 0
    for own, (base, more) in zip(spans, pii.find(texts, pii.trained()), strict=True):
        hit += len((set(own) - set(base)) & set(more))
        total += len(set(own) - set(base))
        added += len(more)
    assert hit >= 0.8 * total and hit >= 0.97 * added


def test_tagger_on_plain_sentences():
    found = lambda s: [(pii.KINDS[k], s[a:b]) for a, b, k in pii.find([s], pii.trained())[0][1]]
    assert found("Write to john dot smith at example dot com today") == [("email", "john dot smith at example dot com")]
    assert found("Berlin office: 030 1234 5678, thanks") == [("phone", "030 1234 5678")]
    assert found("the server 10-0-0-1 is down") == [("ip", "10-0-0-1")]
    for s in ("On 2024-05-17 at 12:30 we sold 1,234,567 items for $12,345.67", "meet me at example.com at 5", "ISBN 978-3-16-148410-0 version 1.20.3", "at the dot of 5 to 10"):
        assert found(s) == []


def test_viterbi_against_all_paths():
    import itertools

    for seed in range(4):
        t, r = pii.Tagger(seed), np.random.default_rng(seed)
        t.p["out"] *= 8
        ids = r.integers(0, 99, (3, 4))
        e, trans, got = t.emit(ids), t.p["T"] + t.bar, t.decode(ids)
        assert np.allclose(e, t.emissions(ids), atol=1e-4)
        for row in range(3):
            score = lambda p: t.first[p[0]] + sum(e[i, row, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            best = max(itertools.product(range(pii.TAGS), repeat=4), key=score)
            assert math.isclose(score(best), score(got[row]), abs_tol=1e-3)


def test_windows_decide_as_if_all_were_decoded():
    r = random.Random(3)
    texts, _ = pii.labelled(120, seed=5)
    plain = " ".join(r.choice(["word", "at", "dot", "lamp", "at the dot of"]) for _ in range(3000))
    texts += ["", "1", "x" * 500, "7" * 700, plain, plain[:5000] + texts[0] + plain[5000:9000] + texts[1], "@" * 300, " ".join(texts)]
    texts += [plain[:n] + "0171-2345678" + plain[:200] for n in range(20, 160, 7)]
    assert pii.find(texts, pii.trained()) == pii.find(texts, pii.trained(), everywhere=True)


def test_reconciling_takes_the_window_of_the_deepest_place():
    r = np.random.default_rng(2)
    for n in (1, 95, 96, 97, 128, 161, 400):
        windows = list(range(pii._zone(n - 1) + 1))
        tags = r.choice([0, 0, 3, 4, 7, 8], (len(windows), pii.WIN)).astype(np.int8)
        want = []
        for i in range(n):
            depth = lambda k: min(i - k * pii.HOP if k else 10**6, (k + 2) * pii.HOP - 1 - i) if k * pii.HOP <= i < k * pii.HOP + pii.WIN else -1  # noqa: B023, E731
            k = max(windows, key=lambda k: (depth(k), k))
            tag = int(tags[k, i - k * pii.HOP])
            kind = (tag - 1) // 2
            if tag and tag % 2 == 0 and want and want[-1][1:] == (i, kind):
                want[-1] = (want[-1][0], i + 1, kind)
            elif tag:
                want.append((i, i + 1, kind))
        assert pii.reconciled("x" * n, windows, tags) == want


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["a@b.cd", "john at x dot com", "10-0-0-12", "10 dot 0 dot 0 dot 12", "030 1234567", "4111.1111.1111.1111"]), st.text("a.@-( at dot)0[]", max_size=6), st.integers(0, 9))
def test_what_is_plausible_holds_a_trigger(s, more, at):
    for t in (s[:at] + more + s[at:], s + more, more + s):
        assert not any(pii.plausible(k, t) for k in range(4)) or pii._TRIGGER.search(t)


def test_pii_odd_rows_and_redaction(spark, odd, none):
    got = pii.detect(odd).collect()
    assert len(got) == 7 and all(g.spans == "" and g.base_sha256 == hashlib.sha256(b"").hexdigest() for g in got)
    assert pii.detect(none).count() == 0
    g = pii.redacted(docs(spark, "write to ann@x.org or 10.0.0.1, é +1 (212) 555-0100")).first()
    assert g.text == "write to <email> or <ip>, é <phone>" and g.n_chars == len(g.text)
    s = pii.detect(docs(spark, "é ann@x.org")).first()
    assert s.spans == "email:2:11" and s.n_email == 1
    long = "a " * 40000 + "ann@x.org " + "b " * 40000
    assert pii.detect(docs(spark, long)).first().spans == "email:80000:80009"


def test_pieces_of_shuffled_rows(spark):
    """Rows behind a shuffle are written first; each run of the plan gives the same blocks."""
    from pyspark import TaskContext

    v = pieces.load(queries.PIECE_MODEL)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    mixed = d.repartition(7, F.rand()).unionByName(d.limit(3))
    assert pieces.shuffled(mixed) and not pieces.shuffled(d.filter("doc_id > 3"))
    # a source whose rows come in another order each time that it is read
    restless = mixed.mapInArrow(lambda bs: (b.take(np.random.default_rng(TaskContext.get().taskAttemptId()).permutation(b.num_rows)) for b in bs), d.schema)
    want = sorted((r.doc_id, r.ids) for r in pieces.encode(d.unionByName(d.limit(3)), v).collect())
    assert sorted((r.doc_id, r.ids) for r in pieces.encode(restless, v).collect()) == want


# 7
def test_templates(spark):
    bench = spark.createDataFrame([(1, "If Alice buys 12 apples at 3.50 dollars each and sells them to Bob for 60 dollars, how much does she make after 12 days?"), (2, "too short"), (3, None), (None, "one two three four five six")], "item_id long, text string")
    t = "If Alice buys {} apples at 4 dollars each and sells them to Carol for 99 dollars, how much does she make after {} days?"
    d = docs(spark, "so. " + t.format(15, 15), t.format(15, 17), "clean words only " * 20, None, "", "too short", bench.first().text.upper())
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(d, bench).collect()}
    assert (0, 1) in got and (1, 1) not in got and got[0, 1].changed >= 3
    assert set(got) == {(0, 1), (5, 2), (6, 1)}
    assert decontam.leaks(d.limit(0), bench).count() == 0 and decontam.leaks(d, bench.limit(0)).count() == 0


def test_excerpts_short_items_and_repeated_ids(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    item = " ".join(words)
    bench = spark.createDataFrame([(1, item), (2, "4 plus 5 equals 9"), (3, "x 12")], "item_id long, text string")
    half, run, less = " ".join(words[:32]), " ".join(words[10:23]), " ".join(words[10:22])
    d = docs(spark, f"see {run} end", f"see {less} end", "so 4 plus 5 equals 9 it is", "so 4 plus 6 equals 10 it is", "x 12", "y x 12", half.upper())
    d = d.unionByName(docs(spark, "nothing here", first=0)).unionByName(docs(spark, item, item, first=50))
    got = {(r.doc_id, r.item_id): r.longest for r in decontam.leaks(d, bench, least=decontam.LITERALS).collect()}
    want = {(0, 1): 6, (2, 2): 1, (4, 3): 1, (6, 1): 25, (50, 1): 57, (51, 1): 57}
    assert got == want
    # a short item is found inside a document too, unless a least length is asked for
    assert {(r.doc_id, r.item_id): r.longest for r in decontam.leaks(d, bench).collect()} == want | {(5, 3): 1}
    inside = spark.createDataFrame([(1, "Short item"), (2, "42"), (3, "a 7 b")], "item_id long, text string")
    texts = docs(spark, "some words Short item some more", "items short", "it is 42 now", "it is 43 now", "x a 7 b", "x a 8 b", "a " * 300 + "7 b")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(texts, inside).collect()} == {(0, 1), (2, 2), (4, 3), (6, 3)}
    assert decontam.leaks(texts, inside, least=4).count() == 0
    # half an item in each of two rows of one id is no whole item
    half = spark.createDataFrame([(9, " ".join(words[:11])), (9, " ".join(words[11:22])), (9, " ".join(words[22:33]))], "doc_id long, text string")
    assert decontam.leaks(half, bench).count() == 0


# questions of school mathematics and of facts, {n}: numbers, {p} and {q}: names behind a lower-case word or a comma
ASKED = [
    "If {p} buys {a} apples at {b} dollars each and sells them to {q} for {c} dollars, how much does she make after {a} days?",
    "A train leaves the station at {a} miles per hour, and after {b} hours another one follows it at {c} miles per hour. When do they meet?",
    "There were {a} birds on the old fence behind the barn until {b} of them flew away and {c} more came to sit. How many birds are there?",
    "Yesterday {p} read {a} pages of a long book and {b} pages of another one. How many pages are left if the books have {c} pages in all?",
    "The sum of two numbers is {a} and their difference is {b}. What is the larger one, if it is known to be less than {c}?",
    "When a farmer named {p} has {a} cows and gives {b} of them to his neighbour {q}, who already has {c}, how many cows does each of them have then?",
    "In a class of {a} pupils there are {b} girls, and each girl has {c} pencils in her bag. How many pencils do the girls have together?",
    "What is the area of a garden that is {a} feet long and {b} feet wide, when a pond of {c} square feet lies in the middle of it?",
    "After the party {p} had {a} balloons left, so she gave {b} to {q} and let {c} fly into the sky. How many balloons did she keep?",
    "A bottle holds {a} ml of juice and a glass holds {b} ml, so how many glasses can be filled from {c} bottles of that size?",
]
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty-one thirty forty-two fifty sixty hundred".split()
PEOPLE = "Alice Bob Carol Dora Emil Fred Gina Hugo Ines Jack Kurt Lena".split()


def test_recall_of_questions_with_other_numbers_and_names(spark):
    """Every kind of question, written anew with other values in digits or words; none is taken for another one."""
    r = random.Random(17)

    def ask(t):
        value = lambda: r.choice(NUMBERS) if r.random() < 0.5 else str(r.randint(2, 990))
        p, q = r.sample(PEOPLE, 2)
        vs = set()
        while len(vs) < 3:
            vs.add(value())
        return t.format(**dict(zip("abc", sorted(vs), strict=True)), p=p, q=q)

    bench = spark.createDataFrame([(i, ask(t)) for i, t in enumerate(ASKED)], "item_id long, text string")
    texts, want = [], set()
    for i, t in enumerate(ASKED):
        for _ in range(8):
            want.add((len(texts), i))
            texts.append(f"some words before it. {ask(t)} and then others.")
    texts += ["She had two dogs and three cats in the old house near the mill, and after seven years she moved to another one with them."] * 5
    got = {(g.doc_id, g.item_id) for g in decontam.leaks(docs(spark, *texts), bench).collect()}
    assert not got - want
    assert len(got & want) / len(want) >= 0.9


def test_long_runs_of_names_and_numbers(spark):
    """Patterns must not recurse, and time follows the length of the text."""
    import time

    bench = spark.createDataFrame([(1, "the cat saw 12 dogs on the hill near the old mill")], "item_id long, text string")
    names, numbers = "said " + "Alan Turing " * 50_000, "1,234.5," * 50_000 + "7"
    d = docs(spark, names, numbers, f"{names} {bench.first().text}", "the cat saw 13 dogs on the hill near the old mill " * 2000)
    assert {r.doc_id for r in decontam.leaks(d, bench).collect()} == {2, 3}
    took = []
    for n in (4_000, 16_000):
        t = time.time()
        assert decontam.leaks(docs(spark, (bench.first().text + " ") * n), bench).count() == 1
        took.append(time.time() - t)
    assert took[1] < 10 * took[0] + 2


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "a text without any id at all")], "item_id long, text string")
    assert decontam.leaks(odd, bench).count() == 0


# 6
CONV = "conv_id long, turn long, role string, text string"


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "a <|im_end|>\n\\s \\p"), (1, 1, "assistant", "<|im_start|>x\n<"), (1, 2, "user", None), (1, 3, "assistant", "ü"), (1, 4, "user", "tail"), (2, None, "sys\ntem", "only"), (None, 0, "assistant", ""), (3, 1, "user", "b"), (3, 1, "user", "b")]
    df = spark.createDataFrame(rows, CONV).withColumn("formatted", F.lit("clash"))
    shown = chat.examples(df)
    assert shown.filter("conv_id = 1").count() == 3
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, r or "", x or "") for cc, t, r, x in rows if cc == c)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(shown).collect()}
    assert got == want
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_chat_many_turns_and_long_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(400)] + [(2, 0, "user", "long " * 50_000), (2, 1, "assistant", "<|im_end|>" * 20_000)]
    got = {g.conv_id: g for g in chat.digest(chat.examples(spark.createDataFrame(rows, CONV))).collect()}
    assert got[1].n_turns == 400 and got[1].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 400, 2)).encode()).hexdigest()
    assert got[2].loss_chars == 200_000 and got[2].loss_sha256 == hashlib.sha256(("<|im_end|>" * 20_000).encode()).hexdigest()


# 8
def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(3).integers(0, 2**60, 400, np.uint64)
    for n in (1, 2, 24, 25):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_sharding(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shards(d, 4).collect()
    assert {g.doc_id: (g.size, g.text_crc32) for g in got} == {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in d.collect()}
    for s in range(4):
        own = sorted(g.slot for g in got if g.shard == s)
        assert own == list(range(len(own)))
    assert all(g.grown_shard in (g.shard, 4) for g in got)
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    assert all(g.shard == slow_jump(key(g.doc_id), 4) for g in got)
    got = sharding.shards(odd).collect()
    assert len(got) == 7 and {(g.size, g.text_crc32) for g in got if g.doc_id == 1} == {(8, 0)}
    assert sharding.shards(none).count() == 0


# 10
def test_rank_follows_links(spark):
    pages = [(1, "http://good.org/fr/a", '<a href="http://friend.io/x">'), (2, "http://friend.io/", None), (3, "http://bad.net/", ""), (4, "http://shady.io/p", "<A class=x HREF='//bad.net/y'>"), (5, "http://far.io", ""), (6, None, "x"), (7, "no scheme", None), (None, "HTTP://Sub.EXAMPLE.net/en/?q=http://x", "")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.RULES).collect()}
    assert got[1].rule == "org/fr/" and got[3].rule == "net/" and got[3].verdict == "block"
    assert got[2].verdict == "allow" and got[2].trust > 0 and got[4].verdict == "block" and got[4].distrust > 0
    assert got[5].verdict == "allow" and (got[6].host, got[6].path, got[7].host) == ("", "", "")
    assert (got[None].host, got[None].path, got[None].rule, got[None].verdict) == ("sub.example.net", "/en/", "example.net/en/", "allow")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string"), queries.RULES).count() == 0


def brute_rank(links, seeds, hosts):
    """Personalised PageRank by 400 steps of a dense matrix."""
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b in links:
        w[at[b], at[a]] += 1
    w = w / np.maximum(w.sum(axis=0), 1)
    base = np.zeros(len(hosts))
    base[[at[h] for h in seeds]] = 1 / max(1, len(seeds))
    x = base
    for _ in range(400):
        x = 0.15 * base + 0.85 * (w @ x)
    return dict(zip(hosts, 0.15 * base if not links else x, strict=True))


def test_rank_against_brute_force(spark):
    r = random.Random(12)
    hosts = [f"h{i}.io" for i in range(25)] + ["a.net", "b.net", "c.org", "d.org", "e.example.net"]
    pages, links = [], []
    for h in hosts:
        path = {"org": "/fr/", "net": "/en/"}.get(h.split(".")[-1], "/")
        out = [r.choice(hosts) for _ in range(r.randint(0, 6))]
        links += [(h, o) for o in out if o != h]
        pages.append((len(pages), f"https://{h}{path}", " ".join(f'<a href="http://{o}/x">' for o in out)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("trust", F.lit(9)).withColumn("n", F.lit(1)).withColumn("rule", F.lit(1))
    got = {g.host: g for g in urlfilter.judge(df, queries.RULES).collect()}
    trust = brute_rank(links, ["c.org", "d.org", "e.example.net"], hosts)
    distrust = brute_rank([(b, a) for a, b in links], ["a.net", "b.net"], hosts)
    for h in hosts:
        assert math.isclose(got[h].trust, trust[h], abs_tol=1e-7) and math.isclose(got[h].distrust, distrust[h], abs_tol=1e-7)
        if got[h].rule is None:
            assert got[h].verdict == ("block" if distrust[h] > trust[h] + 1e-9 else "allow")
    assert {g.verdict for g in got.values() if g.rule is None} == {"allow", "block"}


def test_seeds_score_the_same_whether_or_not_others_link(spark):
    pages = [(1, "http://a.org/fr/", ""), (2, "http://b.net/", "")]
    more = [*pages, (3, "http://x.io/", "<a href='http://y.io/'>" * 3), (3, "http://x.io/", "<a href='http://y.io/'> " + "long " * 50_000)]
    of = lambda rows: {g.host: (round(g.trust, 9), round(g.distrust, 9)) for g in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()}
    assert of(pages) == {"a.org": (0.15, 0), "b.net": (0, 0.15)} and of(more).items() >= of(pages).items()


# 2
def brute_viterbi(chunk, v):
    score = {p: (s, i) for p, i, s in v.pieces}
    best = [(0.0, 0, [])]
    for e in range(1, len(chunk) + 1):
        ways = []
        for s in range(max(0, e - v.longest), e):
            p = chunk[s:e]
            if p in score:
                ways.append((best[s][0] + score[p][0], -s, best[s][2] + [score[p][1]]))
            elif e - s == 1:
                ways.append((best[s][0] + v.unknown_score, -s, best[s][2] + [v.byte_zero + b for b in p.encode()]))
        best.append(max(ways, key=lambda w: w[:2]))
    return best[-1][2]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(queries.PIECE_MODEL)


def test_pieces_against_brute_force(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "FREQUENT", 3)
    texts = ["the quick  brown fox", " lead and trail ", "a\nb\n\n c", "naïve 你好 ☃ 𝄞", "", None, "▁mark", "x" * 300, "of, the; of!! ***", "\t tab"]
    got = {r.doc_id: r for r in pieces.encoded(spark, docs(spark, *texts), queries.PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        marked = pieces.MARK + t.replace(" ", pieces.MARK) if t else ""
        cuts = range(0, len(marked), pieces.LONGEST_CHUNK) if set(t or "") == {"x"} else [0]
        want = [x for a in cuts for x in brute_viterbi(marked[a : a + (pieces.LONGEST_CHUNK if len(cuts) > 1 else len(marked))], vocabulary)]
        assert list(got[i].ids) == want and got[i].n_pieces == len(want)
        assert got[i].round_trip == ("▁" not in (t or ""))


def test_long_runs_against_brute_force(spark, vocabulary):
    r = random.Random(2)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["".join(r.choice(["the", "ing", "er", "tion", "a", "st", "q"]) for _ in range(400)) for _ in range(3)]
    texts = [*words, "=" * 1000, "-" * 333, "".join(r.choice(base64) for _ in range(900)), "see " + words[0] + " end", "é" * 400 + "☃" + "a" * 200]
    got = {g.doc_id: g for g in pieces.encoded(spark, docs(spark, *texts), queries.PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == brute_viterbi(pieces.MARK + t.replace(" ", pieces.MARK), vocabulary)
        assert got[i].round_trip


def test_useful_pieces(spark, vocabulary):
    """Pieces that are worth less than their own parts are not looked for, as no best path has one."""
    assert pieces.useful([("a", 0, -1.0), ("b", 1, -1.0), ("ab", 2, -9.0), ("ba", 3, -2.0)], -19.0) == [("a", 0, -1.0), ("b", 1, -1.0), ("ba", 3, -2.0)]
    halves = [("a", 0, -1.5), ("b", 1, -1.0), ("ab", 2, -9.0)]
    assert pieces.useful(halves, -19.0) == halves
    useful, names = {i for _, i, _ in vocabulary.useful}, [p.replace(pieces.MARK, " ") for p, *_ in vocabulary.pieces]
    assert len(useful) < len(vocabulary.pieces) / 2
    r = random.Random(5)
    texts = ["".join(r.choice(names) for _ in range(6)) + r.choice(["", "ß☃", " 𝄞"]) for _ in range(120)]
    got = {g.doc_id: list(g.ids) for g in pieces.encoded(spark, docs(spark, *texts), queries.PIECE_MODEL).collect()}
    for i, t in enumerate(texts):
        want = brute_viterbi(pieces.MARK + t.replace(" ", pieces.MARK), vocabulary)
        assert got[i] == want and all(x in useful or 0 <= x - vocabulary.byte_zero < 256 for x in want)


def test_cutting_in_place(vocabulary, monkeypatch):
    """Words are cut in their own bytes, many at a time, as one by one."""
    monkeypatch.setattr(pieces, "SLICE", 3)
    joined = {ab for p, *_ in vocabulary.useful for ab in zip(p, p[1:], strict=False)}
    words = ["the", "", "naïve☃x", pieces.MARK + "a", "𝄞𝄞é", "year-2023\nfoo", pieces.MARK * 2, "x"]
    want = []
    for w in words[1:]:
        full = w if pieces.MARK in w else pieces.MARK + w
        ends = [i for i in range(1, len(full)) if (full[i - 1], full[i]) not in joined] + [len(full)]
        want.append([full[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    chunks, counts = vocabulary.cutter()(pa.array(words).slice(1))
    assert chunks.to_pylist() == [c for cs in want for c in cs] and counts.tolist() == [len(cs) for cs in want]
    chunks, counts = vocabulary.cutter()(pa.array([], pa.string()))
    assert len(chunks) == len(counts) == 0


def test_native_decoding(spark, vocabulary):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = pieces.encoded(spark, d, queries.PIECE_MODEL).join(d, "doc_id")
    assert out.filter(~pieces.decode(F.col("ids"), vocabulary).eqNullSafe(F.col("text"))).count() == 0


def test_pieces_odd_rows(spark, odd, none):
    got = pieces.encoded(spark, odd, queries.PIECE_MODEL).collect()
    assert len(got) == 7 and all(g.round_trip for g in got)
    assert pieces.encoded(spark, none, queries.PIECE_MODEL).count() == 0


# pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: r.text for r in d.collect()}
    kept = [*plain]
    comp = brute_components(sorted(plain.items()), 80)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
            path = f"{queries_dir(spark)}/{name}"
            out.write.mode("overwrite").parquet(path)
            d = spark.read.parquet(path)
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "language_id":
            assert ids == sorted(kept)
        if name == "near_dedup":
            kept = [i for i in kept if comp[i][1] == i]
            assert ids == sorted(kept)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            kept = [i for i in kept if not any(t in plain[i] for t in items)]
            assert ids == sorted(kept)
        if name == "personal_data":
            assert ids == sorted(kept) and not any(brute_base(r.text) for r in out.collect())
        if name == "sentencepiece":
            assert ids == sorted(kept) and out.filter("not round_trip").count() == 0


def queries_dir(spark):
    from lexloom.llm.common import Scratch

    return Scratch(spark).root


def test_pipeline_odd_rows(spark, odd, none):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1) for r in df.select("doc_id").collect())
    # language ID: no letters or no language to learn goes, and so does what is like no training text
    d = odd.unionByName(docs(spark, "a plain line of words for the model to learn " * 9, first=20), allowMissingColumns=True)
    assert ids(stages["language_id"](spark, d, SF)) == [3, 20] or set(ids(stages["language_id"](spark, d, SF))) <= {-1, 3, 4, 20}
    # all but language ID keep rows of any kind; texts without words are copies of nothing
    assert ids(stages["near_dedup"](spark, odd, SF)) == [-1, 1, 2, 2, 3, 4, 5]
    assert ids(stages["decontamination"](spark, odd, SF)) == [-1, 1, 2, 2, 3, 4, 5]
    redacted = {r.doc_id: r.text for r in stages["personal_data"](spark, odd, SF).collect()}
    assert len(redacted) == 6 and redacted[1] is None and redacted[2] == "" and redacted[3] == "word " * 30000
    assert ids(stages["sentencepiece"](spark, odd, SF)) == [-1, 1, 2, 2, 3, 4, 5]
    for stage in stages.values():
        assert stage(spark, none, SF).count() == 0


def test_pipeline_decides_by_row(spark):
    """Rows that share a doc_id, and rows without one, are judged one by one."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    a, b = ("one two three four five six seven eight nine ten " + x * 20 for x in ("red fox ", "blue cat "))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, "only here and nowhere else at all"), (7, ""), (7, ""), (8, None)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = stages["near_dedup"](spark, d, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (5, b), (None, "only here and nowhere else at all"), (7, ""), (7, ""), (8, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, f"so. {item}"), (1, "clean"), (1, f"so. {item}"), (None, item), (None, "clean"), (2, None)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in stages["decontamination"](spark, d, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "clean"), (None, "clean"), (2, None)]))
    d = spark.createDataFrame([(1, "ann@x.org", "en", "s", 9), (1, "none", "en", "s", 4), (None, "+1 (212) 555-0100", "en", "s", 17)], DOCS)
    got = sorted((r.text, r.n_chars) for r in stages["personal_data"](spark, d, SF).collect())
    assert got == [("<email>", 7), ("<phone>", 7), ("none", 4)]
    got = sorted((r.n_pieces, r.round_trip) for r in stages["sentencepiece"](spark, d, SF).collect())
    assert len(got) == 3 and all(ok for _, ok in got)


def test_pipeline_run(spark):
    """run() is its stages one after the other."""
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces", "text_crc32")) == rows_of(d.select("doc_id", "n_pieces", "text_crc32"))
