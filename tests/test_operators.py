"""Operators against results worked out by hand, and invariants."""

import json
import math
import random
from collections import Counter, namedtuple

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import constructors, dependencies, kb, numerals, text, trees
from lexloom.operators import edits, graph, intervals, lookup, matching, patterns, ranking, stats, store
from lexloom.sources import resources, treebanks, versions
from lexloom.streaming import collab


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def taxonomy(spark):
    # entity > animal > (dog, cat); dog also > pet; pet > entity; stone stands alone
    return spark.createDataFrame([(2, 1), (3, 2), (4, 2), (3, 5), (5, 1)], "child long, parent long"), spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "id long")


def test_closure_and_distance(spark, taxonomy):
    edges, nodes = taxonomy
    reach = graph.closure(edges)
    assert rows(reach.filter("src = 3")) == [(3, 1, 2), (3, 2, 1), (3, 5, 1)]
    reach0 = graph.with_self(reach, nodes)
    pairs = spark.createDataFrame([(3, 4), (3, 3), (3, 2), (3, 9)], "a long, b long")
    assert rows(graph.path_similarity(pairs, reach0).select("a", "b", "dist", "similarity").fillna(-1, ["dist"])) == [(3, 2, 1, 0.5), (3, 3, 0, 1.0), (3, 4, 2, 1 / 3), (3, 9, -1, 0.0)]


def test_diamond_ancestors(spark, taxonomy):
    edges, nodes = taxonomy
    reach = graph.closure(edges)
    groups = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 2), (3, 3), (3, 9)], "grp long, id long")
    assert rows(graph.common_ancestors(groups, reach)) == [(1, 2), (2, 1)]
    # an input that is an ancestor of another one counts at distance 0
    assert rows(graph.lowest_common_hypernyms(groups, graph.with_self(reach, nodes))) == [(1, 2, 2), (2, 2, 1)]
    assert rows(graph.generalize(groups, reach)) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]


def test_interval_labels_are_the_closure(spark, taxonomy):
    edges, nodes = taxonomy
    reach = graph.closure(edges)
    size = intervals.size(intervals.labels(edges, nodes, reach))
    assert rows(size) == [(1, 5), (2, 3), (3, 1), (4, 1), (5, 2), (9, 1)]


def test_crawl_keeps_one_direction(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (2, 3, "a"), (3, 4, "a")], "src long, tgt long, sym string")
    nodes, kept = graph.crawl(edges, spark.createDataFrame([(1,)], "id long"), 2)
    assert rows(nodes) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert rows(kept) == [(1, 1, 2, "a"), (1, 2, 3, "a")]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "child long, parent long")
    assert graph.closure(none).count() == 0


def test_intervals(spark):
    a = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 9, 9), (2, 5, 1)], "id long, lo long, hi long")
    assert rows(intervals.normalise(a)) == [(1, 1, 5), (1, 9, 9)]
    b = spark.createDataFrame([(1, 5, 9)], "id long, lo long, hi long")
    assert rows(intervals.intersection(intervals.normalise(a), b)) == [(1, 5, 5), (1, 9, 9)]
    assert rows(intervals.size(intervals.union(a, b))) == [(1, 9)]


def test_patterns_narrow_synsets_to_lexemes(spark):
    lex = spark.createDataFrame([("dog", 3), ("animal", 2), ("puppy", None)], "fun string, synset long")
    facts = spark.createDataFrame([("synset", "3", "2", "Hypernym"), ("lexeme", "dog", "puppy", "Derived")], "level string, src string, tgt string, sym string")
    t = patterns.Triple
    out = patterns.match(facts, lex, [t("?x", "Hypernym", "?y"), t("?x", "Derived", "puppy")])
    assert rows(out.select("x_lex", "x_syn", "y_syn")) == [("dog", "3", "2")]
    # evaluated from its bound right side through the inverse relation
    inverse = spark.createDataFrame([("synset", "2", "3", "Hyponym")], "level string, src string, tgt string, sym string")
    assert rows(patterns.match(inverse, lex, [t("?x", "Hypernym", "animal")]).select("x_syn")) == [("3",)]
    assert patterns.match(facts, lex, [t("?x", "Hypernym", "nothing")]).count() == 0


def test_store(spark):
    s = store.Store(spark).create_table("t", "", spark.createDataFrame([(1, "a", [1, 2]), (5, None, [2, 2])], "id long, v string, xs array<int>"))
    s = s.with_index("v", store.Index("t", lambda: F.col("v"), "partial")).with_index("xs", store.Index("t", lambda: F.col("xs"), "multi"))
    assert rows(s.entries("v")) == [("a", 1)]
    assert rows(s.keys("xs", 2)) == [(1,), (5,)]
    assert [r.id for r in s.between("t", 2, 9).collect()] == [5]
    s = s.insert("t", spark.createDataFrame([("z", [7]), ("y", [8])], "v string, xs array<int>"))
    assert rows(s.scan("t").select("id", "v").filter("id > 5")) == [(6, "y"), (7, "z")]
    assert s.delete("t", s.keys("xs", 2)).scan("t").count() == 2
    with pytest.raises(PermissionError):
        store.Store(spark, s.tables, read_only=True).delete("t", s.keys("xs", 2))


def test_context_score_threshold(spark):
    ex = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (3, "d")], "ex_id long, fun string")
    got = {(r.fun, r.other): r.score for r in stats.context_score(ex).collect()}
    assert math.isclose(got["a", "b"], math.log(2 * 36 / (2 * 2 * 12)))
    assert ("a", "c") not in got


def test_em_settles(spark):
    c = [(s, n, n - 1, x) for s in range(4) for n in (1, 2) for x in ("p", f"q{n}")]
    uni, _, post, history = stats.em(spark.createDataFrame(c, stats.CANDIDATES))
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False)) or len(history) > 1
    assert math.isclose(sum(r.p for r in post.filter("sent = 0 and node = 1").collect()), 1.0, rel_tol=1e-9)
    assert math.isclose(uni.agg(F.sum("n")).first()[0], 8.0, rel_tol=1e-9)


def test_sense_keys(spark):
    df = spark.createDataFrame([("go_on_VV",), ("dog_2_N",), ("dog_N",)], "fun string").select("fun", ranking.name_key(F.col("fun")).alias("k")).select("fun", "k.*")
    assert rows(df) == [("dog_2_N", "dog", "N", 2), ("dog_N", "dog", "N", 0), ("go_on_VV", "go", "VV", 0)]


def test_candidate_status(spark):
    df = spark.createDataFrame([(0, 1, 0), (1, 1, 2), (2, 0, 2), (1, 0, 0), (1, 1, 0), (2, 1, 9)], "s int, w int, l int")
    assert [r[0] for r in df.select(ranking.candidate_status(F.col("s"), F.col("w"), F.col("l"))).collect()] == ["checked"] * 4 + ["unchecked", "guessed"]


def test_kb_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    t = lambda s: val(kb.time_adverb(F.lit(s)))
    assert t("+1879-03-14T00:00:00Z") == "dayMonthYearAdv (intMonthday 14) march_Month (intYear 1879)"
    assert t("-0044-00-00T00:00:00Z") == "yearAdv (intYear -44)"
    assert t("+2001-05-00T00:00:00Z") == "monthYearAdv may_Month (intYear 2001)"
    assert t("+2001-13-01T00:00:00Z") is None
    assert val(kb.decimal(F.lit("+12"))) == 12.0 and val(kb.decimal(F.lit("-3.5"))) == -3.5 and val(kb.decimal(F.lit("+1x"))) is None
    assert val(kb.drop_url(F.lit("http://www.wikidata.org/entity/Q5"))) == "Q5"
    assert val(kb.float_decimal(F.lit(-3.25))) == "(IFrac (IFrac (NegDecimal (IDig D_3)) D_2) D_5)"
    assert val(kb.float_decimal(F.lit(-0.5))) == "(IFrac (NegDecimal (IDig D_0)) D_5)"
    assert (val(kb.floor_div(F.lit(-7), F.lit(2))), val(kb.floor_mod(F.lit(-7), F.lit(2))), val(kb.floor_mod(F.lit(7), F.lit(-2)))) == (-4, 1, -1)


def test_variants_multiply_and_replay(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], [3])], "id int, x array<string>, y array<int>")
    out = kb.expand_variants(df, "x", "y")
    assert rows(out.select("id", "x", "y")) == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (1, "b", 2)]
    assert rows(kb.replay(out, {"x": 1, "y": 0}).select("x", "y")) == [("b", 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**12 - 1))
def test_numerals_read_back(n):
    assert numerals.value(numerals.tree(n)) == n
    assert numerals.value(numerals.tree(n, special=False)) == n


def test_numeral_bounds():
    assert numerals.tree(21) == "(num (pot4as5 (pot3as4 (pot2as3 (pot1as2 (pot1plus n2 pot01))))))"
    assert "pot31" in numerals.tree(1000) and "pot3 " in numerals.tree(1000, special=False)
    with pytest.raises(ValueError):
        numerals.tree(0)


def test_trees(spark):
    t = trees.parse('PredVP (UsePN "a (b") (UseV ?1)')
    assert [x.fun for x in t.nodes()] == ["PredVP", "UsePN", '"a (b"', "UseV", "?1"]
    assert trees.parse(str(t)) == t
    for bad in ("(a", "a)", "", "()"):
        with pytest.raises(ValueError):
            trees.parse(bad)
    df = spark.createDataFrame([(0, "F (G x) y", 1), (1, "F (G", 0), (2, None, 0), (3, "F", 5)], "id int, expr string, fid int")
    assert [r[0] for r in trees.subexpressions(df.select("id", "expr"), ["id"], df.select("id", "fid")).orderBy("id").select("sub").collect()] == ["G x", None, None, None]
    assert trees.node_table(df, ["id"]).count() == 5


def test_trees_of_random_texts(spark):
    """Node tables and subtrees by windows against the reader of single texts, broken ones besides."""
    r = random.Random(6)
    atoms = ["F", "G_x", "a1", "?", "?12", '"q (x"', '"\\\\"', '"a\\"b"', "3.5", r"\x ->"]

    def text(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(atoms)
        out = " ".join(f"({text(depth - 1)})" if r.random() < 0.6 else text(0) for _ in range(r.randint(1, 4)))
        return f"( {out})" if r.random() < 0.2 else out

    texts = [text(r.randint(0, 5)) for _ in range(300)]
    texts += [t[:k] + t[k + 1 :] for t in texts[:150] for k in [r.randrange(len(t))]] + ["", "  ", "()", "F ()", ")(", "F )", 'F "open', "(" * 300 + "F" + ")" * 300, "F (" * 300 + "x" + ")" * 300]
    nodes, subs = {}, {}
    for i, t in enumerate(texts):
        try:
            root = trees.parse(t)
        except ValueError:
            continue
        todo, rows_ = [(root, None, 0)], []
        while todo:
            x, up, pos = todo.pop()
            me = len(rows_)
            rows_.append((up, pos, x.fun))
            if i % 7 == 0 and len(t) < 500:
                subs[i, me] = str(x)
            todo += [(a, me, k) for k, a in reversed(list(enumerate(x.args)))]
        nodes |= {(i, fid): v for fid, v in enumerate(rows_)}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, expr string")
    got = {(x.id, x.fid): (x.parent, x.pos, x.fun) for x in trees.node_table(df, ["id"]).collect()}
    assert got == nodes
    wanted = spark.createDataFrame(list(subs), "id int, fid int")
    assert {(x.id, x.fid): x.sub for x in trees.subexpressions(df, ["id"], wanted).collect()} == subs


def test_definition_scanner(spark):
    src = 'lin a = b ;\nlin dog_N = mkN "a;b" (f {x ; y}) ; --guessed\nlin open_N = mkN (x ;'
    df = spark.createDataFrame([(src, "dog_N"), (src, "a"), (src, "open_N"), (src, None), (None, "a"), (src, ""), ("x\nlin q = ;", "q")], "s string, f string")
    assert [x[0] for x in df.select(trees.definitions(F.col("s"), F.col("f"))).collect()] == ['mkN "a;b" (f {x ; y})', None, None, None, None, None, ""]
    blocks = ["abs* F (G\n  x)\neng: y", "abs: F (G", "eng: a\nabs^ F x", "none", None, 'abs: F "(\neng: x" y\n\nkey: 1', "abs: F x)", 'abs: F "x', "abs: F (x\neng: z) y\n"]
    df = spark.createDataFrame([(b,) for b in blocks], "b string")
    assert [x[0] for x in df.select(trees.cut(F.col("b"))).collect()] == ["F (G x)", None, "F x", None, None, 'F "( eng: x" y', None, None, "F (x eng: z) y"]
    texts = df.select(text.nfd(F.col("b")).alias("n"))
    assert texts.count() == len(blocks)


def test_numeral_columns(spark):
    r = random.Random(2)
    ns = [*range(-1, 1200), *(r.randrange(10 ** r.randint(1, 12)) for _ in range(1500)), *(10**k for k in range(13)), *(10**k + 1 for k in range(12)), None]
    df = spark.createDataFrame([(n,) for n in ns], "n long").select("n", numerals.numeral(F.col("n")).alias("t"))
    assert all(x.t == (numerals.tree(x.n) if x.n is not None and 1 <= x.n < 10**12 else None) for x in df.collect())


@pytest.mark.parametrize(
    "name, cats, want",
    [
        ("mkCl", "NP V2 NP", "PredVP x0 (ComplV2 x1 x2)"),
        ("mkCl", "NP V3 NP NP", "PredVP x0 (ComplSlash (Slash3V3 x1 x3) x2)"),
        ("mkCl", "N", "ExistNP (DetCN (DetQuant IndefArt NumSg) (UseN x0))"),
        ("mkVP", "V2 NP", "ComplSlash (SlashV2a x0) x1"),
        ("mkS", "Ant Pol Cl", "UseCl (TTAnt TPres x0) x1 x2"),
        ("mkPhr", "Cl", "PhrUtt NoPConj (UttS (UseCl (TTAnt TPres ASimul) PPos x0)) NoVoc"),
        ("mkNP", "Quant Num Ord CN", "DetCN (DetQuantOrd x0 x1 x2) x3"),
        ("mkQCl", "IP NP V2", "QuestSlash x0 (SlashVP x1 (SlashV2a x2))"),
        ("mkRCl", "RP A2 NP", "RelVP x0 (UseComp (CompAP (ComplA2 x1 x2)))"),
        ("mkCN", "A N", "AdjCN (PositA x0) (UseN x1)"),
        ("mkUttImpSg", "Pol Imp", "UttImpSg x0 x1"),
    ],
)
def test_constructors(name, cats, want):
    assert constructors.construct(name, *((c, f"x{i}") for i, c in enumerate(cats.split()))) == want


def test_constructor_errors_and_lists():
    with pytest.raises(TypeError):
        constructors.construct("mkCl", ("Prep", "x"))
    assert constructors.construct("mkS", ("Conj", "and"), constructors.make_list("S", "a", "b", "c")) == "ConjS and (ConsS a (BaseS b c))"


def test_dependencies(spark):
    rules = {"PredVP": [("mod", "nsubj"), ("head", None)], "ComplV2": [("head", None), ("mod", "obj")]}
    got = dependencies.convert(trees.parse("PredVP she (ComplV2 loves him)"), rules)
    assert [(f, h, lab) for _, f, h, lab in got] == [("she", 4, "nsubj"), ("loves", 0, "root"), ("him", 4, "obj")]
    table = spark.createDataFrame([("PredVP nsubj head -- comment",)], "value string")
    # random trees and pragmas, by joins as by the plain function
    r = random.Random(9)
    kinds = [("head", None), ("head", "own"), ("mod", "m"), ("mod", None), ("rel", None), ("anchor", None), ("skip", None)]
    rules = {f"F{i}": [r.choice(kinds) for _ in range(r.randint(0, 4))] for i in range(12)} | {"S": [("skip", None)] * 4}

    def tree(depth):
        if depth == 0 or r.random() < 0.25:
            return r.choice("abcd")
        return " ".join([r.choice([*rules, "G"]), *(f"({tree(depth - 1)})" for _ in range(r.randint(1, 4)))])

    texts = [tree(r.randint(0, 5)) for _ in range(150)] + ["F (", "F1 (" * 40 + "a" + ")" * 40]
    want = {(i, *x) for i, t in enumerate(texts) if t != "F (" for x in dependencies.convert(trees.parse(t), rules)}
    df, ps = spark.createDataFrame(list(enumerate(texts)), "id int, expr string"), spark.createDataFrame(list(rules.items()), "fun string, pragmas array<struct<kind:string,label:string>>")
    assert {tuple(x) for x in dependencies.to_dependencies(df, ["id"], ps).collect()} == want
    assert resources.pragmas(table).select("fun", F.col("pragmas.kind")).first() == ("PredVP", ["mod", "head"])


def test_readers(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    a = resources.abstract_lexicon(lines("fun dog_N : N ; -- 02086723-n\t[animals, pets] a pet", "fun bare_N : N ;", "-- nothing")).orderBy("fun").collect()
    assert [tuple(r) for r in a] == [("bare_N", "N", None, [], ""), ("dog_N", "N", "02086723-n", ["animals", "pets"], "a pet")]
    c = resources.concrete_lexicon(lines('lin dog_N = mkN "dog" ; --unchecked', "lin cat_N = variants {} ;", "lin x_N = y ;"), "eng")
    assert rows(c.select("fun", "status")) == [("dog_N", "unchecked"), ("x_N", "checked")]
    syn, lex = resources.taxonomy(lines("02086723-n 12 3-5,7 @ 4 #m 9 | a dog", "dog_N ! cat_N"))
    r = syn.first()
    assert (r.offset, r.id, [tuple(x) for x in r.children], [tuple(x) for x in r.pointers], r.gloss) == ("02086723-n", 12, [(3, 5), (7, 7)], [("Hypernym", None, 4), ("Holonym", "Member", 9)], "a dog")
    assert [tuple(x) for x in lex.first().pointers] == [("Antonym", None, "cat_N")]
    d = resources.domains(spark.createDataFrame([(1, "- a *"), (2, "  - b"), (3, "    - c"), (4, "  - d"), (5, "- e")], "line_no long, value string"))
    assert rows(d.select("name", "parent")) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 0)]
    p = resources.princeton(lines("  1 header", "00001740 03 n 02 entity 0 thing 1 002 @ 00002000 n 0000 + 00003000 v 0102 | that which is")).first()
    assert ([w.word for w in p.words], [(x.code, x.offset, x.from_word, x.to_word) for x in p.pointers]) == (["entity", "thing"], [("@", "00002000", 0, 0), ("+", "00003000", 1, 2)])
    k = resources.constructions(lines("abs: F x\neng: a\nkey: Q1", "abs: G\nkey: Q2"))
    assert rows(k.select("qid", "langs")) == [("Q1", ["ParseEng"]), ("Q2", ["ParseMul"])]
    e = resources.examples(lines("abs* UttNP (UsePN dog_N)\neng: A dog\nswe: x\nbul: y\nkey: 1 dog_N")).first()
    assert (e.state, e.eng, e.funs, e.key) == ("abs*", "A dog", ["UttNP", "UsePN", "dog_N"], ["1", "dog_N"])
    f = resources.frame_instances(spark.createDataFrame([("a/b/run_V@{Agent:1,Theme:x}",)], "item string")).first()
    assert (f.fun, f.roles) == ("run_V", {"Agent": 1, "Theme": None})
    assert resources.treebank(spark.createDataFrame([(1, 0, ["a"], []), (1, 1, ["b", "c"], ["d"])], "sent int, pos int, first array<string>, rest array<string>")).first().line == "a [b c | d]"
    assert "<svg" in resources.status_svg(spark.createDataFrame([("eng", 1.0, 2.0, 3.0)], "lang string, guessed double, unchecked double, checked double"))


def test_edits(spark):
    log = spark.createDataFrame([(2, "lexeme", "u", "a", "x", None, "new2"), (1, "lexeme", "u", "a", "x", None, "new1"), (3, "lexeme", "v", "b", "x", None, "other")], "seq long, kind string, user string, lex_id string, lang string, line_no long, def string")
    base = spark.createDataFrame([("a", "x", "old"), ("b", "x", "old")], "lex_id string, lang string, def string")
    assert rows(edits.definitions(base, log, "u")) == [("a", "x", "new1"), ("b", "x", "old")]
    lines = spark.createDataFrame([("x", 1, "a", "lin a = old ;"), ("x", 2, "b", "lin b = old ;")], "lang string, line_no long, fun string, text string")
    done, left = edits.commit(lines, log, "u")
    assert rows(done.select("fun", "text")) == [("a", "lin a = new1 ;"), ("b", "lin b = old ;")] and left.count() == 1
    lex = spark.createDataFrame([("a", {"bul": "guessed"}), ("b", {"bul": "unchecked"})], "fun string, status map<string,string>")
    got, changed = edits.promote(lex, spark.createDataFrame([("a",)], "fun string"), ["bul", "swe"])
    assert rows(changed) == [("a", "bul")] and {r.fun: r.status["bul"] for r in got.collect()} == {"a": "checked", "b": "unchecked"}


changes = st.lists(st.one_of(st.integers(1, 4), st.tuples(st.integers(0, 3), st.text("xyz", max_size=3))), max_size=5)


def fit(cs, n):
    """The changes cut to a document of n characters."""
    out, at = [], 0
    for c in cs:
        if isinstance(c, int):
            c = min(c, n - at)
            at += c
        else:
            c = (min(c[0], n - at), c[1])
            at += c[0]
        out.append(c)
    return collab.normal(out)


@settings(max_examples=400, deadline=None)
@given(st.text("ab\n", max_size=8), changes, changes)
def test_transforms_converge(doc, a, b):
    a, b = fit(a, len(doc)), fit(b, len(doc))
    one = collab.apply(collab.after(b, a), collab.apply(a, doc))
    two = collab.apply(collab.after(a, b, mine_first=True), collab.apply(b, doc))
    assert one == two


def test_pushes_are_rebased():
    d = collab.Document()
    d.push(0, [{"clientID": "a", "changes": [[0, "hello"]]}])
    d.push(1, [{"clientID": "a", "changes": [5, [0, " all"]]}])
    d.push(1, [{"clientID": "b", "changes": [[1, "J"]]}])
    assert d.text() == "Jello all" and len(d.pull(1)) == 2
    assert collab.decode([3, [2, "x", "y"]]) == [3, (2, "x\ny")] and collab.encode([3, (2, "x\ny")]) == [3, [2, "x", "y"]]
    with pytest.raises(ValueError):
        d.push(9, [])


def test_text(spark):
    df = spark.createDataFrame([("Äpfel ß",), ("жук",), ("ok 1",)], "t string")
    table = {"ä": "ae", "ß": "ss"} | {c: c for c in "abcdefghijklmnopqrstuvwxyz"}
    assert [r[0] for r in df.select(text.transliterate(F.col("t"), table)).collect()] == ["Aepfel ss", None, "ok 1"]
    assert [r[0] for r in df.select(text.script(F.col("t"))).collect()] == ["Latin", "Cyrillic", "Latin"]
    seg = text.segment(spark.createDataFrame([(1, ["new", "york", "city", "hall"])], "id int, words array<string>"), spark.createDataFrame([("new york",), ("york city hall",), ("city",)], "form string"))
    assert rows(seg.select("at", "size", F.coalesce("form", F.lit("-")))) == [(1, 2, "new york"), (3, 1, "city"), (4, 1, "-")]
    assert spark.range(1).select(text.replaced_in_order(F.lit("shchi Sh"), [("shch", "щ"), ("sh", "ш"), ("i", "и")])).first()[0] == "щи Ш"


def test_lookups(spark):
    lexicon = spark.createDataFrame([("eng", "dog_N", "dog"), ("eng", "hound_N", "hound"), ("eng", "dog_V", "dog")], "lang string, fun string, form string")
    lex = spark.createDataFrame([(1, "dog_N", 7), (2, "hound_N", 7), (3, "dog_V", None)], "id long, fun string, synset_id long")
    words = spark.createDataFrame([("eng", "dog")], "lang string, form string")
    assert [tuple(r) for r in lookup.synonyms(lexicon, lex, words).collect()] == [("eng", "dog", 7, ["hound_N"], ["hound"])]
    syn = spark.createDataFrame([(7, "an animal")], "id long, gloss string")
    got = lookup.sense_lookup(words.select(F.lit("dog_V").alias("fun")), lex, syn).first()
    assert got.synset_id == 5_000_001 and got.gloss is None
    assert lookup.gendered(lex.select("fun"), spark.createDataFrame([("dog_N", "Male")], "src string, sym string"), "Q1").count() == 0


def test_matching(spark):
    tok = spark.createDataFrame([(1, 1, "Dogs"), (1, 2, "bark")], "sent int, pos int, form string")
    lexicon = spark.createDataFrame([("dogs", "dog_N", "pl"), ("bark", "bark_V", "inf"), ("Bark", "bark_N", "sg")], "form string, fun string, analysis string")
    assert rows(matching.analyses(tok, lexicon).select("pos", "fun")) == [(1, "dog_N"), (2, "bark_V")]
    t = spark.createDataFrame([(1, 1, 2, "NOUN", "nsubj", "Dogs"), (1, 2, 0, "VERB", "root", "bark")], "sent int, pos int, head int, upos string, deprel string, form string")
    cand = spark.createDataFrame([(1, 2, "bark_V", "V"), (1, 2, "bark_V2", "V2")], "sent int, pos int, fun string, cat string")
    rules = spark.createDataFrame([("V", "VERB", None, "nsubj", None, 2), ("V2", "VERB", None, "obj", None, 2), ("V2", "VERB", None, None, None, 1)], matching.RULES)
    assert rows(matching.scored(cand, t, rules).select("fun", "score")) == [("bark_V", 2), ("bark_V2", 1)]
    assert matching.bracketed(t).first().tree == "(bark (Dogs))"


def test_numbering_follows_the_order(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "x double, i int").repartition(7)
    got = [r.x for r in store.numbered_rows(df, F.col("x")).orderBy("row_no").collect()]
    assert got == sorted(got) and len(got) == 500


def test_services(spark):
    from lexloom.plans import service

    lex = spark.createDataFrame([(1, "dog_N", 3), (2, "cat_N", 4), (3, "animal_N", 2)], "id long, fun string, synset_id long")
    syn = spark.createDataFrame([(2, "an animal"), (3, "a dog"), (4, "a cat")], "id long, gloss string")
    edges = spark.createDataFrame([(3, 2, "Hypernym"), (4, 2, "Hypernym")], "src long, tgt long, sym string")
    facts = edges.select(F.lit("synset").alias("level"), F.col("src").cast("string").alias("src"), F.col("tgt").cast("string").alias("tgt"), "sym")
    dom = spark.createDataFrame([("1", "pets", None)], "id string, name string, parent string")
    ld = spark.createDataFrame([("dog_N", "pets"), ("cat_N", "pets")], "fun string, domain string")
    cls = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, name string, super_id long")
    ex = spark.createDataFrame([(1, "dog_N"), (1, "cat_N"), (2, "animal_N")], "ex_id long, fun string")
    s = service.Lexicon(lex, syn, edges, dom, ld, cls, ex, facts)
    ask = lambda **p: service.answer(s, {k: [v] for k, v in p.items()})
    assert ask(gloss_id="dog_N").first().gloss == "a dog"
    assert rows(ask(generalize_ids="dog_N cat_N").select("id")) == [(2,), (3,), (4,)]
    assert ask(domain="pets").first().total == 2
    assert rows(ask(class_id="1").select("id")) == [(1,), (2,)] and ask(list_top_classes="").count() == 1
    assert rows(ask(pattern_match="?x Hypernym animal_N").select("x_syn")) == [("3",), ("4",)]
    assert ask(context_id="dog_N").count() > 0 and ask(lexical_ids="dog_N").count() == 1 and ask(list_domains="").count() == 1
    assert service.as_json(ask(gloss_id="dog_N"), "cb").first().value.startswith("cb({")
    with pytest.raises(ValueError):
        ask(other="x")


def test_programs_are_checked_when_read():
    from lexloom.functions import program

    p = program.read("main = f 1 ; f = \\x -> g x ; g : Int -> Int = \\x -> plusInt x 1 ; -- a comment")
    assert p.order.index("g") < p.order.index("f") < p.order.index("main")
    run = lambda text, fixed=None: [(v, c) for v, c in program.Evaluator(program.read(text), lambda q: {"P1": [1, 2], "label": ["x"]} if q == "Q1" else None, "Q1", "eng", fixed).main()]
    assert run("main = f 1 ; f = \\x -> g x ; g : Int -> Int = \\x -> plusInt x 1 ;") == [(2, ())]
    assert run("main = plusInt (entity qid).P1 variants {10; 20} ;") == [(11, ()), (21, ()), (12, ()), (22, ())]
    # an option that was chosen once holds wherever it comes again
    assert run("main = {a = o; b = o} ; o = [k: 1 | 2] ;") == [({"a": 1, "b": 1}, (("k", 0),)), ({"a": 2, "b": 2}, (("k", 1),))]
    assert run("main = {a = o} ; o = [k: 1 | 2] ;", {"k": 1}) == [({"a": 2}, (("k", 1),))]
    assert run("main = divInt (minusInt 0 7) 2 ;") == [(-4, ())] and run("main = round 2.5 0 ;") == [(2.0, ())]
    for bad in ("x = 1 ;", "main = a ; a = main ;", "main = nothing ;", "main = ( 1 ;", "main = plusInt 1 2 3 ;", "main = {a = 1 ;"):
        with pytest.raises(program.ProgramError):
            program.read(bad)
    for bad in ('main = plusInt "a" 1 ;', "main = modInt 1 0 ;", 'main = entity "Q9" ;', "main = case 1 of {2 => 3} ;", "main = compare 1 1.0 ;", "f : Int -> Int = \\x -> x ; f : Str -> Int = \\x -> 1 ; main = f 1.5 ;"):
        with pytest.raises(program.RowError):
            run(bad)


def test_entity_cache_keeps_the_last():
    from lexloom.functions import program

    asked = []
    get = program.Entities(lambda q: asked.append(q) or '{"labels":{"en":{"value":"x"}},"claims":{}}', "de", most=2)
    for q in ("a", "b", "a", "c", "a", "b"):
        assert get(q)["label"] == ["x"]
    assert asked == ["a", "b", "c", "b"]


def test_cycles_are_errors(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    nodes = spark.range(1, 5)
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(loop, nodes)
    with pytest.raises(ValueError, match="cycle"):
        intervals.tree_paths(loop, nodes)
    assert rows(graph.closure(loop).select("src", "anc").filter("src = anc")) == [(1, 1), (2, 2), (3, 3)]


def test_deep_domains_and_shortest_digits(spark):
    chain = spark.createDataFrame([(i, f"d{i}", i - 1 if i else None) for i in range(12)], "id long, name string, parent long")
    out = lookup.domain_tree_json(chain).first()
    assert out.children.count('"name"') == 11
    val = lambda x: spark.range(1).select(kb.float_decimal(F.lit(x))).first()[0]
    assert val(1e-5) == "(IFrac (IFrac (IFrac (IFrac (IFrac (PosDecimal (IDig D_0)) D_0) D_0) D_0) D_0) D_1)"
    assert val(1.5e7).startswith("(PosDecimal (IIDig D_1 (IIDig D_5") and val(0.1) == "(IFrac (PosDecimal (IDig D_0)) D_1)" and val(float("nan")) is None


def test_small_tables_are_never_cut(spark):
    with pytest.raises(ValueError, match="more than"):
        resources.bounded(spark.range(11), 10)
    assert len(resources.bounded(spark.range(10), 10)) == 10


def test_pushes_by_stream_and_by_batch(spark, tmp_path):
    """The stream, taken on in three runs, and the batch form give the same rows."""
    doc = collab.Document()
    push = namedtuple("Push", "seq version updates")
    assert collab.accepted("d", doc, push(1, 5, "[]")) == [("d", 1, None, None, None, "unknown version")]
    assert collab.accepted("d", doc, push(2, 0, "not json")) == [("d", 2, None, None, None, "unreadable")]
    assert collab.accepted("d", doc, push(3, 0, '[{"clientID": "a", "changes": [[0, "x"]]}]')) == [("d", 3, 1, "a", '[[0, "x"]]', None)]
    r = random.Random(5)
    rows_, sizes = [], {}
    for seq in range(60):
        d = r.choice("pqr")
        n, version = sizes.get(d, 0), r.randint(-1, sizes.get(d, 0) + 1)
        many = r.randint(0, 2)
        bad = r.random() < 0.1
        rows_.append((d, seq, version, "{" if bad else json.dumps([{"clientID": f"c{seq}", "changes": [[0, f"t{seq}"]]}] * many)))
        sizes[d] = n + many * (0 <= version <= n and not bad)
    log = spark.createDataFrame(rows_, "doc_id string, seq long, version long, updates string")
    root = str(tmp_path)
    for k in range(3):
        log.filter(f"seq div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{root}/in")
        collab.drained(collab.push_stream(spark.readStream.schema(log.schema).parquet(f"{root}/in")), root)
    got = spark.read.schema(collab.OUT).parquet(f"{root}/out")
    assert rows(got) == rows(collab.push_batch(log))
    known = spark.createDataFrame([("p", "r", 2), ("q", "r", 0)], "doc_id string, reader string, version long")
    want = collab.pull(collab.push_batch(log).filter("rejected is null"), known).select("doc_id", "version", "client", "changes", "reader")
    assert rows(collab.pull_from_state(spark, root, known)) == rows(want)


def test_entities_are_parsed_once(spark):
    one = """{"id":"Q1","labels":{"zh-hans":{"value":"x"},"en":{"value":"e"}},"claims":{"P1":[{"mainsnak":{"snaktype":"value","datatype":"quantity","datavalue":{"value":{"amount":"+3"}}},
      "references":[{"snaks":{"P8":[{"snaktype":"value","datatype":"time","datavalue":{"value":{"time":"+2001"}}}]}}]}],"P2":[{"mainsnak":{"snaktype":"somevalue"}}],"P3":[{"mainsnak":{"snaktype":"value","datatype":"odd","datavalue":{"value":1}}}]}}"""
    df = spark.createDataFrame([("Q1", one), ("Q2", "no json"), ("Q3", None), ("Q4", "{}")], "qid string, json string")
    out = kb.typed_entity(df, {"label": "Str", "P1": "Int", "P2": "Str", "P3": "Str"}, "zh-hans")
    assert [(r.qid, r.label, r.P1, r.P2, r.P3) for r in out.orderBy("qid").collect()] == [("Q1", ["x"], [3], [], [])] + [(q, [], [], [], []) for q in ("Q2", "Q3", "Q4")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1 and "get_json_object" not in plan and "from_json" not in plan
    c = kb.with_entity(df).select(F.explode(kb.claims(F.col("entity"), "P1")).alias("c"))
    assert [r[0] for r in c.select(kb.qualifier(F.col("c"), "P8")).collect()] == [["+2001"]]
    assert rows(kb.statements(df).select("qid", "prop", "pos", "value")) == [("Q1", "P1", 0, "3"), ("Q1", "P3", 0, None)]
    assert [r[0] for r in df.select(kb.properties(kb.parsed(F.col("json")))).collect()] == [["P1", "P2", "P3"], [], [], []]


def test_xz_lines(spark, tmp_path):
    import lzma

    with lzma.open(tmp_path / "a.conllu.xz", "wt") as f:
        f.write("1\tdog\n\n2\tcat é\n" + "x\n" * 25_000)
    got = resources.xz_lines(spark, str(tmp_path)).filter("line_no <= 3 or line_no > 25002").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == [(1, "1\tdog"), (2, ""), (3, "2\tcat é"), (25003, "x")]


def test_bags_meet_by_rare_words(spark):
    """Equal to all pairs at several thresholds, with far fewer candidates than pairs that share a word."""
    r = random.Random(12)
    bags = {i: Counter(r.choices([f"w{k}" for k in range(60)], weights=[60 / (k + 1) for k in range(60)], k=r.randint(1, 40))) for i in range(90)}
    bags |= {100 + i: bags[i] + Counter([r.choice("xyz")]) for i in range(30)} | {200: Counter({"only": 2})}
    df = spark.createDataFrame([(a, w, n) for a, b in bags.items() for w, n in b.items()], "a long, word string, n long")
    size = {a: math.sqrt(sum(n * n for n in b.values())) for a, b in bags.items()}
    dots = {(a, b): sum(n * bags[b][w] for w, n in bags[a].items()) for a in bags for b in bags if a < b}
    for t in (0.5, 0.8, 0.95):
        want = {k for k, v in dots.items() if v / (size[k[0]] * size[k[1]]) >= t}
        assert {(x.a, x.b) for x in stats.similar_bags(df, t).collect()} == want and want
    assert stats.bag_candidates(df, 0.95).count() < sum(v > 0 for v in dots.values()) / 2  # of sixty words only


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edit_distance_joins(spark, k):
    r = random.Random(k)
    word = lambda: "".join(r.choice("abc\u00e9") for _ in range(r.randint(0, 9)))
    a, b = {word() for _ in range(60)} | {""}, {word() for _ in range(80)} | {"", "abcabcabc"}

    def dist(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i, *row[1:]]
            for j, e in enumerate(y, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != e))
        return row[-1]

    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    want = {(x, y, d) for x in a for y in b if (d := dist(x, y)) <= k}
    assert {tuple(x) for x in ranking.within_edits(left, right, k).collect()} == want
    best = {x: min((d, y) for z, y, d in want if z == x) for x in {w[0] for w in want}}
    assert {x.a: (x.dist, x.b) for x in ranking.nearest_label(left, right, k).collect()} == best


def test_range_joins_of_all_widths(spark):
    r = random.Random(3)
    ranges = [(i, lo, lo + r.choice([-1, 0, 1, 3, 4, 15, 16, 17, 1000, 10**6, 10**12])) for i in range(80) for lo in [r.randint(-2000, 2000)]]
    points = [(j, r.choice([r.randint(-2500, 2500), r.randint(-(10**6), 10**12)])) for j in range(150)]
    got = intervals.range_join(spark.createDataFrame(points, "p long, x long"), spark.createDataFrame(ranges, "r long, lo long, hi long"))
    assert {(x.p, x.r) for x in got.collect()} == {(p, i) for p, x in points for i, lo, hi in ranges if lo <= x <= hi}
    sets = lambda n: intervals.normalise(spark.createDataFrame([(k, x, x + r.randint(0, 9)) for k in range(3) for x in r.sample(range(200), n)] + [(7 + n, 1, 5)], "id long, lo long, hi long"))
    a, b = sets(12), sets(20)
    inside = lambda df: {(x.id, v) for x in df.collect() for v in range(x.lo, x.hi + 1)}
    assert inside(intervals.intersection(a, b)) == inside(a) & inside(b)


def test_lasting_indexes(spark, tmp_path, request):
    """A lookup reads one bucket, two indexes meet without an exchange, and a changed table forgets its indexes."""
    root = str(tmp_path)
    rows_ = spark.createDataFrame([(i, f"k{i % 50}", ["a", "b"][: i % 3]) for i in range(500)], "id long, k string, tags array<string>")
    s = store.Store(spark).create_table("t", "", rows_).with_index("k", store.Index("t", "k")).with_index("tag", store.Index("t", "tags", "multi")).with_index("own", store.Index("t", lambda: F.col("k")))
    s.with_foreign_key("self", "t", "id", "t").commit(root)
    r = store.Store.reopen(spark, root)
    assert set(r.indexes) == {"k", "tag"} and r.foreign == {"self": ("t", "id", "t")} and r.violations().count() == 0
    assert {x.id for x in r.lookup("k", "k7").collect()} == set(range(7, 500, 50)) and r.lookup("tag", "b").count() == 166
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shown = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # a plan names the buckets only where it reads by them
    spark.conf.set(shown, "false")
    request.addfinalizer(lambda: spark.conf.unset(shown))
    assert "SelectedBucketsCount: 1 out of 16" in plan(r.lookup("k", "k7"))
    both = r.indexed("k").join(r.indexed("k").select("value", F.col("id").alias("other")).hint("merge"), "value")
    assert "Exchange" not in plan(both) and both.count() == 50 * 100
    for name in r.kept.values():  # as in another session, whose catalogue knows nothing of them
        spark.sql(f"DROP TABLE {name}")
    again = store.Store.reopen(spark, root, read_only=False)
    assert again.lookup("k", "k7").count() == 10 and "SelectedBucketsCount: 1 out of 16" in plan(again.lookup("k", "k7"))
    fewer = again.delete("t", spark.range(100))
    assert "k" not in fewer.kept and fewer.lookup("k", "k7").count() == 8


def test_versions_are_whole(spark, tmp_path):
    root = str(tmp_path)
    assert versions.current(spark, root) is None
    lines = spark.range(1, 2001).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("l"), "id").alias("text"))
    first = versions.commit_files(lines, root)
    bad = lines.withColumn("text", F.when(F.col("line_no") == 1999, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        versions.commit_files(bad, root)
    assert versions.current(spark, root) == first
    got = versions.read_files(spark, root).orderBy("file", "line_no").collect()
    assert [(x.file, x.line_no, x.text) for x in got] == [(f"f{k}", i, f"l{n}") for k in range(3) for i, n in enumerate((n for n in range(1, 2001) if n % 3 == k), 1)]
    second = versions.commit_files(lines.filter("line_no <= 5"), root)
    assert versions.current(spark, root) == second != first and versions.read_files(spark, root).count() == 5


def _sentence(r, i):
    words = [f"{k}\tw{r.choice(['a', 'é', '本' * 30])}{i}\tl\tN\t_\t_\t0\troot\t_\t{i}" for k in range(1, r.randint(1, 6) + 1)]
    return [f"# sent {i}", "1-2\tskipped", *words]


def _tokens_of(text):
    """(first byte, pos, id, misc) of a whole file, by reading it in one go."""
    out, at, start, pos = [], 0, 0, 0
    for line in text.split("\n"):
        if not line.strip():
            pos = 0
        else:
            start = start if pos else at
            f = line.rstrip("\r").split("\t")
            if len(f) == 10:
                out.append((start, pos, f[0], f[9]))
            pos += 1
        at += len(line.encode()) + 1
    return out


def test_treebank_ranges(tmp_path):
    """Every way to cut a file gives its sentences once: several blank lines, none at the end, one long sentence."""
    r = random.Random(5)
    texts = ["", "\n\n\n", "1\tonly a part", "\n".join(_sentence(r, 0)), "\n\n" + "\n".join(_sentence(r, 1)) + "\r\n\r\n" + "\n".join(_sentence(r, 2)) + "\n"]
    texts.append("".join("\n".join(_sentence(r, i)) + "\n" * r.choice([2, 2, 3, 4]) for i in range(12)))
    for n, t in enumerate(texts):
        file = tmp_path / f"t{n}"
        file.write_bytes(t.encode())
        for split in [*range(1, 40), 101, 1000, 10**6] if len(t) < 10**4 else [7]:
            got = [(x["sent"], x["pos"], x["id"], x["misc"]) for p in treebanks._ranges(str(file), split) for b in treebanks.tokens(p) for x in b.to_pylist()]
            assert got == _tokens_of(t), (n, split)


def test_treebank_compressed(tmp_path):
    """Streams of one block with padding between them, and where the tool is there, one stream of many blocks."""
    import lzma
    import shutil
    import subprocess

    r = random.Random(6)
    text = "".join("\n".join(_sentence(r, i)) + "\n\n" for i in range(300))
    raw, cuts = text.encode(), [0, 10, 11, 5000, 5000, 20_000]
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    (tmp_path / "many.xz").write_bytes(b"".join(lzma.compress(p, check=c) + b"\0" * pad for p, c, pad in zip(parts, (4, 1, 0, 4, 4, 10), (0, 4, 8, 0, 0, 4), strict=True)))
    files = ["many.xz"]
    if shutil.which("xz"):
        (tmp_path / "plain").write_bytes(raw)
        packed = subprocess.run(["xz", "-T2", "--block-size=4096", "-c", str(tmp_path / "plain")], capture_output=True, check=True).stdout
        (tmp_path / "blocks.xz").write_bytes(packed)
        files.append("blocks.xz")
        assert len(list(treebanks._ranges(str(tmp_path / "blocks.xz"), 4096))) == -(-len(raw) // 4096)
    for name in files:
        for split in (1, 6000, 10**6):
            cut = list(treebanks._ranges(str(tmp_path / name), split))
            got = [(x["sent"], x["pos"], x["id"], x["misc"]) for p in cut for b in treebanks.tokens(p) for x in b.to_pylist()]
            assert got == _tokens_of(text), (name, split)
    (tmp_path / "half.xz").write_bytes((tmp_path / "many.xz").read_bytes()[:-6])
    with pytest.raises(ValueError, match="xz"):
        list(treebanks._ranges(str(tmp_path / "half.xz"), 1))


def test_treebank_stream_takes_files_once(spark, tmp_path):
    """Files that come late, with an older date and a smaller name, over a restart."""
    import os

    treebanks.register(spark)
    folder, r = tmp_path / "in", random.Random(7)
    folder.mkdir()

    def add(name, i):
        (tmp_path / "new").write_text("\n".join(_sentence(r, i)) + "\n")
        os.utime(tmp_path / "new", (10**9 - i, 10**9 - i))
        (tmp_path / "new").rename(folder / name)

    def run():
        s = spark.readStream.format("treebank").option("path", f"file:{folder}").load()
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        return Counter(x.misc for x in spark.read.parquet(str(tmp_path / "out")).select("misc", "sent", "file").distinct().collect())

    add("m", 1)
    add("_hidden", 2)
    assert run() == {"1": 1}
    add("a", 3)
    (folder / "m").unlink()
    assert run() == {"1": 1, "3": 1}
    assert run() == {"1": 1, "3": 1}
    with pytest.raises(Exception, match="NotFound|not exist|no such|absent|gone"):
        spark.read.format("treebank").option("path", str(tmp_path / "gone")).load().count()


def test_class_trees_of_uneven_depth(spark):
    """A class alone, one in a tree three deep, and no class at all; each asked class is the root of its own tree."""
    classes = spark.createDataFrame([(1, 'a "b"', None), (2, "c", 1), (3, "d", 2), (4, "e", 1), (9, "z", None)], "id long, name string, super_id long")
    frames = spark.createDataFrame([(7, 3, "NP V", "s")], "id long, class_id long, pattern string, semantics string")
    lexemes = spark.createDataFrame([("f", [7])], "fun string, frame_ids array<long>")
    reach = graph.closure(classes.filter("super_id is not null").select(F.col("id").alias("child"), F.col("super_id").alias("parent")))

    def trees_of(*ids):
        asked = spark.createDataFrame([(i,) for i in ids], "id long")
        return {r.root: json.loads(r.tree) for r in lookup.class_trees(lookup.class_objects(asked, classes, frames, lexemes, reach), reach).collect()}

    leaf = {"id": 3, "name": "d", "frames": [{"frame_id": 7, "pattern": "NP V", "semantics": "s", "funs": ["f"]}], "subclasses": []}
    mid = {"id": 2, "name": "c", "frames": [], "subclasses": [leaf]}
    top = {"id": 1, "name": 'a "b"', "frames": [], "subclasses": [mid, {"id": 4, "name": "e", "frames": [], "subclasses": []}]}
    assert trees_of(1, 2, 9) == {1: top, 2: mid, 9: {"id": 9, "name": "z", "frames": [], "subclasses": []}}
    assert trees_of() == {} and trees_of(77) == {}


def test_constructors_keep_a_bounded_number_of_calls():
    """Arguments are rows' own, so what is remembered of them must not grow with the rows."""
    from lexloom.functions import constructors

    for i in range(3000):
        constructors.construct("mkDigits", ("int", str(i)))
        assert constructors.construct("mkCl", ("NP", f"s{i}_NP"), ("V", "sleep_V")) == f"PredVP s{i}_NP (UseV sleep_V)"
    assert max(f.cache_info().currsize for f in (constructors.build, constructors._share)) <= constructors.KEPT


def test_first_stored_row_of_equals(spark, tmp_path):
    """Lines with equal numbers in several files: the same one counts in every run, the first that is stored."""
    from lexloom.plans.access import role_highlighting
    from lexloom.plans.knowledge import em_initial_counts

    for k in range(8):
        rows = [(o, 10 + (7 * k + o) % 8, 100 + k, 1) for o in range(40)]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    files = sorted(str(p) for p in (tmp_path / "lineitem.parquet").glob("*.parquet"))
    first = {o: p for o, p, *_ in spark.read.parquet(files[0]).collect()}
    spark.createDataFrame([(10 + i, f"b{i}", f"t{i}") for i in range(8)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = {f"b{p - 10}": 0.0 for p in first.values()}
    for p in first.values():
        want[f"b{p - 10}"] += 0.5
    for n in ("1", "5", "64"):
        spark.conf.set("spark.sql.files.openCostInBytes", n)  # other tasks, other orders
        got = {r.choice: r.n for r in em_initial_counts(spark, str(tmp_path)).collect()}
        assert {k: v for k, v in got.items() if k[0] == "b"} == want
    spark.conf.unset("spark.sql.files.openCostInBytes")
    again = spark.createDataFrame([(o, 10, 100 + k, 1) for o in range(40) for k in range(8)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    again.repartition(5).write.parquet(f"{tmp_path}/b/lineitem.parquet")
    stored = spark.read.parquet(f"{tmp_path}/b/lineitem.parquet").select("l_orderkey", "l_suppkey", "_metadata.file_path", "_metadata.row_index").collect()
    least = {o: min((r.file_path, r.row_index, r.l_suppkey) for r in stored if r.l_orderkey == o)[2] for o in range(40)}
    got = role_highlighting(spark, f"{tmp_path}/b").filter("role = 'Theme'").collect()
    assert {r.expr_id: r.role_fid for r in got} == least


def test_classes_with_a_row_a_lexeme(spark):
    from lexloom.operators import lookup

    classes = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, name string, super_id long")
    frames = spark.createDataFrame([(7, 2, "NP V", "s")], "id long, class_id long, pattern string, semantics string")
    reach = spark.createDataFrame([(2, 1, 1)], "src long, anc long, dist long")
    rows = lookup.class_frames(spark.createDataFrame([(1,)], "id long"), classes, frames, reach).collect()
    assert sorted((r.root, r.id, r.frame_id or 0) for r in rows) == [(1, 1, 0), (1, 2, 7)]
    lex = spark.createDataFrame([("x", [7, 7]), ("y", [7])], "fun string, frame_ids array<long>")
    assert sorted(map(tuple, lookup.frame_lexemes(lex).collect())) == [(7, "x"), (7, "y")]
