"""What the work of a query grows with: plans and rows that would grow faster than the input."""

import os

from pyspark.sql import functions as F

from lexloom.plans.catalogue import collect
from tests.conftest import SF

QUERIES, _ = collect()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_score_parts_not_candidates(spark):
    """F2: no exchange of rows a category; shared parts of rules are scored once a token."""
    assert plan_of(QUERIES["candidate_rules"](spark, SF)).count("Exchange hashpartitioning") <= 12


def test_rules_at_places_without_a_token(spark):
    from lexloom.operators import matching

    tokens = spark.createDataFrame([(1, 2, 9, "obj", "NOUN", ["m0"])], "sent long, pos int, head int, label string, upos string, choices array<string>")
    asked = spark.createDataFrame([(1, 9, "m0", ["V2", "N", "Odd"]), (2, 1, "m0", ["V2"])], "sent long, pos int, lemma string, cats array<string>")
    got = {(r.sent, r.cat): (r.score, r.cnt) for r in matching.ranked_categories(asked, tokens).collect()}
    assert got == {(1, "V2"): (2, 8), (1, "N"): (0, 1), (1, "Odd"): (0, 1), (2, "V2"): (0, 3)}


def test_demonyms_are_not_sent_as_pairs(spark):
    """nothing stands above the join that makes the pairs."""
    from lexloom.operators import lookup

    plan = plan_of(QUERIES["demonym_path"](spark, SF))
    assert plan.index("Join") < plan.index("Exchange")
    places = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("c", None), ("n", 1)], "fun string, via long")
    adjectives = spark.createDataFrame([("x", 2), ("x", 1), ("x", 1), ("y", 2), ("z", None)], "demonym string, via long")
    cats = spark.createDataFrame([(f, "LN") for f in "aabc"] + [(f, "A") for f in "xxyz"], "fun string, cat string")
    got = sorted(tuple(r) for r in lookup.demonyms_via(places, adjectives, cats).collect())
    assert got == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_index_join_counts_before_it_joins(spark):
    """the other index is counted once a value, so the join lists no pairs."""
    plan = plan_of(QUERIES["store_lasting_join"](spark, SF))
    assert "Aggregate" in plan[plan.index("Join") :]


def test_synonyms_keep_columns_of_words(spark):
    """what a word brings stays with it, so the lists are not joined to it again."""
    from lexloom.operators import lookup

    lexicon = spark.createDataFrame([("eng", "dog_N", "dog"), ("eng", "hound_N", "hound")], "lang string, fun string, form string")
    lex = spark.createDataFrame([("dog_N", 7), ("hound_N", 7)], "fun string, synset_id long")
    words = spark.createDataFrame([("eng", "dog", 1), ("eng", "dog", 2), ("eng", "dog", 2)], "lang string, form string, supp long")
    assert sorted((r.supp, r.funs) for r in lookup.synonyms(lexicon, lex, words).collect()) == [(1, ["hound_N"]), (2, ["hound_N"])]


def test_node_tables_are_made_in_place(spark):
    """an expression is read where it lies, however many there are; nothing is sent or sorted."""
    plan = plan_of(QUERIES["node_tables"](spark, SF))
    assert "Exchange" not in plan and "Sort" not in plan


def test_nodes_of_deep_and_unreadable_texts():
    from lexloom.functions import trees

    deep = trees.nodes_of("f (" * 5000 + "x" + ")" * 5000)
    assert len(deep) == 5001 and deep[-1] == (5000, 5000, 5000, 4999, 0, "x") and deep[0][1] == 5000
    assert [trees.nodes_of(x) for x in ("", "()", "f (x", "f x)", 'f "', ")f(")] == [[]] * 6


def test_subexpressions_meet_once(spark):
    """an expression meets all its numbers at once, and repeated and missing ones keep their rows."""
    from lexloom.functions import trees

    assert plan_of(QUERIES["subexpressions"](spark, SF)).count("Exchange") <= 2
    e = spark.createDataFrame([(1, "f (g x) y")], "id long, expr string")
    w = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 9, "c"), (2, 0, "d"), (1, None, "e")], "id long, fid int, note string")
    got = {r.note: r.sub for r in trees.subexpressions(e, ["id"], w).collect()}
    assert got == {"a": "g x", "b": "g x", "c": None, "d": None, "e": None}


def test_dependencies_are_made_in_place(spark):
    """an expression is turned where it lies, at any depth."""
    from lexloom.functions import dependencies, trees

    assert "Exchange" not in plan_of(QUERIES["dependency_rows"](spark, SF))
    deep = dependencies.words_of(trees.nodes_of("f (" * 5000 + "x" + ") y" * 5000), {"f": [("head", None), ("mod", "obj")]})
    assert len(deep) == 5001 and deep[0] == (5001, "x", 0, "root") and deep[-1][2:] == (5001, "obj")


def test_records_are_cut_once(spark):
    """the fields of a record are a column; words and pointers don't cut it again."""
    plan = QUERIES["princeton_parse"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # records and the header line


def test_pointers_are_listed_once(spark):
    """that a record has pointers is not told by cutting it another time."""
    plan = QUERIES["pointer_split"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 4  # records and the header line, for either kind


def test_conjuncts_are_read_once():
    """the items of a list are read once for all categories, and long lists are written in one pass."""
    from lexloom.functions import constructors

    assert constructors.make_lists(("NP", "S"), "a", "F x", "(G (y))", "c") == [f"Cons{c} a (Cons{c} (F x) (Base{c} (G y) c))" for c in ("NP", "S")]
    assert constructors.make_lists(("S",), *["a"] * 5000)[0].endswith("BaseS a a" + ")" * 4998)


def test_likelihood_needs_the_way_up_alone(spark, monkeypatch):
    """what only the way down needs is not written."""
    from lexloom.operators import stats

    written = []
    monkeypatch.setattr(stats, "settled", lambda df, keep=stats.settled: written.append(1) or keep(df))
    c = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 0, "b"), (1, 2, 1, "a"), (1, 2, 1, "c"), (1, 3, 2, "b")], "sent long, node int, head int, choice string")
    whole = stats.expected(c, *stats.initial_counts(c)).filter("kind = 'logl'").collect()
    n = len(written)
    assert stats.expected(c, *stats.initial_counts(c), likelihood_only=True).collect() == whole
    assert len(written) - n < n


def test_bags_meet_in_blocks(spark, monkeypatch):
    """long bags of frequent words are compared in blocks, and no row is made for a word that two of them share."""
    import random
    from collections import Counter

    from lexloom.operators import stats

    r = random.Random(7)
    bags = {i: Counter({f"w{k}": r.randint(1, 4) for k in r.sample(range(200), 80)} | {"the": r.randint(1, 60)}) for i in range(60)}
    bags |= {100 + i: bags[i] + Counter({f"x{i}": 2}) for i in range(20)} | {200: Counter({"only": 2})}
    df = spark.createDataFrame([(a, w, n) for a, b in bags.items() for w, n in b.items()] + [(200, None, 1)], "a long, word string, n long")
    size = {a: sum(n * n for n in b.values()) ** 0.5 for a, b in bags.items()} | {200: 5**0.5}
    cos = {(a, b): sum(n * bags[b][w] for w, n in bags[a].items()) / (size[a] * size[b]) for a in bags for b in bags if a < b}
    want = {k: round(v, 9) for k, v in cos.items() if v >= 0.9}
    monkeypatch.setattr(stats, "PACK", 5)
    out = stats.similar_bags(df, 0.9)
    assert {(x.a, x.b): round(x.cosine, 9) for x in out.collect()} == want and len(want) > 20
    monkeypatch.setattr(stats, "DIMS", 3)  # almost all words in groups
    monkeypatch.setattr(stats, "GROUPS", 2)
    known = {}
    x = stats.Bags.read([p.bags for p in stats.packed_bags(df).collect()], known)
    near = [(tuple(sorted((int(a), int(b)))), round(float(c), 9)) for part in stats._near(x, x, len(known), True, 0.9) for a, b, c in zip(*part, strict=True)]
    assert dict(near) == want and len(near) == len(want)
    plan = plan_of(out)
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and "word" not in plan


def test_programs_run_on_all_cores(spark):
    """A file of many rows is few tasks, so rows are dealt out; errors come as they would one by one."""
    from lexloom.functions import program

    rows = spark.createDataFrame([("Q1", '{"claims":{}}'), ("Q2", '{"claims":{"P1":[{"mainsnak":{"snaktype":"value","datatype":"string","datavalue":{"value":"x"}}}]}}')], "qid string, json string").coalesce(1)
    assert program.run(rows, "main = qid ;").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    said = lambda text: program.evaluated_row(program.read(text), "Q1", "{}", {}, "eng", None)[0][4]
    assert said("main = {a = variants {1; divInt 1 0} ; b = (variants {2; plusInt 1 qid})} ;") == "Q1 is no Int"
    assert said("main = {a = variants {1; divInt 1 0} ; b = 2} ;") == "division by zero"
    assert said("main = plusInt (variants {1; divInt 1 0}) (variants {1; case 2 of {3 => 4}}) ;") == "no case for 2"


def test_a_choice_filters_what_ran(spark, monkeypatch):
    """choosing an option evaluates only the entities whose run ended in an error, and gives what a run of all gives."""
    from lexloom.functions import program

    text = 'main = {n = (entity qid).P1 ; m = [o: divInt 6 (entity qid).P1 | [p: 1 | 2]]} ;'
    one = lambda q, n: (q, '{"claims":{"P1":[{"mainsnak":{"snaktype":"value","datatype":"quantity","datavalue":{"value":{"amount":"+%d"}}}}]}}' % n)
    rows = spark.createDataFrame([one("Q1", 2), one("Q2", 0), one("Q3", 3), one("Q3", 0)], "qid string, json string")
    ran = []
    plain = program.run
    monkeypatch.setattr(program, "run", lambda rows, *a: ran.append(rows.count()) or plain(rows, *a))
    c = program.Client(rows, text).submit().choose("o", 1)
    assert c.state == "interactive" and ran == [4, 3]
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(c.results) == listed(plain(rows, text, "eng", {"o": 1})) and c.results.filter("error is null").count() == 8
    assert c.choose("p", 0).state == "valid" and ran == [4, 3]
    assert listed(c.results) == listed(plain(rows, text, "eng", {"o": 1, "p": 0}))


def test_languages_share_what_is_sent(spark):
    """functions meet their forms once for all languages, and expressions are not joined to what was said."""
    from lexloom.operators import lookup

    assert plan_of(QUERIES["linearised_orders"](spark, SF)).count("SortMergeJoin") <= 1
    lexicon = spark.createDataFrame([("eng", "a_N", "x", 2.0), ("eng", "a_N", "w", 1.0), ("ger", "a_N", "v", None), ("ger", "b_N", "u", 1.0)], "lang string, fun string, form string, neglogp double")
    exprs = [(1, "eng", "a_N b_N a_N"), (1, "ger", "a_N b_N a_N"), (2, "eng", "b_N"), (2, "ger", "a_N"), (3, "ger", '"lit"'), (4, "eng", None)]
    got = {(r.id, r.lang): r.text for r in lookup.linearised(spark.createDataFrame(exprs, "id long, lang string, expr string"), lexicon).collect()}
    assert got == {(1, "eng"): "w [b_N] w", (1, "ger"): "v u v", (2, "eng"): "[b_N]", (2, "ger"): "v", (3, "ger"): "", (4, "eng"): ""}


def test_facts_of_synsets_look_for_no_lexeme(spark):
    """facts without a lexeme are not joined to lexemes, where all of them met in one task by a null key."""
    from lexloom.operators import patterns

    edges = [("synset", "1", "2", "Hypernym"), ("synset", "2", "1", "Hyponym"), ("lexeme", "b", "a", "Derived"), ("lexeme", "a", "b", "Derived"), ("lexeme", "z", "a", "Derived")]
    edges = spark.createDataFrame(edges, "level string, src string, tgt string, sym string").repartition(4)
    lex = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "fun string, synset long")
    members = lex.select("fun", F.col("synset").cast("string").alias("synset"))
    got = sorted(patterns.facts(edges, "Derived", members).select("l_lex", "l_syn", "r_lex", "r_syn").collect())
    assert [tuple(r) for r in got] == [("a", "1", "b", "3"), ("a", "1", "z", None), ("b", "3", "a", "1"), ("z", None, "a", "1")]
    got = patterns.facts(edges, "Hypernym", members)
    assert [(r.l_lex, r.l_syn, r.r_lex, r.r_syn) for r in got.collect()] == [(None, "1", None, "2")]
    senses = F.lit("synset").alias("level")
    plan = plan_of(patterns.facts(edges.select(senses, "src", "tgt", "sym"), "Hypernym", members))
    assert "Join" not in plan
    out = patterns.match(edges, lex, [patterns.Triple("?y", "Hypernym", "?z"), patterns.Triple("?x", "Derived", "?y")])
    assert sorted((r.x_lex, r.y_lex, r.z_syn) for r in out.collect()) == [("b", "a", "2"), ("z", "a", "2")]


def test_few_nodes_need_no_closure(spark):
    """a few nodes are generalised without the closure of the hierarchy, with the same result at any limit."""
    import random

    from lexloom.operators import graph

    r = random.Random(3)
    edges = [(c, (c - 1) // 2) for c in range(1, 60)] + [(c, r.randrange(c)) for c in range(3, 60, 4)]
    edges = spark.createDataFrame(edges, "child long, parent long").distinct()
    groups = spark.createDataFrame([(g, r.randrange(15, 60)) for g in range(12) for _ in range(2)] + [(20, 1), (21, 777)], "grp long, id long")
    reach = graph.closure(edges)
    listed = lambda df: sorted(tuple(x) for x in df.select("grp", "id").collect())
    for limit in (5, 2000):
        assert listed(graph.generalize_few(groups, edges, limit)) == listed(graph.generalize(groups, reach, limit))
    starts = spark.createDataFrame([(0,)], "id long")
    down = edges.select(F.col("parent").alias("src"), F.col("child").alias("tgt"))
    assert graph.reached(down, starts).count() == 60 and 5 <= graph.reached(down, starts, 5).count() < 30


def test_a_batch_asks_the_state_for_old_updates_alone(spark):
    """what a micro-batch appends is known to its later pushes, and no frame is made a document."""
    from pyspark.sql import Row

    from lexloom.streaming import collab

    class State(dict):
        asked = 0

        def getValue(self, k):
            self.asked += 1
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def get(self):
            return dict.get(self, "n")

        def update(self, v):
            self["n"] = v

    doc = collab.Documents()
    doc.log, doc.size = State(), State()
    push = lambda seq, version: Row(doc_id="d", seq=seq, version=version, updates='[{"clientID":"c","changes":[[0,"x"]]}]')
    first = list(doc.handleInputRows(("d",), iter([push(3, 0), push(1, 0), push(2, 9)]), None))
    assert [(r.seq, r.version, r.rejected) for r in first] == [(1, 1, None), (2, None, "unknown version"), (3, 2, None)]
    assert doc.log.asked == 0 and doc.size.get() == (2,)
    again = list(doc.handleInputRows(("d",), iter([push(4, 1), push(5, 2)]), None))
    assert [r.version for r in again] == [3, 4] and doc.log.asked == 1


def test_examples_may_be_rows_of_sense_objects(spark):
    """an example that very many lexemes name need not be one row, and the answer reads written lexemes."""
    from lexloom.operators import lookup

    lex = spark.createDataFrame(
        [(i, f, s, {"eng": "checked"}, [], [1], [5], [7], []) for i, f, s in ((1, "a_N", 3), (2, "b_N", 3), (3, "c_N", None))],
        "id long, fun string, synset_id long, status map<string,string>, images array<string>, domain_ids array<long>, example_ids array<long>, frame_ids array<long>, pointers array<struct<sym string, tgt long>>",
    )
    asked = spark.createDataFrame([("a_N",), ("c_N",)], "fun string")
    syn, dom = spark.createDataFrame([(3, "g")], "id long, gloss string"), spark.createDataFrame([(1, "d")], "id long, name string")
    frames = spark.createDataFrame([(7, 1, 1, "NP V", "s")], "id long, class_id long, base_class_id long, pattern string, semantics string")
    classes = spark.createDataFrame([(1, "k")], "id long, name string")
    listed = spark.createDataFrame([(5, ["a_N"]), (6, ["a_N", "b_N"])], "id long, funs array<string>")
    ask = lambda ex: lookup.sense_objects(asked, lex, syn, dom, ex, frames, classes)
    got = ask(listed.select("id", F.explode("funs").alias("fun")))
    assert sorted(map(str, got.collect())) == sorted(map(str, ask(listed).collect()))
    seen = {(r.synset_id, m.fun, m.asked, tuple(m.primary or ()), tuple(m.secondary or ()), m.frames[0].pattern) for r in got.collect() for m in r.members}
    assert seen == {(3, "a_N", True, (5,), (6,), "NP V"), (3, "b_N", False, (), (), "NP V"), (5_000_001, "c_N", True, (5,), (), "NP V")}
    assert "FileScan parquet" in plan_of(got)


def test_overloads_are_chosen_by_categories():
    """what the arguments are changes no choice, so a search is made once for all rows of the same categories."""
    from lexloom.functions import constructors

    one = lambda i: constructors.dispatched("mkCl", f"s{i}_NP", "see_V2", f"(F s{i})", cats={f"s{i}_NP": "NP", "see_V2": "V2", "F": "NP"})
    assert one(0) == "PredVP s0_NP (ComplV2 see_V2 (F s0))"
    before = constructors._share.cache_info().misses
    assert [one(i) for i in range(1, 50)] == [f"PredVP s{i}_NP (ComplV2 see_V2 (F s{i}))" for i in range(1, 50)]
    assert constructors._share.cache_info().misses == before


def test_number_literals_share_a_search():
    """a literal is written by itself; only what it can stand for is searched by."""
    from lexloom.functions import constructors

    first = {f: constructors.construct(f, ("int", "1000007")) for f in ("mkDigits", "mkDecimal", "mkNum", "mkCard")}
    before = constructors.build.cache_info().misses
    for n in range(1_000_008, 1_000_058):
        assert {f: constructors.construct(f, ("int", str(n))).count("IIDig") for f in first} == dict.fromkeys(first, 6)
    assert constructors.build.cache_info().misses == before
    assert constructors.construct("mkNumeral", ("int", "12")) == "num (pot4as5 (pot3as4 (pot2as3 (pot1as2 (pot1to19 n2)))))"
    assert constructors.construct("mkDecimal", ("float", "-2.50")) == "IFrac (IFrac (NegDecimal (IDig D_2)) D_5) D_0"


def test_groups_that_are_too_general_are_ruled_out_early(spark):
    """groups without a chance are dropped before their ancestors meet, and the others give what trying all nodes gives."""
    import random

    from lexloom.operators import graph

    r = random.Random(5)
    edges = {(c, (c - 1) // 2) for c in range(1, 120)} | {(c, r.randrange(c)) for c in range(3, 120, 4)}
    up = {c: set() for c in range(120)}
    for c in range(1, 120):
        up[c] = set().union(*({p} | up[p] for x, p in edges if x == c))
    groups = {g: {r.randrange(2 if g % 9 == 0 else 40, 120) for _ in range(1 + g % 4)} for g in range(200)} | {200: {5, 777}, 201: {0}}
    reach = graph.closure(spark.createDataFrame(sorted(edges), "child long, parent long"))
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "grp long, id long")
    for limit in (4, 12, 60, 500):
        want = {}
        for g, xs in groups.items():
            met = set.intersection(*(up.get(x, set()) for x in xs))
            tops = {t for t in met if not any(t in up[o] for o in met)}
            ids = [x for x in up if tops and all(t == x or t in up[x] for t in tops)]
            if ids and len(ids) < limit:
                want[g] = (len(ids), sum(ids))
        assert {x.grp: (x.n, x.ids) for x in graph.generalized_counts(rows, reach, limit).collect()} == want
        assert {g: len(groups[g]) for g in want}.items() <= {x.grp: x.n for x in graph.promising(rows, reach, graph.sizes_under(reach), limit).groupBy("grp").agg(F.count("*").alias("n")).collect()}.items()
    assert graph.promising(rows, reach, graph.sizes_under(reach), 4).select("grp").distinct().count() < 100


def test_shuffle_files_of_settled_tables_go(spark):
    """what was shuffled for a written table doesn't stay on disk until the session ends."""
    from lexloom.session import settled, unsettle

    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for at, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = files()
    out = settled(spark.range(10_000).repartition(7, "id"))
    assert not files() - before and out.count() == 10_000
    unsettle(out)
    assert not os.path.exists(out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
