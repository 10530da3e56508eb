"""Lookups of lexemes, synsets, domains and classes.

All take whole sets of questions as a DataFrame, so that one join answers any number of them;
the single-question forms filter by a literal, which the scan prunes by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.store import numbered_rows
from lexloom.session import settled

WIDE = 4


def lexeme(lexemes: DataFrame, fun: str) -> DataFrame:
    """The first lexeme with that function name."""
    return lexemes.filter(F.col("fun") == fun).orderBy("id").limit(1)


def lexemes_by_qid(lexemes: DataFrame, questions: DataFrame) -> DataFrame:
    """Lexemes linked to each question's qid; a lexeme counts once for an entity."""
    linked = lexemes.withColumn("qid", F.explode(F.array_distinct(F.col("images.qid"))))
    return questions.select("qid").distinct().join(linked, "qid")


def lexemes_of_form(lexicon: DataFrame, lexemes: DataFrame, lang: str, form: str, cat: str | None = None) -> DataFrame:
    """Distinct lexemes that the morphology has under a form; lexicon(lang, form, fun, analysis, neglogp)."""
    hits = lexicon.filter((F.col("lang") == lang) & (F.col("form") == form)).select("fun").distinct()
    out = lexemes.join(hits, "fun", "left_semi")
    return out.filter(F.regexp_extract("fun", "([^_]*)$", 1) == cat) if cat else out


def synset(synsets: DataFrame, lexemes: DataFrame, key: str) -> DataFrame:
    """By offset; a key that starts with Q is an entity, whose first lexeme's synset is meant."""
    if not key.startswith("Q"):
        return synsets.filter(F.col("offset") == key).orderBy("id").limit(1)
    hit = lexemes.filter(F.array_contains(F.col("images.qid"), key)).orderBy("id").limit(1).select(F.col("synset_id").alias("id"))
    return synsets.join(hit, "id")


def synsets_of_form(lexicon: DataFrame, lexemes: DataFrame, synsets: DataFrame, lang: str, form: str, cat: str | None = None) -> DataFrame:
    found = lexemes_of_form(lexicon, lexemes, lang, form, cat).filter("synset_id is not null").select(F.col("synset_id").alias("id")).distinct()
    return synsets.join(found, "id", "left_semi")


def synonyms(lexicon: DataFrame, lexemes: DataFrame, words: DataFrame) -> DataFrame:
    """For each word (lang, form) and sense: the other lexemes of the sense that the language can
    say, as sorted function names and forms; senses without any are left out. Other columns of a word stay
    with it, so that nobody needs to join them to the lists again."""
    own = lexemes.filter("synset_id is not null").select("fun", "synset_id")
    said = lexicon.select("lang", "fun", "form").join(own, "fun")
    # what each language says of a sense is gathered once; a word drops its own lexemes from it
    members = said.groupBy("lang", "synset_id").agg(F.array_sort(F.collect_set(F.struct("fun", "form"))).alias("members"))
    more = [c for c in words.columns if c not in ("lang", "form")]
    mine = said.join(words.distinct(), ["lang", "form"]).groupBy("lang", "form", *more, "synset_id").agg(F.collect_set("fun").alias("mine"))
    rest = F.filter("members", lambda m: ~F.array_contains(F.col("mine"), m["fun"]))
    out = mine.join(members, ["lang", "synset_id"]).select("lang", "form", *more, "synset_id", rest.alias("rest")).filter(F.size("rest") > 0)
    return out.select("lang", "form", *more, "synset_id", F.array_distinct("rest.fun").alias("funs"), F.array_sort(F.array_distinct("rest.form")).alias("forms"))


def synset_members(synsets: DataFrame, lexemes: DataFrame, lexicon: DataFrame | None = None, lang: str | None = None) -> DataFrame:
    """Lexemes, and with a lexicon the set of forms, of each synset."""
    m = lexemes.select("fun", F.col("synset_id").alias("id"))
    if lexicon is not None:
        f = lexicon.filter(F.col("lang") == lang).select("fun", "form")
        return synsets.join(m, "id").join(f, "fun").groupBy("id").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return synsets.join(m, "id").groupBy("id").agg(F.array_sort(F.collect_set("fun")).alias("funs"))


def synset_examples(synsets: DataFrame, lexemes: DataFrame, examples: DataFrame) -> DataFrame:
    """(id, fun, example) of synsets (id): the examples (id, funs) that name a lexeme of the synset, once for each
    such lexeme; a synset without any gives no row."""
    named = examples.select(F.col("id").alias("example"), F.explode(F.array_distinct("funs")).alias("fun"))
    return synsets.select("id").join(lexemes.select("fun", F.col("synset_id").alias("id")).distinct(), "id").join(named, "fun").select("id", "fun", "example")


def pointed(edges: DataFrame, nodes: DataFrame, sym: str, subtype: str | None = None) -> DataFrame:
    """(src, and the columns of the target): typed navigation on synsets or lexemes."""
    e = edges.filter(F.col("sym") == sym)
    if subtype:
        e = e.filter(F.col("subtype") == subtype)
    return e.select("src", F.col("tgt").alias("id")).join(nodes, "id")


def lexeme_facts(lexemes: DataFrame, lexicon: DataFrame, lang: str) -> DataFrame:
    """Function, expression, form (null without one), first entity, page address, probability and its -log."""
    one = lexicon.filter(F.col("lang") == lang).groupBy("fun").agg(F.min_by("form", F.struct("neglogp", "form")).alias("form"))
    image = F.get("images", 0)
    return lexemes.join(one, "fun", "left").select(
        "fun", F.col("fun").alias("expression"), "form", image["qid"].alias("qid"), page_url(image["qid"], image["page"]).alias("url"), "synset_id", "prob", neglog(F.col("prob")).alias("neglogp")
    )


def page_url(qid, page):
    """An entity's article, or its entry where it has no article."""
    return F.when(F.coalesce(page, F.lit("")) == "", F.concat(F.lit("https://www.wikidata.org/wiki/"), qid)).otherwise(F.concat(F.lit("https://en.wikipedia.org/wiki/"), page))


def neglog(p):
    return F.when(p > 0, -F.log(p))


def full_hyponyms(synsets: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, id) for every key inside the closure ranges of the asked synsets."""
    from lexloom.operators.intervals import range_join

    spans = synsets.join(questions.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("question"), F.explode("children").alias("r"))
    spans = spans.select("question", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    return range_join(synsets.select(F.col("id").alias("x")), spans).select("question", F.col("x").alias("id"))


def sense_lookup(questions: DataFrame, lexemes: DataFrame, synsets: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Senses of the asked lexemes (fun): gloss and all members of each, the asked ones marked;
    a lexeme without synset is a sense of its own with a made-up key from 5000000 on.
    Examples: the lexeme's own first, then others that name it."""
    asked = questions.select("fun").distinct()
    known = lexemes.join(asked, "fun", "left_semi")
    lone = numbered_rows(known.filter("synset_id is null").select("id", "fun"), F.col("id")).select("id", "fun", (F.lit(5_000_000) + F.col("row_no")).alias("synset_id"))
    wanted = known.filter("synset_id is not null").select("synset_id").distinct()
    members = lexemes.join(wanted, "synset_id").select("id", "fun", "synset_id").unionByName(lone)
    members = members.join(asked.withColumn("asked", F.lit(True)), "fun", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    if examples is not None:
        own = lexemes.select("fun", F.explode("example_ids").alias("ex")).distinct()
        named = examples.select(F.col("id").alias("ex"), F.explode(F.array_distinct("funs")).alias("fun"))
        more = named.join(own, ["fun", "ex"], "left_anti").groupBy("fun").agg(F.sort_array(F.collect_list("ex")).alias("secondary"))
        first = own.groupBy("fun").agg(F.sort_array(F.collect_list("ex")).alias("primary"))
        members = members.join(first, "fun", "left").join(more, "fun", "left")
        member = F.struct("fun", "asked", F.when(F.col("asked"), F.col("primary")).alias("primary"), F.when(F.col("asked"), F.col("secondary")).alias("secondary"))
    else:
        member = F.struct("fun", "asked")
    shaped = members.groupBy("synset_id").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return shaped.join(synsets.select(F.col("id").alias("synset_id"), "gloss"), "synset_id", "left")


def gloss(questions: DataFrame, lexemes: DataFrame, synsets: DataFrame) -> DataFrame:
    return questions.join(lexemes.select("fun", "synset_id"), "fun").join(synsets.select(F.col("id").alias("synset_id"), "gloss"), "synset_id").select("fun", "gloss")


def with_all_domains(lexdom: DataFrame, domains: list[str], cap: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """Lexemes that are in all the domains, the first ``cap`` of them in order, and their number."""
    hit = lexdom.filter(F.col("domain").isin(domains)).groupBy("fun").agg(F.count_distinct("domain").alias("n")).filter(F.col("n") == len(set(domains))).select("fun")
    return (hit.orderBy("fun").limit(cap) if cap else hit), hit.agg(F.count("*").alias("total"))


def roots(nodes: DataFrame, parent: str = "parent") -> DataFrame:
    return nodes.filter(F.col(parent).isNull())


def subtree_counts(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n): nodes under each node, itself included."""
    below = reach.groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("under"))
    return nodes.select("id").join(below, "id", "left").select("id", (F.coalesce("under", F.lit(0)) + 1).alias("n"))


def domain_tree_json(nodes: DataFrame) -> DataFrame:
    """Nested JSON of a forest (id, name, parent), built from the deepest level up, whatever its depth."""
    from lexloom.operators.graph import levels
    from lexloom.session import settled

    deep = levels(nodes.filter("parent is not null").select(F.col("id").alias("child"), "parent"), nodes.select("id"))
    cur = nodes.select("id", "name", "parent", F.lit("[]").alias("children"))
    for _ in range(deep.agg(F.max("level")).first()[0] or 0):
        shown = cur.select(F.col("parent").alias("id"), F.concat(F.lit('{"name":'), F.to_json(F.array("name")), F.lit(',"children":'), "children", F.lit("}")).alias("child"))
        kids = shown.filter("id is not null").groupBy("id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("child")), ","), F.lit("]")).alias("kids"))
        cur = settled(nodes.select("id", "name", "parent").join(kids, "id", "left").select("id", "name", "parent", F.coalesce("kids", F.lit("[]")).alias("children")))
    return cur.filter("parent is null").select("id", "name", "children")


def expressions(wanted: DataFrame, lexemes: DataFrame, constructions: DataFrame, general: str = "Mul") -> DataFrame:
    """(qid, lang, expr, source): lexemes of the entity and constructions of (qid, lang); only where
    the language has none, the general ones. wanted(qid, lang)."""
    lex = lexemes.select(F.explode(F.array_distinct(F.col("images.qid"))).alias("qid"), F.col("fun").alias("expr"))
    by_lexeme = wanted.join(lex, "qid").select("qid", "lang", "expr", F.lit("lexeme").alias("source"))
    c = constructions.select("qid", "expr", F.explode("langs").alias("clang"))
    own = wanted.join(c, "qid").filter("lang = clang").select("qid", "lang", "expr")
    rest = wanted.join(own.select("qid", "lang").distinct(), ["qid", "lang"], "left_anti")
    other = rest.join(c.filter(F.col("clang") == general), "qid").select("qid", "lang", "expr")
    return by_lexeme.unionByName(own.withColumn("source", F.lit("construction"))).unionByName(other.withColumn("source", F.lit("general")))


def gendered(rows: DataFrame, edges: DataFrame, gender: str) -> DataFrame:
    """Rows (fun) fit for the gender: male drops what points to a male form, female what points to
    a female one; any other gender leaves nothing. Fixed values: the two entities' ids."""
    bars = {"Q6581097": "Male", "Q6581072": "Female"}
    if gender not in bars:
        return rows.limit(0)
    return rows.join(edges.filter(F.col("sym") == bars[gender]).select(F.col("src").alias("fun")).distinct(), "fun", "left_anti")


def demonyms(places: DataFrame, edges: DataFrame, cats: DataFrame, place_cat: str = "LN", adj_cat: str = "A") -> DataFrame:
    """(fun, demonym): place lexeme, derived pointer, adjective; cats(fun, cat)."""
    start = places.join(cats.filter(F.col("cat") == place_cat), "fun").select("fun")
    ends = cats.filter(F.col("cat") == adj_cat).select(F.col("fun").alias("demonym"))
    return start.join(edges.filter(F.col("sym") == "Derived").select(F.col("src").alias("fun"), F.col("tgt").alias("demonym")), "fun").join(ends, "demonym").select("fun", "demonym")


def demonyms_via(places: DataFrame, adjectives: DataFrame, cats: DataFrame, place_cat: str = "LN", adj_cat: str = "A", parts: int = 16) -> DataFrame:
    """Distinct (fun, demonym) as ``demonyms`` has them, where the pointers lead through what both name: places(fun, via),
    adjectives(demonym, via). The pairs may be a product of both sides, so categories are settled and repetitions dropped
    on each side before it, and no pair is sent anywhere: one that meets by several ways counts by the first.
    A way's places are dealt over ``parts`` tasks, and its adjectives copied to each, as ways may be few."""
    ways = lambda rows, name, cat: rows.filter("via is not null").join(cats.filter(F.col("cat") == cat).select(F.col("fun").alias(name)).distinct(), name, "left_semi").groupBy(name).agg(F.array_sort(F.collect_set("via")).alias(f"{name}_ways"))
    a = ways(places, "fun", place_cat).withColumn("via", F.explode("fun_ways")).withColumn("part", F.pmod(F.xxhash64("fun"), F.lit(parts)).cast("int"))
    b = ways(adjectives, "demonym", adj_cat).withColumn("via", F.explode("demonym_ways")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    one = (F.size("fun_ways") == 1) | (F.size("demonym_ways") == 1)
    first = F.col("via") == F.array_min(F.array_intersect("fun_ways", "demonym_ways"))
    return a.join(b, ["via", "part"]).filter(F.when(one, True).otherwise(first)).select("fun", "demonym")


def facet(rows: DataFrame, selected: list[str]) -> DataFrame:
    """Any of the selected domains; an empty selection keeps all."""
    return rows.filter(F.arrays_overlap("domains", F.array(*map(F.lit, selected)))) if selected else rows


def relevance_bars(rows: DataFrame) -> DataFrame:
    """bars = round(exp(-p) * scale), scale = least of 5/max and 3/min of exp(-p), over a whole result."""
    e = rows.withColumn("e_", F.exp(-F.col("neglogp")))
    lim = e.agg(F.max("e_").alias("hi_"), F.min("e_").alias("lo_"))
    scaled = e.join(F.broadcast(lim))  # one row
    return scaled.withColumn("bars", F.round(F.col("e_") * F.least(5 / F.col("hi_"), 3 / F.col("lo_"))).cast("int")).drop("e_", "hi_", "lo_")


def by_frames(members: DataFrame) -> DataFrame:
    """Synonyms grouped by equal lists of frames, the asked lexeme's group first; members(grp, fun, frames, asked)."""
    key = F.to_json(F.array_sort("frames"))
    g = members.withColumn("frames_key", key).groupBy("grp", "frames_key").agg(F.array_sort(F.collect_list("fun")).alias("funs"), F.max("asked").alias("own"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("own"), "frames_key")))


def pick_example(examples: DataFrame, seed: int) -> DataFrame:
    """A random unchecked example; the same seed gives the same one."""
    return examples.filter("state = 'abs*'").orderBy(F.xxhash64(F.lit(seed), "expr"), "expr").limit(1)


def languages(lexicon: DataFrame) -> DataFrame:
    """The languages that can say something."""
    return lexicon.select("lang").distinct()


def linearised(exprs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, lang, text) of expressions (id, lang, expr): the forms of their functions in order, the
    likeliest of each; a function that the language can't say stands in brackets. The lexicon stands
    in for the external grammar, so word order is that of the expression."""
    from lexloom.functions.trees import functions

    # a function and an expression travel once, whatever the number of languages; an expression's key is its id and first language.
    # Lists are gathered after their rows were sent, as there is nothing to gather before. Both sides of the join are sorted at
    # once, so it has more and smaller partitions than other steps
    n = WIDE * int(exprs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = lexicon.filter("lang is not null").select("lang", "fun", "neglogp", "form").repartition(n, "fun").groupBy("fun").agg(F.sort_array(F.collect_list(F.struct("lang", "neglogp", "form"))).alias("xs"))
    best = F.filter("xs", lambda x, i: (i == 0) | (x["lang"] != F.get("xs", i - 1)["lang"]))
    one = forms.select("fun", F.transform(best, lambda x: F.struct(x["lang"].alias("lang"), x["form"].alias("form"))).alias("said"))
    asked = exprs.groupBy("id", "expr").agg(F.sort_array(F.collect_list("lang")).alias("langs"))
    parts = asked.select("id", "langs", F.posexplode_outer(functions(F.col("expr"))).alias("pos", "fun"))
    parts = parts.select("id", F.get("langs", 0).alias("key"), F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("langs")).alias("langs"), "pos", "fun").repartition(n, "fun").join(one, "fun", "left")
    lists = parts.repartition(n, "id").groupBy("id", "key").agg(F.max("langs").alias("langs"), F.sort_array(F.collect_list(F.struct("pos", "fun", "said"))).alias("ps"))
    own = lambda p: F.get(F.filter(p["said"], lambda s: s["lang"] == F.col("lang")), 0)["form"]
    word = lambda p: F.coalesce(own(p), F.concat(F.lit("["), p["fun"], F.lit("]")))
    said = lists.select("id", F.explode("langs").alias("lang"), F.filter("ps", lambda p: p["pos"].isNotNull()).alias("ps"))
    return said.select("id", "lang", F.array_join(F.transform("ps", word), " ").alias("text"))


def lexeme_details(asked: DataFrame, lexemes: DataFrame, domains: DataFrame, examples: DataFrame) -> DataFrame:
    """What a matched lexeme (fun) carries: domains (id, name), images, its own examples, other examples
    that name it, and pointers to lexemes (sym, fun). lexemes as in the model, examples(id, funs), or (id, fun),
    a row a function that an example names."""
    own = lexemes.join(asked.select("fun").distinct(), "fun", "left_semi")

    def listed(rows: DataFrame, name: str, *cols: str) -> DataFrame:
        item = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
        return rows.repartition("fun").groupBy("fun").agg(F.array_sort(F.collect_set(item)).alias(name))

    dom = own.select("fun", F.explode("domain_ids").alias("domain_id")).join(domains.select(F.col("id").alias("domain_id"), "name"), "domain_id")
    first = own.select("fun", F.explode("example_ids").alias("example")).join(examples.select(F.col("id").alias("example")).distinct(), "example")
    named = examples if "fun" in examples.columns else examples.select("id", F.explode(F.array_distinct("funs")).alias("fun"))
    named = named.select(F.col("id").alias("example"), "fun").join(own.select("fun").distinct(), "fun", "left_semi")
    more = named.join(first.select("fun", "example"), ["fun", "example"], "left_anti")
    ptr = own.select("fun", F.explode("pointers").alias("p")).join(lexemes.select(F.col("id").alias("to"), F.col("fun").alias("target")), F.col("p.tgt") == F.col("to"))
    out = own.select("fun", "images")
    for rows, name, cols in ((dom, "domains", ("domain_id", "name")), (first, "primary", ("example",)), (more, "secondary", ("example",)), (ptr.select("fun", F.col("p.sym").alias("sym"), "target"), "pointers", ("sym", "target"))):
        out = out.join(listed(rows, name, *cols), "fun", "left")
    return out


def member_frames(lexemes: DataFrame, frames: DataFrame, classes: DataFrame) -> DataFrame:
    """(fun, frames): frame id, pattern and semantics with the name of the base class, of each lexeme."""
    j = lexemes.select("fun", "frame_ids").repartition("fun").select("fun", F.explode("frame_ids").alias("frame_id")).join(frames.withColumnRenamed("id", "frame_id"), "frame_id")
    j = j.join(classes.select(F.col("id").alias("base_class_id"), F.col("name").alias("class")), "base_class_id")
    return j.groupBy("fun").agg(F.array_sort(F.collect_set(F.struct("class", "frame_id", "pattern", "semantics"))).alias("frames"))


def sense_objects(questions: DataFrame, lexemes: DataFrame, synsets: DataFrame, domains: DataFrame, examples: DataFrame, frames: DataFrame, classes: DataFrame) -> DataFrame:
    """The whole answer to a sense lookup: (synset_id, gloss, members), each member with status and
    frames, the asked ones also with their details. Lexemes are written once with a mark of the asked ones, and members
    keep their columns, so no part of the answer makes the lexemes again. A lexeme without synset is a sense of its own,
    as in ``sense_lookup``."""
    asked = questions.select("fun").distinct()
    marked = asked.withColumn("asked", F.lit(True))
    cols = ("id", "fun", "synset_id", "status", "images", "domain_ids", "example_ids", "frame_ids", "pointers")
    lex = settled(lexemes.select(*cols).join(marked, "fun", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    own = lex.filter("asked")
    wanted = own.filter("synset_id is not null").select("synset_id").distinct()
    part = ("fun", "asked", "status", "frame_ids")
    members = lex.join(wanted, "synset_id", "left_semi").select("synset_id", *part)
    lone = numbered_rows(own.filter("synset_id is null").select("id", *part), F.col("id"))
    members = members.unionByName(lone.select((F.lit(5_000_000) + F.col("row_no")).alias("synset_id"), *part))
    rows = members.join(member_frames(members.select("fun", "frame_ids"), frames, classes), "fun", "left").join(lexeme_details(asked, lex, domains, examples), "fun", "left")
    said = ("fun", "asked", "frames", "domains", "primary", "secondary", "pointers")
    member = F.struct(*said[:2], F.to_json("status").alias("status"), *said[2:], F.to_json("images").alias("images"))
    # lists are gathered once their rows are together: before, there is nothing to gather, and it sorts wide rows
    out = rows.repartition("synset_id").groupBy("synset_id").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return out.join(synsets.select(F.col("id").alias("synset_id"), "gloss"), "synset_id", "left").select("synset_id", "gloss", "members")


def class_frames(ids: DataFrame, classes: DataFrame, frames: DataFrame, reach: DataFrame) -> DataFrame:
    """(root, id, name, super_id, frame_id, pattern, semantics): the classes of ``class_objects``, a row a frame."""
    roots = ids.select(F.col("id").alias("root")).distinct()
    under = roots.join(reach.select(F.col("anc").alias("root"), F.col("src").alias("id")), "root").unionByName(roots.select("root", F.col("root").alias("id")))
    f = frames.select(F.col("id").alias("frame_id"), F.col("class_id").alias("id"), "pattern", "semantics")
    return under.join(classes.select("id", "name", "super_id"), "id").join(f, "id", "left").select("root", "id", "name", "super_id", "frame_id", "pattern", "semantics")


def frame_lexemes(lexemes: DataFrame) -> DataFrame:
    """(frame_id, fun): the lexemes that name a frame, a row each; a frame may have any number of them."""
    return lexemes.select(F.explode("frame_ids").alias("frame_id"), "fun").distinct()


def class_objects(ids: DataFrame, classes: DataFrame, frames: DataFrame, lexemes: DataFrame, reach: DataFrame) -> DataFrame:
    """(root, id, name, super_id, frames) of the asked classes (id) and all classes under them; each
    frame has the lexemes that name it. reach is the closure (src, anc) over super_id."""
    roots = ids.select(F.col("id").alias("root")).distinct()
    under = roots.join(reach.select(F.col("anc").alias("root"), F.col("src").alias("id")), "root").unionByName(roots.select("root", F.col("root").alias("id")))
    named = lexemes.select("fun", F.explode("frame_ids").alias("frame_id")).groupBy("frame_id").agg(F.array_sort(F.collect_set("fun")).alias("funs"))
    f = frames.select(F.col("id").alias("frame_id"), F.col("class_id").alias("id"), "pattern", "semantics").join(named, "frame_id", "left")
    f = f.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "pattern", "semantics", "funs"))).alias("frames"))
    return under.join(classes.select("id", "name", "super_id"), "id").join(f, "id", "left").select("root", "id", "name", "super_id", "frames")


def class_trees(flat: DataFrame, reach: DataFrame) -> DataFrame:
    """(root, tree): the rows of ``class_objects`` as one JSON object a root, classes with their subclasses inside
    in the order of ids, put together from the deepest level up. reach has the distance over super_id, and is
    that of a forest; a tree is one row."""
    depth = reach.select(F.col("anc").alias("root"), F.col("src").alias("id"), "dist")
    rows = settled(flat.join(depth, ["root", "id"], "left").withColumn("dist", F.coalesce("dist", F.lit(0))))
    frames = F.coalesce("frames", F.array().cast(rows.schema["frames"].dataType)).alias("frames")
    rows = rows.select("root", "id", "super_id", "dist", F.to_json(F.struct("id", "name", frames)).alias("own"))
    deepest = rows.agg(F.max("dist")).first()[0]
    inside = rows.select("root", "id", F.lit("").alias("inside")).limit(0)
    for d in range(deepest or 0, -1, -1):
        here = rows.filter(F.col("dist") == d).join(inside, ["root", "id"], "left")
        tree = F.concat(F.expr("left(own, length(own) - 1)"), F.lit(',"subclasses":['), F.coalesce("inside", F.lit("")), F.lit("]}"))
        here = settled(here.select("root", "id", "super_id", tree.alias("tree")))
        each = F.sort_array(F.collect_list(F.struct("id", "tree")))
        inside = here.groupBy("root", F.col("super_id").alias("id")).agg(F.array_join(F.transform(each, lambda x: x["tree"]), ",").alias("inside"))
    return here.select("root", "tree")


def typed_expressions(wanted: DataFrame, found: DataFrame, cats: DataFrame) -> DataFrame:
    """(qid, lang, cat, exprs): of the expressions found (qid, lang, expr), those of the asked category
    (wanted has qid, lang, cat), several being alternatives; cats(expr, cat). Without one, an empty list."""
    hit = wanted.join(found.join(cats, "expr"), ["qid", "lang", "cat"]).groupBy("qid", "lang", "cat").agg(F.array_sort(F.collect_set("expr")).alias("exprs"))
    return wanted.distinct().join(hit, ["qid", "lang", "cat"], "left").select("qid", "lang", "cat", F.coalesce("exprs", F.array().cast("array<string>")).alias("exprs"))


def verb_frame(instances: DataFrame, clicks: DataFrame) -> DataFrame:
    """Role highlighting: of an expression's frame instances (expr_id, frame, roles) the first whose Verb
    is the clicked node, as (expr_id, fid, frame, role, role_fid); clicks(expr_id, fid). Of instances of the same
    frame a column nth, if there is one, tells the first."""
    j = clicks.join(instances, "expr_id").filter(F.try_element_at("roles", F.lit("Verb")) == F.col("fid"))
    one = j.groupBy("expr_id", "fid").agg(F.min_by("roles", F.struct("frame", *(c for c in ("nth",) if c in instances.columns))).alias("roles"), F.min("frame").alias("frame"))
    return one.select("expr_id", "fid", "frame", F.explode("roles").alias("role", "role_fid"))


def senses_of_forms(questions: DataFrame, lexicon: DataFrame, lexemes: DataFrame, synsets: DataFrame) -> DataFrame:
    """The lookup chain of an editor plug-in: forms (lang, form) to distinct lemmas, their senses, and what
    the language says for each sense: (lang, form, fun, gloss, said)."""
    hits = questions.select("lang", "form").distinct().join(lexicon, ["lang", "form"]).select("lang", "form", "fun").distinct()
    senses = hits.join(lexemes.select("fun", "synset_id"), "fun").join(synsets.select(F.col("id").alias("synset_id"), "gloss"), "synset_id")
    said = lexicon.join(lexemes.select("fun", "synset_id"), "fun").groupBy("lang", "synset_id").agg(F.array_sort(F.collect_set("form")).alias("said"))
    return senses.join(said, ["lang", "synset_id"]).select("lang", "form", "fun", "gloss", "said")
