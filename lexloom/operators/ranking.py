"""Ranking of senses and of translation candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import settled


def name_key(fun: Column) -> Column:
    """struct(base, cat, sense): category behind the last underscore; sense the digits of the segment
    before it (0 without any); base the rest without that number: go_on_2_V has base go_on, sense 2."""
    cat = F.regexp_extract(fun, "([^_]*)$", 1)
    rest = F.regexp_replace(fun, "_[^_]*$", "")
    part = F.regexp_extract(rest, "_([^_]*)$", 1)
    digits = F.regexp_replace(part, r"\D", "")
    return F.struct(
        F.when(part == "", rest).otherwise(F.regexp_replace(rest, "_[^_]*$", "")).alias("base"),
        cat.alias("cat"),
        F.when(digits == "", F.lit(0)).otherwise(F.try_to_number(digits, F.lit("999999999")).cast("int")).alias("sense"),
    )


def ranked_senses(members: DataFrame) -> DataFrame:
    """members(synset_id, fun, asked): rank of a lexeme in its sense (asked ones first, then base,
    category, sense number, name), and of a sense by its first lexeme's key."""
    k = members.withColumn("key", F.struct((~F.col("asked")).alias("other"), name_key(F.col("fun")).alias("k"), F.col("fun").alias("name")))
    inner = F.row_number().over(Window.partitionBy("synset_id").orderBy("key"))
    first = k.groupBy("synset_id").agg(F.min("key").alias("first"))
    return k.withColumn("lex_rank", inner).join(first, "synset_id").select("synset_id", "fun", "asked", "lex_rank", "first")


def best_candidates(c: DataFrame, key: tuple[str, ...] = ("fun", "lang")) -> DataFrame:
    """The first candidate of each key by (s up, c down, l down, w up, d up), then its form."""
    w = Window.partitionBy(*key).orderBy(F.asc("s"), F.desc("c"), F.desc("l"), F.asc("w"), F.asc("d"), F.asc("lin"))
    return c.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def candidate_status(s: Column, w: Column, supp: Column) -> Column:
    """checked if s=0, or s=1 with more than one source, or w=0 with more than one source, or
    w=0 with s=1; unchecked if s=1; guessed otherwise."""
    sure = (s == 0) | ((s == 1) & (supp > 1)) | ((w == 0) & (supp > 1)) | ((w == 0) & (s == 1))
    return F.when(sure, "checked").when(s == 1, "unchecked").otherwise("guessed")


def feature_filter(c: DataFrame, key: str = "token") -> DataFrame:
    """Candidates of each token with the highest score, among them those with the least count; ties stay."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("cnt"))
    return c.withColumn("rk_", F.rank().over(w)).filter("rk_ = 1").drop("rk_")


def ranked_choices(posteriors: DataFrame, digits: int = 6) -> DataFrame:
    """(key, first, rest): choices of the highest posterior, and the others by posterior."""
    w = Window.partitionBy("key").orderBy(F.desc(F.round("p", digits)))
    r = posteriors.withColumn("rk", F.dense_rank().over(w))
    return r.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("rk") == 1, F.col("choice")))).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rk") > 1, F.struct("rk", "choice")))), lambda x: x["choice"]).alias("rest"),
    )


def cooccurrence_support(senses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fun, lang, lin, c): over the other languages' candidates of the same function, the number of
    senses that hold both forms; senses(lang, sense, lin), candidates(fun, lang, lin)."""
    a = candidates.select("fun", "lang", "lin").distinct()
    b = a.select("fun", F.col("lang").alias("lang2"), F.col("lin").alias("lin2"))
    w = senses.select("lang", "sense", "lin").distinct()
    w2 = w.select(F.col("lang").alias("lang2"), "sense", F.col("lin").alias("lin2"))
    # forms that share a sense are few; pairs of candidates of one function may be many
    both = w.join(w2, "sense").filter("lang <> lang2").groupBy("lang", "lin", "lang2", "lin2").agg(F.count("*").alias("n"))
    hit = both.join(a, ["lang", "lin"]).join(b, ["fun", "lang2", "lin2"]).groupBy("fun", "lang", "lin").agg(F.sum("n").alias("c"))
    return a.join(hit, ["fun", "lang", "lin"], "left").select("fun", "lang", "lin", F.coalesce("c", F.lit(0)).alias("c"))


def translation_support(denotations: DataFrame) -> DataFrame:
    """(expr2, l): distinct source expressions behind each target; denotations(expr1, expr2)."""
    return denotations.groupBy("expr2").agg(F.count_distinct("expr1").cast("long").alias("l"))


def panlex_pairs(denotation: DataFrame, denotation_class: DataFrame, meaning: DataFrame, expr: DataFrame, langvar: int, wanted: DataFrame, codes: list[int]) -> DataFrame:
    """(txt, target, class): expressions that share a meaning with the wanted texts (txt) of one
    variety; the class, where one of the codes, of the target's denotation."""
    src = expr.filter(F.col("langvar") == langvar).join(wanted.select("txt"), "txt").select(F.col("id").alias("e1"), "txt")
    d1 = denotation.select("meaning", F.col("expr").alias("e1"))
    d2 = denotation.select("meaning", F.col("expr").alias("e2"), F.col("id").alias("den2"))
    classes = denotation_class.filter(F.col("expr2").isin(codes)).select(F.col("denotation").alias("den2"), F.col("expr2").alias("class"))
    j = src.join(d1, "e1").join(d2, "meaning").filter("e1 <> e2").join(meaning.select(F.col("id").alias("meaning")), "meaning")
    j = j.join(classes, "den2", "left").join(expr.select(F.col("id").alias("e2"), F.col("txt").alias("target"), F.col("langvar").alias("target_langvar")), "e2")
    return j.select("txt", "target", "target_langvar", "class").distinct()


def merge_candidates(have: DataFrame, new: DataFrame, flag: str) -> DataFrame:
    """have(fun, lang, lin, flags...) with the flag set to 0 where a new form (fun, lang, lin) agrees
    but for case; other new forms are appended with the flag at 0 and the rest at 1."""
    flags = [c for c in have.columns if c not in ("fun", "lang", "lin")]
    n = new.select("fun", "lang", F.lower("lin").alias("low_"), "lin").groupBy("fun", "lang", "low_").agg(F.min("lin").alias("new_lin"))
    j = have.withColumn("low_", F.lower("lin")).join(n, ["fun", "lang", "low_"], "full")
    both = F.col("new_lin").isNotNull()
    value = lambda c: F.when(both & F.lit(c == flag), F.lit(0)).otherwise(F.coalesce(c, F.lit(1))).alias(c)
    return j.select("fun", "lang", F.coalesce("lin", "new_lin").alias("lin"), *(value(c) for c in flags))


# What each source writes of a candidate: flags where a form is known already, and of a new one.
SOURCES = {
    "wikidata": ({"w": 0}, {"o": 1, "s": 2, "w": 0, "l": 0, "c": 0}),
    "wiktionary": ({"s": 0, "w": 0}, {"o": 1, "s": 0, "w": 0, "l": 0, "c": 0}),
}


def merge_source(have: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """have(fun, lang, lin, o, s, w, l, c) and the forms (fun, lang, lin) of a source: forms that agree
    but for case take the source's flags, others are appended."""
    known, fresh = SOURCES[source]
    n = new.groupBy("fun", "lang", F.lower("lin").alias("low_")).agg(F.min("lin").alias("new_"))
    j = have.withColumn("low_", F.lower("lin")).join(n, ["fun", "lang", "low_"], "full")
    value = lambda c: F.when(F.col("lin").isNull(), F.lit(fresh[c])).when(F.col("new_").isNotNull() & F.lit(c in known), F.lit(known.get(c))).otherwise(F.col(c)).alias(c)
    return j.select("fun", "lang", F.coalesce("lin", "new_").alias("lin"), *(value(c) for c in "oswlc"))


def merge_translations(have: DataFrame, new: DataFrame) -> DataFrame:
    """Translations (fun, lang, lin, l) with their support: known forms take it; of the new ones only
    those of the highest support of a function and language stay, as (1, 2, 1, l, 0)."""
    n = new.groupBy("fun", "lang", F.lower("lin").alias("low_")).agg(F.min("lin").alias("new_"), F.max("l").alias("sup_"))
    j = have.withColumn("low_", F.lower("lin")).join(n, ["fun", "lang", "low_"], "full")
    top = F.max(F.when(F.col("lin").isNull(), F.col("sup_"))).over(Window.partitionBy("fun", "lang"))
    j = j.withColumn("top_", top).filter(F.col("lin").isNotNull() | (F.col("sup_") == F.col("top_")))
    fresh = {"o": 1, "s": 2, "w": 1, "c": 0}
    return j.select("fun", "lang", F.coalesce("lin", "new_").alias("lin"), *(F.when(F.col("lin").isNull(), F.lit(fresh[c])).otherwise(F.col(c)).alias(c) if c in fresh else F.coalesce("sup_", "l").alias("l") for c in "oswlc"))


def image_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """One image of each entity: the first property of the order, then the first name."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("property"))
    w = Window.partitionBy("qid").orderBy(rank, "image")
    return rows.filter(rank > 0).withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def nearest_by_edits(rows: DataFrame, key: str, label: str, form: str) -> DataFrame:
    """For each key the row whose form is nearest to the label; ties go to the least form."""
    d = F.levenshtein(F.col(label), F.col(form))
    return rows.withColumn("dist", d).groupBy(key).agg(F.min_by(form, F.struct("dist", form)).alias(form), F.min("dist").alias("dist"))


def edit_segments(forms: DataFrame, column: str, k: int) -> DataFrame:
    """forms with size, place and segment: each form cut in k + 1 segments of nearly equal length, a row each."""
    n = F.length(column)
    start = lambda i: F.floor(n * i / (k + 1)).cast("int")
    cut = F.array(*[F.struct(F.lit(i).alias("place"), F.substr(column, start(i) + 1, start(i + 1) - start(i)).alias("segment")) for i in range(k + 1)])
    return forms.select("*", n.alias("size"), F.explode(cut).alias("x")).select(*forms.columns, "size", "x.*")


def edit_probes(forms: DataFrame, column: str, k: int) -> DataFrame:
    """forms with size, place and segment: the substrings that a form within k edits may have as a segment, by the
    length of that form and the segment's place, at most k characters off. Each comes once."""
    n = F.length(column)
    sizes = F.sequence(F.greatest(n - k, F.lit(0)), n + k)

    def probes(size: Column) -> Column:
        start = lambda i: F.floor(size * i / (k + 1)).cast("int")
        out = []
        for i in range(k + 1):
            length = start(i + 1) - start(i)
            for shift in range(-k, k + 1):
                at = start(i) + shift
                out.append(F.when((at >= 0) & (at + length <= n), F.struct(size.alias("size"), F.lit(i).alias("place"), F.substr(column, at + 1, length).alias("segment"))))
        return F.array(*out)

    each = F.array_distinct(F.filter(F.flatten(F.transform(sizes, probes)), lambda x: x.isNotNull()))
    return forms.select("*", F.explode(each).alias("x")).select(*forms.columns, "x.*")


def within_edits(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(a, b, dist): all forms a of left(a) and b of right(b) that are at most k edits apart. Of k + 1 segments of b
    one is whole in a, so the two meet in a join on segment, length and place before their distance is taken."""
    a, b = left.select("a").distinct(), right.select("b").distinct()
    met = edit_probes(a, "a", k).join(edit_segments(b, "b", k), ["size", "place", "segment"]).select("a", "b").distinct()
    return met.withColumn("dist", F.levenshtein("a", "b", k)).filter("dist >= 0")


def nearest_label(rows: DataFrame, labels: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, dist): for each form of rows(a) the nearest of labels(b), of equals the least, if one is at most ``most``
    edits away. What one edit finds is not sought again with more."""
    rows, out = rows.select("a").distinct(), None
    for k in range(1, most + 1):
        near = settled(within_edits(rows, labels, k).groupBy("a").agg(F.min(F.struct("dist", "b")).alias("x")).select("a", "x.b", "x.dist"))
        out = near if out is None else out.unionByName(near)
        rows = rows.join(near, "a", "left_anti")
    return out


def mirrored(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """A twin (fun, twin) gets the same image, and the other way round."""
    both = twins.select("fun", "twin").unionByName(twins.select(F.col("twin").alias("fun"), F.col("fun").alias("twin")))
    return rows.unionByName(rows.join(both, "fun").select(F.col("twin").alias("fun"), *[c for c in rows.columns if c != "fun"])).distinct()


def word_cloud(rows: DataFrame, n: int) -> DataFrame:
    """The n likeliest rows (fun, prob), their size scaled to 0..1 between least and most."""
    top = rows.orderBy(F.desc("prob"), "fun").limit(n)
    lim = top.agg(F.min("prob").alias("lo_"), F.max("prob").alias("hi_"))
    return top.join(F.broadcast(lim)).select("fun", "prob", F.when(F.col("hi_") > F.col("lo_"), (F.col("prob") - F.col("lo_")) / (F.col("hi_") - F.col("lo_"))).otherwise(1.0).alias("size"))


def nearest_word(cosines: DataFrame) -> DataFrame:
    """Of (a, b, cosine, dist) the best b for each a: highest cosine, then nearest, then least."""
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "dist", "b")
    return cosines.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def distance_over_languages(rows: DataFrame, spelled: Column | None = None) -> DataFrame:
    """(fun, lang, lin, d): least edit distance to the forms of the same function in other languages;
    null spellings (no transliteration) never compare. rows(fun, lang, lin, latin)."""
    del spelled
    b = rows.select("fun", F.col("lang").alias("lang2"), F.col("latin").alias("latin2"))
    j = rows.join(b, "fun").filter("lang <> lang2 and latin is not null and latin2 is not null")
    d = j.groupBy("fun", "lang", "lin").agg(F.min(F.levenshtein("latin", "latin2")).cast("long").alias("d"))
    return rows.select("fun", "lang", "lin").join(d, ["fun", "lang", "lin"], "left").select("fun", "lang", "lin", F.coalesce("d", F.lit(2**31 - 1)).alias("d"))


def person_names(people: DataFrame, given: DataFrame, family: DataFrame) -> DataFrame:
    """(qid, expr): first known given name with first known family name, else one of them;
    people(qid, given array, family array), given(name, fun), family(name, fun)."""
    def first(col: str, names: DataFrame, out: str) -> DataFrame:
        x = people.select("qid", F.posexplode(col).alias("pos", "name")).join(names, "name")
        return x.groupBy("qid").agg(F.min_by("fun", F.struct("pos", "fun")).alias(out))

    j = people.select("qid").join(first("given", given, "g"), "qid", "left").join(first("family", family, "f"), "qid", "left")
    expr = F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), F.concat(F.lit("FullName "), "g", F.lit(" "), "f"))
    expr = expr.when(F.col("g").isNotNull(), F.concat(F.lit("GivenName "), "g")).when(F.col("f").isNotNull(), F.concat(F.lit("UseSurname "), "f"))
    return j.select("qid", expr.alias("expr")).filter("expr is not null")


def label_in(labels: Column, languages: list[str]) -> Column:
    """The first of the languages that a map of labels has."""
    return F.coalesce(*(F.try_element_at(labels, F.lit(x)) for x in languages))


def restrict(rows: DataFrame, token: str, keep: Column) -> DataFrame:
    """Rows of each token that meet the rule; where none does, all of them."""
    n = F.sum(keep.cast("int")).over(Window.partitionBy(token))
    return rows.withColumn("keep_", keep).withColumn("n_", n).filter((F.col("n_") == 0) | F.col("keep_")).drop("keep_", "n_")


def annotated(rows: DataFrame, token: str) -> DataFrame:
    """Analyses of tokens, restricted rule by rule, each with its fallback: the analysis fits the tag
    (tag, analysis), then its particle or preposition stands in the sentence (particle, words; null needs none)."""
    fit = restrict(rows, token, F.coalesce(F.col("tag") == F.col("analysis"), F.lit(False)))
    return restrict(fit, token, F.col("particle").isNull() | F.array_contains("words", F.col("particle")))


# Tags with the analyses that contradict them; and for closed classes the analyses that a tag and
# a category take: they are kept as they are, or, behind a dash, only their function is.
CONTRADICTED = """
rb: s (AAdj Posit Nom)
vbd: s VPPart, s VInf
vbn: s VPast, s VInf
vb: s VPPart, s VPast
nn: s Pl Nom
nns: s Sg Nom
"""
CLOSED = """
pp$ Pron: s (NCase Gen)
ppo Pron - s (NCase Nom), s NPAcc
pps Pron - s (NCase Nom), s NPAcc
ppss Pron - s (NCase Nom), s NPAcc
in Prep: s
dtx Det: s
dt Quant - s False Sg, s True Sg
dts Quant - s False Pl, s True Pl
dti Quant - s False Sg, s False Pl, s True Sg, s True Pl
dti Det - s
at Quant - s False Sg, s False Pl, s True Sg, s True Pl
"""


def contradictions() -> list[tuple[str, str]]:
    return [(tag, x) for tag, xs in (line.split(": ") for line in CONTRADICTED.strip().split("\n")) for x in xs.split(", ")]


def closed_classes() -> list[tuple[str, str, str, bool]]:
    """(tag, cat, analysis, kept)."""
    out = []
    for line in CLOSED.strip().split("\n"):
        kept = ": " in line
        head, xs = line.split(": " if kept else " - ")
        out += [(*head.split(" "), x, kept) for x in xs.split(", ")]
    return out


def annotate(tokens: DataFrame, analyses: DataFrame, needs: DataFrame) -> DataFrame:
    """(sent, pos, fun, cat, analysis, ambiguous): what the tokens of a tagged corpus stand for.

    tokens(sent, pos, form, tag, funs), funs the functions of the token's sense, null without one; analyses(sent, pos, fun,
    cat, analysis, rank); needs(fun, words, s1, s2): the particles and prepositions that a function asks for, and both
    parts of a conjunction. A token with a sense takes its functions' analyses that agree with the tag, or else all of them, and
    of these the ones whose words all stand in the sentence. A token without one takes closed-class words by its
    tag; a conjunction of two parts whose other part is there too wins alone, the first by rank. Equal rows come once."""
    spark = tokens.sparkSession
    words = tokens.groupBy("sent").agg(F.collect_set("form").alias("said"))
    token = F.struct("sent", "pos").alias("token_")
    a = analyses.join(tokens.select("sent", "pos", "tag", "funs"), ["sent", "pos"]).join(words, "sent").join(needs, "fun", "left").select("*", token)
    of = ["sent", "pos", "fun", "cat", "analysis"]

    against = spark.createDataFrame(contradictions(), "tag string, analysis string").withColumn("against", F.lit(True))
    known = a.filter(F.array_contains("funs", F.col("fun"))).join(F.broadcast(against), ["tag", "analysis"], "left")
    known = restrict(known, "token_", F.col("against").isNull())
    there = lambda w: (w == "") | F.array_contains("said", w)
    known = known.filter(F.coalesce(F.forall("words", there), F.lit(True))).select(*of)

    plain = a.filter("funs is null")
    rules = spark.createDataFrame(closed_classes(), "tag string, cat string, analysis string, kept boolean")
    closed = plain.join(F.broadcast(rules), ["tag", "cat", "analysis"]).withColumn("analysis", F.when(F.col("kept"), F.col("analysis")).otherwise("_")).select(*of)
    article = tokens.filter("funs is null and tag = 'at' and lower(form) in ('a', 'an')").select("sent", "pos", F.lit("IndefArt").alias("fun"), F.lit("Quant").alias("cat"), F.lit("_").alias("analysis"))

    two = plain.filter("cat = 'Conj'")
    other = F.when(F.col("tag").isin("abx", "cc") & (F.col("analysis") == "s1"), F.col("s2")).when((F.col("tag") == "cc") & (F.col("analysis") == "s2"), F.col("s1"))
    whole = two.withColumn("other", other).filter((F.col("other") != "") & F.array_contains("said", F.col("other")))
    whole = whole.groupBy("sent", "pos").agg(F.min_by(F.struct("fun", "cat", "analysis"), F.struct("rank", "fun", "analysis")).alias("x")).select("sent", "pos", "x.*")
    alone = two.filter("tag = 'cc' and analysis = 's2' and coalesce(s1, '') = ''").select(*of)

    rest = closed.unionByName(alone).unionByName(article).join(whole.select("sent", "pos"), ["sent", "pos"], "left_anti")
    out = known.unionByName(rest).unionByName(whole).distinct()
    return out.withColumn("ambiguous", F.count("*").over(Window.partitionBy("sent", "pos")) > 1)


def gold_keys(tokens: DataFrame, sense_index: DataFrame, lexemes: DataFrame) -> DataFrame:
    """(token, funs): sense key to synset offset and tag to lexemes; tokens(token, sense_key),
    sense_index(sense_key, offset), lexemes(fun, offset)."""
    j = tokens.join(sense_index, "sense_key").join(lexemes.select("fun", "offset"), "offset")
    return j.groupBy("token").agg(F.array_sort(F.collect_set("fun")).alias("funs"))
