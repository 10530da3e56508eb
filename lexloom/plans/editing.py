"""Queries of candidate handling, name building, the edit workflow and tree output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import constructors, dependencies, kb
from lexloom.operators import edits as ed
from lexloom.operators import matching, ranking, stats
from lexloom.plans.lexical import CANDIDATES, candidates
from lexloom.plans.views import view, with_views
from lexloom.session import table
from lexloom.sources import resources

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


@query("""
WITH h AS (SELECT DISTINCT l_partkey AS fun, l_linestatus AS lang, concat('F', l_suppkey) AS lin FROM lineitem WHERE l_returnflag = 'A'),
n AS (SELECT DISTINCT l_partkey AS fun, l_linestatus AS lang, concat('f', l_suppkey) AS lin FROM lineitem WHERE l_linenumber > 1)
SELECT coalesce(h.fun, n.fun) AS fun, coalesce(h.lang, n.lang) AS lang, coalesce(h.lin, n.lin) AS lin, CASE WHEN n.fun IS NOT NULL THEN 0 ELSE 1 END AS o, 1 AS s
FROM h FULL JOIN n ON h.fun = n.fun AND h.lang = n.lang AND lower(h.lin) = lower(n.lin)""")
def candidate_merge(spark, d):
    li = table(spark, d, "lineitem")
    have = li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("fun"), F.col("l_linestatus").alias("lang"), F.concat(F.lit("F"), "l_suppkey").alias("lin"), F.lit(1).alias("o"), F.lit(1).alias("s")).distinct()
    new = li.filter("l_linenumber > 1").select(F.col("l_partkey").alias("fun"), F.col("l_linestatus").alias("lang"), F.concat(F.lit("f"), "l_suppkey").alias("lin"))
    return ranking.merge_candidates(have, new, "o")


@query("""
WITH g AS (SELECT o_custkey AS qid, min_by(concat('g', o_orderkey % 50), o_orderkey) AS f FROM orders WHERE o_orderkey % 50 < 25 GROUP BY 1),
s AS (SELECT o_custkey AS qid, min_by(concat('s', o_orderkey % 30), o_orderkey) AS f FROM orders WHERE o_orderkey % 30 < 10 GROUP BY 1)
SELECT coalesce(g.qid, s.qid) AS qid, CASE WHEN g.f IS NOT NULL AND s.f IS NOT NULL THEN 'FullName ' || g.f || ' ' || s.f WHEN g.f IS NOT NULL THEN 'GivenName ' || g.f ELSE 'UseSurname ' || s.f END AS expr
FROM g FULL JOIN s ON g.qid = s.qid""")
def person_names(spark, d):
    """A customer's orders as name claims in their order; only some names are known."""
    o = table(spark, d, "orders")
    key = lambda n: F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k % n)
    people = o.groupBy(F.col("o_custkey").alias("qid")).agg(key(50).alias("given"), key(30).alias("family"))
    names = lambda c, n: spark.range(n).select(F.col("id").alias("name"), F.concat(F.lit(c), "id").alias("fun"))
    return ranking.person_names(people, names("g", 25), names("s", 10))


@query("""
SELECT DISTINCT a.p_name AS txt, c.p_name AS target, CASE WHEN y.l_linenumber IN (1, 2) THEN y.l_linenumber::BIGINT END AS class
FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey JOIN part a ON a.p_partkey = x.l_partkey JOIN part c ON c.p_partkey = y.l_partkey""")
def shared_meanings(spark, d):
    """Orders as meanings, lines as denotations of parts; a denotation's class is its line number."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    den = li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("meaning"), F.col("l_partkey").alias("expr"), F.col("l_linenumber").cast("long").alias("expr2"))
    cls = den.select(F.col("id").alias("denotation"), "expr2")
    expr = part.select(F.col("p_partkey").alias("id"), F.lit(1).alias("langvar"), F.col("p_name").alias("txt"))
    meaning = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    out = ranking.panlex_pairs(den.drop("expr2"), cls, meaning, expr, 1, part.select(F.col("p_name").alias("txt")).distinct(), [1, 2])
    return out.select("txt", "target", "class").distinct()


@query("""
SELECT qid, image FROM (SELECT c_custkey AS qid, concat('i', o_orderkey) AS image, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, concat('i', o_orderkey)) AS r
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) x WHERE r = 1""")
def image_choice(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("property"), F.concat(F.lit("i"), "o_orderkey").alias("image"))
    o = o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("qid")), "qid")
    return ranking.image_rank(o, ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("qid", "image")


@query("""
WITH p AS (SELECT l_orderkey AS key, concat('c', l_linenumber) AS choice, l_discount AS p FROM lineitem), m AS (SELECT key, max(round(p, 6)) AS m FROM p GROUP BY key)
SELECT p.key, string_agg(choice, ' ' ORDER BY choice) FILTER (round(p, 6) = m) AS first,
  coalesce(string_agg(choice, ' ' ORDER BY round(p, 6) DESC, choice) FILTER (round(p, 6) < m), '') AS rest FROM p JOIN m ON m.key = p.key GROUP BY p.key""")
def ranked_choices(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("c"), "l_linenumber").alias("choice"), F.col("l_discount").alias("p"))
    return ranking.ranked_choices(p).select("key", F.array_join("first", " ").alias("first"), F.array_join("rest", " ").alias("rest"))


@query(f"""
SELECT lin, s FROM (SELECT lin, s, fun, sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY fun) AS n FROM ({CANDIDATES}) x) y WHERE n = 0 OR s = 0""")
def rule_with_fallback(spark, d):
    return ranking.restrict(candidates(spark, d), "fun", F.col("s") == 0).select("lin", "s")


@query("""
SELECT l_orderkey AS token, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS funs FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def sense_key_chain(spark, d):
    """Order to part key to name, as sense key to synset to lexemes."""
    tok = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("token"), F.concat(F.lit("k"), "l_partkey").alias("sense_key"))
    part = table(spark, d, "part")
    idx = part.select(F.concat(F.lit("k"), "p_partkey").alias("sense_key"), F.concat(F.lit("o"), "p_partkey").alias("offset"))
    lex = part.select(F.col("p_name").alias("fun"), F.concat(F.lit("o"), "p_partkey").alias("offset"))
    return ranking.gold_keys(tok, idx, lex).select("token", F.array_join("funs", ",").alias("funs"))


LINES = "SELECT p_partkey AS line_no, concat('p', p_partkey, '_N') AS fun, 'lin p' || p_partkey || '_N = mkN \"' || p_name || '\" ; --guessed' AS text FROM part"


def lines(spark, d) -> DataFrame:
    v = F.concat(F.lit("lin p"), "p_partkey", F.lit('_N = mkN "'), "p_name", F.lit('" ; --guessed'))
    return table(spark, d, "part").select(F.lit("x").alias("lang"), F.col("p_partkey").alias("line_no"), F.concat(F.lit("p"), "p_partkey", F.lit("_N")).alias("fun"), v.alias("text"))


@query(f"""
SELECT line_no, CASE WHEN fun IN (SELECT concat('p', l_partkey, '_N') FROM lineitem WHERE l_returnflag = 'R') THEN regexp_replace(text, '\\s*--.*$', '') ELSE text END AS text FROM ({LINES}) l""")
def annotate_checked(spark, d):
    named = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("p"), "l_partkey", F.lit("_N")).alias("fun"))
    return ed.annotate(lines(spark, d), named).select("line_no", "text")


@query(f"""
WITH c AS (SELECT concat('p', fun, '_N') AS fun, max(CASE WHEN s <> 0 THEN 1 ELSE 0 END) AS any_new, min(lin) AS def FROM ({CANDIDATES}) x GROUP BY fun)
SELECT line_no, CASE WHEN any_new = 1 THEN 'lin ' || l.fun || ' = ' || def || ' ;' ELSE text END AS text FROM ({LINES}) l LEFT JOIN c ON c.fun = l.fun""")
def apply_predictions(spark, d):
    p = candidates(spark, d).select(F.concat(F.lit("p"), "fun", F.lit("_N")).alias("fun"), F.lit("x").alias("lang"), F.col("s").alias("o"), F.col("lin").alias("def"))
    return ed.apply_predictions(lines(spark, d), p).select("line_no", "text")


@query("SELECT fun, gloss AS text FROM (SELECT concat('p', p_partkey, '_N') AS fun, 'mkN \"' || p_name || '\"' AS gloss FROM part)")
def concrete_lexicon_parse(spark, d):
    return resources.concrete_lexicon(lines(spark, d).select(F.col("text").alias("value")), "x").select("fun", F.col("def").alias("text"))


@query("SELECT DISTINCT l_partkey AS fun, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part)) x GROUP BY l_partkey")
def load_relations(spark, d):
    """A part's suppliers, read as names of parts, become pointers where that part exists."""
    lex = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("x"), "p_partkey").alias("fun"), F.array().cast("array<struct<sym:string,tgt:bigint>>").alias("pointers"))
    rel = table(spark, d, "lineitem").select(F.concat(F.lit("x"), "l_partkey").alias("fun"), F.lit("Derived").alias("sym"), F.concat(F.lit("x"), "l_suppkey").alias("target")).distinct()
    out = ed.load_relations(lex, rel).filter(F.size("pointers") > 0)
    return out.select(F.col("id").alias("fun"), F.size("pointers").cast("long").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT concat('o', l_suppkey) AS off FROM lineitem WHERE concat('o', l_suppkey) NOT IN (SELECT concat('o', s_suppkey) FROM supplier WHERE s_nationkey < 12))
SELECT off AS "offset", row_number() OVER (ORDER BY off) + (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey < 12) AS id FROM m""")
def missing_synsets(spark, d):
    lex = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_suppkey").alias("offset"))
    syn = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.concat(F.lit("o"), "s_suppkey").alias("offset"), F.col("s_suppkey").alias("id"))
    return ed.missing_synsets(lex, syn)


@query("SELECT head, mod, round(n + 0.002 * ph * pm, 9) AS p FROM (SELECT p_brand AS head, p_type AS mod, count(*) AS n FROM part GROUP BY 1, 2) b JOIN (SELECT p_brand AS h, count(*) / sum(count(*)) OVER () AS ph FROM part GROUP BY 1) x ON h = head JOIN (SELECT p_type AS m, count(*) / sum(count(*)) OVER () AS pm FROM part GROUP BY 1) y ON m = mod WHERE n + 0.002 * ph * pm > 0.00001")
def smoothed_bigrams(spark, d):
    part = table(spark, d, "part")
    total = part.count()
    heads = part.groupBy(F.col("p_brand").alias("head"), F.col("p_type").alias("mod")).agg(F.count("*").alias("n"))
    uni = part.select(F.explode(F.array("p_brand", "p_type")).alias("fun")).groupBy("fun").agg((F.count("*") / total).alias("p"))
    return stats.cut_off(stats.smoothed_bigrams(heads, uni), 1.0).select("head", "mod", F.round("p", 9).alias("p"))


@query("SELECT l_suppkey AS cat, round(-ln(sum(exp(-l_discount))), 6) AS mass FROM lineitem GROUP BY l_suppkey")
def category_mass(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cat")).agg(F.round(stats.log_sum(F.col("l_discount")), 6).alias("mass"))


@query("""
SELECT l_orderkey AS sent, string_agg('c' || l_linenumber, ' ' ORDER BY l_linenumber) AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) x GROUP BY l_orderkey""")
def treebank_lines(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("pos"), F.array(F.concat(F.lit("c"), "l_linenumber")).alias("first"), F.array().cast("array<string>").alias("rest")).distinct()
    return resources.treebank(c)


@query("""
SELECT o_orderkey AS id, 'PredVP p' || o_custkey || '_NP (ComplV2 v' || (o_orderkey % 7) || '_V2 o_NP)' AS tree FROM orders""")
def constructed_clauses(spark, d):
    """Clauses of a customer, a verb and an object; a clause's shape is built once and filled in."""
    shape = constructors.construct("mkCl", ("NP", "SUBJECT"), ("V2", "VERB"), ("NP", "o_NP"))
    fill = F.replace(F.replace(F.lit(shape), F.lit("SUBJECT"), F.concat(F.lit("p"), "o_custkey", F.lit("_NP"))), F.lit("VERB"), F.concat(F.lit("v"), F.col("o_orderkey") % 7, F.lit("_V2")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fill.alias("tree"))


# the words of three shapes of clauses: (node, fun, head, label)
@query("""
WITH e AS (SELECT o_orderkey AS id, o_orderkey % 3 AS shape, 'p' || o_custkey AS p FROM orders)
SELECT id, r[1]::INT AS node, r[2] AS fun, r[3]::INT AS head, r[4] AS label FROM (SELECT id, unnest(CASE shape
  WHEN 0 THEN [(2, p, 4, 'nsubj'), (4, 'see', 0, 'root'), (5, 'it', 4, 'obj')]
  WHEN 1 THEN [(3, p, 12, 'nsubj'), (4, 'old', 3, 'dep'), (10, 'not', 12, 'anchor'), (12, 'see', 0, 'root'), (14, 'a', 15, 'rel'), (15, 'cat', 12, 'obj')]
  ELSE [(4, p, 0, 'root'), (5, 'b', 4, 'dep'), (6, 'c', 4, 'dep'), (7, 'd', 4, 'dep')] END) AS r FROM e)""")
def dependency_rows(spark, d):
    """A plain clause; one with tense and polarity skipped and a modified subject; functions without pragmas, nested."""
    rules = [("PredVP", [("mod", "nsubj"), ("head", None)]), ("ComplV2", [("head", None), ("mod", "obj")]), ("UseCl", [("skip", None), ("skip", None), ("head", None)]), ("AdvVP", [("anchor", None), ("head", None)]), ("DetCN", [("rel", None), ("head", None)])]
    rules = spark.createDataFrame(rules, "fun string, pragmas array<struct<kind:string,label:string>>")
    p = F.concat(F.lit("p"), "o_custkey")
    shapes = (F.concat(F.lit("PredVP "), p, F.lit(" (ComplV2 see it)")), F.concat(F.lit("PredVP (Adj "), p, F.lit(" old) (UseCl (TT past) pos (AdvVP not (ComplV2 see (DetCN a cat))))")), F.concat(F.lit("F (G (H "), p, F.lit(" b) c) d")))
    k = F.col("o_orderkey") % 3
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).otherwise(shapes[2]).alias("expr"))
    return dependencies.to_dependencies(e, ["id"], rules)


@query("SELECT l_orderkey AS sent, l_linenumber AS pos, concat('f', l_partkey) AS fun FROM lineitem GROUP BY 1, 2, 3")
def morphology_lookup(spark, d):
    """Forms in capitals are found by their small letters where the form itself is unknown."""
    li = table(spark, d, "lineitem")
    form = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("W"), "l_partkey")).otherwise(F.concat(F.lit("w"), "l_partkey"))
    tok = li.select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("pos"), form.alias("form"))
    lex = table(spark, d, "part").select(F.concat(F.lit("w"), "p_partkey").alias("form"), F.concat(F.lit("f"), "p_partkey").alias("fun"), F.lit("sg").alias("analysis"))
    return matching.analyses(tok, lex).select("sent", "pos", "fun")


@query("SELECT p_brand AS header, count(*) AS n, min(p_partkey) AS first_pos FROM part GROUP BY p_brand")
def rows_by_header(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.array("p_brand").alias("headers"), F.array(kb.render(F.col("p_size"))).alias("cells"))
    return kb.grouped_by_header(r).select(F.get("headers", 0).alias("header"), F.size("rows").cast("long").alias("n"), "first_pos")
