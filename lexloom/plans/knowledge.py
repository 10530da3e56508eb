"""Queries of knowledge-base functions, text, edits, readers, learning and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import kb, numerals, text, trees
from lexloom.functions.numerals import value as numeral_value
from lexloom.operators import edits as ed
from lexloom.operators import ranking, stats
from lexloom.plans.views import view, with_views
from lexloom.session import in_file_order, shared_dir, table
from lexloom.sources import resources, versions
from lexloom.streaming import tail

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


ENTITY = """'{"id":"Q' || event_id || '","labels":{"en":{"value":"e' || user_id || '"}},"claims":{"P1":[{"mainsnak":{"snaktype":"value","datatype":"quantity","datavalue":{"value":{"amount":"+' || CAST(event_id AS VARCHAR(20)) || '"}}},"qualifiers":{"P9":[{"snaktype":"value","datatype":"string","datavalue":{"value":"' || event_type || '"}}]}},{"mainsnak":{"snaktype":"' || CASE WHEN event_id % 3 = 0 THEN 'novalue' ELSE 'value' END || '","datatype":"quantity","datavalue":{"value":{"amount":"-7"}}}}]}}'"""


def entities(spark, d) -> DataFrame:
    own = ENTITY.replace("{", "{{").replace("}", "}}").replace("VARCHAR(20)", "STRING")
    return spark.sql(f"SELECT event_id, user_id, event_type, {own} AS json FROM {{events}}", events=table(spark, d, "events"))


@query("""
SELECT event_id, CAST(event_id AS DOUBLE) AS amount, concat('e', user_id) AS label FROM events
UNION ALL SELECT event_id, -7.0, concat('e', user_id) FROM events WHERE event_id % 3 <> 0""")
def json_claims(spark, d):
    e = entities(spark, d)
    c = kb.with_entity(e).select("event_id", F.explode(kb.claims(F.col("entity"), "P1")).alias("c"), kb.label(F.col("entity"), "de").alias("label"))
    return c.select("event_id", kb.decimal(kb.decoded(F.col("c.datatype"), F.col("c.value"))).alias("amount"), "label")


@query("SELECT event_id, event_type AS kind FROM events")
def json_qualifier(spark, d):
    c = kb.with_entity(entities(spark, d)).select("event_id", F.explode(kb.claims(F.col("entity"), "P1")).alias("c"))
    return c.select("event_id", F.explode(kb.qualifier(F.col("c"), "P9")).alias("kind"))


@query("""
SELECT event_id::VARCHAR AS qid, 'P1' AS prop, 0 AS pos, 'quantity' AS datatype, event_id::VARCHAR AS value, 'P9=' || event_type AS qualifiers FROM events
UNION ALL SELECT event_id::VARCHAR, 'P1', 1, 'quantity', '-7', '' FROM events WHERE event_id % 3 <> 0""")
def entity_statements(spark, d):
    """Untyped entities as rows: every statement with its decoded value and qualifiers, by exploding the variant."""
    out = kb.statements(entities(spark, d).select(F.col("event_id").cast("string").alias("qid"), "json"))
    return out.withColumn("qualifiers", F.array_join(F.transform("qualifiers", lambda q: F.concat(q["prop"], F.lit("="), q["value"])), ","))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey AS id, c_acctbal AS amount FROM customer UNION ALL SELECT -1 - c_custkey, NULL FROM customer")
def quantity_decimal(spark, d):
    c = table(spark, d, "customer")
    signed = F.concat(F.when(F.col("c_acctbal") >= 0, "+").otherwise(""), F.col("c_acctbal").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), kb.decimal(signed).alias("amount")).unionByName(c.select((-1 - F.col("c_custkey")).alias("id"), kb.decimal(F.concat(signed, F.lit("x"))).alias("amount")))


@query("SELECT p_partkey AS id, 'https://upload.wikimedia.org/wikipedia/commons/' || left(md5(f), 1) || '/' || left(md5(f), 2) || '/' || f AS url FROM (SELECT p_partkey, replace(p_name || ' ' || p_type || '.jpg', ' ', '_') AS f FROM part)")
def image_url_md5(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), kb.image_url(F.concat("p_name", F.lit("%20"), "p_type", F.lit(".jpg"))).alias("url"))


@query("SELECT o_orderkey AS id, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate)::INT END AS m, CASE WHEN o_orderkey % 3 > 1 THEN day(o_orderdate)::INT END AS dd FROM orders")
def iso_date_parts(spark, d):
    """Partial dates: every third has no month, every third no day."""
    k = F.col("o_orderkey") % 3
    t = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.when(k > 0, F.date_format("o_orderdate", "MM")).otherwise("00"), F.lit("-"), F.when(k > 1, F.date_format("o_orderdate", "dd")).otherwise("00"), F.lit("T00:00:00Z"))
    p = kb.time_parts(t)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("dd"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, list_reduce(list_prepend('(IDig D_' || right(l_partkey::VARCHAR, 1) || ')', list_reverse(string_split(left(l_partkey::VARCHAR, -1), ''))), lambda a, x: CASE WHEN x = '' THEN a ELSE '(IIDig D_' || x || ' ' || a || ')' END) AS tree FROM lineitem""")
def int_digits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), kb.int_digits(F.col("l_partkey")).alias("tree"))


@query("SELECT a, b, CAST(floor(a::DOUBLE / b) AS BIGINT) AS q, a - b * CAST(floor(a::DOUBLE / b) AS BIGINT) AS r FROM (SELECT DISTINCT l_partkey - 100 AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 1 ELSE -l_linenumber END::BIGINT AS b FROM lineitem)")
def floor_div_mod(spark, d):
    b = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") + 1).otherwise(-F.col("l_linenumber")).cast("long")
    x = table(spark, d, "lineitem").select((F.col("l_partkey") - 100).alias("a"), b.alias("b")).distinct()
    return x.select("a", "b", kb.floor_div(F.col("a"), F.col("b")).alias("q"), kb.floor_mod(F.col("a"), F.col("b")).alias("r"))


@query("SELECT DISTINCT l_quantity / 2 AS x, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS y FROM lineitem")
def bankers_round(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 2).alias("x")).distinct().select("x", kb.round_half_even(F.col("x"), 0).alias("y"))


@query("SELECT a, b, CASE WHEN x < y THEN 'LT' WHEN x = y THEN 'EQ' ELSE 'GT' END AS c FROM (SELECT a, b, s.p_size AS x, t.p_size AS y FROM pairs JOIN part s ON s.p_partkey = a JOIN part t ON t.p_partkey = b)")
def compare3(spark, d):
    size = table(spark, d, "part").select("p_partkey", "p_size")
    j = view(spark, d, "pairs").join(size.toDF("a", "x"), "a").join(size.toDF("b", "y"), "b")
    return j.select("a", "b", kb.compare(F.col("x"), F.col("y")).alias("c"))


@query("SELECT o_orderkey AS id, x, y FROM orders, (VALUES ('a'), ('b')) v(x), (VALUES (1), (2), (3)) w(y) WHERE o_orderkey % 2 = 0 OR y < 3")
def variants_cross(spark, d):
    """Two alternatives by two or three; the empty set of alternatives would give no row."""
    ys = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(*map(F.lit, (1, 2))))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("x"), ys.alias("y"))
    return kb.expand_variants(rows, "x", "y").select("id", "x", "y")


@query("SELECT DISTINCT l_partkey AS n, l_partkey BETWEEN 1 AND 999999999999 AS ok FROM lineitem")
def numeral_round_trip(spark, d):
    """Trees of numerals are read back by their value."""

    @F.pandas_udf("boolean")
    def same(n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([x is not None and numeral_value(x) == k for k, x in zip(n, t, strict=True)])

    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("n")).distinct()
    return n.select("n", same("n", numerals.numeral(F.col("n"))).alias("ok"))


BELOW_10 = "CASE WHEN {n} = 1 THEN 'pot01' ELSE '(pot0 n' || {n} || ')' END"
BELOW_100 = (
    "CASE WHEN {n} < 10 THEN '(pot0as1 ' || " + BELOW_10 + " || ')' WHEN {n} = 10 THEN 'pot110' WHEN {n} = 11 THEN 'pot111' WHEN {n} < 20 THEN '(pot1to19 n' || {n} - 10 || ')' "
    "WHEN {n} % 10 = 0 THEN '(pot1 n' || {n} // 10 || ')' ELSE '(pot1plus n' || {n} // 10 || ' ' || " + BELOW_10.replace("{n}", "({n} % 10)") + " || ')' END"
)


@query(f"""
WITH s AS (SELECT n, CASE WHEN n < 100 THEN '(pot1as2 ' || {BELOW_100.format(n="n")} || ')' WHEN n = 100 THEN 'pot21' WHEN n % 100 = 0 THEN '(pot2 ' || {BELOW_10.format(n="(n // 100)")} || ')'
  ELSE '(pot2plus ' || {BELOW_10.format(n="(n // 100)")} || ' ' || {BELOW_100.format(n="(n % 100)")} || ')' END AS t FROM range(1, 1000) r(n)),
o AS (SELECT o_orderkey AS n, o_orderkey // 1000 AS h, o_orderkey % 1000 AS r FROM orders)
SELECT o.n, CASE WHEN o.n > 0 THEN '(num (pot4as5 (pot3as4 ' || CASE WHEN o.h = 0 THEN '(pot2as3 ' || b.t || ')' WHEN o.r > 0 THEN '(pot3plus ' || a.t || ' ' || b.t || ')' WHEN o.h = 1 THEN 'pot31' ELSE '(pot3 ' || a.t || ')' END || ')))' END AS tree
FROM o LEFT JOIN s a ON a.n = o.h LEFT JOIN s b ON b.n = o.r""")
def numeral_tree(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), numerals.numeral(F.col("o_orderkey")).alias("tree"))


@query("""
WITH t AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_partkey AS id, (SELECT arg_min(t.p_type, (levenshtein(p_name, t.p_type), t.p_type)) FROM t WHERE t.p_brand = part.p_brand) AS nearest FROM part""")
def levenshtein_nearest(spark, d):
    """Each part's name against the types of its brand, which are its candidate labels."""
    part = table(spark, d, "part")
    types = part.select("p_brand", F.col("p_type").alias("form")).distinct()
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand").join(types, "p_brand")
    return ranking.nearest_by_edits(rows, "id", "name", "form").select("id", F.col("form").alias("nearest"))


ASCII_WORDS = "SELECT DISTINCT unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '')) AS {} FROM {}"


def _ascii_words(spark, d, name: str, column: str):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return table(spark, d, name).select(F.explode(words).alias(column)).distinct()


@query(f"WITH x AS ({ASCII_WORDS.format('a', 'benchmark')}), y AS ({ASCII_WORDS.format('b', 'documents')}) SELECT a, b, levenshtein(a, b)::INT AS dist FROM x JOIN y ON abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= 2")
def words_within_edits(spark, d):
    """Words of the benchmark against all words of the documents, up to two edits apart, met by shared segments."""
    return ranking.within_edits(_ascii_words(spark, d, "benchmark", "a"), _ascii_words(spark, d, "documents", "b"), 2)


@query(f"""
WITH x AS ({ASCII_WORDS.format('a', 'benchmark')}), y AS (SELECT lower(p_name) AS b FROM part UNION SELECT lower(word) FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) UNION SELECT lower(n_name) FROM nation),
z AS (SELECT a, b, levenshtein(a, b)::INT AS dist FROM x JOIN y ON levenshtein(a, b) <= 3) SELECT a, b, dist FROM z QUALIFY row_number() OVER (PARTITION BY a ORDER BY dist, b) = 1""")
def nearest_labels(spark, d):
    """For each word of the benchmark the nearest name of the catalogue, if one is near at all."""
    part = table(spark, d, "part")
    labels = part.select(F.lower("p_name").alias("b")).union(part.select(F.explode(F.split(F.lower("p_type"), " ")))).union(table(spark, d, "nation").select(F.lower("n_name")))
    return ranking.nearest_label(_ascii_words(spark, d, "benchmark", "a"), labels)


@query(r"""
WITH t AS (SELECT min(doc_id) AS a, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT a, word, count(*) AS n FROM (SELECT a, unnest(ws) AS word FROM t) GROUP BY 1, 2), s AS (SELECT a, sqrt(sum(n * n)) AS l FROM w GROUP BY a)
SELECT x.a, y.a AS b, round(sum(x.n * y.n) / any_value(s.l * r.l), 6) AS cosine FROM w x JOIN w y ON x.word = y.word AND x.a < y.a JOIN s ON s.a = x.a JOIN s r ON r.a = y.a
GROUP BY 1, 2 HAVING sum(x.n * y.n) / any_value(s.l * r.l) >= 0.9""")
def similar_documents(spark, d):
    """Different texts whose bags of words have a cosine of 0.9 or more, met block by block."""
    t = table(spark, d, "documents").filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("a")).repartition("a")  # counts and bags need no further exchange
    words = t.select("a", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("word"))
    return stats.similar_bags(words.groupBy("a", "word").agg(F.count("*").alias("n")), 0.9).select("a", "b", F.round("cosine", 6).alias("cosine"))


TRANSLIT = dict(zip("äöüßéèêçñáíóúàâîôûëïœæ", ["ae", "oe", "ue", "ss", *"eeecnaiouaaioueioe"], strict=False))


@query("""
WITH w AS (SELECT o_orderpriority AS lang, c_mktsegment AS fun, c_name AS lin FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
p AS (SELECT n_nationkey AS fun, 'x' AS lang, n_name AS lin FROM nation UNION ALL SELECT n_nationkey, 'y', r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.fun, a.lang, a.lin, CAST(min(levenshtein(lower(a.lin), lower(b.lin))) AS BIGINT) AS d FROM p a JOIN p b ON a.fun = b.fun AND a.lang <> b.lang GROUP BY 1, 2, 3""")
def translit_distance(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.select(F.col("n_nationkey").alias("fun"), F.lit("x").alias("lang"), F.col("n_name").alias("lin"))
    rows = rows.unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("fun"), F.lit("y").alias("lang"), F.col("r_name").alias("lin")))
    latin = text.transliterate(F.lower("lin"), TRANSLIT | {c: c for c in "abcdefghijklmnopqrstuvwxyz"})
    return ranking.distance_over_languages(rows.withColumn("latin", latin))


@query(r"""
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: w <> '')) AS word FROM documents),
a AS (SELECT d.source AS a, word, count(*) AS n FROM t JOIN documents d USING (doc_id) GROUP BY 1, 2), b AS (SELECT d.lang AS b, word, count(*) AS n FROM t JOIN documents d USING (doc_id) GROUP BY 1, 2),
na AS (SELECT a, sqrt(sum(n * n)) AS l FROM a GROUP BY a), nb AS (SELECT b, sqrt(sum(n * n)) AS l FROM b GROUP BY b)
SELECT a.a, b.b, round(sum(a.n * b.n) / (any_value(na.l) * any_value(nb.l)), 6) AS cosine FROM a JOIN b ON a.word = b.word JOIN na ON na.a = a.a JOIN nb ON nb.b = b.b GROUP BY 1, 2""")
def bow_cosine(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select("source", "lang", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("word"))
    counts = words.groupBy("source", "lang", "word").agg(F.count("*").alias("n"))
    a = counts.groupBy(F.col("source").alias("a"), "word").agg(F.sum("n").alias("n"))
    b = counts.groupBy(F.col("lang").alias("b"), "word").agg(F.sum("n").alias("n"))
    return stats.cosine(a, b).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""
WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS n, p_type FROM part),
s AS (SELECT id, unnest(range(1, len(n) + 1)) AS p, 1 AS size, NULL AS form FROM p UNION ALL SELECT id, len(n) + 1, len(string_split(p_type, ' ')), p_type FROM p
  UNION ALL SELECT id, unnest(range(len(n) + len(string_split(p_type, ' ')) + 1, 2 * len(n) + len(string_split(p_type, ' ')) + 1)), 1, NULL FROM p)
SELECT id, CAST(p AS INT) AS "at", size::INT AS size, form FROM s""")
def segment_longest(spark, d):
    """Types as multi-word entries, part names and types strung together as texts."""
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ").alias("words"))
    return text.segment(rows, part.select(F.col("p_type").alias("form")))


@query("SELECT DISTINCT ex_id AS id, string_agg(fun, '|' ORDER BY pos, fun) AS funs FROM (SELECT l_orderkey AS ex_id, l_linenumber AS pos, replace(p_brand, '#', '') || '_N' AS fun FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ex_id")
def expr_functions(spark, d):
    """Expressions are strung from the brands of an order; literals in them are no functions."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f = li.select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("pos"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_N")).alias("fun")).alias("x"))
    e = f.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit('(?1 "a b" '), x["fun"], F.lit(" 12)"))), " ").alias("expr"))
    return e.select("id", F.array_join(trees.functions(F.col("expr")), "|").alias("funs"))


BASE = "SELECT lex_id, 'x' AS lang, concat('base', lex_id) AS def FROM (SELECT DISTINCT lex_id FROM edits) z"
LOG = "SELECT seq, 'lexeme' AS kind, concat('u', user_id % 5) AS usr, lex_id, concat('def', seq) AS def FROM edits"


def log(spark, d) -> DataFrame:
    e = view(spark, d, "edits")
    return e.select("seq", F.lit("lexeme").alias("kind"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("user"), "lex_id", F.lit("x").alias("lang"), F.lit(None).cast("long").alias("line_no"), F.concat(F.lit("def"), "seq").alias("def"))


@query(f"SELECT b.lex_id, coalesce((SELECT arg_min(l.def, l.seq) FROM ({LOG}) l WHERE l.lex_id = b.lex_id AND usr = 'u3'), b.def) AS def FROM ({BASE}) b")
def pending_edit_or_base(spark, d):
    base = view(spark, d, "edits").select("lex_id").distinct().select("lex_id", F.lit("x").alias("lang"), F.concat(F.lit("base"), "lex_id").alias("def"))
    return ed.definitions(base, log(spark, d), "u3").select("lex_id", "def")


@query(f'SELECT usr AS "user", count(*) AS n FROM ({LOG}) l GROUP BY usr')
def edit_counts(spark, d):
    return ed.counts(log(spark, d))


@query(f"SELECT b.lex_id AS line_no, coalesce('lin ' || b.lex_id || ' = ' || (SELECT arg_min(l.def, l.seq) FROM ({LOG}) l WHERE l.lex_id = b.lex_id AND usr = 'u2') || ' ;', b.def) AS text FROM ({BASE}) b")
def commit_first_wins(spark, d):
    e = view(spark, d, "edits")
    lines = e.select("lex_id").distinct().select(F.lit("x").alias("lang"), F.col("lex_id").alias("line_no"), F.col("lex_id").alias("fun"), F.concat(F.lit("base"), "lex_id").alias("text"))
    return ed.commit(lines, log(spark, d), "u2")[0].select("line_no", "text")


@query(f"""
WITH b AS ({BASE}), e AS (SELECT lex_id, arg_min(def, seq) AS def FROM ({LOG}) l WHERE usr = 'u2' GROUP BY 1)
SELECT f AS file, row_number() OVER (PARTITION BY f ORDER BY b.lex_id) AS line_no, CASE WHEN f = 'x' AND e.def IS NOT NULL THEN 'lin ' || b.lex_id || ' = ' || e.def || ' ;' ELSE b.def END AS text
FROM b CROSS JOIN (VALUES ('x'), ('y')) l(f) LEFT JOIN e ON e.lex_id = b.lex_id""")
def commit_patched_files(spark, d):
    """A user's commit rewrites the source files as a whole version, which is read back."""
    root = f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"
    e = view(spark, d, "edits")
    lines = e.select("lex_id").distinct().select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("lang"), F.col("lex_id").alias("line_no"), F.col("lex_id").alias("fun"), F.concat(F.lit("base"), "lex_id").alias("text"))
    versions.commit_files(lines.withColumnRenamed("lang", "file"), root)
    patched, _ = ed.commit(lines, log(spark, d), "u2")
    versions.commit_files(patched.withColumnRenamed("lang", "file"), root)
    return versions.read_files(spark, root)


@query("""
WITH s AS (SELECT DISTINCT fun, lang, min(status) OVER (PARTITION BY fun, lang) AS status FROM status), n AS (SELECT DISTINCT fun FROM status WHERE status = 'checked')
SELECT s.fun, s.lang, CASE WHEN n.fun IS NOT NULL AND s.lang = 'O' THEN 'checked' ELSE s.status END AS status FROM s LEFT JOIN n ON n.fun = s.fun""")
def promote_status(spark, d):
    st = view(spark, d, "status")
    per = st.groupBy("fun", "lang").agg(F.min("status").alias("status"))
    lex = per.groupBy("fun").agg(F.map_from_entries(F.collect_list(F.struct("lang", "status"))).alias("status"))
    done, _ = ed.promote(lex, st.filter("status = 'checked'").select("fun"), ["O"])
    return done.select("fun", F.explode("status").alias("lang", "status"))


@query("""SELECT l_orderkey AS sent, l_linenumber::VARCHAR AS id, p_name AS form, lower(p_name) AS lemma FROM lineitem JOIN part ON p_partkey = l_partkey""")
def conllu_parse(spark, d):
    """Sentences written from orders and read back."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), "p_name", F.lower("p_name"), *(F.lit("_") for _ in range(7)))
    s = li.groupBy(F.col("l_orderkey").alias("sent")).agg(F.concat(F.lit("# order\n1-2\tskipped\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n")).alias("value"))
    return resources.conllu(s).select("sent", "id", "form", "lemma")


@query("SELECT concat('p', p_partkey, '_N') AS fun, 'N' AS cat, lpad(p_partkey::VARCHAR, 8, '0') || '-n' AS offset_tag, p_type AS gloss, p_brand AS domain FROM part")
def abstract_lexicon_parse(spark, d):
    p = table(spark, d, "part")
    v = F.concat(F.lit("fun p"), "p_partkey", F.lit("_N : N ; -- "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-n\t["), "p_brand", F.lit("] "), "p_type")
    out = resources.abstract_lexicon(p.select(v.alias("value")))
    return out.select("fun", "cat", F.col("offset").alias("offset_tag"), "gloss", F.array_join("domains", ",").alias("domain"))


@query("SELECT l_orderkey AS id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def taxonomy_parse(spark, d):
    """Synset lines of orders, with their parts as ranges and pointers."""
    li = table(spark, d, "lineitem")
    s = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("@ "), "l_partkey")), " ").alias("p"), F.array_join(F.collect_list(F.concat("l_partkey", F.lit("-"), "l_partkey")), ",").alias("r"))
    v = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-n "), "l_orderkey", F.lit(" "), "r", F.lit(" "), "p", F.lit(" | a gloss"))
    syn, _ = resources.taxonomy(s.select(v.alias("value")))
    ok = F.forall("pointers", lambda p: p["sym"] == "Hypernym")
    return syn.filter(ok).select("id", F.size("children").cast("long").alias("n"), F.aggregate("pointers", F.lit(0).cast("long"), lambda a, p: a + p["tgt"]).alias("total"))


@query("""
WITH k AS (SELECT l_orderkey AS o, string_agg('p' || l_partkey || '_N', ' ' ORDER BY 'p' || l_partkey || '_N') AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'abs*' AS state, 'PhrUtt ' || k AS expr, 'text ' || o AS eng, (n + 1)::INT AS n_funs FROM k""")
def examples_blocks(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("p"), "l_partkey", F.lit("_N")))), " ").alias("k"))
    v = F.concat(F.lit("abs* PhrUtt "), "k", F.lit("\neng: text "), "l_orderkey", F.lit("\nswe: \nbul: \nkey: 1 "), "k")
    return resources.examples(li.select(v.alias("value"))).select("state", "expr", "eng", F.size("funs").alias("n_funs"))


@query("SELECT n_nationkey AS id, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def domain_indent_parse(spark, d):
    """Regions and nations written as an indented list and read back."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    rows = r.select((F.col("r_regionkey") * 1000).alias("line_no"), F.concat(F.lit("- "), "r_name", F.lit(" *")).alias("value"))
    rows = rows.unionByName(n.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line_no"), F.concat(F.lit("  - "), "n_name").alias("value")))
    dom = resources.domains(rows.select(F.col("line_no").cast("long").alias("line_no"), "value"))
    up = dom.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return dom.join(up, "parent").join(n.select(F.col("n_name").alias("name"), "n_nationkey"), "name").select(F.col("n_nationkey").alias("id"), "name", F.col("parent_name").alias("parent"))


def _sentences(spark, d) -> DataFrame:
    """Orders as sentences, each line hung on the line before; a part's choices are its brand and type. Of lines with
    the same number the first that is stored counts, so that every run and every use has the same sentences."""
    li = in_file_order(table(spark, d, "lineitem")).groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", "row_at").alias("l_partkey"))
    j = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("sent"), F.col("l_linenumber").alias("node"), (F.col("l_linenumber") - 1).alias("head"), F.explode(F.array("p_brand", "p_type")).alias("choice"))


@query("""
WITH li AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey FROM lineitem),
c AS (SELECT l_orderkey AS sent, l_linenumber AS node, unnest([p_brand, p_type]) AS choice FROM li JOIN part ON p_partkey = l_partkey)
SELECT choice, round(sum(0.5), 6)::DOUBLE AS n FROM c GROUP BY choice""")
def em_initial_counts(spark, d):
    return stats.initial_counts(_sentences(spark, d))[0].select("choice", F.round("n", 6).alias("n"))


NMF_RANK, NMF_ROUNDS = 3, 4


def _nmf_sql(rounds: int) -> str:
    """The updates written out, a round after the other, over (fun, d, x) tables."""
    start = lambda c, s: f"SELECT fun, d, ('0x' || substr(md5(fun || '|{s}|' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM (SELECT DISTINCT {c} AS fun FROM v), range({NMF_RANK}) r(d)"
    out = [
        "v AS MATERIALIZED (SELECT p_brand AS head, p_type AS mod, count(*)::DOUBLE AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
        f"h0 AS MATERIALIZED ({start('head', 'h')})", f"m0 AS MATERIALIZED ({start('mod', 'm')})",
    ]
    for k in range(rounds + 1):
        out.append(f"e{k} AS (SELECT {k} AS step, sum((coalesce(p, 0) - x) ** 2) AS error FROM (SELECT h.fun AS head, m.fun AS mod, sum(h.x * m.x) AS x FROM h{k} h JOIN m{k} m USING (d) GROUP BY 1, 2) LEFT JOIN v USING (head, mod))")
        for new, old, other, mine, theirs in ((f"m{k + 1}", f"m{k}", f"h{k}", "mod", "head"), (f"h{k + 1}", f"h{k}", f"m{k + 1}", "head", "mod")):
            gram = f"(SELECT a.d AS d, b.d AS e, sum(a.x * b.x) AS g FROM {other} a JOIN {other} b USING (fun) GROUP BY 1, 2)"
            top = f"(SELECT {mine} AS fun, d, sum(p * x) AS t FROM v JOIN {other} o ON o.fun = {theirs} GROUP BY 1, 2)"
            low = f"(SELECT o.fun, g.d, sum(o.x * g.g) AS l FROM {old} o JOIN {gram} g ON g.e = o.d GROUP BY 1, 2)"
            out.append(f"{new} AS MATERIALIZED (SELECT o.fun, o.d, o.x * t / greatest(l, 1e-12) AS x FROM {old} o JOIN {top} USING (fun, d) JOIN {low} USING (fun, d))")
    return "WITH " + ",\n".join(out)


def _brand_types(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.without_stops(j.groupBy(F.col("p_brand").alias("head"), F.col("p_type").alias("mod")).agg(F.count("*").cast("double").alias("p")))


@query(f"{_nmf_sql(NMF_ROUNDS)} SELECT fun, d::INT AS dim, round(x / sum(x) OVER (PARTITION BY d), 6) AS x FROM h{NMF_ROUNDS}")
def nmf_embedding(spark, d):
    """Embeddings of brands by their types after a few updates, each dimension normalised."""
    left, _, _ = stats.nmf(_brand_types(spark, d), NMF_RANK, NMF_ROUNDS, tolerance=0.0)
    return stats.normalised_vectors(left).select("fun", F.posexplode("vector").alias("dim", "x")).select("fun", "dim", F.round("x", 6).alias("x"))


@query(f"{_nmf_sql(NMF_ROUNDS)} SELECT step, round(error, 3) AS error, coalesce(error <= lag(error) OVER (ORDER BY step), true) AS falls FROM ({' UNION ALL '.join(f'SELECT * FROM e{k}' for k in range(NMF_ROUNDS + 1))})")
def nmf_errors(spark, d):
    """The squared error of the factors, round by round."""
    _, _, errors = stats.nmf(_brand_types(spark, d), NMF_RANK, NMF_ROUNDS, tolerance=0.0)
    rows = [(k, e, k == 0 or e <= errors[k - 1]) for k, e in enumerate(errors)]
    return spark.createDataFrame(rows, "step int, error double, falls boolean").withColumn("error", F.round("error", 3))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_edit_counts(spark, d):
    return tail.drained(tail.edit_counts(tail.follow(spark, f"{d}/events.parquet")))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_windows(spark, d):
    out = tail.drained(tail.windowed(tail.follow(spark, f"{d}/events.parquet"), "1 day", late="3650 days"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
