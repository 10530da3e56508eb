"""Queries of the text formats: each writes lines from the test tables and reads them back, or writes a sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import kb, text
from lexloom.operators import ranking
from lexloom.plans.views import view, with_views
from lexloom.session import shared_dir, table
from lexloom.sources import resources, treebanks
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


def place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"


@query("SELECT l_orderkey || '/' || l_linenumber AS id, 'f' || l_partkey || '_V' AS fun, l_suppkey::INT AS agent, l_linenumber::INT AS theme FROM lineitem")
def frame_instances_parse(spark, d):
    li = table(spark, d, "lineitem")
    item = F.concat("l_orderkey", F.lit("/"), "l_linenumber", F.lit("/f"), "l_partkey", F.lit("_V@{Agent:"), "l_suppkey", F.lit(",Theme:"), "l_linenumber", F.lit("}"))
    out = resources.frame_instances(li.select(item.alias("item")))
    return out.select(F.regexp_extract("item", "^([0-9]+/[0-9]+)/", 1).alias("id"), "fun", F.col("roles")["Agent"].alias("agent"), F.col("roles")["Theme"].alias("theme"))


@query("SELECT 'Q' || n_nationkey AS qid, 'F ' || n_name AS expr, CASE n_nationkey % 3 WHEN 0 THEN 'ParseMul' WHEN 1 THEN 'ParseEng' ELSE 'ParseEng,ParseSwe' END AS langs FROM nation")
def constructions_parse(spark, d):
    n = table(spark, d, "nation")
    langs = F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, "eng: x\n").otherwise("eng: x\nswe: y\n")
    out = resources.constructions(n.select(F.concat(F.lit("abs: F "), "n_name", F.lit("\n"), langs, F.lit("key: Q"), "n_nationkey").alias("value")))
    return out.select("qid", "expr", F.array_join("langs", ",").alias("langs"))


@query("SELECT 'class ' || r_name AS class, 'Agent:animate+human,Theme:' AS roles FROM region")
def verb_classes_parse(spark, d):
    r = table(spark, d, "region")
    out = resources.verb_classes(r.select(F.concat(F.lit("class: class "), "r_name", F.lit("\nrole: Agent animate human\nrole: Theme")).alias("value")))
    roles = F.array_join(F.transform("vars", lambda v: F.concat(v["role"], F.lit(":"), F.array_join(v["restr"], "+"))), ",")
    return out.select("class", roles.alias("roles"))


@query("SELECT 'NP V ' || n_name AS pattern, 'sem ' || n_nationkey AS semantics, 'a_V,b_V' AS key FROM nation")
def frames_parse(spark, d):
    n = table(spark, d, "nation")
    out = resources.frames(n.select(F.concat(F.lit("frm: NP V "), "n_name", F.lit("\nsem: sem "), "n_nationkey", F.lit("\nkey: a_V b_V")).alias("value")))
    return out.select("pattern", "semantics", F.array_join("key", ",").alias("key"))


@query("SELECT 'p' || p_partkey AS fun, CASE WHEN p_partkey % 10 > 0 THEN p_retailprice END AS prob FROM part")
def probabilities_parse(spark, d):
    p = table(spark, d, "part")
    v = F.concat(F.lit("p"), "p_partkey", F.lit("\t"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_retailprice").cast("string")).otherwise("none"))
    return resources.probabilities(p.select(v.alias("value")))


@query("SELECT 'p' || p_partkey AS fun, 'Q' || p_size AS qid, CASE WHEN p_size % 2 = 0 THEN 'page' ELSE '' END AS page, 'i' || p_partkey AS img, 2::INT AS n FROM part")
def images_parse(spark, d):
    p = table(spark, d, "part")
    v = F.concat(F.lit("p"), "p_partkey", F.lit("\tQ"), "p_size", F.lit(";"), F.when(F.col("p_size") % 2 == 0, "page").otherwise(""), F.lit(";i"), "p_partkey", F.lit("\tQ0;;j"))
    out = resources.images(p.select(v.alias("value")))
    i = F.get("images", 0)
    return out.select("fun", i["qid"].alias("qid"), i["page"].alias("page"), i["img"].alias("img"), F.size("images").alias("n"))


BIGRAMS = "SELECT l_suppkey AS h, l_partkey % 50 AS m, count(*) / 1000000.0 AS p FROM lineitem GROUP BY 1, 2"


@query(f"""
WITH b AS ({BIGRAMS}), u AS (SELECT h::VARCHAR AS f, (h + 1) / 1000.0 AS p FROM (SELECT DISTINCT l_suppkey AS h FROM lineitem))
SELECT 'f' || b.h AS head, 'f' || m AS mod, round(0.002 * coalesce((SELECT p FROM u WHERE f = b.h::VARCHAR) * (SELECT p FROM u WHERE f = m::VARCHAR), 0) + 0.998 * b.p, 12)::DOUBLE AS p FROM b""")
def bigrams_with_back_off(spark, d):
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("m")).agg(F.count("*").alias("n"))
    lines = g.select(F.concat(F.lit("f"), "l_suppkey", F.lit("\tf"), "m", F.lit("\t"), (F.col("n") / 1000000).cast("string")).alias("value"))
    u = li.select("l_suppkey").distinct().select(F.concat(F.lit("f"), "l_suppkey").alias("fun"), ((F.col("l_suppkey") + 1) / 1000).alias("p"))
    return resources.interpolated(resources.bigrams(lines), u).select("head", "mod", F.round("p", 12).alias("p"))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'new-' || p_partkey ELSE lpad(p_partkey::VARCHAR, 8, '0') || '-n' END AS sense, p_name AS form FROM part")
def multilingual_tab_parse(spark, d):
    p = table(spark, d, "part")
    key = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-n"))
    rows = p.select(F.concat(key, F.lit("\teng:lemma\t"), "p_name").alias("value")).unionByName(p.select(F.concat(F.lit("# "), "p_name").alias("value"))).unionByName(p.select(F.concat(key, F.lit("\teng:def\t0\ta gloss")).alias("value")))
    remap = p.filter("p_partkey % 4 = 0").select(key.alias("old"), F.concat(F.lit("new-"), "p_partkey").alias("new"))
    return resources.multilingual_tab(rows, remap)


@query("SELECT 'Q' || c_custkey AS qid, c_name AS text, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'de-at' END AS lang FROM customer")
def entity_labels_parse(spark, d):
    c = table(spark, d, "customer")
    tail = F.when(F.col("c_custkey") % 2 == 0, ' (city)"@en').otherwise(', place"@de-at')
    return resources.entity_labels(c.select(F.concat(F.lit("<http://www.wikidata.org/entity/Q"), "c_custkey", F.lit('>\t"'), "c_name", tail).alias("value")))


@query("SELECT p_name AS word, 'noun' AS pos, lang, CASE lang WHEN 'de' THEN p_type ELSE p_brand END AS form FROM part, (VALUES ('de'), ('fr')) t(lang)")
def dictionary_parse(spark, d):
    p = table(spark, d, "part")
    j = F.to_json(F.array(F.struct(F.lit("de").alias("code"), F.col("p_type").alias("word")), F.struct(F.lit("fr").alias("code"), F.col("p_brand").alias("word"))))
    return resources.dictionary(p.select(F.concat("p_name", F.lit("\tnoun\t"), j).alias("value")))


@query("""
SELECT l_orderkey AS meaning, count(DISTINCT l_partkey) AS exprs, min(p_name) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def panlex_tables(spark, d):
    """The dump's CSV files, written and read with their types."""
    root, li = place(spark), table(spark, d, "lineitem")
    ex = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("langvar"), F.col("p_name").alias("txt"))
    den = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("meaning"), F.col("l_partkey").alias("expr"))
    one = spark.createDataFrame([(1, "x")], "id int, label string")
    files = {"expr": ex, "denotation": den, "source": one, "langvar": one.select("id", F.lit("eng").alias("lang_code"), F.lit(0).alias("var_code")), "meaning": li.select(F.col("l_orderkey").alias("id"), F.lit(1).alias("source")).distinct(), "denotation_class": den.select("id", F.col("id").alias("denotation"), F.col("expr").alias("expr1"), F.col("expr").alias("expr2"))}
    for n, df in files.items():
        df.write.csv(f"{root}/{n}.csv", header=True)
    t = resources.panlex(spark, root)
    j = t["denotation"].join(t["expr"].select(F.col("id").alias("expr"), "txt"), "expr").join(t["meaning"].select(F.col("id").alias("meaning")), "meaning")
    return j.groupBy("meaning").agg(F.count_distinct("expr").alias("exprs"), F.min("txt").alias("first"))


def _princeton(spark, d) -> DataFrame:
    # the packed keys are a small file, the records made of them are not
    p = table(spark, d, "part").select("p_partkey", "p_type").repartition("p_partkey")
    k = lambda c: F.lpad(c.cast("string"), 8, "0")
    v = F.concat(k(F.col("p_partkey")), F.lit(" 03 n 0a "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("w"), i.cast("string"), F.lit(" f"))), " "), F.lit(" 002 @ "), k(F.col("p_partkey") + 1), F.lit(" n 0000 + "), k(F.col("p_partkey") + 2), F.lit(" v 0a01 | "), "p_type")
    return resources.princeton(p.select(v.alias("value")).unionByName(spark.createDataFrame([("  1 a header line",)], "value string")))


@query("SELECT lpad(p_partkey::VARCHAR, 8, '0') AS offset_, 'n' AS tag, 10::INT AS words, 15::INT AS lex_id, p_type AS gloss FROM part")
def princeton_parse(spark, d):
    """Ten words a record: the count is hexadecimal, and so is a word's number."""
    out = _princeton(spark, d)
    return out.select(F.col("offset").alias("offset_"), "tag", F.size("words").alias("words"), F.get("words", 9)["lex_id"].alias("lex_id"), "gloss")


@query("""
SELECT 'semantic' AS kind, lpad(p_partkey::VARCHAR, 8, '0') AS src, '@' AS code, lpad((p_partkey + 1)::VARCHAR, 8, '0') AS tgt, NULL::INT AS word FROM part
UNION ALL SELECT 'lexical', 'w10', '+', lpad((p_partkey + 2)::VARCHAR, 8, '0'), 1 FROM part""")
def pointer_split(spark, d):
    sem, lex = resources.split_pointers(_princeton(spark, d))
    a = sem.select(F.lit("semantic").alias("kind"), F.col("offset").alias("src"), "code", "tgt", F.lit(None).cast("int").alias("word"))
    return a.unionByName(lex.select(F.lit("lexical").alias("kind"), F.col("word").alias("src"), "code", F.col("tgt_offset").alias("tgt"), F.col("to_word").alias("word")))


ENTITY = """'{"id":"Q' || c_custkey || '","labels":{"en":{"value":"' || c_name || '"}},"descriptions":{"en":{"value":"d"}},' || CASE WHEN c_custkey % 2 = 0 THEN '"sitelinks":{"enwiki":{"title":"A b"}},' ELSE '' END ||
 '"claims":{"P31":[' || CASE WHEN c_custkey % 3 = 0 THEN '{"mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q101352"}}}},{"mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q12308941"}}}}' ELSE '{"mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q5"}}}}' END ||
 '],"P735":[' || CASE WHEN c_custkey % 5 = 0 THEN '{"mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q1"}}}},{"mainsnak":{"snaktype":"novalue"}}' ELSE '' END || '],"P18":[{"mainsnak":{"snaktype":"value","datavalue":{"value":"a b.jpg"}}}]}}'"""


def _dump(spark, d) -> DataFrame:
    own = ENTITY.replace("{", "{{").replace("}", "}}")
    rows = spark.sql(f"SELECT {own} || ',' AS value FROM {{customer}}", customer=table(spark, d, "customer"))
    return resources.entity_dump(rows.unionByName(spark.createDataFrame([("[",), ("]",)], "value string")))


@query(f"SELECT 'Q' || c_custkey AS qid, {ENTITY} AS json FROM customer")
def entity_dump_parse(spark, d):
    return _dump(spark, d)


@query("""
SELECT 'Q' || c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN 'Q12308941' END AS name_type, CASE WHEN c_custkey % 5 = 0 THEN 'Q1' ELSE '' END AS given, 'd' AS description,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://en.wikipedia.org/wiki/A_b' ELSE 'http://www.wikidata.org/entity/Q' || c_custkey END AS url,
  'commons/' || left(md5('a_b.jpg'), 1) || '/' || left(md5('a_b.jpg'), 2) || '/a_b.jpg' AS image FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0""")
def dump_names(spark, d):
    out = resources.dump_names(_dump(spark, d))
    return out.select("qid", "name_type", F.array_join("given", ",").alias("given"), "description", "url", F.get("images", 0).alias("image"))


@query("SELECT 'Q' || c_custkey AS qid, 'P18,P31,P735' AS props FROM customer")
def entity_properties(spark, d):
    return _dump(spark, d).select("qid", F.array_join(kb.properties(kb.parsed(F.col("json"))), ",").alias("props"))


@query("SELECT o_orderkey AS sent, pos::INT AS pos, form, CASE pos WHEN 0 THEN 'o' || o_orderkey ELSE o_orderstatus END AS lemma, 'NN' AS tag FROM orders, LATERAL (VALUES (0, 'Order'), (1, 'is')) t(pos, form)")
def semcor_xml(spark, d):
    """Sense-tagged sentences as XML files of up to 500, written and read back."""
    o, root = table(spark, d, "orders"), place(spark)
    s = F.concat(F.lit('<s snum="'), "o_orderkey", F.lit('"><wf pos="NN" lemma="o'), "o_orderkey", F.lit('" lexsn="1:00:00::">Order</wf><wf pos="NN" lemma="'), "o_orderstatus", F.lit('">is</wf></s>'))
    files = o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("part")).agg(F.concat(F.lit("<corpus>\n"), F.array_join(F.collect_list(s), "\n"), F.lit("\n</corpus>")).alias("value"))
    files.write.partitionBy("part").text(root)
    return resources.semcor(spark, root).select(F.col("sent").cast("long").alias("sent"), "pos", "form", "lemma", "tag")


@query("SELECT l_orderkey AS sent, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS pos, 'w/' || l_partkey AS form, l_returnflag AS tag FROM lineitem")
def tagged_corpus_parse(spark, d):
    li = table(spark, d, "lineitem")
    w = F.concat(F.lit("w/"), "l_partkey", F.lit("/"), "l_returnflag")
    s = li.groupBy(F.col("l_orderkey").alias("sent")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", w.alias("w")))), lambda x: x["w"]), " ").alias("value"))
    return resources.tagged_corpus(s)


@query("SELECT 'f' || n_nationkey AS fun, 'head,mod,rel,anchor,skip' AS kinds, 'obj' AS label, n_regionkey::INT AS idx FROM nation")
def pragmas_parse(spark, d):
    n = table(spark, d, "nation")
    rows = n.select(F.concat(F.lit("f"), "n_nationkey", F.lit(" head obj:"), "n_regionkey", F.lit(" rel:2 anchor _ -- a comment")).alias("value")).unionByName(spark.createDataFrame([("-- only a comment",)], "value string"))
    p = resources.pragmas(rows)
    return p.select("fun", F.array_join("pragmas.kind", ",").alias("kinds"), F.get("pragmas", 1)["label"].alias("label"), F.get("pragmas", 1)["idx"].alias("idx"))


@query("""
WITH c AS (SELECT DISTINCT 'p' || l_partkey || CASE l_partkey % 4 WHEN 0 THEN '_N' WHEN 1 THEN '_V2' WHEN 2 THEN '_PN' ELSE '_CN' END AS fun, 'W' || l_suppkey AS lin, l_suppkey AS k, l_partkey % 3 AS s FROM lineitem),
x AS (SELECT *, CASE WHEN ends_with(fun, '_N') THEN 'mkN "' || lower(lin) || '"' WHEN ends_with(fun, '_V2') THEN 'mkV2 (mkV "' || lower(lin) || '")' WHEN ends_with(fun, '_PN') THEN 'mkPN "' || lin || '"' ELSE 'variants {}' END AS def FROM c)
SELECT fun, 'lin ' || fun || ' = ' || CASE WHEN count(*) = 1 THEN min(def) ELSE 'variants {' || string_agg(def, '; ' ORDER BY k) || '}' END || ' ;' || CASE min(s) WHEN 0 THEN '' WHEN 1 THEN ' --unchecked' ELSE ' --guessed' END AS line FROM x GROUP BY fun""")
def predictions_to_draft(spark, d):
    """Predictions written as lines, read, given statuses and definitions, and written as a draft lexicon."""
    cat = F.element_at(F.array(*map(F.lit, ("_N", "_V2", "_PN", "_CN"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    v = F.concat(F.lit("p"), "l_partkey", cat, F.lit("\teng\tW"), "l_suppkey", F.lit("\t1\t"), (F.col("l_partkey") % 3).cast("string"), F.lit("\t1\t0\t0\t"), F.col("l_suppkey").cast("string"))
    p = resources.predictions(li.select(v.alias("value")))
    p = p.withColumn("status", ranking.candidate_status(F.col("s"), F.col("w"), F.col("l"))).withColumn("rank", F.col("d"))
    none = spark.createDataFrame([], "name string, def string")
    return resources.draft_lexicon(text.predicted_definitions(p, none))


@query("SELECT 'a' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN 'Masc_N' WHEN 1 THEN '_A2' ELSE '_Voc' END AS fun, CASE p_partkey % 3 WHEN 0 THEN 'irregular' WHEN 1 THEN 'mkA2 (mkA \"x\")' ELSE '{s=\"x\"}' END AS def FROM part")
def definition_texts(spark, d):
    """A known paradigm of the masculine form, a wrapped one, and one that is written as it is."""
    p = table(spark, d, "part")
    suffix = F.element_at(F.array(*map(F.lit, ("Masc_N", "_A2", "_Voc"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.select(F.concat(F.lit("a"), "p_partkey", suffix).alias("fun"), F.lit("X").alias("lin"))
    return text.predicted_definitions(rows, spark.createDataFrame([("xMasc_N", "irregular")], "name string, def string")).select("fun", "def")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def sinks_read_back(spark, d):
    """Tab separated and JSON sinks, read again."""
    root, n = place(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    resources.write_tsv(n, f"{root}/tsv")
    resources.write_json(n, f"{root}/json")
    tsv = spark.read.csv(f"{root}/tsv", sep="\t").toDF("id", "name")
    j = spark.read.text(f"{root}/json").select(F.col("value").alias("json"), F.get_json_object("value", "$.n_name").alias("name"))
    return tsv.join(j, "name").select("id", "name", "json")


@query("""
WITH c AS (SELECT lang, sum((status = 'guessed')::INT) / 1000.0 AS g, sum((status = 'unchecked')::INT) / 1000.0 AS u, sum((status = 'checked')::INT) / 1000.0 AS k FROM status GROUP BY lang),
t AS (SELECT max(g + u + k) AS top FROM c)
SELECT lang, round(400 * k / top, 1)::DOUBLE AS checked, round(400 * u / top, 1)::DOUBLE AS unchecked, round(400 * g / top, 1)::DOUBLE AS guessed FROM c, t""")
def status_chart(spark, d):
    """Widths of the bars in the chart that is drawn from the status counts."""
    import re

    from lexloom.operators import stats

    svg = resources.status_svg(stats.status_counts(view(spark, d, "status")))
    langs, widths = re.findall(r">([^<>]+)</text>", svg), [float(w) for w in re.findall(r'<rect [^>]*width="([0-9.]+)"', svg)]
    rows = [(x, *widths[3 * i : 3 * i + 3]) for i, x in enumerate(langs)]
    return spark.createDataFrame(rows, "lang string, checked double, unchecked double, guessed double")


@query("SELECT chr(97 + x::INT) AS letter, upper(chr(97 + x::INT)) || '~' AS sound, 'const t = {\"a\": \"A~\", \"b\": \"B~\", \"c\": \"C~\"};' AS script FROM range(3) t(x)")
def transliteration_table(spark, d):
    lines = spark.createDataFrame([("a\tA~",), ("b\tB~",), ("c\tC~",), ("malformed",)], "value string")
    t = resources.translit_table(lines)
    js = resources.translit_script(t, "t").strip()
    return spark.createDataFrame([(k, v, js) for k, v in t.items()], "letter string, sound string, script string")


HAVE = "SELECT DISTINCT 'p' || l_partkey % 40 AS fun, 'eng' AS lang, 'W' || l_suppkey AS lin, 1 AS o, 2 AS s, 1 AS w, 0 AS l, 0 AS c FROM lineitem WHERE l_returnflag = 'A'"
NEW = "SELECT 'p' || l_partkey % 40 AS fun, 'eng' AS lang, 'w' || l_suppkey AS lin, max(l_linenumber)::INT AS l FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3"


def _candidates(spark, d):
    li = table(spark, d, "lineitem")
    fun = F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("fun")
    have = li.filter("l_returnflag = 'A'").select(fun, F.lit("eng").alias("lang"), F.concat(F.lit("W"), "l_suppkey").alias("lin")).distinct()
    have = have.select("*", *(F.lit(x).alias(c) for c, x in zip("oswlc", (1, 2, 1, 0, 0), strict=True)))
    new = li.filter("l_returnflag <> 'A'").groupBy(fun, F.lit("eng").alias("lang"), F.concat(F.lit("w"), "l_suppkey").alias("lin")).agg(F.max("l_linenumber").cast("int").alias("l"))
    return have, new


@query(f"""
WITH h AS ({HAVE}), n AS ({NEW}), j AS (SELECT coalesce(h.fun, n.fun) AS fun, coalesce(h.lin, n.lin) AS lin, h.fun IS NOT NULL AS old, n.fun IS NOT NULL AS hit FROM h FULL JOIN n ON h.fun = n.fun AND lower(h.lin) = n.lin)
SELECT 'wikidata' AS source, fun, lin, 1 AS o, 2 AS s, CASE WHEN hit THEN 0 ELSE 1 END AS w FROM j
UNION ALL SELECT 'wiktionary', fun, lin, 1, CASE WHEN hit THEN 0 ELSE 2 END, CASE WHEN hit THEN 0 ELSE 1 END FROM j""")
def merge_by_source(spark, d):
    have, new = _candidates(spark, d)
    out = None
    for source in ("wikidata", "wiktionary"):
        part = ranking.merge_source(have, new, source).select(F.lit(source).alias("source"), "fun", "lin", "o", "s", "w")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH h AS ({HAVE}), n AS ({NEW}), j AS (SELECT coalesce(h.fun, n.fun) AS fun, coalesce(h.lin, n.lin) AS lin, h.fun IS NOT NULL AS old, n.l FROM h FULL JOIN n ON h.fun = n.fun AND lower(h.lin) = n.lin),
t AS (SELECT *, max(CASE WHEN NOT old THEN l END) OVER (PARTITION BY fun) AS top FROM j)
SELECT fun, lin, 1 AS o, 2 AS s, 1 AS w, coalesce(l, 0) AS l FROM t WHERE old OR l = top""")
def merge_translations(spark, d):
    have, new = _candidates(spark, d)
    return ranking.merge_translations(have, new).select("fun", "lin", "o", "s", "w", "l")


TOKENS = "SELECT l_orderkey::VARCHAR AS misc, l_linenumber::VARCHAR AS id, p_name AS form, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name) + 1)::INT AS pos FROM lineitem JOIN part ON p_partkey = l_partkey"


def _treebank(spark, d) -> str:
    """A folder of treebank files with one sentence an order."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), "p_name", *(F.lit("_") for _ in range(7)), F.col("l_orderkey").cast("string"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"])
    path = place(spark)
    li.groupBy("l_orderkey").agg(F.concat(F.lit("# order\n1-2\tskipped\n"), F.array_join(in_order, "\n")).alias("value")).select("value").write.text(path, lineSep="\n\n")
    treebanks.register(spark)
    return path


@query(TOKENS)
def treebank_source(spark, d):
    """Files of sentences read by the data source, in ranges that cut sentences."""
    return spark.read.format("treebank").option("path", _treebank(spark, d)).option("split", 1 << 20).load().select("misc", "id", "form", "pos")


@query(TOKENS)
def treebank_stream(spark, d):
    """The same files as a stream."""
    stream = spark.readStream.format("treebank").option("path", _treebank(spark, d)).option("split", 1 << 20).load()
    return tail.drained(stream, "append").select("misc", "id", "form", "pos")


@query("SELECT n_nationkey AS id, n_name || ' <&> \"x\"' AS name FROM nation")
def workbook_report(spark, d):
    """A spreadsheet written and its cells read again."""
    import io
    import re
    import zipfile
    from xml.sax.saxutils import unescape

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(' <&> "x"')).alias("name"))
    xml = zipfile.ZipFile(io.BytesIO(resources.workbook(n))).read("xl/sheet.xml").decode()
    cells = re.findall(r"<row><c><v>([0-9]+)</v></c><c[^>]*><is><t[^>]*>(.*?)</t></is></c></row>", xml)
    return spark.createDataFrame([(int(a), unescape(b)) for a, b in cells], "id int, name string")


@query("SELECT 'Q' || c_custkey AS qid, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS kinds, CASE WHEN c_custkey % 5 = 0 THEN 'Q1' ELSE '' END AS given, 0 AS none FROM customer")
def typed_entities(spark, d):
    """A record type's fields: references, a property whose values are of another type, and one that is missing."""
    j = F.replace("json", F.lit('"snaktype":"value","datavalue"'), F.lit('"snaktype":"value","datatype":"wikibase-item","datavalue"'))
    out = kb.typed_entity(_dump(spark, d).withColumn("json", j), {"label": "Str", "P31": "Str", "P735": "Str", "P18": "Int", "P999": "Float"}, "de")
    return out.select("qid", F.get("label", 0).alias("label"), F.size("P31").alias("kinds"), F.array_join("P735", ",").alias("given"), (F.size("P18") + F.size("P999")).alias("none"))
