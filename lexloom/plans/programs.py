"""Queries of the expression language and of the services that run it and the edit workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import program
from lexloom.plans import service
from lexloom.plans.knowledge import entities, log
from lexloom.plans.views import view, with_views
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


SOURCE = r"""
main = show who.P1 ;                       -- one row an amount and an option
show : Int -> Record = \x -> { name = who.label ; amount = x ; half = divInt x 2 ; rest = modInt x 2 ; sign = sign x ; words = word x ; unit = unit } ;
sign : Str -> Str = \x -> "text" ;
sign : Int -> Str = \x -> case compare x 0 of { LT => "neg" ; EQ => "zero" ; _ => "pos" } ;
word = \x -> case sign x of { "neg" => NegDecimal (F "it") ; other => Named other } ;
unit = [unit: "a" | "b"] ;
who = entity qid ;
"""
AMOUNTS = "SELECT event_id, user_id, event_id AS x FROM events UNION ALL SELECT event_id, user_id, -7 FROM events WHERE event_id % 3 <> 0"


def _entities(spark, d):
    return entities(spark, d).select(F.concat(F.lit("Q"), "event_id").alias("qid"), "json")


@query(f"""
SELECT 'Q' || event_id AS qid, 'name,amount,half,rest,sign,words,unit' AS headers,
  concat_ws('|', 'e' || user_id, x, CAST(floor(x / 2.0) AS BIGINT), x - 2 * CAST(floor(x / 2.0) AS BIGINT), CASE WHEN x < 0 THEN 'neg' WHEN x = 0 THEN 'zero' ELSE 'pos' END,
    CASE WHEN x < 0 THEN 'NegDecimal (F "it")' WHEN x = 0 THEN 'Named "zero"' ELSE 'Named "pos"' END, u) AS cells,
  '[["unit", ' || CASE u WHEN 'a' THEN 0 ELSE 1 END || ']]' AS choices FROM ({AMOUNTS}) a, (VALUES ('a'), ('b')) t(u)""")
def program_over_entities(spark, d):
    """A program of definitions out of order, overloads, cases, lambdas, options and several values of a property."""
    out = program.run(_entities(spark, d), SOURCE, "de")
    return out.filter("error is null").select("qid", F.array_join("headers", ",").alias("headers"), F.array_join("cells", "|").alias("cells"), "choices")


@query(f"SELECT 'Q' || event_id AS qid, x::VARCHAR AS amount FROM ({AMOUNTS}) a")
def program_replayed(spark, d):
    """The same program with its option fixed."""
    out = program.run(_entities(spark, d), SOURCE, "de", {"unit": 1})
    return out.filter("error is null").select("qid", F.get("cells", 1).alias("amount"))


@query("SELECT 'Q' || event_id AS qid, CASE WHEN event_id % 5 = 0 THEN 'division by zero' END AS error, CASE WHEN event_id % 5 > 0 THEN (100 // (event_id % 5))::VARCHAR END AS value FROM events WHERE event_id % 3 = 0")
def program_errors(spark, d):
    """An error in one row is that row's alone."""
    rows = _entities(spark, d).filter("cast(substr(qid, 2) as bigint) % 3 = 0")
    out = program.run(rows, "main = divInt 100 (modInt (entity qid).P1 5) ;")
    return out.select("qid", "error", F.get("cells", 0).alias("value"))


@query("""
SELECT 'time' AS label, 'Q' || o_orderkey AS qid, CASE o_orderkey % 3 WHEN 0 THEN 'yearAdv (intYear ' || year(o_orderdate) || ')' WHEN 1 THEN 'monthYearAdv ' || lower(monthname(o_orderdate)) || '_Month (intYear ' || year(o_orderdate) || ')'
  ELSE 'dayMonthYearAdv (intMonthday ' || day(o_orderdate) || ') ' || lower(monthname(o_orderdate)) || '_Month (intYear ' || year(o_orderdate) || ')' END AS adv FROM orders""")
def program_times(spark, d):
    o = table(spark, d, "orders")
    part = lambda f, k: F.when(F.col("o_orderkey") % 3 >= k, F.date_format("o_orderdate", f)).otherwise("00")
    t = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), part("MM", 1), F.lit("-"), part("dd", 2), F.lit("T00:00:00Z"))
    snak = F.struct(F.lit("value").alias("snaktype"), F.lit("time").alias("datatype"), F.struct(F.struct(t.alias("time")).alias("value")).alias("datavalue"))
    j = F.to_json(F.struct(F.struct(F.array(F.struct(snak.alias("mainsnak"))).alias("P585")).alias("claims")))
    out = program.run(o.select(F.concat(F.lit("Q"), "o_orderkey").alias("qid"), j.alias("json")), "main = {time = time2adv (entity qid).P585} ;")
    return out.select(F.get("headers", 0).alias("label"), "qid", F.get("cells", 0).alias("adv"))


@query("SELECT 'n,linked' AS headers, count(*) AS n FROM (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def program_links(spark, d):
    """A program that follows a property to another entity, which comes with the row; results grouped by headers."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    item = F.concat(F.lit('{"claims":{"P17":[{"mainsnak":{"snaktype":"value","datatype":"wikibase-item","datavalue":{"value":{"id":"N'), "n_nationkey", F.lit('"}}}}]}}'))
    other = F.concat(F.lit('{"labels":{"en":{"value":"'), "n_name", F.lit('"}}}'))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Q"), "s_suppkey").alias("qid"), item.alias("json"), F.create_map(F.concat(F.lit("N"), "n_nationkey"), other).alias("links"))
    out = program.run(rows, "main = {n = (entity qid).P17 ; linked = (entity (entity qid).P17).label} ;")
    return program.datasets(out).select(F.array_join("headers", ",").alias("headers"), "n")


@query("SELECT * FROM (VALUES ('initial', 'initial'), ('submitted', 'interactive'), ('chosen', 'valid'), ('cycle', 'invalid'), ('unknown', 'invalid'), ('arity', 'invalid')) t(step, state)")
def program_client(spark, d):
    """A client's states: an open option, the option chosen, and programs that can't be read."""
    rows = _entities(spark, d)
    c = program.Client(rows, SOURCE, "de")
    steps = [("initial", c.state), ("submitted", c.submit().state), ("chosen", c.choose("unit", 0).state)]
    for name, bad in (("cycle", "main = a ; a = b ; b = a ;"), ("unknown", "main = nothing ;"), ("arity", "main = plusInt 1 2 3 ;")):
        steps.append((name, program.Client(rows, bad).submit().state))
    return spark.createDataFrame(steps, "step string, state string")


@query(f"""SELECT '["amount","unit"]' AS headers, count(*) AS n FROM ({AMOUNTS}) a""")
def service_functions(spark, d):
    out = service.functions(_entities(spark, d), {"lang": "ParseDeu", "code": 'main = show (entity qid).P1 ; show = \\x -> {amount = x ; unit = [u: "a" | "b"]} ;', "input": '["u", 1]'})
    return out.select(F.to_json("headers").alias("headers"), "n")


BASE = "SELECT lex_id, concat('base', lex_id) AS def FROM (SELECT DISTINCT lex_id FROM edits) z"


@query(f"""
WITH own AS (SELECT lex_id, arg_min(concat('def', seq), seq) AS def FROM edits WHERE user_id % 5 = 3 GROUP BY 1)
SELECT 'get' AS step, b.lex_id::VARCHAR AS id, coalesce(own.def, b.def) AS text FROM ({BASE}) b LEFT JOIN own ON own.lex_id = b.lex_id WHERE b.lex_id = 7
UNION ALL SELECT 'commit', b.lex_id::VARCHAR, CASE WHEN own.def IS NOT NULL THEN 'lin ' || b.lex_id || ' = ' || own.def || ' ;' ELSE b.def END FROM ({BASE}) b LEFT JOIN own ON own.lex_id = b.lex_id
UNION ALL SELECT 'left', 'u3', '0' UNION ALL SELECT 'updated', 'u9', '1'""")
def service_content(spark, d):
    """Reading a definition, updating one, and committing a user's edits."""
    base = view(spark, d, "edits").select("lex_id").distinct().select(F.col("lex_id").cast("string").alias("lex_id"), F.lit("x").alias("lang"), F.concat(F.lit("base"), "lex_id").alias("def"))
    lex = base.select(F.col("lex_id").alias("fun"), F.create_map(F.lit("x"), F.lit("guessed")).alias("status"))
    lines = base.select(F.lit("x").alias("lang"), F.col("lex_id").cast("long").alias("line_no"), F.col("lex_id").alias("fun"), F.col("def").alias("text"))
    state = service.Content(base, lex, lines, log(spark, d).withColumn("lex_id", F.col("lex_id").cast("string")))
    got = state.answer({"user": "u3", "get_id": "7", "lang": "x"}).select(F.lit("get").alias("step"), F.col("lex_id").alias("id"), F.col("def").alias("text"))
    new = state.answer({"user": "u9", "update_id": "7", "lang": "x", "def": "mine"}).select(F.lit("updated").alias("step"), F.col("user").alias("id"), F.col("n").cast("string").alias("text"))
    done = state.answer({"user": "u3", "commit": ""}).select(F.lit("commit").alias("step"), F.col("fun").alias("id"), "text")
    left = state.edits.filter("user = 'u3'").agg(F.count("*").cast("string").alias("text")).select(F.lit("left").alias("step"), F.lit("u3").alias("id"), "text")
    return got.unionByName(new).unionByName(done).unionByName(left)


@query("SELECT fun, 'checked' AS status FROM (SELECT DISTINCT lex_id::VARCHAR AS fun FROM edits WHERE lex_id IN (1, 2)) z")
def service_examples(spark, d):
    """An example's update promotes the statuses of the lexemes that it names; a picked example is unchecked."""
    lex = view(spark, d, "edits").select(F.col("lex_id").cast("string").alias("fun")).distinct().select("fun", F.create_map(F.lit("swe"), F.lit("guessed")).alias("status"), F.array().cast("array<bigint>").alias("example_ids"))
    ex = spark.createDataFrame([("abs*", "F 1 2"), ("abs:", "G 3")], "state string, expr string")
    state = service.Content(None, lex, None, log(spark, d).withColumn("lex_id", F.col("lex_id").cast("string")), ex)
    picked = state.answer({"pick_example": "5"}).first()
    if picked is None or picked.state != "abs*":
        raise ValueError("an unchecked example was expected")
    return state.answer({"user": "u1", "update_example": "99", "key": "1 2"}).filter("status['swe'] = 'checked' and array_contains(example_ids, 99)").select("fun", F.col("status")["swe"].alias("status"))
