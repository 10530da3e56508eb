"""The lexical model as views over the test tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.session import table

# One definition serves both engines: the SQL below runs in Spark and in DuckDB alike.
SYN = "SELECT p_partkey AS id, p_name AS gloss, p_type AS offset_tag FROM part"
HYPER = """
SELECT DISTINCT child, parent FROM (
  SELECT p_partkey AS child, CAST(floor((p_partkey - 1) / 2) AS BIGINT) AS parent FROM part WHERE p_partkey >= 1
  UNION ALL
  SELECT p_partkey, CAST(floor((p_partkey - 1) / 3) AS BIGINT) FROM part WHERE p_partkey >= 14 AND p_partkey % 7 = 0) h"""
LEX = """
SELECT concat('p', l_partkey, '_', l_suppkey, '_N') AS fun, l_partkey AS synset_id, l_suppkey AS supp, COUNT(*) AS cnt
FROM lineitem GROUP BY l_partkey, l_suppkey"""
EX = "SELECT l_orderkey AS ex_id, l_linenumber AS pos, concat(p_brand, ' ', p_type) AS fun, p_type AS cat FROM lineitem JOIN part ON l_partkey = p_partkey"
DOM = """
SELECT concat('r', r_regionkey) AS id, r_name AS name, CAST(NULL AS VARCHAR(9)) AS parent FROM region
UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey) FROM nation
UNION ALL SELECT concat('c', c_custkey), c_name, concat('n', c_nationkey) FROM customer"""
PAIRS = """
SELECT DISTINCT a, b FROM (
  SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) p
WHERE b IS NOT NULL"""
STATUS = """
SELECT concat('p', l_partkey, '_', l_suppkey, '_N') AS fun, l_linestatus AS lang,
  CASE l_returnflag WHEN 'A' THEN 'checked' WHEN 'N' THEN 'unchecked' ELSE 'guessed' END AS status FROM lineitem"""
EDITS = "SELECT event_id AS seq, user_id, event_type AS kind, CAST(user_id % 97 AS BIGINT) AS lex_id, value FROM events"
TOK = r"""
SELECT doc_id, pos, word FROM (
  SELECT doc_id, posexplode(split(lower(text), '[^\\p{L}]+')) AS (pos, word) FROM documents) t WHERE word <> ''"""

VIEWS = {"syn": SYN, "hyper": HYPER, "lex": LEX, "ex": EX, "dom": DOM, "pairs": PAIRS, "status": STATUS, "edits": EDITS}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the model as a DataFrame; the tables it reads are registered under its directory."""
    sql = VIEWS[name]
    tables = {t: table(spark, sf_dir, t) for t in TABLES if t in sql.replace("(", " ").replace(")", " ").split()}
    # DataFrames pass by reference, so that two directories never share a view name
    for t in sorted(tables, key=len, reverse=True):
        sql = _bind(sql, t)
    return spark.sql(sql, **tables)


def _bind(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def with_views(sql: str) -> str:
    """The oracle form: the views that sql names, as common table expressions before it."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n not in need and re.search(rf"\b(FROM|JOIN|,)\s*{n}\b", text):
                need.append(n)
                add(VIEWS[n])

    add(sql)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE') :]}" if head else body
    if body.upper().startswith("WITH"):
        return f"WITH {head},\n{body[len('WITH') :]}" if head else body
    return f"WITH {head}\n{body}" if head else body
