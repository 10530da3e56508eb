"""The operators' registered queries and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, chat, decontam, langid, media, neardup, periods, pieces, pii, quality, sharding, spelling, urlfilter
from lexloom.llm.common import crc_mod, table

ORACLES: dict[str, str] = {}


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLES["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s
  FROM split),
classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
sh AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.rep AS u, b.rep AS v FROM sh a JOIN sh b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT rep, rep FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
comp AS (SELECT u AS rep, min(v) AS c FROM reach GROUP BY u),
named AS (SELECT k.s, c.c FROM classes k JOIN comp c USING (rep))
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(n.c, t.doc_id) AS component_id,
       t.doc_id = coalesce(n.c, t.doc_id) AS kept
FROM sets t LEFT JOIN named n ON len(t.s) > 0 AND list_sort(t.s) = n.s
"""

def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(spark, table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep=False)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.examples(turns.unionByName(extra)))


ORACLES["op6_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    12 + length(replace(replace(replace(role, '\', '\s'), '<|', '<\p'), chr(10), '\n')) + 1
       + length(replace(replace(text, '\', '\s'), '<|', '<\p')) + 11 AS shown
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
run AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _marked_sql(text: str, names: bool = True) -> str:
    out = f"coalesce({text}, '')"
    for pattern, by in (decontam.OWN, *[decontam.NAMES] * names, *decontam.REST):
        # possessive repetitions only spare Java the stack; here the plain ones are the same. A look back is a group
        if pattern.startswith(" (?<="):
            pattern, by = pattern.replace(" (?<=", "("), "@1" + by.replace("@1", "@2").lstrip()
        out = f"regexp_replace({out}, '{pattern.replace('++', '+').replace('*+', '*')}', '{by.replace('@', chr(92))}', 'g')"
    return f"lower({out})"


_IS_SLOT = f"left(t, 1) IN ('{decontam.NUM}', '{decontam.NAME}', '{decontam.UNIT}')"
_KEY = f"""array_to_string(list_transform(x, lambda t: CASE WHEN {_IS_SLOT} THEN left(t, 1) ELSE t END), ' ')
      || CASE WHEN len(list_filter(x, lambda t: NOT {_IS_SLOT})) >= {decontam.LITERALS} THEN '' ELSE '|' || array_to_string(x, ' ') END"""
ORACLES["op7_benchmark_decontamination"] = rf"""
WITH cut AS MATERIALIZED (
  SELECT kind, id, form, CASE WHEN kind = 'b' THEN regexp_extract_all(marked, '{decontam.VALUED}')[2:] ELSE regexp_extract_all(marked, '{decontam.VALUED}') END AS own FROM (
    SELECT DISTINCT 'd' AS kind, doc_id AS id, md5(coalesce(text, '')) AS form, {_marked_sql("text")} AS marked FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'i', item_id, '', {_marked_sql("text")} FROM benchmark WHERE item_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'i', item_id, '', {_marked_sql("text", False)} FROM benchmark WHERE item_id IS NOT NULL
    UNION ALL SELECT DISTINCT 'b', item_id, '', {_marked_sql(f"'{decontam.BEHIND}' || coalesce(text, '')")} FROM benchmark WHERE item_id IS NOT NULL)),
items AS (SELECT id, own, least(len(own), {decontam.WINDOW}) AS w, row_number() OVER () AS form FROM (SELECT DISTINCT id, own FROM cut WHERE kind <> 'd' AND len(own) > 0)),
item_w AS MATERIALIZED (
  SELECT *, {_KEY} AS h FROM (SELECT id, form, w, pos, len(own) - w + 1 AS n, own[pos:pos + w - 1] AS x
    FROM (SELECT *, unnest(range(1, len(own) - w + 2)) AS pos FROM items))),
doc_w AS (
  SELECT *, {_KEY} AS h FROM (SELECT id, form, w, pos, own[pos:pos + w - 1] AS x
    FROM (SELECT *, unnest(range(1, len(own) - w + 2)) AS pos FROM cut, (SELECT DISTINCT w FROM item_w)
          WHERE kind = 'd' AND len(own) >= w))),
met AS MATERIALIZED (
  SELECT d.id AS doc_id, d.form AS dform, i.id AS item_id, i.form AS form, n, i.pos, d.pos - i.pos AS diagonal, i.x AS own, d.x AS seen
  FROM doc_w d JOIN item_w i ON d.h = i.h AND d.w = i.w),
slot AS (SELECT doc_id, dform, item_id, form, diagonal, unnest(own) AS t, unnest(seen) AS v FROM met),
checked AS (
  SELECT doc_id, dform, item_id, form, diagonal, count(DISTINCT t || chr(0) || v) = count(DISTINCT t) AS fits, count(DISTINCT CASE WHEN t <> v THEN t END) AS changed
  FROM slot WHERE {_IS_SLOT} GROUP BY ALL),
good AS (
  SELECT m.*, coalesce(changed, 0) AS changed FROM (SELECT DISTINCT doc_id, dform, item_id, form, n, pos, diagonal FROM met) m
  LEFT JOIN checked c USING (doc_id, dform, item_id, form, diagonal) WHERE coalesce(fits, true)),
runs AS (
  SELECT doc_id, dform, item_id, form, max(c) AS longest FROM (
    SELECT doc_id, dform, item_id, form, diagonal, pos - i, count(*) AS c FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, dform, item_id, form, diagonal ORDER BY pos) AS i FROM good) GROUP BY ALL) GROUP BY ALL),
whole AS (
  SELECT doc_id, item_id, n, count(DISTINCT pos) AS matched, max(longest) AS longest, max(changed) AS changed
  FROM good JOIN runs USING (doc_id, dform, item_id, form) GROUP BY doc_id, dform, item_id, form, n)
SELECT doc_id, item_id, n AS n_windows, matched, CAST(longest AS BIGINT) AS longest, CAST(changed AS BIGINT) AS changed
FROM whole WHERE matched >= {decontam.COVER} * n OR longest >= {decontam.RUN}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, n DESC, longest DESC, changed DESC) = 1
"""


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES).select(
        "page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust")
    )


def _rank_sql(name: str, edges: str, seed: str) -> str:
    """As many steps as leave a change under 1e-6, all written out; flows stop by themselves where links do."""
    d = urlfilter.DAMPING
    out = [
        f"{name}_w AS MATERIALIZED (SELECT src, dst, {d} * n / sum(n) OVER (PARTITION BY src) AS w FROM {edges})",
        f"{name}_0 AS MATERIALIZED (SELECT host, {1 - d!r}::DOUBLE / count(*) OVER () AS score FROM hosts WHERE 2 * {seed} > n)",
    ]
    for i in range(_STEPS):
        out.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {name}_0 "
            f"UNION ALL SELECT dst, score * w FROM {name}_{i} JOIN {name}_w ON host = src) GROUP BY host)"
        )
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {name}_{_STEPS})"])


_STEPS = 100


def _rule_sql() -> str:
    out = "NULL"
    for _, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        out = f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}' ELSE {out} END"
    return out


_SAYS = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES) + " END"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINK = urlfilter.LINK.replace("'", "''")
ORACLES["op10_url_filters"] = rf"""
WITH parsed AS (
  SELECT page_id, html, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tagged AS MATERIALIZED (SELECT *, {_rule_sql()} AS rule FROM parsed),
says AS (SELECT *, {_SAYS} AS ruled FROM tagged),
hosts AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM says GROUP BY host),
links AS (SELECT host AS src, {_LOWER.format("unnest(regexp_extract_all(html, '" + _LINK + "', 2))")} AS dst FROM says),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY src, dst),
redges AS (SELECT dst AS src, src AS dst, n FROM edges),
{_rank_sql("good_rank", "edges", "good")},
{_rank_sql("bad_rank", "redges", "bad")}
SELECT page_id, s.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(b.score, 0) > coalesce(g.score, 0) + 1e-9 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(g.score, 0), 6) AS trust, round(coalesce(b.score, 0), 6) AS distrust
FROM says s LEFT JOIN good_rank g USING (host) LEFT JOIN bad_rank b USING (host)
"""

def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rules = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.count_tokens(table(spark, sf_dir, "documents"), rules).withColumn("over_limit", F.col("n_tokens") > 512)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), typos=31)
    return spelling.variants(words.filter("n >= 2"))


#: CRC-32 of lists of bytes: its table from the polynomial, then a fold over the bytes.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc_sql(bytes_: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _latin_bytes(text: str) -> str:
    """The UTF-8 bytes of text up to U+00FF."""
    code = "CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [192 | (unicode(ch) >> 6)::BIGINT, 128 | (unicode(ch) & 63)::BIGINT] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda ch: {code}))"


ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(coalesce(text, ''), '[" + spelling.LETTERS + "]+'))")} AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, c, {_crc_sql(_latin_bytes("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs, crc_table),
written AS (
  SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.d = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.d = words.word),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(struct_pack(f := b, n := w.n), struct_pack(n := -w.n, f := b)) AS top FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 10 * w.n THEN top.f END AS form, CASE WHEN top.n >= 10 * w.n THEN top.n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
way AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT way.word, forms.form, step + 1 FROM way JOIN forms ON forms.word = root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(periods.repeated_tail(table(spark, sf_dir, "documents"))).withColumn("top", periods.longest(F.col("runs")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


ORACLES["op13_periodic_runs"] = rf"""
WITH {_CRC_TABLE},
split AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS ws,
    {_crc_sql(_latin_bytes("coalesce(doc_id::VARCHAR, '')"))} AS h
  FROM documents, crc_table),
cut AS (SELECT rid, doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM split),
tail AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM cut),
seen AS MATERIALIZED (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE ws END AS ws
  FROM tail),
grams AS MATERIALIZED (
  SELECT rid, i, array_to_string(ws[i + 1:i + 6], ' ') AS k FROM (SELECT rid, ws, unnest(range(n - 5)) AS i FROM seen WHERE n >= 12)),
alike AS (SELECT a.rid, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.rid = b.rid AND a.k = b.k AND a.i < b.i),
held AS (
  SELECT rid, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM alike)
  GROUP BY rid, q, island),
runs AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM held WHERE length >= greatest(12, 2 * q) GROUP BY rid, start, length),
listed AS (
  SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT rid, unnest(ws) AS w, unnest(range(n)) AS i FROM seen) ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM seen LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for k, v in list(globals().items()) if k.startswith("op") and callable(v)}
