"""Text functions: transliteration, normal forms, names, segmentation, edit distance over scripts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def transliterate(text: Column, table: dict[str, str]) -> Column:
    """Character by character; capitals follow from the small letters' entries; null if a letter
    has no entry (a distance to it is then undefined)."""
    both = table | {k.upper(): v[:1].upper() + v[1:] for k, v in table.items() if k.upper() != k and len(k.upper()) == 1}
    m = F.create_map(*(F.lit(x) for kv in sorted(both.items()) for x in kv))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    out = F.transform(chars, lambda c: F.coalesce(F.try_element_at(m, c), F.when(~c.rlike(r"\p{L}"), c)))
    return F.when(F.forall(out, lambda c: c.isNotNull()), F.array_join(out, ""))


def nfd(text: Column) -> Column:
    """Canonical decomposition; Spark has no function for it, so it runs in Arrow batches. The function
    is made when it is asked for: one that a module holds could not travel with that module."""

    def decomposed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFD", x) if isinstance(x, str) else None)

    return F.pandas_udf(decomposed, T.StringType())(text)


def replaced_in_order(text: Column, table: list[tuple[str, str]]) -> Column:
    """Ordered replacement, longer letter groups before their parts; capitals alike."""
    pairs = [p for a, b in table for p in ((a, b), (a[:1].upper() + a[1:], b[:1].upper() + b[1:]))]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def script(text: Column) -> Column:
    """Name of the first letter's script, among those that are told apart."""
    first = F.regexp_extract(text, r"(\p{L})", 1)
    names = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han"]
    return reduce(lambda acc, n: F.when(first.rlike(rf"\p{{Is{n}}}"), n).otherwise(acc), reversed(names), F.lit(None).cast("string"))


def normalised_name(labels: Column) -> Column:
    """English or general label, cut at a slash or bracket, small letters, blanks as underscores."""
    raw = F.coalesce(F.try_element_at(labels, F.lit("en")), F.try_element_at(labels, F.lit("mul")))
    return F.replace(F.lower(F.trim(F.regexp_replace(raw, r"[/(].*$", ""))), F.lit(" "), F.lit("_"))


def trimmed_label(raw: Column) -> Column:
    """struct(text, lang) of ``"text"@lang``, the text cut at the first of ( , / and backslash."""
    return F.struct(F.trim(F.regexp_extract(raw, r'^"([^(,/\\"]*)', 1)).alias("text"), F.regexp_extract(raw, r"@([A-Za-z-]+)$", 1).alias("lang"))


def escape_semicolons(x: Column) -> Column:
    return F.replace(x, F.lit(";"), F.lit("%3B"))


def quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def segment(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Greedy longest match from the left: rows(id, words) against lexicon(form), words of a form parted
    by single blanks; (id, at, size, form), unknown words alone with a null form.

    Candidate spans meet the lexicon in a join; the cover is a fold over each text's spans."""
    longest = lexicon.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    n = F.size("words")
    cut = rows.select("id", "words", F.explode(F.sequence(F.lit(1), n)).alias("at")).select("id", "words", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("size"))
    spans = cut.select("id", "at", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("form"))
    hits = spans.join(lexicon.select("form").distinct(), "form").groupBy("id", "at").agg(F.max_by(F.struct("size", "form"), "size").alias("h"))
    per = rows.select("id", F.posexplode("words").alias("p", "word")).select("id", (F.col("p") + 1).alias("at")).join(hits, ["id", "at"], "left")
    seq = per.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("h.size"), F.lit(1)).alias("size"), F.col("h.form").alias("form")))).alias("s"))
    kind = "array<struct<at:int,size:int,form:string>>"
    fold = F.aggregate(
        "s",
        F.struct(F.lit(1).alias("next"), F.array().cast(kind).alias("out")),
        lambda a, x: F.when(x["at"] == a["next"], F.struct((x["at"] + x["size"]).alias("next"), F.array_append(a["out"], x).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )
    return seq.select("id", F.explode(fold).alias("x")).select("id", "x.at", "x.size", "x.form")


# Categories whose definition wraps that of a plainer one, as constructor and category; the
# lower-cased ones among the rest; and those that are written as they are.
WRAPPED = {"A2": ("mkA2", "A"), "N2": ("mkN2", "N"), "V2": ("mkV2", "V"), "V2A": ("mkV2", "V"), "V2S": ("mkV2S", "V"), "V2Q": ("mkV2Q", "V"), "V2V": ("mkV2V", "V"), "V3": ("mkV3", "V"), "VA": ("mkVA", "V"), "VQ": ("mkVQ", "V"), "VS": ("mkVS", "V"), "VV": ("mkVV", "V")}
LOWERED, NAMES = ("A", "AdA", "AdN", "AdV", "Adv", "Interj", "N", "Prep", "V"), ("PN", "LN", "GN", "SN")


def predicted_definitions(rows: DataFrame, paradigms: DataFrame) -> DataFrame:
    """rows(fun, lin) with def, the draft definition by the function's category: a known paradigm
    (name, def) under the lemma, its gender and the plain category, else the plain constructor of the
    lemma; categories without a paradigm have none."""
    cat = F.regexp_extract("fun", "([^_]*)$", 1)
    m = F.create_map(*(F.lit(x) for k, (_, c) in WRAPPED.items() for x in (k, c)))
    w = F.create_map(*(F.lit(x) for k, (f, _) in WRAPPED.items() for x in (k, f)))
    plain = F.coalesce(F.try_element_at(m, cat), F.when(cat.isin(*LOWERED, *NAMES), cat))
    lemma = F.when(cat.isin(*NAMES), F.col("lin")).otherwise(F.lower("lin"))
    gender = F.when(F.col("fun").contains("Masc_"), "Masc_").when(F.col("fun").contains("Fem_"), "Fem_").otherwise("_")
    r = rows.select("*", cat.alias("cat_"), plain.alias("plain_"), lemma.alias("lemma_"), F.concat(F.lower("lin"), gender, plain).alias("name_"))
    j = r.join(paradigms.select(F.col("name").alias("name_"), F.col("def").alias("known_")), "name_", "left")
    own = F.coalesce("known_", F.concat(F.lit("mk"), "plain_", F.lit(' "'), "lemma_", F.lit('"')))
    wrap = F.try_element_at(w, F.col("cat_"))
    text = F.when(wrap.isNotNull(), F.concat(wrap, F.lit(" ("), own, F.lit(")"))).when(F.col("cat_") == "Voc", F.concat(F.lit('{s="'), "lemma_", F.lit('"}'))).when(F.col("plain_").isNotNull(), own)
    return j.select(*rows.columns, F.coalesce(text, F.lit("variants {}")).alias("def"))


def definition_text(cat: Column, form: Column, paradigms: dict[str, str]) -> Column:
    """Draft definition by the category's paradigm, such as ``mkN "form"``; null for other categories."""
    m = F.create_map(*(F.lit(x) for kv in sorted(paradigms.items()) for x in kv))
    return F.concat(F.try_element_at(m, cat), F.lit(" "), quoted(form))
