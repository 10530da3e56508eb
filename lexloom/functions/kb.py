"""Builtins of the knowledge-base language as Column expressions.

A value with several alternatives is an array: an empty array gives no rows, and alternatives of
several columns multiply when they are exploded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "http://www.wikidata.org/entity/"


# The months' names in the grammar.
MONTHS = "january february march april may june july august september october november december".split()


SNAK = "struct<snaktype:string,datatype:string,datavalue:struct<value:variant>>"
CLAIMS = f"array<struct<mainsnak:{SNAK},qualifiers:variant,references:variant>>"


def parsed(json: Column) -> Column:
    """An entity's JSON as a variant, which is parsed once and then read by path; null for what is no JSON."""
    return F.try_parse_json(json)


def with_entity(entities: DataFrame, json: str = "json") -> DataFrame:
    """entities with ``entity``, the variant of their JSON, as a column of its own before anything reads it."""
    return entities.withColumn("entity", parsed(F.col(json)))


def _at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def claims(entity: Column, prop: str) -> Column:
    """Main snaks of a property that hold a value, each with its datatype, its value and its qualifiers and
    references as variants; missing or novalue: none. entity is a variant."""
    snaks = F.coalesce(_at(entity, f"$.claims.{prop}", CLAIMS), F.array().cast(CLAIMS))
    some = F.filter(snaks, lambda s: s["mainsnak"]["snaktype"] == "value")
    return F.transform(some, lambda s: F.struct(s["mainsnak"]["datatype"].alias("datatype"), s["mainsnak"]["datavalue"]["value"].alias("value"), s["qualifiers"].alias("qualifiers"), s["references"].alias("references")))


def properties(entity: Column) -> Column:
    """Names of all properties of an untyped entity."""
    return F.array_sort(F.coalesce(F.map_keys(_at(entity, "$.claims", "map<string,variant>")), F.array().cast("array<string>")))


def statements(entities: DataFrame) -> DataFrame:
    """(qid, prop, pos, datatype, value, qualifiers): a row a statement of untyped entities (qid, json), whatever
    their properties, values decoded, undecodable ones null; novalue has no row. qualifiers: (prop, value) pairs by name."""
    e = with_entity(entities.select("qid", "json")).select("qid", "entity")
    rows = e.sparkSession.sql(
        "SELECT e.qid, p.key AS prop, c.pos, c.value AS claim FROM {e} e, LATERAL variant_explode(try_variant_get(e.entity, '$.claims', 'variant')) p, LATERAL variant_explode(p.value) c", e=e
    )
    main = F.try_variant_get("claim", "$.mainsnak", SNAK)
    rows = rows.select("qid", "prop", "pos", main.alias("s"), _at(F.col("claim"), "$.qualifiers", f"map<string,array<{SNAK}>>").alias("q")).filter("s.snaktype = 'value'")
    pairs = F.transform(F.array_sort(F.map_keys("q")), lambda k: F.transform(F.filter(F.col("q")[k], lambda s: s["snaktype"] == "value"), lambda s: F.struct(k.alias("prop"), decoded(s["datatype"], s["datavalue"]["value"]).alias("value"))))
    return rows.select("qid", "prop", "pos", F.col("s.datatype").alias("datatype"), decoded(F.col("s.datatype"), F.col("s.datavalue.value")).alias("value"), F.coalesce(F.flatten(pairs), F.array()).alias("qualifiers"))


def decoded(datatype: Column, value: Column) -> Column:
    """A value, which is a variant, by its datatype as text; an unknown datatype is null."""
    return (
        F.when(datatype == "commonsMedia", image_url(_at(value, "$")))
        .when(datatype == "quantity", decimal_text(_at(value, "$.amount")))
        .when(datatype == "wikibase-item", _at(value, "$.id"))
        .when(datatype == "globe-coordinate", F.concat_ws(",", _at(value, "$.latitude"), _at(value, "$.longitude")))
        .when(datatype == "time", _at(value, "$.time"))
        .when(datatype == "monolingualtext", _at(value, "$.text"))
        .when(datatype == "string", _at(value, "$"))
    )


# The types of the language and the datatypes that they take.
DATATYPES = {"Int": ("quantity",), "Float": ("quantity",), "Time": ("time",), "Str": ("commonsMedia", "wikibase-item", "monolingualtext", "string"), "Coordinate": ("globe-coordinate",)}


def typed_entity(entities: DataFrame, fields: dict[str, str], lang: str = "en") -> DataFrame:
    """qid and a column for each field of the asked record type, an array of alternatives: properties
    decoded by their datatype, of which those that don't fit the field's type drop out, and ``label``.
    A missing property has no alternatives."""
    fits = lambda kinds: lambda c: c["datatype"].isin(*kinds)
    cast_to = lambda to: lambda x: x.try_cast(to)
    cols = []
    for name, kind in fields.items():
        if name == "label":
            one = label(F.col("entity"), lang)
            cols.append(F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>")).alias("label"))
            continue
        fit = F.filter(claims(F.col("entity"), name), fits(DATATYPES[kind]))
        values = F.transform(fit, lambda c: decoded(c["datatype"], c["value"]))
        if kind in ("Int", "Float"):
            values = F.transform(values, cast_to("long" if kind == "Int" else "double"))
        cols.append(F.filter(values, lambda x: x.isNotNull()).alias(name))
    return with_entity(entities).select("qid", *cols)


def qualifier(snak: Column, prop: str) -> Column:
    """Values of a qualifier or a reference, whichever has the property; undecodable ones drop out."""
    kind = f"array<{SNAK}>"
    none = F.array().cast(kind)
    q = F.coalesce(_at(snak["qualifiers"], f"$.{prop}", kind), none)
    refs = F.coalesce(_at(snak["references"], "$", "array<struct<snaks:variant>>"), F.array().cast("array<struct<snaks:variant>>"))
    r = F.flatten(F.transform(refs, lambda x: F.coalesce(_at(x["snaks"], f"$.{prop}", kind), none)))
    values = F.transform(F.filter(F.concat(q, r), lambda s: s["snaktype"] == "value"), lambda s: decoded(s["datatype"], s["datavalue"]["value"]))
    return F.filter(values, lambda x: x.isNotNull())


def label(entity: Column, lang: str) -> Column:
    """In the language, else in English; entity is a variant."""
    return F.coalesce(_at(entity, f"$.labels['{lang}'].value"), _at(entity, "$.labels.en.value"))


def drop_url(x: Column) -> Column:
    return F.regexp_replace(x, "^" + ENTITY.replace(".", r"\."), "")


def decimal_text(x: Column) -> Column:
    """Without the leading plus; null unless the whole string is a number."""
    bare = F.regexp_replace(x, r"^\+", "")
    return F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), bare)


def decimal(x: Column) -> Column:
    return decimal_text(x).try_cast("double")


def image_url(name: Column) -> Column:
    """The address of a media file: blanks as underscores, folders by md5 of the name."""
    file = F.replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit(" "), F.lit("_"))
    h = F.md5(file.cast("binary"))
    return F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/"), F.substring(h, 1, 1), F.lit("/"), F.substring(h, 1, 2), F.lit("/"), file)


def time_parts(t: Column) -> Column:
    """struct(year, month, day) of YYYY-MM-DD..., a sign before it or not; month 0: year alone; day 0: no day; a month
    above 12 or another form: null."""
    pattern = r"^([+-]?\d{4})-(\d\d)-(\d\d)"
    year, month, day = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    none = F.lit(None).cast("int")
    return F.when(t.rlike(pattern) & (m <= 12), F.struct(y.alias("year"), F.when(m > 0, m).otherwise(none).alias("month"), F.when((m > 0) & (d > 0), d).otherwise(none).alias("day")))


def time_adverb(t: Column) -> Column:
    """Tree of a date: by year, month and year, or day, month and year."""
    p = time_parts(t)
    year = F.concat(F.lit("(intYear "), p["year"].cast("string"), F.lit(")"))
    month = F.concat(F.get(F.array(*map(F.lit, MONTHS)), p["month"] - 1), F.lit("_Month"))
    day = F.concat(F.lit("(intMonthday "), p["day"].cast("string"), F.lit(")"))
    full = F.concat_ws(" ", F.lit("dayMonthYearAdv"), day, month, year)
    return F.when(p.isNull(), F.lit(None)).when(p["month"].isNull(), F.concat_ws(" ", F.lit("yearAdv"), year)).when(p["day"].isNull(), F.concat_ws(" ", F.lit("monthYearAdv"), month, year)).otherwise(full)


def language(code: str) -> str:
    """The current language's code: ParseEng is eng."""
    return code.removeprefix("Parse").lower()


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, "LT").when(a == b, "EQ").when(a > b, "GT")


def floor_div(a: Column, b: Column) -> Column:
    """Rounds down, not towards zero; a zero divisor is an error."""
    exact = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), exact - 1).otherwise(exact)


def floor_mod(a: Column, b: Column) -> Column:
    """Takes the sign of the divisor."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def round_half_even(x: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("digits must not be negative")
    return F.bround(x, n)


def int_digits(n: Column) -> Column:
    """Digit tree of a whole number: (IIDig D_1 (IIDig D_2 (IDig D_3))), a minus in front for negatives."""
    return _digit_tree(F.regexp_replace(n.cast("string"), "^-", ""))


def _digit_tree(text: Column) -> Column:
    digits = F.split(text, "")
    digits = F.filter(digits, lambda d: d != "")
    last = F.concat(F.lit("(IDig D_"), F.element_at(digits, -1), F.lit(")"))
    rest = F.reverse(F.slice(digits, 1, F.size(digits) - 1))
    return F.aggregate(rest, last, lambda acc, d: F.concat(F.lit("(IIDig D_"), d, F.lit(" "), acc, F.lit(")")))


def int_decimal(n: Column) -> Column:
    return F.concat(F.when(n < 0, "(NegDecimal ").otherwise("(PosDecimal "), int_digits(n), F.lit(")"))


def float_decimal(x: Column) -> Column:
    """Decimal tree of the shortest digits that give the number back: the whole part, then a fraction
    step for each digit behind the point; negative zero is negative, what is no number is null."""
    text = F.regexp_replace(x.cast("double").cast("string"), "^-", "")
    exp = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole, frac = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    # the point moves over by the exponent: zeros are filled in on both sides
    left = F.concat(F.repeat(F.lit("0"), F.greatest(-exp, F.lit(0))), whole, frac, F.repeat(F.lit("0"), F.greatest(exp, F.lit(0))))
    point = F.length(whole) + F.greatest(exp, F.lit(0))
    digits = F.regexp_replace(F.substr(left, F.lit(1), point), "^0+(?=.)", "")
    behind = F.regexp_replace(F.substr(left, point + 1), "0+$", "")
    sign = F.when(x.cast("string").startswith("-"), "(NegDecimal ").otherwise("(PosDecimal ")
    start = F.concat(sign, _digit_tree(digits), F.lit(")"))
    tree = F.aggregate(F.filter(F.split(behind, ""), lambda d: d != ""), start, lambda acc, d: F.concat(F.lit("(IFrac "), acc, F.lit(" D_"), d, F.lit(")")))
    return F.when(whole != "", tree)


def render(x: Column) -> Column:
    """A table cell; a missing field shows as a question mark."""
    return F.coalesce(x.cast("string"), F.lit("?"))


def header_types(df: DataFrame) -> list[tuple[str, str]]:
    """(column, string, number, markup or text) for the client."""
    kinds = {"string": "string", "int": "number", "bigint": "number", "double": "number", "float": "number", "boolean": "text"}
    return [(c, "markup" if c.startswith("markup_") else kinds.get(t, "text")) for c, t in df.dtypes]


def expand_variants(df: DataFrame, *cols: str) -> DataFrame:
    """The cross product of the alternatives in the array columns, with the index of each choice."""
    for c in cols:
        df = df.select("*", F.posexplode(c).alias(f"{c}_choice", f"{c}_value")).drop(c).withColumnRenamed(f"{c}_value", c)
    return df


def replay(df: DataFrame, choices: dict[str, int]) -> DataFrame:
    """Rows of the given choices alone."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(f"{c}_choice") == i for c, i in choices.items()), F.lit(True)))


def grouped_by_header(rows: DataFrame) -> DataFrame:
    """(headers, rows): rows (pos, headers, cells) of equal headers together, in the order in which a
    header came first."""
    g = rows.groupBy("headers").agg(F.min("pos").alias("first_pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "cells"))), lambda r: r["cells"]).alias("rows"))
    return g.select("first_pos", "headers", "rows")


def page(template: Column, values: dict[str, Column]) -> Column:
    """A template with its <%name%> marks filled."""
    return reduce(lambda t, kv: F.replace(t, F.lit(f"<%{kv[0]}%>"), render(kv[1])), values.items(), template)


def page_script(entities: DataFrame, scripts: DataFrame, overrides: DataFrame) -> DataFrame:
    """(qid, script): an entity's own script, else that of its first class (P31) that has one."""
    cls = with_entity(entities).select("qid", F.posexplode(F.transform(claims(F.col("entity"), "P31"), lambda c: _at(c["value"], "$.id"))).alias("pos", "class"))
    by = cls.join(scripts, "class").groupBy("qid").agg(F.min_by("script", "pos").alias("class_script"))
    own = overrides.select("qid", F.col("script").alias("own_script"))
    return entities.select("qid").join(by, "qid", "left").join(own, "qid", "left").select("qid", F.coalesce("own_script", "class_script").alias("script"))


def linked(brackets: DataFrame, links: DataFrame) -> DataFrame:
    """Forms of subtrees whose function has a link become hyperlinks; brackets(fun, form), links(fun, url)."""
    a = F.concat(F.lit('<a href="'), "url", F.lit('">'), "form", F.lit("</a>"))
    return brackets.join(links, "fun", "left").withColumn("markup", F.coalesce(a, "form"))


def inflections(lexicon: DataFrame, fun: str, lang: str) -> DataFrame:
    """(analysis, form) of one function; the lexicon stands in for the external morphology."""
    return lexicon.filter((F.col("fun") == fun) & (F.col("lang") == lang)).select("analysis", "form").orderBy("analysis", "form")
