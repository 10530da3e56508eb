"""Readers of the text resources, as DataFrame transforms of lines.

Every parser takes a DataFrame with a column ``value`` (one line or one block each), so it runs on
``spark.read.text`` output of any size; what a malformed line gives is stated in each docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.model import POINTER_CODES


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file with their numbers (from 1): one task reads a file, and files are many."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "value")).select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "value")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated blocks."""
    return spark.read.text(path, lineSep="\n\n")


def abstract_lexicon(rows: DataFrame) -> DataFrame:
    """``fun ID : CAT ; -- OFFSET-TAG<TAB>[dom, dom] gloss`` to (fun, cat, offset, domains, gloss);
    other lines drop out, the comment may be missing."""
    v = F.col("value")
    head = r"^\s*fun\s+(\S+)\s*:\s*([^;]+?)\s*;"
    comment = F.regexp_extract(v, r";\s*--\s*(.*)$", 1)
    key, rest = F.substring_index(comment, "\t", 1), F.when(F.instr(comment, "\t") > 0, F.regexp_replace(comment, r"^[^\t]*\t", "")).otherwise(F.lit(""))
    offset = F.when(F.instr(comment, "\t") > 0, F.regexp_extract(key, r"(.{10})$", 1))
    doms = F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)
    return rows.filter(v.rlike(head)).select(
        F.regexp_extract(v, head, 1).alias("fun"),
        F.regexp_extract(v, head, 2).alias("cat"),
        F.when(offset != "", offset).alias("offset"),
        F.filter(F.transform(F.split(doms, ","), lambda d: F.trim(d)), lambda d: d != "").alias("domains"),
        F.trim(F.regexp_replace(rest, r"^\[[^\]]*\]", "")).alias("gloss"),
    )


def concrete_lexicon(rows: DataFrame, lang: str) -> DataFrame:
    """``lin ID = DEF ; --unchecked`` to (fun, lang, def, status); missing definitions drop out."""
    v = F.col("value")
    pat = r"^\s*lin\s+(\S+)\s*=\s*(.*?)\s*;\s*(--.*)?$"
    tail = F.regexp_extract(v, pat, 3)
    status = F.when(tail.contains("guessed"), "guessed").when(tail.contains("unchecked"), "unchecked").otherwise("checked")
    out = rows.filter(v.rlike(pat)).select(F.regexp_extract(v, pat, 1).alias("fun"), F.lit(lang).alias("lang"), F.regexp_extract(v, pat, 2).alias("def"), status.alias("status"))
    return out.filter(~F.col("def").rlike(r"^variants\s*\{\s*\}$"))


def _field(name: str):
    return F.regexp_extract("value", rf"(?m)^{name}:[ \t]*(.*)$", 1)


def examples(rows: DataFrame) -> DataFrame:
    """Blocks of abs/eng/swe/bul/key lines to (state, expr, eng, swe, bul, key, funs); state is
    abs:, abs* (unchecked) or abs^ (needs work)."""
    from lexloom.functions.trees import functions

    head = F.regexp_extract("value", r"(?m)^(abs[:*^])", 1)
    expr = F.trim(F.regexp_extract("value", r"(?m)^abs[:*^][ \t]*(.*)$", 1))
    key = F.filter(F.split(F.trim(_field("key")), r"[ \t]+"), lambda k: k != "")
    return rows.filter(head != "").select(head.alias("state"), expr.alias("expr"), *(F.trim(_field(x)).alias(x) for x in ("eng", "swe", "bul")), key.alias("key"), functions(expr).alias("funs"))


def verb_classes(rows: DataFrame) -> DataFrame:
    """class/role blocks to (class, vars): roles with their restrictions."""
    role = F.regexp_extract_all("value", F.lit(r"(?m)^role:[ \t]*(.*)$"), F.lit(1))
    var = lambda r: F.struct(F.substring_index(r, " ", 1).alias("role"), F.filter(F.split(F.regexp_replace(r, r"^\S+\s*", ""), r"\s+"), lambda x: x != "").alias("restr"))
    return rows.filter(F.col("value").rlike(r"(?m)^class:")).select(F.trim(_field("class")).alias("class"), F.transform(role, var).alias("vars"))


def frames(rows: DataFrame) -> DataFrame:
    """frm/sem/key blocks to (pattern, semantics, key)."""
    return rows.filter(F.col("value").rlike(r"(?m)^frm:")).select(F.trim(_field("frm")).alias("pattern"), F.trim(_field("sem")).alias("semantics"), F.split(F.trim(_field("key")), r"\s+").alias("key"))


def frame_instances(rows: DataFrame) -> DataFrame:
    """``path/ID@{role:fid,...}`` items of an example's key to (item, fun, roles map)."""
    item = F.regexp_extract(F.col("item"), r"^(?:.*/)?([^/@]+)@\{([^}]*)\}$", 1)
    roles = F.str_to_map(F.regexp_extract("item", r"@\{([^}]*)\}$", 1), F.lit(","), F.lit(":"))
    return rows.filter(item != "").select("item", item.alias("fun"), F.transform_values(roles, lambda k, v: v.try_cast("int")).alias("roles"))


def constructions(rows: DataFrame) -> DataFrame:
    """abs / language / key blocks to (qid, expr, langs); without languages the general one, Mul, holds."""
    langs = F.filter(F.regexp_extract_all("value", F.lit(r"(?m)^([a-z]{3}):"), F.lit(1)), lambda x: ~x.isin("abs", "key"))
    return rows.filter(F.col("value").rlike(r"(?m)^abs:")).select(
        F.trim(_field("key")).alias("qid"),
        F.trim(_field("abs")).alias("expr"),
        F.when(F.size(langs) == 0, F.array(F.lit("ParseMul"))).otherwise(F.transform(langs, lambda x: F.concat(F.lit("Parse"), F.initcap(x)))).alias("langs"),
    )


def _pointers(text):
    """``SYM KEY SYM KEY`` as structs; a code's relation and subtype come from the fixed table."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    name = F.create_map(*(F.lit(x) for k, (s, _) in POINTER_CODES.items() for x in (k, s)))
    sub = F.create_map(*(F.lit(x) for k, (_, t) in POINTER_CODES.items() for x in (k, t or "")))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)) - 1, F.lit(1)), lambda i: i % 2 == 1)
    at = F.when(F.size(words) >= 2, at).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.try_element_at(name, F.element_at(words, i)).alias("sym"), F.nullif(F.try_element_at(sub, F.element_at(words, i)), F.lit("")).alias("subtype"), F.element_at(words, i + 1).alias("tgt")))


def taxonomy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synset rows (offset, id, children, pointers, gloss), which start with a digit or Q, and lexeme
    rows (fun, pointers). Children are ``lo-hi`` ranges, comma separated, a dash for none."""
    v = F.trim("value")
    is_synset = v.rlike("^[0-9Q]")
    body, gloss = F.trim(F.substring_index(v, "|", 1)), F.trim(F.when(F.instr(v, "|") > 0, F.regexp_replace(v, r"^[^|]*\|", "")).otherwise(F.lit("")))
    part = lambda i: F.get(F.split(body, r"\s+"), i)
    ranges = F.filter(F.split(part(2), ","), lambda r: r.rlike(r"^\d+(-\d+)?$"))
    kids = F.transform(ranges, lambda r: F.struct(F.substring_index(r, "-", 1).cast("long").alias("lo"), F.substring_index(r, "-", -1).cast("long").alias("hi")))
    pts = lambda t: F.transform(_pointers(t), lambda p: F.struct(p["sym"].alias("sym"), p["subtype"].alias("subtype"), p["tgt"].try_cast("long").alias("tgt")))
    syn = rows.filter(is_synset).select(part(0).alias("offset"), part(1).try_cast("long").alias("id"), kids.alias("children"), pts(F.regexp_replace(body, r"^\S+\s+\S+\s+\S+", "")).alias("pointers"), gloss.alias("gloss"))
    lex = rows.filter(~is_synset & (v != "")).select(part(0).alias("fun"), _pointers(F.regexp_replace(v, r"^\S+", "")).alias("pointers"))
    return syn, lex


def probabilities(rows: DataFrame) -> DataFrame:
    """``ID<TAB>p`` to (fun, prob); an unreadable number is null."""
    p = F.split("value", "\t")
    return rows.filter(F.size(p) >= 2).select(F.get(p, 0).alias("fun"), F.get(p, 1).try_cast("double").alias("prob"))


def bigrams(rows: DataFrame) -> DataFrame:
    """``head mod p``, blank or tab separated; lines of another shape drop out."""
    p = F.split(F.trim("value"), r"\s+")
    return rows.filter(F.size(p) == 3).select(F.get(p, 0).alias("head"), F.get(p, 1).alias("mod"), F.get(p, 2).try_cast("double").alias("p")).filter("p is not null")


def interpolated(loaded: DataFrame, unigram: DataFrame, smoothing: float = 0.002) -> DataFrame:
    """Loaded bigrams (head, mod, p) with their back-off: smoothing * p(head) * p(mod) + (1 - smoothing) * p;
    a function without a probability backs off to 0. unigram(fun, p)."""
    u = unigram.select(F.col("fun").alias("head"), F.col("p").alias("ph_"))
    v = unigram.select(F.col("fun").alias("mod"), F.col("p").alias("pm_"))
    back = F.coalesce(F.col("ph_") * F.col("pm_"), F.lit(0.0))
    return loaded.join(u, "head", "left").join(v, "mod", "left").select("head", "mod", (smoothing * back + (1 - smoothing) * F.col("p")).alias("p"))


def domains(rows: DataFrame) -> DataFrame:
    """Indented ``- name [*]`` lines (line_no, value) to (id, name, is_dim, parent): the parent is the
    last line above with a smaller indent, 0 for a root. ids are numbers of the lines that count.

    Lines are numbered, and the place of the last line of each indent is carried on, by range
    partitions, so no task sees all lines. There is one column an indent, and indents are few."""
    from lexloom.operators.store import carried_on, numbered_rows
    pat = r"^(\s*)-\s*(.*?)\s*(\*)?\s*$"
    base = rows.filter(F.col("value").rlike(pat)).select("line_no", F.length(F.regexp_extract("value", pat, 1)).alias("indent"), F.regexp_extract("value", pat, 2).alias("name"), (F.regexp_extract("value", pat, 3) == "*").alias("is_dim"))
    base = numbered_rows(base, F.col("line_no")).withColumnRenamed("row_no", "id")
    depths = sorted(r[0] for r in base.select("indent").distinct().collect())
    last = {f"at_{i}": F.when(F.col("indent") == i, F.col("id")) for i in depths}
    base = carried_on(base, "id", last)
    above = [F.when(F.col("indent") > i, F.col(f"at_{i}")) for i in depths]
    return base.select("id", "name", "is_dim", F.coalesce(F.greatest(*above, F.lit(0)), F.lit(0)).cast("long").alias("parent"))


def images(rows: DataFrame) -> DataFrame:
    """``ID<TAB>qid;page;img<TAB>...`` to (fun, images)."""
    parts = F.split("value", "\t")
    img = lambda x: F.struct(F.get(F.split(x, ";"), 0).alias("qid"), F.get(F.split(x, ";"), 1).alias("page"), F.get(F.split(x, ";"), 2).alias("img"))
    return rows.filter(F.trim("value") != "").select(F.get(parts, 0).alias("fun"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), img).alias("images"))


CONLLU = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def conllu(sentences: DataFrame) -> DataFrame:
    """Sentence blocks (sent, value) to tokens (sent, pos, ten columns); comments, multiword ranges and
    lines without ten fields drop out."""
    t = sentences.select("sent", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    t = t.filter(~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) == 10) & F.col("line").rlike(r"^\d+\t"))
    f = F.split("line", "\t")
    return t.select("sent", "pos", *(F.get(f, i).alias(c) for i, c in enumerate(CONLLU)))


def multilingual_tab(rows: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """``offset-tag<TAB>lang:lemma<TAB>form`` to (sense, form), senses renamed by remap(old, new)."""
    p = F.split("value", "\t")
    out = rows.filter((F.size(p) >= 3) & ~F.col("value").startswith("#") & F.get(p, 1).rlike("lemma")).select(F.get(p, 0).alias("sense"), F.trim(F.get(p, 2)).alias("form"))
    if remap is None:
        return out
    return out.join(remap, F.col("sense") == F.col("old"), "left").select(F.coalesce("new", "sense").alias("sense"), "form")


def entity_labels(rows: DataFrame) -> DataFrame:
    """``<entity><TAB>"text"@lang`` to (qid, text, lang)."""
    from lexloom.functions.text import trimmed_label

    p = F.split("value", "\t")
    lab = trimmed_label(F.get(p, 1))
    return rows.filter(F.size(p) >= 2).select(F.regexp_extract(F.get(p, 0), r"(Q\d+)", 1).alias("qid"), lab["text"].alias("text"), lab["lang"].alias("lang")).filter("qid <> '' and lang <> ''")


def dictionary(rows: DataFrame) -> DataFrame:
    """``word<TAB>pos<TAB>JSON translations`` to (word, pos, lang, form)."""
    p = F.split("value", "\t")
    j = F.from_json(F.get(p, 2), "array<struct<code:string,word:string>>")
    return rows.filter(F.size(p) >= 3).select(F.get(p, 0).alias("word"), F.get(p, 1).alias("pos"), F.explode(j).alias("t")).select("word", "pos", F.col("t.code").alias("lang"), F.col("t.word").alias("form"))


def panlex(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The dump's CSV tables with types."""
    kinds = {
        "source": "id int, label string",
        "langvar": "id int, lang_code string, var_code int",
        "expr": "id long, langvar int, txt string",
        "meaning": "id long, source int",
        "denotation": "id long, meaning long, expr long",
        "denotation_class": "id long, denotation long, expr1 long, expr2 long",
    }
    return {k: spark.read.schema(v).csv(f"{root}/{k}.csv", header=True) for k, v in kinds.items()}


def princeton(rows: DataFrame) -> DataFrame:
    """``offset file tag words... pointers... | gloss`` records to (offset, tag, words, pointers, gloss).
    The word count is hexadecimal; a header line starts with two blanks. A pointer is sym, offset,
    tag and four hex digits, 0000 for one between synsets."""
    v = F.col("value")
    # the fields of a record and their number are columns of their own, or each word and pointer would cut the record again
    rows = rows.filter(~v.startswith("  ") & v.rlike(r"^\d{8} ")).select(F.split(F.trim(F.substring_index(v, "|", 1)), r"\s+").alias("body"), F.trim(F.regexp_replace(v, r"^[^|]*\|", "")).alias("gloss"))
    body, gloss = F.col("body"), F.col("gloss")
    n = F.conv(F.get(body, 3), 16, 10).cast("int")
    rows = rows.select("body", "gloss", n.alias("n"))
    n = F.col("n")
    words = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.get(body, 4 + 2 * i).alias("word"), F.conv(F.get(body, 5 + 2 * i), 16, 10).cast("int").alias("lex_id")))
    start = 4 + 2 * n
    k = F.get(body, start).try_cast("int")
    hexpair = lambda r, a: F.conv(F.substring(r, a, 2), 16, 10).cast("int")

    def pointer(i):
        at = start + 1 + 4 * i
        ref = F.get(body, at + 3)
        return F.struct(F.get(body, at).alias("code"), F.get(body, at + 1).alias("offset"), F.get(body, at + 2).alias("tag"), hexpair(ref, 1).alias("from_word"), hexpair(ref, 3).alias("to_word"))

    pts = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), pointer)).otherwise(F.array().cast("array<struct<code:string,offset:string,tag:string,from_word:int,to_word:int>>"))
    return rows.select(F.get(body, 0).alias("offset"), F.get(body, 2).alias("tag"), words.alias("words"), pts.alias("pointers"), gloss.alias("gloss"))


def split_pointers(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Semantic pointers (offset, code, tgt) and lexical ones (word, code, tgt_offset, tgt_word)."""
    # an outer one, as a record is else cut once more to tell whether it has pointers; one without gives no row below
    p = records.select("offset", "words", F.explode_outer("pointers").alias("p"))
    sem = p.filter("p.from_word = 0").select("offset", F.col("p.code").alias("code"), F.col("p.offset").alias("tgt"))
    lex = p.filter("p.from_word > 0").select(F.get("words", F.col("p.from_word") - 1)["word"].alias("word"), F.col("p.code").alias("code"), F.col("p.offset").alias("tgt_offset"), F.col("p.to_word").alias("to_word"))
    return sem, lex


def entity_dump(rows: DataFrame) -> DataFrame:
    """Lines of a JSON array dump to (qid, json); brackets and trailing commas go."""
    j = F.regexp_replace(F.trim("value"), r",$", "")
    return rows.filter(j.startswith("{")).select(F.get_json_object(j, "$.id").alias("qid"), j.alias("json"))


# Classes of given and family names, of genders of given names; properties of images by rank.
NAME_CLASSES, GENDER_CLASSES = ("Q202444", "Q101352", "Q3918"), ("Q12308941", "Q11879590", "Q18972245", "Q18972207")
IMAGE_PROPERTIES = ("P18", "P6802", "P117", "P8224", "P242", "P41", "P94")


def dump_names(entities: DataFrame) -> DataFrame:
    """What the names importer keeps of entities (qid, json): the last name class or, before it, gender
    class under P31; given (P735) and family names (P734); place ids (P1566); synsets (P8814); the English
    description; the page; and image paths by property in order. Entities with none of these drop out."""
    from lexloom.functions import kb

    j, get = F.col("entity"), F.try_variant_get
    ids = lambda p: F.transform(kb.claims(j, p), lambda c: get(c["value"], "$.id", "string"))
    plain = lambda p: F.transform(kb.claims(j, p), lambda c: get(c["value"], "$", "string"))
    last = lambda xs, of: F.try_element_at(F.filter(xs, lambda x: x.isin(*of)), F.lit(-1))
    title = get(j, "$.sitelinks.enwiki.title", "string")
    url = F.when(title.isNotNull(), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("http://www.wikidata.org/entity/"), "qid"))

    def path(c):
        name = F.replace(get(c["value"], "$", "string"), F.lit(" "), F.lit("_"))
        return F.concat(F.lit("commons/"), F.substring(F.md5(name), 1, 1), F.lit("/"), F.substring(F.md5(name), 1, 2), F.lit("/"), name)

    images = F.concat(*(F.transform(kb.claims(j, p), path) for p in IMAGE_PROPERTIES))
    kinds = kb.with_entity(entities).select("qid", "entity", ids("P31").alias("kinds"))
    out = kinds.select(
        "qid", F.coalesce(last(F.col("kinds"), GENDER_CLASSES), last(F.col("kinds"), NAME_CLASSES)).alias("name_type"), ids("P735").alias("given"), ids("P734").alias("family"),
        plain("P1566").alias("places"), plain("P8814").alias("synsets"), F.coalesce(get(j, "$.descriptions.en.value", "string"), F.lit("")).alias("description"), url.alias("url"), images.alias("images"),
    )
    return out.filter(F.col("name_type").isNotNull() | (F.size("given") > 0) | (F.size("family") > 0) | (F.size("places") > 0))


def semcor(spark: SparkSession, path: str) -> DataFrame:
    """Word forms of the sense-tagged XML to (file, sent, pos, form, lemma, tag, sense)."""
    rows = spark.read.format("xml").option("rowTag", "s").load(path)
    w = rows.select(F.input_file_name().alias("file"), F.col("_snum").cast("int").alias("sent"), F.posexplode("wf").alias("pos", "w"))
    get = lambda c: F.col(f"w.{c}").cast("string")
    return w.select("file", "sent", "pos", get("_VALUE").alias("form"), get("_lemma").alias("lemma"), get("_pos").alias("tag"), get("_lexsn").alias("sense"))


def sense_index(rows: DataFrame) -> DataFrame:
    """``key offset number count`` to (sense_key, offset, number, count)."""
    p = F.split("value", " ")
    return rows.filter(F.size(p) >= 4).select(F.get(p, 0).alias("sense_key"), F.get(p, 1).alias("offset"), F.get(p, 2).cast("int").alias("number"), F.get(p, 3).cast("int").alias("count"))


def tagged_corpus(rows: DataFrame) -> DataFrame:
    """``form/tag form/tag`` lines (sent, value) to (sent, pos, form, tag)."""
    t = rows.select("sent", F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("pos", "t"))
    return t.select("sent", "pos", F.regexp_extract("t", r"^(.*)/[^/]*$", 1).alias("form"), F.regexp_extract("t", r"/([^/]*)$", 1).alias("tag"))


def pragmas(rows: DataFrame) -> DataFrame:
    """``fun item item ...`` to (fun, pragmas): head or head:label:n, rel:n, label:n, anchor, _ (skip);
    -- starts a comment."""
    text = F.trim(F.regexp_replace("value", r"--.*$", ""))
    p = F.split(text, r"\s+")

    def one(x):
        bits = F.split(x, ":")
        kind = F.when(x == "_", "skip").when(x == "anchor", "anchor").when(F.get(bits, 0) == "head", "head").when(F.get(bits, 0) == "rel", "rel").otherwise("mod")
        lab = F.when(kind == "head", F.get(bits, 1)).when(kind == "mod", F.get(bits, 0))
        return F.struct(kind.alias("kind"), lab.alias("label"), F.element_at(bits, -1).try_cast("int").alias("idx"))

    return rows.filter(text != "").select(F.get(p, 0).alias("fun"), F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), one).alias("pragmas"))


def predictions(rows: DataFrame) -> DataFrame:
    """``fun lang form o s w l c d`` (tabs) to typed columns."""
    p = F.split("value", "\t")
    return rows.filter(F.size(p) == 9).select(F.get(p, 0).alias("fun"), F.get(p, 1).alias("lang"), F.get(p, 2).alias("lin"), *(F.get(p, i + 3).cast("int").alias(c) for i, c in enumerate("oswlcd")))


def draft_lexicon(candidates: DataFrame) -> DataFrame:
    """Lines of a draft concrete lexicon from ranked predictions (fun, def, status): (fun, line); several
    definitions of a function are variants, and the status of the first is the comment."""
    g = candidates.groupBy("fun").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "def", "status"))), lambda x: F.struct(x["def"], x["status"])).alias("x"))
    defs = F.transform("x", lambda x: x["def"])
    body = F.when(F.size("x") == 1, F.get(defs, 0)).otherwise(F.concat(F.lit("variants {"), F.array_join(defs, "; "), F.lit("}")))
    status = F.get("x", 0)["status"]
    return g.select("fun", F.concat(F.lit("lin "), "fun", F.lit(" = "), body, F.lit(" ;"), F.when(status == "checked", "").otherwise(F.concat(F.lit(" --"), status))).alias("line"))


def translit_table(rows: DataFrame) -> dict[str, str]:
    """``char<TAB>out`` lines; a fixed table of a few hundred rows, read on the driver."""
    p = F.split("value", "\t")
    return dict(map(tuple, bounded(rows.filter(F.size(p) >= 2).select(F.get(p, 0), F.get(p, 1)), 10_000)))


def bounded(rows: DataFrame, most: int) -> list:
    """A small table's rows on the driver; one of more rows than it may have is an error, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows in a table that should be small")
    return got


def translit_script(table: dict[str, str], name: str = "translit") -> str:
    """The table as a JavaScript constant, in order of its letters."""
    import json

    return f"const {name} = {json.dumps(dict(sorted(table.items())), ensure_ascii=False)};\n"


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", quote="")


def write_json(df: DataFrame, path: str, callback: str | None = None) -> None:
    """One JSON object a line, wrapped in a call where a callback is named."""
    j = F.to_json(F.struct(*df.columns))
    df.select((F.concat(F.lit(f"{callback}("), j, F.lit(")")) if callback else j).alias("value")).write.mode("overwrite").text(path)


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of xz-compressed text files, one task a file; lines are streamed, never held."""
    import io
    import lzma
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with lzma.open(io.BytesIO(content.as_buffer()), "rt", encoding="utf-8", newline="\n") as f:
                    part: list[str] = []
                    n = 0
                    for line in f:
                        part.append(line.rstrip("\n"))
                        if len(part) == 10_000:
                            yield rows(name, n, part)
                            n, part = n + len(part), []
                    if part:
                        yield rows(name, n, part)

    def rows(name: str, n: int, part: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(n + 1, n + len(part) + 1), pa.int64()), pa.array(part, pa.string())], names=["file", "line_no", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line_no long, value string")


SHEET_ROWS = 1_048_575


def workbook(df: DataFrame) -> bytes:
    """A report as a spreadsheet file with a header row; more rows than a sheet holds are an error."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    cell = lambda x: "<c/>" if x is None else f"<c><v>{x}</v></c>" if isinstance(x, (int, float)) and not isinstance(x, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'
    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *map(tuple, bounded(df, SHEET_ROWS))])
    space, kind = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/sheet.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="sheet.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="report" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/sheet.xml": f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def treebank(choices: DataFrame) -> DataFrame:
    """(sent, line): each token's choices as ``[best best | others]`` in order of position; choices
    (sent, pos, first, rest)."""
    rest = F.when(F.size("rest") > 0, F.concat(F.lit(" | "), F.array_join("rest", " "))).otherwise(F.lit(""))
    cell = F.when((F.size("first") == 1) & (F.size("rest") == 0), F.get("first", 0)).otherwise(F.concat(F.lit("["), F.array_join("first", " "), rest, F.lit("]")))
    seq = F.sort_array(F.collect_list(F.struct("pos", cell.alias("c"))))
    return choices.groupBy("sent").agg(seq.alias("s")).select("sent", F.array_join(F.transform("s", lambda x: x["c"]), " ").alias("line"))


def status_svg(counts: DataFrame) -> str:
    """A bar chart of (lang, guessed, unchecked, checked); one bar a language, so it is small."""
    rows = sorted(bounded(counts, 10_000))
    top = max((r.guessed + r.unchecked + r.checked for r in rows), default=1) or 1
    bars = []
    for i, r in enumerate(rows):
        x = 60.0
        bars.append(f'<text x="4" y="{20 * i + 15}">{r.lang}</text>')
        for part, colour in ((r.checked, "#4a4"), (r.unchecked, "#cc4"), (r.guessed, "#c44")):
            w = 400 * part / top
            bars.append(f'<rect x="{x:.1f}" y="{20 * i + 3}" width="{w:.1f}" height="14" fill="{colour}"/>')
            x += w
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="480" height="{20 * len(rows) + 6}">{"".join(bars)}</svg>'
