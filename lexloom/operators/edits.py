"""The edit log over the lexicon: pending edits, promotion of statuses, commits.

Everything is a transform of tables: a log is appended to, a base table is joined with what a
commit takes. The first matching edit wins, for reading as for committing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_edits(edits: DataFrame, *key: str) -> DataFrame:
    """The oldest edit of each key."""
    cols = [c for c in edits.columns if c not in key]
    first = edits.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col("seq")).alias("e_"))
    return first.select(*key, "e_.*")


def definitions(base: DataFrame, edits: DataFrame, user: str) -> DataFrame:
    """(lex_id, lang, def): the user's pending definition, else the file's."""
    own = first_edits(edits.filter((F.col("user") == user) & (F.col("kind") == "lexeme")), "lex_id", "lang").select("lex_id", "lang", F.col("def").alias("edit_"))
    return base.join(own, ["lex_id", "lang"], "full").select("lex_id", "lang", F.coalesce("edit_", "def").alias("def"))


def with_status(status: Column, lang: Column, value: str = "checked") -> Column:
    """A map of statuses with one language set; appended where absent."""
    return F.map_concat(F.map_filter(status, lambda k, v: k != lang), F.map_from_arrays(F.array(lang), F.array(F.lit(value))))


def update_lexeme(lexemes: DataFrame, edits: DataFrame, seq: int, user: str, fun: str, lang: str, definition: str) -> tuple[DataFrame, DataFrame]:
    """Lexemes with the language checked, and the longer log."""
    done = lexemes.withColumn("status", F.when(F.col("fun") == fun, with_status(F.col("status"), F.lit(lang))).otherwise(F.col("status")))
    row = edits.sparkSession.createDataFrame([(seq, "lexeme", user, fun, lang, None, definition)], "seq long, kind string, user string, lex_id string, lang string, line_no long, def string")
    return done, edits.unionByName(row)


def counts(edits: DataFrame) -> DataFrame:
    return edits.groupBy("user").agg(F.count("*").alias("n"))


def promote(lexemes: DataFrame, named: DataFrame, languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lexemes that a checked example names (fun): statuses of the languages that are not checked
    become so; also what changed, as (fun, lang)."""
    hit = lexemes.join(named.select("fun").distinct().withColumn("hit_", F.lit(True)), "fun", "left")
    open_ = lambda k, v: F.col("hit_") & k.isin(languages) & (v != "checked")
    new = F.transform_values("status", lambda k, v: F.when(open_(k, v), F.lit("checked")).otherwise(v))
    changed = hit.select("fun", F.explode("status").alias("lang", "was")).filter(F.col("lang").isin(languages) & (F.col("was") != "checked"))
    changed = changed.join(named.select("fun").distinct(), "fun", "left_semi").select("fun", "lang")
    return hit.withColumn("status", F.when(F.col("hit_"), new).otherwise(F.col("status"))).drop("hit_"), changed


def add_example(lexemes: DataFrame, named: DataFrame, example_id: int) -> DataFrame:
    """The example comes first among those of the lexemes on its key line."""
    hit = lexemes.join(named.select("fun").distinct().withColumn("hit_", F.lit(True)), "fun", "left")
    return hit.withColumn("example_ids", F.when(F.col("hit_"), F.array_insert("example_ids", 1, F.lit(example_id).cast("long"))).otherwise(F.col("example_ids"))).drop("hit_")


def commit(lines: DataFrame, edits: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """The concrete files' lines (lang, line_no, fun, text) with the user's first edit of each lexeme
    in place, and the log without the user's edits."""
    own = first_edits(edits.filter((F.col("user") == user) & (F.col("kind") == "lexeme")), "lex_id", "lang").select(F.col("lex_id").alias("fun"), "lang", "def")
    new = lines.join(own, ["fun", "lang"], "left").withColumn("text", F.when(F.col("def").isNotNull(), F.concat(F.lit("lin "), "fun", F.lit(" = "), "def", F.lit(" ;"))).otherwise(F.col("text")))
    return new.select("lang", "line_no", "fun", "text"), edits.filter(F.col("user") != user)


def replace_blocks(lines: DataFrame, edits: DataFrame, size: int) -> DataFrame:
    """An example's edit takes the place of ``size`` lines from its line number on: (line_no, part, text)."""
    first = first_edits(edits.filter("kind = 'example'"), "line_no").select(F.col("line_no").alias("at"), "def")
    covered = first.select("at", F.explode(F.sequence(F.col("at"), F.col("at") + size - 1)).alias("line_no"))
    rest = lines.join(covered.select("line_no"), "line_no", "left_anti").select("line_no", F.lit(0).alias("part"), "text")
    new = first.select(F.col("at").alias("line_no"), F.posexplode(F.split("def", "\n")).alias("part", "text"))
    return rest.unionByName(new)


def annotate(lines: DataFrame, checked: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """QA: definitions of lexemes in checked examples lose their status comment; a patch (fun, lang,
    def) sets a new one."""
    j = lines.join(checked.select("fun").distinct().withColumn("ok_", F.lit(True)), "fun", "left")
    text = F.when(F.col("ok_"), F.regexp_replace("text", r"\s*--.*$", "")).otherwise(F.col("text"))
    if patches is not None:
        j = j.join(patches.select("fun", "lang", F.col("def").alias("patch_")), ["fun", "lang"], "left")
        text = F.when(F.col("patch_").isNotNull(), F.concat(F.lit("lin "), "fun", F.lit(" = "), "patch_", F.lit(" ;"))).otherwise(text)
    return j.select("lang", "line_no", "fun", text.alias("text"))


def load_relations(lexemes: DataFrame, relations: DataFrame) -> DataFrame:
    """Named relations (fun, sym, target) as key pointers of the lexemes; unknown names are dropped."""
    ids = lexemes.select("id", "fun")
    r = relations.join(ids.select(F.col("fun").alias("target"), F.col("id").alias("tgt")), "target")
    p = r.groupBy("fun").agg(F.sort_array(F.collect_list(F.struct("sym", "tgt"))).alias("new_"))
    return lexemes.join(p, "fun", "left").withColumn("pointers", F.coalesce("new_", "pointers")).drop("new_")


def missing_synsets(lexemes: DataFrame, synsets: DataFrame) -> DataFrame:
    """(offset, id): keys for offsets that lexemes name and the taxonomy lacks."""
    from lexloom.operators.store import numbered_rows

    lost = lexemes.filter("offset is not null").select("offset").distinct().join(synsets.select("offset"), "offset", "left_anti")
    top = synsets.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered_rows(lost, F.col("offset")).select("offset", (F.col("row_no") + top).alias("id"))


def apply_predictions(lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """A definition is patched only where some candidate is new (o <> 0); predictions(fun, lang, o, def)."""
    new = predictions.groupBy("fun", "lang").agg(F.max((F.col("o") != 0).cast("int")).alias("any_"), F.min("def").alias("def_"))
    j = lines.join(new, ["fun", "lang"], "left")
    return j.select("lang", "line_no", "fun", F.when(F.col("any_") == 1, F.concat(F.lit("lin "), "fun", F.lit(" = "), "def_", F.lit(" ;"))).otherwise(F.col("text")).alias("text"))
