"""The query services as functions of request parameters, with results as DataFrames or JSON rows.

One request may name several things; the first that is present in the order below is answered."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import program
from lexloom.operators import edits as ed
from lexloom.operators import graph, lookup, patterns, stats
from lexloom.session import settled

ORDER = ("lexical_ids", "context_id", "gloss_id", "generalize_ids", "list_domains", "domain", "list_top_classes", "class_id", "pattern_match")
DEPTH = 4


@dataclass
class Lexicon:
    """Tables that the services read, as in ``lexloom.model``; examples as (ex_id, fun)."""

    lexemes: DataFrame
    synsets: DataFrame
    edges: DataFrame  # src, tgt, sym between synsets
    domains: DataFrame
    lexdom: DataFrame  # fun, domain
    classes: DataFrame
    examples: DataFrame
    facts: DataFrame  # level, src, tgt, sym
    frames: DataFrame | None = None
    example_texts: DataFrame | None = None  # id, funs, or id, fun


def answer(lex: Lexicon, params: dict[str, list[str]]) -> DataFrame:
    spark = lex.lexemes.sparkSession
    which = next((k for k in ORDER if k in params), None)
    if which is None:
        raise ValueError(f"one of {', '.join(ORDER)} is needed")
    given = params[which]
    asked = spark.createDataFrame([(x,) for v in given for x in v.split()], "fun string")
    if which == "lexical_ids":
        if lex.frames is not None and lex.example_texts is not None:
            return lookup.sense_objects(asked, lex.lexemes, lex.synsets, lex.domains, lex.example_texts, lex.frames, lex.classes)
        return lookup.sense_lookup(asked, lex.lexemes, lex.synsets)
    if which == "context_id":
        scores = stats.context_score(lex.examples).filter(F.col("fun").isin(given))
        starts = lex.lexemes.join(asked, "fun").select(F.col("synset_id").alias("id")).distinct()
        nodes, _ = graph.crawl(lex.edges, starts, int(params.get("depth", [DEPTH])[0]))
        around = nodes.select(F.lit(None).cast("string").alias("fun"), F.col("node").cast("string").alias("other"), F.col("dist").cast("double").alias("score"))
        return scores.withColumn("kind", F.lit("context")).unionByName(around.withColumn("kind", F.lit("graph")))
    if which == "gloss_id":
        return lookup.gloss(asked, lex.lexemes, lex.synsets)
    if which == "generalize_ids":
        up = lex.edges.filter(F.col("sym").isin("Hypernym", "InstanceHypernym")).select(F.col("src").alias("child"), F.col("tgt").alias("parent"))
        group = lex.lexemes.join(F.broadcast(asked), "fun").select(F.lit(0).alias("grp"), F.col("synset_id").alias("id"))
        hit = settled(graph.generalize_few(group, up).select("id").distinct())  # fewer than the guard
        funs = lex.lexemes.select(F.col("synset_id").alias("id"), "fun").join(F.broadcast(hit), "id").groupBy("id").agg(F.array_sort(F.collect_list("fun")).alias("funs"))
        return hit.join(lex.synsets, "id").join(funs, "id", "left").select("id", "gloss", F.coalesce("funs", F.array().cast("array<string>")).alias("funs"))
    if which == "list_domains":
        return lookup.domain_tree_json(lex.domains)
    if which == "domain":
        rows, total = lookup.with_all_domains(lex.lexdom, given)
        return rows.join(F.broadcast(total))
    if which == "list_top_classes":
        return lookup.roots(lex.classes, "super_id")
    if which == "class_id":
        below = graph.closure(lex.classes.filter("super_id is not null").select(F.col("id").alias("child"), F.col("super_id").alias("parent")))
        ids = below.filter(F.col("anc").isin([int(x) for x in given])).select(F.col("src").alias("id")).unionByName(spark.createDataFrame([(int(x),) for x in given], "id long"))
        if lex.frames is not None and "flat" in params:  # a row a lexeme, where frames may have too many of them for one row
            rows = lookup.class_frames(spark.createDataFrame([(int(x),) for x in given], "id long"), lex.classes, lex.frames, below)
            return rows.join(lookup.frame_lexemes(lex.lexemes), "frame_id", "left")
        if lex.frames is not None:
            return lookup.class_objects(spark.createDataFrame([(int(x),) for x in given], "id long"), lex.classes, lex.frames, lex.lexemes, below)
        return lex.classes.join(ids.distinct(), "id")
    triples = [patterns.Triple(*t.split()) for t in given]
    return patterns.match(lex.facts, lex.lexemes.select("fun", F.col("synset_id").alias("synset")), triples)


def functions(entities: DataFrame, params: dict[str, str]) -> DataFrame:
    """A program over entities (qid, json): code, lang, and input, a JSON list of option and index in turn.
    Results grouped by headers; a program that can't be read is an error."""
    given = json.loads(params.get("input", "[]"))
    if len(given) % 2:
        raise ValueError("choices come in pairs")
    lang = params.get("lang", "ParseEng").removeprefix("Parse").lower()
    return program.datasets(program.run(entities, params["code"], lang, dict(zip(given[::2], given[1::2], strict=True))))


@dataclass
class Content:
    """The edit workflow: definitions (lex_id, lang, def), lexemes, the concrete files' lines, the edit log
    and the examples (state, expr). Changes replace the tables that the next request sees."""

    definitions: DataFrame | None
    lexemes: DataFrame
    lines: DataFrame | None
    edits: DataFrame
    examples: DataFrame | None = None

    def answer(self, params: dict[str, str]) -> DataFrame:
        """The first of these that is present: get_id, update_id, commit, pick_example, update_example."""
        user, lang = params.get("user", ""), params.get("lang", "")
        if "get_id" in params:
            return ed.definitions(self.definitions, self.edits, user).filter((F.col("lex_id") == params["get_id"]) & (F.col("lang") == lang))
        seq = (self.edits.agg(F.max("seq")).first()[0] or 0) + 1
        if "update_id" in params:
            self.lexemes, self.edits = ed.update_lexeme(self.lexemes, self.edits, seq, user, params["update_id"], lang, params["def"])
            return ed.counts(self.edits).filter(F.col("user") == user)
        if "commit" in params:
            self.lines, self.edits = ed.commit(self.lines, self.edits, user)
            return self.lines
        if "pick_example" in params:
            return lookup.pick_example(self.examples, int(params["pick_example"] or 0))
        if "update_example" in params:
            named = self.lexemes.sparkSession.createDataFrame([(x,) for x in params["key"].split()], "fun string")
            self.lexemes, _ = ed.promote(self.lexemes, named, ["bul", "swe"])
            self.lexemes = ed.add_example(self.lexemes, named, int(params["update_example"]))
            return self.lexemes
        raise ValueError("one of get_id, update_id, commit, pick_example, update_example is needed")


def as_json(df: DataFrame, callback: str | None = None) -> DataFrame:
    """One JSON text a row, wrapped in a call where a callback is named."""
    j = F.to_json(F.struct(*df.columns))
    return df.select((F.concat(F.lit(f"{callback}("), j, F.lit(")")) if callback else j).alias("value"))
