"""URL filters: prefix rules, and for what no rule covers the verdict of a link graph.

Hosts link to hosts through the pages' absolute links. Personalised PageRank spreads trust from
trusted hosts along the links, and distrust from blocked hosts against them. A host is a seed
when rules allow, or block, more than half of its pages. A host whose distrust exceeds its trust
is blocked; with equal scores, as for a host that no seed reaches, it is allowed.

Each kind of seed shares a mass of 1. A host's share that flows over a link is in proportion to
the number of links. What a host without links holds flows nowhere. Steps go on until the scores
of all hosts together change by less than TOLERANCE; each step shrinks that change by DAMPING, so
their number is bounded.

Defined results: a null url, or one without ``://``, has an empty host and path, which is a host
like any other but never links; null html has no links; repeated rows count each; a null
page_id stays null; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, ascii_lower

DAMPING, TOLERANCE = 0.85, 1e-9
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, else null. rules: (verdict, host, path)."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: absolute links between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), 2)).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    return links.filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(scratch: Scratch, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank of seeds (kind, host) over edges (kind, src, dst, n) as (kind, host,
    score), each kind by itself."""
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    share = scratch.save(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.lit(DAMPING) * F.col("n") / F.col("total")).alias("w")))
    total = F.broadcast(seeds.groupBy("kind").agg(F.count("*").alias("total")))  # one row a kind
    base = scratch.save(seeds.join(total, "kind").select("kind", "host", ((1 - DAMPING) / F.col("total")).alias("score")))
    rank = base
    for _ in range(math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING)) + 1):
        flow = rank.join(share, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w")).alias("score"))
        new = base.select("kind", "host", "score", F.lit(0.0).alias("was")).unionAll(flow.withColumn("was", F.lit(0.0)))
        new = new.unionAll(rank.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("was")))
        new = scratch.save(new.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")))
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if rank is not base:
            scratch.drop(rank)
        rank = new.select("kind", "host", "score")
        if change < TOLERANCE:
            break
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(pages.sparkSession)
    says = {h + p: v for v, h, p in rules}
    verdict = F.element_at(F.create_map(*[F.lit(x) for kv in says.items() for x in kv]), F.col("rule")) if says else F.lit(None).cast("string")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict)
    hosts = rows.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    hosts = scratch.save(hosts)
    edges = scratch.save(host_links(pages))
    seeds = hosts.select("host", F.explode(F.expr("filter(array('good', 'bad'), k -> 2 * if(k = 'good', good, bad) > n)")).alias("kind"))
    against = edges.select(F.lit("bad").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    ranks = spread(scratch, edges.select(F.lit("good").alias("kind"), "src", "dst", "n").unionAll(against), seeds)
    scores = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(name) for k, name in (("good", "trust"), ("bad", "distrust"))])
    scored = hosts.select("host").join(scores, "host", "left")
    scored = scratch.save(scored.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    method = F.when(F.col("distrust") > F.col("trust") + TOLERANCE, "block").otherwise("allow")
    return rows.join(scored, "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
