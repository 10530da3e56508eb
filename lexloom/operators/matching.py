"""Choosing sense candidates for tokens of dependency trees: morphology lookup, and rules that
score candidates by part of speech, label and children."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import settled


def analyses(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(sent, pos, fun, analysis): by form, and only where the form itself is unknown by its small
    letters; equal analyses once. tokens(sent, pos, form), lexicon(form, fun, analysis)."""
    lex = lexicon.select("form", "fun", "analysis").distinct()
    exact = tokens.join(lex, "form").select("sent", "pos", "fun", "analysis")
    rest = tokens.join(exact.select("sent", "pos").distinct(), ["sent", "pos"], "left_anti")
    lower = rest.withColumn("form", F.lower("form")).join(lex, "form").select("sent", "pos", "fun", "analysis")
    return exact.unionByName(lower).distinct()


RULES = "cat string, upos string, label string, child_label string, child_upos string, score int"


def scored(candidates: DataFrame, tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates with the sum of the rules that they meet. A rule is for a category; each of its
    other fields, where not null, has to hold: the token's part of speech and label, and a child
    with a label or a part of speech. candidates(sent, pos, fun, cat), tokens(sent, pos, head, upos, deprel)."""
    kids = tokens.select("sent", F.col("head").alias("pos"), F.struct(F.col("deprel").alias("label"), "upos").alias("k")).groupBy("sent", "pos").agg(F.collect_set("k").alias("kids"))
    t = tokens.select("sent", "pos", "upos", "deprel").join(kids, ["sent", "pos"], "left")
    r = rules.select("cat", F.col("upos").alias("r_upos"), F.col("label").alias("r_label"), "child_label", "child_upos", "score")
    j = candidates.join(t, ["sent", "pos"]).join(r, "cat", "left")
    same = lambda rule, value: rule.isNull() | (rule == value)
    child = F.exists(F.coalesce("kids", F.array().cast("array<struct<label:string,upos:string>>")), lambda k: same(F.col("child_label"), k["label"]) & same(F.col("child_upos"), k["upos"]))
    holds = same(F.col("r_upos"), F.col("upos")) & same(F.col("r_label"), F.col("deprel")) & ((F.col("child_label").isNull() & F.col("child_upos").isNull()) | child)
    return j.groupBy("sent", "pos", "fun", "cat").agg(F.sum(F.when(holds, F.col("score")).otherwise(0)).alias("score"))


# What each category asks of a word's tree, a test a line: categories, place, field, allowed
# values. A place is group.alternative: at the candidate's own token first, and behind > at a child of the
# token before. ``lemma`` asks whether one of the token's choices is the candidate's lemma.
RULES_OF_CATEGORIES = """
A A2                                    0.0           upos   ADJ
Adv AdV AdA AdN                         0.0           upos   ADV
Interj                                  0.0           upos   INTJ
N N2                                    0.0           upos   NOUN
PN                                      0.0           upos   PROPN
Conj                                    0.0           upos   CCONJ
Det Quant                               0.0           upos   DET
Pron                                    0.0           upos   PRON
Subj                                    0.0           upos   SCONJ
Prep                                    0.0           upos   ADP
Prep                                    0.1           upos   SCONJ
V0 V V2 V3 VA VS VQ V2A V2S V2Q V2V VV  0.0           upos   VERB
VV                                      0.1           upos   AUX
A2                                      1.0>0.0       label  obl
A2                                      1.0>1.0>0.0   label  case
A2                                      1.0>1.0>1.0   lemma
N2                                      1.0>0.0       label  nmod
N2                                      1.0>1.0>0.0   label  case
N2                                      1.0>1.0>1.0   lemma
V2 V2A V2S V2Q V2V                      1.0>0.0       label  obj nsubj:pass
V2                                      1.1>0.0       label  obl
V2                                      1.1>1.0       upos   NOUN
V2                                      1.1>2.0>0.0   label  case
V2                                      1.1>2.0>1.0   upos   PREP
V2                                      1.1>2.0>2.0   lemma
V3                                      1.0>0.0>0.0   label  obj nsubj:pass
V3                                      2.0>0.0       label  iobj nsubj:pass
V3                                      2.1>0.0       label  obl
V3                                      2.1>1.0       upos   NOUN
V3                                      2.1>2.0>0.0   label  case
V3                                      2.1>2.0>1.0   upos   PREP
V3                                      2.1>2.0>2.0   lemma
VA                                      1.0>0.0       label  xcomp
VA                                      1.0>1.0       upos   ADJ
V2A                                     2.0>0.0       label  xcomp
V2A                                     2.0>1.0       upos   ADJ
VS VQ VV                                1.0>0.0       label  xcomp
VS VQ VV                                1.0>1.0       upos   VERB
VS                                      1.0>2.0>0.0   label  nsubj nsubj:pass
V2S V2Q V2V                             2.0>0.0       label  xcomp
V2S V2Q V2V                             2.0>1.0       upos   VERB
V2S                                     2.0>2.0>0.0   label  nsubj nsubj:pass
V                                       1.0>0.0       label  compound:prt
V                                       1.0>1.0       lemma
VA VS VQ VV V2                          2.0>0.0       label  compound:prt
VA VS VQ VV V2                          2.0>1.0       lemma
V3 V2A V2S V2Q V2V                      3.0>0.0       label  compound:prt
V3 V2A V2S V2Q V2V                      3.0>1.0       lemma
"""

Test = tuple[str, str, str, tuple[str, ...]]


def rule_rows(text: str = RULES_OF_CATEGORIES) -> list[Test]:
    """(category, place, field, values) of a table of tests as text."""
    out = []
    for line in text.strip().splitlines():
        cells = re.split(r"\s{2,}", line.strip())
        out += [(cat, cells[1], cells[2], tuple(cells[3].split()) if len(cells) > 3 else ()) for cat in cells[0].split()]
    return out


BITS = 62  # tests in one number


def ranked_by_rules(candidates: DataFrame, tokens: DataFrame, tests: list[Test] | None = None) -> DataFrame:
    """Candidates (sent, pos, lemma, cat) with score and cnt, the number of tests that count.
    tokens(sent, pos, head, label, upos, choices), a row a token; tests as in ``rule_rows``, of any depth.

    A group scores its best alternative, of equals the later one; a test scores one if it holds, and an
    alternative that stands at a child scores what its groups do at the best child, the last of equals,
    or nothing in one test where none scores. Categories without tests score 0 of 1."""
    asked = candidates.groupBy("sent", "pos", "lemma").agg(F.collect_list("cat").alias("cats"))
    return ranked_categories(asked, tokens, tests)


def ranked_categories(asked: DataFrame, tokens: DataFrame, tests: list[Test] | None = None) -> DataFrame:
    """``ranked_by_rules`` of candidates (sent, pos, lemma, cats), whose categories come as a list.

    Categories share most of what they ask of a child, so each part of a rule is scored once a token and lemma,
    not once a candidate: a token's tests are bits of a number, and what a child scores travels to its head as
    one number a part, the best by its maximum. That is a grouping by sentence and token a level of the table; only the result has
    a row a category. All groupings stand within a sentence, so tokens are dealt to the tasks once."""
    tests = [(cat, place, field, tuple(values) if field != "lemma" else ()) for cat, place, field, values in (rule_rows() if tests is None else tests)]
    kinds = {f: i for i, f in enumerate(dict.fromkeys(t[2:] for t in tests))}
    parts: dict[tuple, int] = {}  # parts of rules by what they hold; a child's part comes before that of its head
    height: list[int] = []

    def part(cat: str, place: str) -> int:
        groups: dict[int, dict[int, tuple]] = {}
        for c, p, field, values in tests:
            if c == cat and p.startswith(place):
                grp, alt = map(int, p[len(place) :].split(">")[0].split("."))
                own = ("test", kinds[field, values])
                below = f"{place}{grp}.{alt}>"
                groups.setdefault(grp, {}).setdefault(alt, []).append(("part", part(cat, below)) if p.startswith(below) else own)
        made = tuple(sorted(tuple((k, n) for _, own in sorted(alts.items()) for k, n in dict.fromkeys(own)) for alts in groups.values()))
        if made not in parts:
            parts[made] = len(height)
            height.append(max((height[n] + 1 for alts in made for k, n in alts if k == "part"), default=0))
        return parts[made]

    top = {cat: part(cat, "") for cat in dict.fromkeys(cat for cat, *_ in tests)}
    inner = sorted({n for made in parts for alts in made for k, n in alts if k == "part"})
    depth = max(height, default=0)
    if len(tests) >= 1 << 14:
        raise ValueError("too many tests")

    # a number holds score, token and tests of a child in this order, so the greatest is the best child
    packed = lambda res, n: F.shiftleft(res.cast("long"), 48) + F.shiftleft(F.col("tok").cast("long") + (1 << 31), 15) + n
    here = F.col("b0").isNotNull()

    def holds(i: int) -> Column:
        return F.shiftright(F.col(f"b{i // BITS}"), i % BITS).bitwiseAND(F.lit(1).cast("long")).cast("int")

    def scored_part(made: tuple) -> tuple[Column, Column]:
        """(score, tests) of a part at a token. The place of a candidate may be no token: then only its children count."""
        total = F.lit(0), F.lit(1)
        for alts in made:
            best = None
            for k, n in alts:
                if k == "test":
                    one = F.when(here, F.shiftleft(holds(n), 15) + 1)
                else:
                    c = F.coalesce(F.col(f"c{n}"), F.lit(0).cast("long"))
                    one = F.when(c > 0, F.shiftleft(F.shiftright(c, 48).cast("int"), 15) + c.bitwiseAND(F.lit((1 << 15) - 1).cast("long")).cast("int")).otherwise(F.lit(1))
                # the later one of equals, by the score alone
                best = one if best is None else F.when(best.isNull() | (F.shiftright(one, 15) >= F.shiftright(best, 15)), one).otherwise(best)
            best = F.coalesce(best, F.lit(0))
            total = total[0] + F.shiftright(best, 15), total[1] + best.bitwiseAND(F.lit((1 << 15) - 1))
        return total

    by_place = {i: made for made, i in parts.items()}
    bits = [F.lit(0).cast("long") for _ in range(len(kinds) // BITS + 1)]
    for (field, values), i in kinds.items():
        hit = F.array_contains("choices", F.col("lemma")) if field == "lemma" else F.col(field).isin(*values) if field in ("upos", "label") else F.lit(False)
        bits[i // BITS] = bits[i // BITS] + F.when(hit, F.lit(1 << i % BITS).cast("long")).otherwise(F.lit(0).cast("long"))
    bit_names = [f"b{k}" for k in range(len(bits))]

    asked = asked.select("sent", F.col("pos").alias("tok"), "lemma", "cats")
    wanted = asked.groupBy("sent").agg(F.collect_set("lemma").alias("lemmas"), F.collect_set("tok").alias("asked"))
    x = tokens.select("sent", F.col("pos").alias("tok"), "head", "label", "upos", "choices").filter("tok is not null").join(wanted, "sent")
    x = x.select("sent", "tok", "head", "label", "upos", "choices", "asked", F.explode("lemmas").alias("lemma"))
    x = x.select("sent", "tok", "head", "lemma", "asked", *(b.alias(n) for b, n in zip(bits, bit_names, strict=True)))
    known: list[int] = []
    for h in range(depth):
        new = [n for n in inner if height[n] == h]
        scores = {n: scored_part(by_place[n]) for n in new}
        x = x.select("*", *(F.when(r > 0, packed(r, n_)).alias(f"n{n}") for n, (r, n_) in scores.items()))
        null = lambda n: F.lit(None).cast("long").alias(n)
        own = F.struct(F.col("tok").alias("to"), F.col("head").alias("head"), *bit_names, *(f"c{n}" for n in known), *(null(f"c{n}") for n in new))
        up = F.struct(F.col("head").alias("to"), F.lit(None).cast(x.schema["head"].dataType).alias("head"), *(null(b) for b in bit_names), *(null(f"c{n}") for n in known), *(F.col(f"n{n}").alias(f"c{n}") for n in new))
        sent = F.array(own, up)
        if h == depth - 1:  # only what is asked for is left to score
            sent = F.filter(sent, lambda e: F.array_contains("asked", e["to"]))
        # every task holds whole sentences, so these groupings need no further exchange; a token's bits are in one row
        x = x.select("sent", "lemma", "asked", F.explode(sent).alias("e")).select("sent", "lemma", "asked", "e.*").filter("to is not null")
        known += new
        merged = x.groupBy("sent", F.col("to").alias("tok"), "lemma")
        kept = [F.first("asked").alias("asked")] if h < depth - 1 else []
        x = merged.agg(*kept, F.max("head").alias("head"), *(F.max(b).alias(b) for b in bit_names), *(F.max(f"c{n}").alias(f"c{n}") for n in known))

    scores = F.create_map(*(e for cat, n in top.items() for e in (F.lit(cat), F.struct(*(v.cast("int").alias(k) for k, v in zip(("score", "cnt"), scored_part(by_place[n]), strict=True))))))
    none = F.struct(F.lit(0).alias("score"), F.lit(1).alias("cnt"))
    at = asked.join(x.select("sent", "tok", "lemma", *bit_names, *(f"c{n}" for n in known)), ["sent", "tok", "lemma"], "left")
    at = at.select("sent", F.col("tok").alias("pos"), "lemma", "cats", (scores if top else F.create_map().cast("map<string,struct<score:int,cnt:int>>")).alias("scores"))
    rows = at.select("sent", "pos", "lemma", "scores", F.explode("cats").alias("cat"))
    return rows.select("sent", "pos", "lemma", "cat", F.coalesce(F.try_element_at("scores", F.col("cat")), none).alias("x")).select("sent", "pos", "lemma", "cat", "x.score", "x.cnt")


def bracketed(tokens: DataFrame) -> DataFrame:
    """(sent, tree): the dependency tree of each sentence as nested brackets; tokens(sent, pos, head,
    form), head 0 or missing at a root. A cycle of heads is an error.

    Each token's way from its root, as the places on it, puts the tokens in the order of the text: the
    ways are built by depth, a join a level, and the brackets that close follow from the depth of the next
    token, so no subtree is copied level by level."""
    t = settled(tokens.select("sent", "pos", "head", "form"))
    roots = t.join(t.select("sent", F.col("pos").alias("head")), ["sent", "head"], "left_anti").select("sent", "pos", "form", F.array("pos").alias("way"))
    done = level = settled(roots)
    while True:
        level = settled(level.select("sent", F.col("pos").alias("head"), "way").join(t, ["sent", "head"]).select("sent", "pos", "form", F.array_append("way", F.col("pos")).alias("way")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    if t.count() != done.count():
        raise ValueError("the heads of a sentence form a cycle")
    depth = F.size("way")
    ends = depth - F.coalesce(F.lead(depth).over(Window.partitionBy("sent").orderBy("way")), F.lit(1)) + 1
    piece = F.concat(F.lit("("), "form", F.repeat(F.lit(")"), ends))
    rows = done.withColumn("piece", piece)
    return rows.groupBy("sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("way", "piece"))), lambda x: x["piece"]), " ").alias("tree"))
