"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and the units behind numbers become typed placeholders that keep their value
beside them. Windows of WINDOW template tokens of the documents meet those of the benchmark in a
hash join; matches on one diagonal (document position minus item position) must map every slot
value of the item to one value in the document. An item is found in a document if consistent
diagonals cover at least COVER of its windows, or if one of them matches RUN windows in a row,
which are WINDOW + RUN - 1 tokens; so copies are caught, long excerpts and re-parameterised
questions too, while a few shared words are not enough.

A number is written in digits or in English words. A name is a run of capitalised words behind a
lower-case letter or a comma, so not at the start of a sentence. Each item is sought a second time without names, as copies in upper or lower case
show none, and a third time as it reads behind other words. A window of fewer than LITERALS words that are no placeholders must agree in its
values too. An item shorter than a window is one window, values and all if it has fewer than LITERALS
words, and is found wherever it stands. ``least`` asks for more: an item of fewer tokens than that counts only
where it is the whole document.

Texts are cut into runs of CHUNK windows. The hashes of all windows of a run come from those of half
the size, pair by pair, so in three passes over its tokens; a run's slot values, as hashes, go along
only if it has any. So time and memory follow the length of the text.

Defined results: null texts and items count as empty and match nothing; repeated items or
documents match once each by id, and rows that share a doc_id are searched one by one; ties need
no order; a null doc_id or item_id matches nothing; extra columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

WINDOW, LITERALS, COVER, RUN = 8, 4, 0.5, 6
CHUNK = 256
BEHIND = "x "
#: Up to so many benchmark windows are broadcast: some 250 bytes each, so 50 MB. Beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000
BROADCAST_TEXTS = 1_000_000
NUM, NAME, UNIT, STOP = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = (
    "km|cm|mm|kg|mg|ml|mph|kmh|miles|mile|meters|metres|meter|metre|feet|foot|inches|inch|yards|yard|grams|gram|pounds|pound|ounces|ounce|liters|litres|liter|litre"
    "|gallons|gallon|dollars|dollar|euros|euro|cents|cent|percent|seconds|second|minutes|minute|hours|hour|days|day|weeks|week|months|month|years|year|degrees|degree"
)
# (pattern, replacement by group): own marks out first, then names, numbers, units. Repetitions are
# possessive (++, *+): others recurse in Java, once a repetition.
OWN = (f"[{NUM}-{STOP}]", " ")
NAMES = (r" (?<=[\p{Ll},;:] )(\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+)", f" {NAME}@1{STOP}")
#: English number words, alone or in a row.
WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    "|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
)
REST = (
    (rf"([^\p{{L}}{NUM}-{STOP}]|^)((?i:{WORDS})(?:[ -](?i:{WORDS}))*+)([^\p{{L}}]|$)", f"@1 {NUM}@2{STOP}@3"),
    (r"([0-9]++(?:[.,][0-9]++)*+)", f" {NUM}@1{STOP}"),
    (rf"({STOP} ?)((?i:{UNITS})|%|€|\$|£)([^\p{{L}}]|$)", f"@1 {UNIT}@2{STOP}@3"),
)
VALUED = rf"[{NUM}-{UNIT}][^{STOP}]*{STOP}|[\p{{L}}\p{{M}}]+"


def annotated(text: Column, names: bool = True) -> Column:
    """The text in lower case with its placeholders, values inside them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for pattern, by in (OWN, *[NAMES] * names, *REST):
        text = F.regexp_replace(text, pattern, by.replace("@", "$"))
    return F.lower(text)


def _slot(token: Column) -> Column:
    """Whether a token begins with a placeholder's mark; the marks are neighbours."""
    return (token >= NUM) & (token < STOP)


def coded(rows: DataFrame) -> DataFrame:
    """Adds t, the hashes of the template's tokens, and v, those of the slots' values (0 for a
    literal word), of the column ``marked``, which goes."""
    rest = [c for c in rows.columns if c != "marked"]
    rows = rows.select(*rest, F.regexp_extract_all("marked", F.lit(VALUED), F.lit(0)).alias("own"))
    t = F.transform("own", lambda x: F.xxhash64(F.when(_slot(x), x.substr(1, 1)).otherwise(x)))
    v = F.transform("own", lambda x: F.when(_slot(x), F.xxhash64(x).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    return rows.select(*rest, t.alias("t"), v.alias("v"))


def _pairwise(a: str, b: str, shift: int) -> Column:
    """Hashes of a's windows with b's that stand shift tokens behind."""
    m = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(shift + 1), m), lambda x, y: F.xxhash64(x, y))


def _with_values(size: int):
    """A window's key from its template's hash and its position."""

    def key(h: Column, i: Column) -> Column:
        values = F.slice("v", i + 1, size)
        slots = F.size(F.array_remove(values, F.lit(0).cast("long")))
        return F.when(slots <= size - LITERALS, h).otherwise(F.xxhash64(h, values))

    return key


def window_keys(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds k<size>, the keys of all windows of each size (at most WINDOW) of the token hashes t and
    slot values v. With few literal words the values are part of the key. Each array is a column of
    its own before it is used twice, so nothing is computed again for each window."""
    rows = rows.withColumn("h1", F.col("t"))
    for k in (1, 2, 4):
        rows = rows.withColumn(f"h{2 * k}", _pairwise(f"h{k}", f"h{k}", k))
    for size in sizes:
        done, at = None, 0
        for k in (8, 4, 2, 1):
            if size & k:
                rows = rows.withColumn(f"k{size}", F.col(f"h{k}") if done is None else _pairwise(f"k{size}", f"h{k}", at))
                done, at = k, at + k
        slots = F.size(F.array_remove("v", F.lit(0).cast("long"))) > 0
        rows = rows.withColumn(f"k{size}", F.when(slots | F.lit(size < LITERALS), F.transform(f"k{size}", _with_values(size))).otherwise(F.col(f"k{size}")))
    return rows.drop("h1", "h2", "h4", "h8")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form (a number of the item's text, as it was read), at, len, h, own (slot values), n (windows)."""
    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    read = lambda text, named: coded(rows.select("item_id", annotated(text, named).alias("marked")))
    cut = read(F.col("text"), True).unionByName(read(F.col("text"), False))
    # and as it stands behind other words, where a capital letter at its beginning makes a name
    behind = read(F.concat(F.lit(BEHIND), F.coalesce(F.col("text").cast("string"), F.lit(""))), True)
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    cut = cut.unionByName(behind.select("item_id", rest("t").alias("t"), rest("v").alias("v")))
    cut = window_keys(cut.distinct().filter(F.size("t") > 0), list(range(1, WINDOW + 1)))
    size = F.least(F.size("t"), F.lit(WINDOW))
    keys = F.coalesce(*[F.when(size == k, F.col(f"k{k}")) for k in range(1, WINDOW + 1)])
    cut = cut.select("item_id", F.xxhash64("t", "v").alias("form"), "v", size.alias("len"), F.size("t").alias("tokens"), F.posexplode(keys).alias("i", "h"))
    own = F.slice("v", F.col("i") + 1, F.col("len"))
    return cut.select("item_id", "form", (F.col("i") + 1).alias("at"), "len", "h", own.alias("own"), (F.col("tokens") - F.col("len") + 1).alias("n"))


def doc_windows(docs: DataFrame, sizes: list[int], least: int = 1) -> DataFrame:
    """doc_id, text_key, h of all windows of the given sizes, with c, size, slots and pos to place them (see ``placed``)."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), annotated(F.col("text")).alias("marked"))
    rows = coded(rows)
    part = lambda c: F.struct(c.alias("c"), F.slice("t", c, CHUNK + WINDOW - 1).alias("t"), F.slice("v", c, CHUNK + WINDOW - 1).alias("v"))
    # both arrays are named outside the lambda too, so that they are computed once a row
    starts = F.when(F.least(F.size("t"), F.size("v")) > 0, F.sequence(F.lit(1), F.size("t"), F.lit(CHUNK)))
    rows = rows.select("doc_id", "text_key", F.size("t").alias("tokens"), F.explode(F.transform(starts, part)).alias("x"))
    rows = window_keys(rows.select("doc_id", "text_key", "tokens", "x.*"), sizes)
    # an item of fewer than ``least`` tokens must be the whole document
    keys = [F.col(f"k{s}") if s >= least else F.when(F.col("tokens") == s, F.col(f"k{s}")).otherwise(F.array().cast("array<bigint>")) for s in sizes]
    slots = F.when(F.size(F.array_remove("v", F.lit(0).cast("long"))) > 0, F.col("v"))
    rows = rows.select("doc_id", "text_key", "tokens", "c", F.size("t").alias("size"), slots.alias("slots"), F.concat(*keys).alias("keys"))
    # outer: a plain explode would have the planner test the arrays by computing them once more; the join drops null keys
    return rows.select("doc_id", "text_key", "tokens", "c", "size", "slots", F.posexplode_outer("keys").alias("pos", "h"))


def placed(met: DataFrame, sizes: list[int], least: int = 1) -> DataFrame:
    """Adds p, the position of a matched window in its document (from 0), and seen, its slot values."""
    before = F.lit(0)
    for i, s in enumerate(sizes):
        ahead = F.lit(0)
        for x in sizes[:i]:
            own = F.greatest(F.col("size") - x + 1, F.lit(0))
            ahead = ahead + (own if x >= least else F.when(F.col("tokens") == x, own).otherwise(0))
        before = F.when(F.col("len") == s, ahead).otherwise(before)
    met = met.withColumn("i", F.col("pos") - before)
    # no slots in the document's window means none in the item's
    return met.withColumn("p", F.col("c") - 1 + F.col("i")).withColumn("seen", F.coalesce(F.slice("slots", F.col("i") + 1, F.col("len")), "own"))


def _longest_run(ats: Column) -> Column:
    """The length of the longest run of numbers without a gap in a sorted array."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(x == a["last"] + 1, a["now"] + 1).otherwise(1)
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(ats, start, step, lambda a: a["most"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, item_id, n_windows, matched, longest (windows in a row), changed (slot values that
    differ from the item's), for each item that a document holds. An item of fewer than ``least`` tokens counts
    only where it is the whole document."""
    return _found(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "n", "longest", "changed")).alias("x")).select(
        "doc_id", "item_id", F.col("x.n").alias("n_windows"), "x.matched", "x.longest", "x.changed"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The rows whose text holds no item. Equal texts share that fate, so rows are told by a hash of
    the text; hashes of up to BROADCAST_TEXTS dirty texts (8 MB) are broadcast, more are joined."""
    key = F.xxhash64("text")
    found = _found(docs.select(key.alias("doc_id"), "text"), benchmark, least).select("text_key").distinct()
    found = Scratch(docs.sparkSession).save(found)
    found = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    return docs.join(found, key == found["text_key"], "left_anti")


def _found(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    items = item_windows(benchmark)
    lengths, total = items.agg(F.collect_set("len"), F.count("*")).first()
    if not total:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, n long, matched long, longest long, changed long")
    items = F.broadcast(items) if total <= BROADCAST_WINDOWS else items
    sizes = sorted(lengths)
    met = placed(doc_windows(docs, sizes, least).join(items, "h"), sizes, least)
    pairs = F.filter(F.arrays_zip("own", "seen"), lambda z: z["own"] != 0)
    key = ["doc_id", "text_key", "item_id", "form", "n"]
    lines = met.groupBy(*key, (F.col("p") + 1 - F.col("at")).alias("diagonal")).agg(
        F.array_sort(F.collect_set("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots")
    )
    lines = lines.filter(F.size(F.array_distinct(F.transform("slots", lambda z: z["own"]))) == F.size("slots"))
    whole = lines.groupBy(*key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"),
        F.max(_longest_run(F.col("ats"))).cast("long").alias("longest"),
        F.max(F.size(F.filter("slots", lambda z: z["own"] != z["seen"]))).cast("long").alias("changed"),
    )
    whole = whole.filter((F.col("matched") >= COVER * F.col("n")) | (F.col("longest") >= RUN))
    return whole.select("doc_id", "text_key", "item_id", F.col("n").cast("long").alias("n"), "matched", "longest", "changed")
