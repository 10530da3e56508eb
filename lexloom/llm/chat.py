"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only
its reply under the loss mask. Turns behind the last reply, or a conversation without any,
give one more example with nothing to learn, so that no turn is lost.

The template is ``<|im_start|>role LF text<|im_end|> LF``. Escapes are reversible: a backslash
becomes ``\\s``, ``<|`` becomes ``<\\p``, a line feed in a role becomes ``\\n``; so a control
string inside a text can't be taken for one.

Defined results: a null text or role counts as empty; turns are ordered by turn (null first),
then role, then text; repeated rows stay repeated; a null conv_id is a conversation; extra
columns are ignored.

The examples of a conversation grow with the square of its turns; that is the expansion itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\p", "|"), ("\\s", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"), escape(text), F.lit(END))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start, loss_chars (code points in formatted)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", F.col("ts.role").alias("role"), F.transform("ts", lambda t: _turn(t["role"], t["text"])).alias("said"))
    n = F.size("role")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("role", i - 1) == "assistant") | (i == n))
    cut = convs.select("conv_id", "role", "said", F.posexplode(ends).alias("example", "upto"))
    last = F.get("said", F.col("upto") - 1)
    learn = F.get("role", F.col("upto") - 1) == "assistant"
    before = F.array_join(F.slice("said", 1, F.col("upto") - 1), "")
    head, tail = len(START) + len("assistant\n"), len(END)
    return cut.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat(before, last).alias("formatted"),
        F.when(learn, F.length(before) + head).otherwise(F.length(before) + F.length(last)).cast("long").alias("loss_start"),
        F.when(learn, F.length(last) - head - tail).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text as an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def digest(shown: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    target = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    own = shown.select("conv_id", "example", "formatted", F.struct("example", target.alias("text")).alias("target"))
    convs = own.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.sort_array(F.collect_list("target")).alias("targets"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    lines = F.transform(read_turns(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    convs = convs.select("conv_id", lines.alias("lines"), F.array_join("targets.text", "").alias("loss"), "formatted_chars")
    return convs.select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
