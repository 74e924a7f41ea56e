"""Chat formatting by prefix-target expansion, in DataFrame and SQL functions only.

Each turn becomes ``<s>role[INST]text[/INST]``, after an assistant's turn also ``</s>``. Control strings inside a text get one more
backslash after their first character, in a role also line ends do, so that texts cannot forge a turn and everything reads back.
Every assistant turn becomes an example: all the turns before it as context, only its own text under the loss mask. Turns after the
last assistant turn become one more example with an empty mask, so no turn is lost.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text), nulls first, repeated rows stay; rows of
a null conv_id form one conversation; other columns, of any name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def conversations_text(turns: DataFrame) -> DataFrame:
    """conv_id and its formatted turns: array of (head, body, tail, trained), in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    part = F.transform(
        "ts",
        lambda t: F.struct(
            F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]")).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(t["role"] == "assistant", "[/INST]</s>").otherwise("[/INST]").alias("tail"),
            (t["role"] == "assistant").alias("trained"),
        ),
    )
    return rows.select("conv_id", part.alias("ps"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), n_turns, text, loss_start, loss_end (code points of text, end exclusive)."""
    ends = F.expr(
        """aggregate(ps, named_struct('at', 0, 'k', 0, 'out', cast(array() AS array<struct<n:int,s:int,e:int,len:int,trained:boolean>>)),
            (a, p) -> named_struct('at', a.at + char_length(p.head) + char_length(p.body) + char_length(p.tail), 'k', a.k + 1,
                'out', array_append(a.out, named_struct('n', a.k + 1, 's', a.at + char_length(p.head), 'e', a.at + char_length(p.head) + char_length(p.body),
                    'len', a.at + char_length(p.head) + char_length(p.body) + char_length(p.tail), 'trained', p.trained))), a -> a.out)"""
    )
    # an example ends at each assistant turn, and at the last turn whoever speaks
    cuts = F.expr("filter(ends, (x, i) -> x.trained OR i = size(ends) - 1)")
    whole = F.expr("array_join(transform(ps, p -> concat(p.head, p.body, p.tail)), '')")
    df = conversations_text(turns).select("conv_id", whole.alias("whole"), ends.alias("ends"))
    df = df.select("conv_id", "whole", F.posexplode(cuts).alias("example", "x"))
    return df.select(
        "conv_id",
        "example",
        F.col("x.n").alias("n_turns"),
        F.expr("substring(whole, 1, x.len)").alias("text"),
        F.expr("if(x.trained, x.s, x.len)").alias("loss_start"),
        F.expr("if(x.trained, x.e, x.len)").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, parsed from its examples."""
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    per = examples.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.max_by("text", "example").alias("last"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
    )
    turns = F.transform(
        F.filter(F.split("last", "<s>", -1), lambda p, i: i > 0),
        lambda p: F.struct(
            unescape(F.substring_index(p, "[INST]", 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, "[INST]", -1), "[/INST]", 1)).alias("text"),
        ),
    )
    return per.select("conv_id", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def digests(examples: DataFrame) -> DataFrame:
    back = read_back(examples)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
