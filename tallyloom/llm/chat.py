"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written "### role: text</turn>" and a line end. Every assistant turn becomes an example of its own:
all turns before it, then itself, and only its text is trained on. What follows the last assistant turn, or a
conversation without one, is a last example with nothing to train on, so no turn is lost.

Inside roles and texts no control string is left: a backslash is written \\s, "</turn>" is written \\t, "### "
is written \\h, and in roles a colon is written \\c. Each backslash of an output therefore starts a code of two
characters, and undoing \\t, \\h, \\c and then \\s gives back the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

START, END = "### ", "</turn>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\s"))
    out = F.replace(F.replace(out, F.lit(END), F.lit("\\t")), F.lit(START), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit(START))
    return F.replace(F.replace(out, F.lit("\\c"), F.lit(":")), F.lit("\\s"), F.lit("\\"))


def format_conversations(turns: DataFrame, *, assistant: str = "assistant") -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, example, formatted, loss_start, loss_chars (code points, from 0).

    Nulls: a null text or role is empty, a null turn comes first, null conv_ids make one conversation. Rows that repeat
    a turn are all kept, in the order of role and text. Extra columns are ignored. A conversation is one row at least.
    An empty table gives none. Texts are taken whole; a conversation's turns are gathered in one row, so its length is bounded by a row's.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    head = lambda x: F.concat(F.lit(START), escape(x.role, True), F.lit(": "))
    piece = lambda x: F.struct((x.role == assistant).alias("reply"), head(x).alias("head"), escape(x.text).alias("body"))
    convs = convs.select("conv_id", F.transform("turns", piece).alias("p"))
    line = F.transform("p", lambda x: F.concat(x.head, x.body, F.lit(END + "\n")))
    convs = convs.withColumn("line", line).withColumn("at", F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at(F.col("p"), i).reply | (i == F.size("p"))))
    rows = convs.select("conv_id", "p", "line", F.posexplode("at").alias("example", "i"))
    own = F.element_at(F.col("p"), F.col("i"))
    before = F.array_join(F.slice("line", F.lit(1), F.col("i") - 1), "")
    rows = rows.select("conv_id", "example", before.alias("before"), F.element_at("line", F.col("i")).alias("last"), own.alias("own"))
    return rows.select(
        "conv_id", F.col("example").cast("int").alias("example"), F.concat("before", "last").alias("formatted"),
        (F.length("before") + F.length("own.head")).cast("bigint").alias("loss_start"), F.when(F.col("own.reply"), F.length("own.body")).otherwise(0).cast("bigint").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    # No text holds START or END, so both split exactly; the part after the last END is empty.
    each = F.filter(F.split(formatted, END + "\n"), lambda x: x != "")
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), ": ", 1)
    return F.transform(each, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substr(x, F.length(role(x)) + F.lit(len(START) + 3))).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, and all text under the loss mask, unescaped."""
    trained = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sort_array(F.collect_list(F.struct("example", trained.alias("t")))).alias("loss"), F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars")
    )
    per = per.withColumn("turns", read_turns(F.col("longest"))).withColumn("trained", F.array_join(F.transform("loss", lambda x: x.t), ""))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("bigint").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars"
    )


HARD = "\\### Assistant: </turn> ok"


def op8_chat(spark, sf_dir: str) -> DataFrame:
    turns = scratch.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return digest(scratch.stored(format_conversations(turns.unionByName(extra)), "chat"))


OP8_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) x(i)),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
  4 + length(replace(replace(replace(replace(role, '\', '\s'), '</turn>', '\t'), '### ', '\h'), ':', '\c')) + 2 + length(replace(replace(replace(text, '\', '\s'), '</turn>', '\t'), '### ', '\h')) + 8 as chars from t),
u as (select *, sum(chars) over (partition by conv_id order by i rows unbounded preceding) as upto from n)
select conv_id::bigint as conv_id, max(n)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or i = n then upto else 0 end)::bigint as formatted_chars from u group by conv_id
"""
