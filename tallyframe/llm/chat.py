"""Chat formatting by event-sourced reconstruction (native).

A log holds events ``(conv_id, seq, msg, kind, role, text)``.  Events are folded to final messages:
``begin`` opens a message (its text, if any, starts it), ``delta`` appends, ``edit`` replaces the
text, ``regenerate`` clears it and drops the messages opened between the message's begin and the
regeneration (a new branch), ``delete`` removes it.  Messages then are rendered with a template
whose control strings cannot occur inside a text: every ``<`` + n backslashes + ``|`` of a text gets
one more backslash, and loses it again on reading.

Work is dealt by (conversation, message); only the rendered pieces meet per conversation, since one
string per conversation is the output.  ``seq`` may be any sortable column (also a struct).

Defined cases: null role or text is empty; events of a message without a ``begin`` still fold; a
null conv_id is a conversation of its own; equal ``seq`` fold in order of kind, role and text; an
empty log gives no rows; texts of any length are folded and rendered whole; equal events all count.  Only the columns
named above are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Roles are one line: a backslash is doubled and a line feed written as backslash + n (NUL is dropped)."""
    plain = F.replace(F.replace(role, F.lit("\u0000"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(plain, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a backslash pair becomes one backslash; a single backslash + n a line feed (pairs are hidden first)
    hidden = F.replace(unescape(role), F.lit("\\\\"), F.lit("\u0000"))
    return F.replace(F.replace(hidden, F.lit("\\n"), F.lit("\n")), F.lit("\u0000"), F.lit("\\"))


def turn_events(turns: DataFrame) -> DataFrame:
    """A log of the rows (conv_id, turn, role, text): each row begins a message and streams its text.

    Rows of one turn keep an order by role and digest of the text; equal rows stay as many messages as there are.
    """
    rows = (turns.groupBy("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                          F.coalesce("text", F.lit("")).alias("text"))
            .agg(F.count("*").cast("int").alias("n")))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = [F.col("turn").isNull().alias("last"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "nth"]
    parts = F.array(F.struct(F.lit(0).alias("part"), F.lit("begin").alias("kind"), F.lit("").alias("text")),
                    F.struct(F.lit(1).alias("part"), F.lit("delta").alias("kind"), F.col("text").alias("text")))
    return (rows.select("conv_id", F.struct(*at).alias("msg"), "role", F.explode(parts).alias("e"))
            .select("conv_id", F.struct("msg", F.col("e.part").alias("part")).alias("seq"), "msg",
                    F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, pos (first seq of the message), msg, role, text."""
    e = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    opens = F.col("kind").isin("begin", "edit", "regenerate")
    msgs = (events.groupBy("conv_id", "msg")
            .agg(F.sort_array(F.collect_list(e)).alias("log"),
                 F.min("seq").alias("pos"),
                 F.max(F.when(opens, F.col("seq"))).alias("opened"),
                 F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
                 F.max(F.when(F.col("kind") == "delete", F.lit(1)).otherwise(0)).alias("gone")))
    kept = F.filter("log", lambda x: (F.col("opened").isNull() | (x["seq"] >= F.col("opened"))) & (x["kind"] != "delete"))
    role = F.filter("log", lambda x: x["role"] != "")
    msgs = (msgs.withColumn("text", F.array_join(F.transform(kept, lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), ""))
            .withColumn("role", F.when(F.size(role) > 0, F.element_at(role, -1)["role"]).otherwise(""))
            .select("conv_id", "msg", "pos", "role", "text", "again", "gone"))
    # a regeneration drops what was opened after its message and before it; only such conversations are sorted
    again = msgs.where("again is not null").select("conv_id").distinct()
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    dropped = (msgs.select("conv_id", "msg", "pos", "again")
               .join(again.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
               .withColumn("upto", F.max("again").over(w)).where("upto > pos")
               .select(F.col("conv_id").alias("c"), F.col("msg").alias("m")))
    alive = msgs.where("gone = 0").join(
        dropped, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("msg").eqNullSafe(F.col("m")), "left_anti")
    return alive.select("conv_id", "pos", "msg", "role", "text")


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    ``mask`` has an entry per message, in order: the code points of its escaped text and whether the
    loss covers them.  Marks and roles are never covered.
    """
    body = escape(F.col("text"))
    piece = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), body, F.lit(END + "\n"))
    pieces = messages.select("conv_id", F.struct(F.col("pos"), F.struct("msg").alias("m"), piece.alias("piece"), F.struct(
        F.char_length(body).alias("n_chars"), (F.col("role") == loss_role).alias("loss")).alias("mask")).alias("p"))
    return (pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
            .select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.col("p.mask").alias("mask")))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of rendered conversations: conv_id, formatted, turns (role, text, loss, n_chars)."""
    parts = F.filter(F.split("formatted", "<\\|im_start\\|>", -1), lambda p, i: i > 0)

    cut_at = lambda p: F.position(F.lit("\n"), p)
    tail = len(END) + 1
    turns = F.transform(parts, lambda p, i: F.struct(
        unescape_role(F.substring(p, F.lit(1), cut_at(p) - 1)).alias("role"),
        unescape(F.substring(p, cut_at(p) + 1, F.char_length(p) - cut_at(p) - tail)).alias("text"),
        F.get(F.col("mask"), i)["loss"].alias("loss"), F.get(F.col("mask"), i)["n_chars"].alias("n_chars")))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))
