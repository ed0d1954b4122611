"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
The turns after the last assistant turn (all turns, if there is none) become a last example without a trainable part,
so no turn is lost. A turn reads `<|role|>`, a line break, the text, `</s>` and a line break. Control strings in
roles and texts are escaped by backslashes, and every backslash is doubled, so the text can be read back exactly.

Defined results: a null text is empty, a null role is written as an empty role, rows with a null conv_id are one
conversation. Turns go by turn, then role, then text (nulls first), so ties and repeated rows have one order. An empty
table gives an empty result. Only conv_id, turn, role and text are read, so extra columns cannot clash. The one shuffle
brings a conversation's turns together; the examples, which are longer, are cut from the formatted conversation after
it and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

TARGET = "assistant"
OPEN, SHUT, END = "<|", "|>\n", "</s>\n"
#: First characters of control strings, of this template and of other common ones, where the rest of the string follows.
CONTROL = r"([<\[|])(?=\||>|s>|/s>|/?INST\]|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)"


def escape(text: Column) -> Column:
    """The text with doubled backslashes, and with a backslash inside every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted (all turns) and cuts, an array that says for each turn whether it is a target, where its text starts and stops and where the turn ends, in code points."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = clean.select(
        "conv_id", "turn", "role", "text", (F.col("role") == TARGET).alias("target"),
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT)).alias("head"), escape(F.col("text")).alias("body"),
    ).withColumns({"head_n": F.length("head").cast("long"), "body_n": F.length("body").cast("long")})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum(F.col("head_n") + F.col("body_n") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.select(
        "conv_id", F.row_number().over(order).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), "target",
        (end - len(END) - F.col("body_n")).alias("start"), (end - len(END)).alias("stop"), end.alias("end"),
    )
    held = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "target", "start", "stop", "end"))).alias("t"))
    return held.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["target"].alias("target"), *(t[x].cast("int").alias(x) for x in ("start", "stop", "end")))).alias("cuts"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), is_last, formatted, and loss_start and loss_stop, the trainable code points of it (null in a tail without a reply)."""
    whole = conversations(turns)
    targets = F.filter("cuts", lambda c: c["target"])
    tail = F.when(~F.element_at("cuts", -1)["target"], F.array(F.element_at("cuts", -1)))
    wanted = F.when(tail.isNotNull(), F.concat(targets, tail)).otherwise(targets)
    spread = whole.withColumn("wanted", wanted).select("conv_id", "formatted", F.size("wanted").alias("n"), F.posexplode("wanted").alias("example", "cut"))
    loss = lambda x: F.when(F.col("cut.target"), F.col(x))
    return spread.select(
        "conv_id", "example", (F.col("example") == F.col("n") - 1).alias("is_last"),
        F.substring(F.col("formatted"), F.lit(1), F.col("cut.end")).alias("formatted"),
        loss("cut.start").alias("loss_start"), loss("cut.stop").alias("loss_stop"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    pieces = let(F.split(formatted, END, -1), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), F.position(F.lit(SHUT), x) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, F.position(F.lit(SHUT), x) + len(SHUT), F.length(x))).alias("text"),
    ))


def digest(turns: DataFrame) -> DataFrame:
    """The contract's columns, read back from the examples."""
    made = examples(turns)
    seen = made.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        F.coalesce(unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_stop") - F.col("loss_start"))), F.lit("")).alias("reply"),
        F.col("loss_start").isNotNull().alias("trained"),
    )
    by = seen.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.sum(F.col("trained").cast("long")).alias("n_examples"),
    )
    lines = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = by.select("conv_id", "formatted_chars", "n_examples", read_back(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )


#: DuckDB SQL of digest(), over conversations and conversation -7.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT unnest([chr(92), '<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<start_of_turn>', '<end_of_turn>']) AS mark),
n AS (SELECT c.*, row_number() OVER w AS pos, 11 - 1 + length(role) + length(text)
             + (SELECT sum((length(role) - length(replace(role, mark, '')) + length(text) - length(replace(text, mark, ''))) // length(mark)) FROM k) AS len
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, max(pos) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR pos = last) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM p GROUP BY conv_id
"""
