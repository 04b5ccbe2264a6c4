"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its context and only its text is under the loss mask.
A conversation that does not end in an assistant turn gives one more, untrainable example with all its turns, so that no turn is
lost. A turn reads ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings inside roles and texts get one
backslash after their first character, and those that already have backslashes there get one more, so that unescaping is exact.

Defined cases: a null text or role is empty; turns go by (turn, role, text), nulls first, so ties and repeated rows have an order and
all of them stay; a null conversation id is a conversation; an empty table gives no example; other columns are not read.
One example is one row, as a model reads it: its size, and the square-shaped total, are inherent in the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's marks, and control strings of chat templates that texts may hold.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TAILS = ((r"(<)", r"(\|im_(?:start|sep|end)\|>|/?s>|</?SYS>>)"), (r"(\[)", r"(/?INST\])"))


def escape(text: Column) -> Column:
    for head, tail in TAILS:
        text = F.regexp_replace(text, head + r"(\\*)" + tail, r"$1\\$2$3")
    return text


def unescape(text: Column) -> Column:
    for head, tail in TAILS:
        text = F.regexp_replace(text, head + r"\\(\\*)" + tail, "$1$2$3")
    return text


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, target, n_turns, text, loss_start, loss_length, trainable): one row per example, offsets in code points from 0."""
    body = F.col("t.text")
    empty = F.lit("")
    ordered = (
        turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"),
                                                            F.coalesce(F.col(text), empty).alias("text")).alias("t"))
        .select("conv_id", F.struct("t.turn", "t.role", "t.text", F.concat(
            F.lit(OPEN), escape(F.col("t.role")), F.lit(SEP), escape(body), F.lit(CLOSE)).alias("shown"),
            F.length(escape(body)).alias("length")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("n_turns", F.size("turns"))
        .withColumn("targets", F.filter(F.sequence(F.lit(1), F.col("n_turns")), lambda i: (
            (F.element_at("turns", i)["role"] == "assistant") | (i == F.col("n_turns")))))
        .withColumn("shown", F.col("turns.shown"))
    )
    last = F.element_at("turns", F.col("target"))
    return (
        ordered.select("conv_id", "n_turns", "turns", "shown", F.explode("targets").alias("target"))
        .select("conv_id", "target", "n_turns", F.array_join(F.slice("shown", F.lit(1), F.col("target")), "").alias("text"),
                (last["role"] == "assistant").alias("trainable"), last["length"].alias("_length"))
        .select("conv_id", "target", "n_turns", "text",
                (F.length("text") - F.lit(len(CLOSE)) - F.col("_length")).alias("loss_start"),
                F.when(F.col("trainable"), F.col("_length")).otherwise(0).alias("loss_length"), "trainable")
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.split(text, F.lit(r"<\|im_end\|>\n"), -1)
    shown = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(shown, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescape(F.substring_index(p, SEP, -1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples; grouped as they were made, so nothing is shuffled again."""
    turns = read_turns(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    is_last = F.col("target") == F.col("n_turns")
    reply = F.when(F.col("trainable"), unescape(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_length")))).otherwise("")
    return (
        examples.select("conv_id", "target", F.when(is_last, F.sha2(said, 256)).alias("said"), F.when(is_last, F.size(turns)).alias("n"),
                        reply.alias("reply"), F.length("text").cast("long").alias("chars"))
        .groupBy("conv_id").agg(
            F.max("n").cast("long").alias("n_turns"), F.max("said").alias("turns_sha256"),
            F.array_join(F.sort_array(F.collect_list(F.struct("target", "reply")))["reply"], "").alias("loss"),
            F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )
