"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, runs of one role are put together under one header,
and everything is joined into one text:

    ### user:
    first turn</turn>second turn of the same role</turn>### assistant:
    answer</turn>

Inside texts and roles a backslash is put before ``\\``, before ``###`` and before the ``/`` of ``</turn>``
(and before ``:`` in roles), so that no text can look like a header or an end mark; taking each backslash
away and keeping the character after it restores the text.

``pieces`` holds the same text cut where the loss mask changes: the mask is the flag ``loss`` of each piece,
true for exactly the texts of ``trained`` roles. Rows with equal turn numbers are ordered by role and text,
null turns come first, null roles and texts are empty; rows without a conversation id form one conversation.
A conversation is one output row, so its turns must fit into a row, as its text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>"


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit(END), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, pieces (array of text and loss) for every conversation."""
    rows = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            turns["turn"].cast("bigint").alias("turn"),
            F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def opens(turn: Column, i: Column) -> Column:
        """The header, where the role differs from that of the turn before."""
        new = (i == 0) | (F.get("said", i - 1)["role"] != turn["role"])
        role = F.replace(_escape(turn["role"]), F.lit(":"), F.lit("\\:"))
        return F.when(new, F.concat(F.lit("### "), role, F.lit(":\n"))).otherwise(F.lit(""))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    pieces = F.flatten(
        F.transform(
            "said",
            lambda t, i: F.array(
                piece(opens(t, i), F.lit(False)),
                piece(_escape(t["text"]), t["role"] == trained),
                piece(F.lit(END), F.lit(False)),
            ),
        )
    )
    return chats.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.col("pieces.text"), "").alias("formatted"), "pieces"
    )


def read_turns(formatted: Column) -> Column:
    """The turns (array of role and text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, "(?<=</turn>)(?=### )"), lambda b: b != "")
    header = r"(?s)^### ((?:[^\\:]++|\\.)*+):\n(.*)$"

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_extract(block, header, 1))
        texts = F.split(F.regexp_extract(block, header, 2), END)
        return F.transform(
            F.slice(texts, F.lit(1), F.size(texts) - 1),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(pieces: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return unescape(F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: p["text"]), ""))


def report(chats: DataFrame) -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("pieces")).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
