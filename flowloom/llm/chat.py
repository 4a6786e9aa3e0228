"""Chat formatting from event logs, with DataFrame functions only.

A log holds events (conv_id, seq, message_id, kind, role, text). `start` opens a message with its role, `delta` appends to it, `edit` replaces what it
says so far, `regenerate` drops it to be streamed anew, `delete` takes the message out. A message is what follows its last edit, regeneration or
start, in order of seq; a conversation is its messages in order of their first event. Deltas are folded per message, so that a long stream is spread
over its messages before conversations are put together.

Rendering: <|im_start|>role newline text <|im_end|> newline. Inside roles and texts the two characters "<|" become "<␛|", "␛" becomes "␛e" and, in roles,
a newline becomes "␛n"; replacing backwards gives the original. The loss mask lists (start, length) of assistant texts in the formatted string.

Null roles and texts are empty. A null conv_id is a conversation of its own. Equal seq values are ordered by kind (start first) and text. An empty log gives no rows.
A conversation is one value, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.text import sha256_hex

OPEN, CLOSE, ESCAPE = "<|im_start|>", "<|im_end|>\n", "␛"
_RESETS = ["start", "edit", "regenerate"]


def escape(text: Column) -> Column:
    marked = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    return F.replace(marked, F.lit("<|"), F.lit(f"<{ESCAPE}|"))


def unescape(text: Column) -> Column:
    opened = F.replace(text, F.lit(f"<{ESCAPE}|"), F.lit("<|"))
    return F.replace(opened, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, at, role, text): the final messages; `at` is the first seq of the message."""
    order = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "delete", 2).otherwise(1)
    inside = Window.partitionBy("conv_id", "message_id").orderBy("seq", "__order", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = events.withColumn("__order", order).withColumn(
        "__epoch", F.sum(F.col("kind").isin(*_RESETS, "delete").cast("int")).over(inside)
    )
    # one row per epoch: the pieces of text in order, and what began it
    folded = epochs.groupBy("conv_id", "message_id", "__epoch").agg(
        F.min("seq").alias("first"), F.max(F.col("kind") == "delete").alias("gone"), F.max("role").alias("role"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "__order", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]
        ), "").alias("text"),
    )
    messages = folded.groupBy("conv_id", "message_id").agg(
        F.min("first").alias("at"), F.max_by("gone", "__epoch").alias("gone"), F.max("role").alias("role"), F.max_by("text", "__epoch").alias("text")
    )
    return messages.where(~F.col("gone")).select("conv_id", "message_id", "at", F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; `loss` is the mask, ordered (start, length) in code points from 0."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select(
        "conv_id", "at", "message_id", (F.col("role") == "assistant").alias("own"), head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("from", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("from", "piece", "own", F.length("body").alias("length")))).alias("turns")
    )
    return grouped.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["own"]), lambda t: F.struct(t["from"].alias("start"), t["length"].cast("long").alias("length"))
        ).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and what the formatted string and its mask say: turns and the text under the mask, unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    kept = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substring(p, len(OPEN) + 1, 2_147_483_647))
    turns = F.transform(kept, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.locate("\n", p) + 1, F.lit(2_147_483_647))).alias("text"),
    ))
    under = F.transform("loss", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("learned"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), sha256_hex(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of(turns: DataFrame) -> DataFrame:
    """A log in which every row (conv_id, turn, role, text) is opened and streamed: rows by turn, equal turns by role and text."""
    row = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(row).cast("long").alias("message_id"), "role", "text")
    return numbered.select("conv_id", "message_id", F.explode(F.array(
        F.struct((F.col("message_id") * 2).alias("seq"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text")),
        F.struct((F.col("message_id") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text")),
    )).alias("e")).select("conv_id", "message_id", "e.*")
