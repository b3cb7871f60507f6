"""Conversations from event logs, rendered as training text.

A log row is one event of a conversation, ordered by ``seq``:

* ``message``    starts a message ``message_id`` with a role and a text,
* ``delta``      appends text to it (and starts it, where it is new),
* ``edit``       replaces its text,
* ``regenerate`` empties it and drops every message begun after it; deltas follow.

The log is partitioned by conversation. Deltas are folded per message first, so a reply
streamed in thousands of pieces is one string before its conversation is put together;
what one task holds of a conversation is what its rendered text holds anyway.

Template: ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``, a line feed. In
texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string survives
inside a text and the original comes back exactly; roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No control string is left in the result."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def restored(text: Column) -> Column:
    """Inverse of ``escaped``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one ``message`` event a row, by turn.

    Rows with the same turn stay separate messages, ordered by role and text, nulls
    first; identical rows are separate messages too.
    """
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    place = F.row_number().over(order).cast("long")
    return conversations.select(
        "conv_id", place.alias("seq"), place.alias("message_id"), F.lit("message").alias("event"), "role", "text")


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages: ``conv_id``, ``messages`` array<struct<first, message_id, role, text>> in order.

    ``log`` has conv_id, seq, message_id, event, role, text. A null text or role is empty,
    a null conv_id is a conversation of its own, a null seq sorts first, an unknown or null
    event counts as ``delta``. An event delivered twice (all six values equal) counts once.
    Events with one seq are folded in the order message, regenerate, edit, delta, then by
    text. An empty log gives no rows; other columns are dropped.
    """
    rank = F.when(F.col("event") == "message", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "edit", 2).otherwise(3)
    text = F.coalesce("text", F.lit(""))
    event = F.struct(F.col("seq").alias("seq"), rank.alias("rank"), text.alias("text"))
    role = F.when(F.col("role").isNotNull(), F.struct(F.col("seq"), rank.alias("rank"), F.col("role")))
    pieces = log.groupBy("conv_id", "message_id").agg(
        F.array_distinct(F.array_sort(F.collect_list(event))).alias("events"),
        F.min(F.col("seq")).alias("first"), F.min(role).alias("named"),
        F.max(F.when(rank == 1, F.col("seq"))).alias("redone"))
    # what counts begins with the last event that sets the whole text
    begin = F.expr("coalesce(array_max(transform(events, (e, i) -> if(e.rank < 3, i, 0))), 0)")
    final = F.array_join(F.transform(F.slice("events", begin + 1, F.size("events")),
                                     lambda e: F.when(e["rank"] == 1, "").otherwise(e["text"])), "")
    message = F.struct(F.col("first"), F.col("message_id"), F.coalesce(F.col("named.role"), F.lit("")).alias("role"),
                       final.alias("text"), F.col("redone"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("all"))
    # a message goes if a message before it was regenerated after this one began
    kept = F.filter("all", lambda m: ~F.exists(
        "all", lambda r: F.coalesce((r["first"] < m["first"]) & (r["redone"] > m["first"]), F.lit(False))))
    return whole.select("conv_id", F.when(F.exists("all", lambda m: m["redone"].isNotNull()), kept)
                        .otherwise(F.col("all")).alias("messages"))


def render(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` and ``mask``: array<struct<start, length>> in code points of ``formatted``,
    the escaped texts of the trained roles, in order."""
    pieces = F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(OPEN), F.url_encode(m["role"]), F.lit("\n")).alias("head"), escaped(m["text"]).alias("body"),
        m["role"].isin(*trained).alias("trained")))
    tail = F.lit(CLOSE + "\n")
    rows = conversations.withColumn("_pieces", pieces)
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], tail)), "")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        start, size = acc["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(CLOSE) + 1).alias("at"),
                        F.when(p["trained"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("_pieces", state, step, lambda acc: acc["mask"])
    return rows.select("conv_id", formatted.alias("formatted"), mask.alias("mask"))


def parsed(formatted: Column) -> Column:
    """Messages of a rendered text: array<struct<role, text>>; the inverse of ``render``."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda t: t != "")

    def read(t: Column) -> Column:
        head = F.substring_index(t, "\n", 1)
        body = F.substring(t, F.length(head) + 2, F.length(t) - F.length(head) - 2 - len(CLOSE))
        return F.struct(F.url_decode(head).alias("role"), restored(body).alias("text"))

    return F.transform(turns, read)


def report(rendered: DataFrame) -> DataFrame:
    """The digest columns of the contract, all read back from the rendered text and its mask."""
    rows = rendered.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), F.transform(
        "mask", lambda s: restored(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learnt"))
    learnt = F.array_join("learnt", "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
