"""Chat formatting: one training text per conversation, with its loss mask.

Turns become messages; adjacent turns of one role share a message as its parts::

    <|start|>user<|text|>first part<|part|>second part<|end|><|start|>assistant<|text|>answer<|end|>

Roles and texts are escaped so that ``<|`` occurs in control strings only, and
any text can be read back: ``\\`` becomes ``\\s``, then ``<|`` becomes ``<\\p|``.
The loss mask is the list of segments the formatted text consists of, each with
whether it counts: the texts of the answering role do, marks and roles do not.

DataFrame expressions only.  Escaping happens on rows, before turns meet; array
functions then work in time linear in the length of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, PART, END = "<|start|>", "<|text|>", "<|part|>", "<|end|>"
SEGMENTS = "array<struct<text:string,loss:boolean>>"


def escape(text: Column) -> Column:
    """``text`` without any ``<|``; see ``unescape``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p|"))


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def messages(turns: Column) -> Column:
    """array<struct<role, parts>> of sorted turns: those of one role that follow each other become one message."""
    def same_role(starts: Column) -> Column:
        return F.transform(starts, lambda start, i: F.struct(
            F.get(turns, start)["role"].alias("role"),
            F.transform(F.slice(turns, start + 1, F.coalesce(F.get(starts, i + 1), F.size(turns)) - start),
                        lambda t: t["text"]).alias("parts")))

    changes = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (
        F.get(turns, i)["role"] != F.get(turns, F.greatest(i - 1, F.lit(0)))["role"]))
    return _let(changes, same_role)


def segments(chat: Column, answers: str) -> Column:
    """The formatted text of messages in pieces, each with whether it is under the loss mask."""
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_message(m: Column) -> Column:
        head = F.concat(F.lit(START), m["role"], F.lit(TEXT))
        parts = F.flatten(F.transform(m["parts"], lambda p, i: F.array(
            piece(F.when(i == 0, head).otherwise(F.lit(PART)), F.lit(False)), piece(p, m["role"] == answers))))
        return F.concat(parts, F.array(piece(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(chat, of_message))


def format_chats(turns: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 answers: str = "assistant") -> DataFrame:
    """One row per conversation: the id, ``formatted`` and ``segments`` (text, loss), whose texts make up ``formatted``.

    Rows are ordered by ``turn``, then role, then text, so ties and repeated
    rows have one result; NULL turns come first.  NULL roles and texts are
    empty; NULL ids are one conversation.  An empty table gives an empty
    result.  Other columns are not read.

    A conversation becomes one row, so it has to fit in one (2 GB); rows are
    escaped before they are grouped, and only the answering task joins them.
    """
    rows = turns.select(
        F.col(id_column).alias("__id"),
        F.struct(F.col(turn).alias("turn"),
                 escape(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
                 escape(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")).alias("__turn"))
    sorted_turns = rows.groupBy("__id").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    chats = sorted_turns.select("__id", segments(messages(F.col("__turns")), answers).alias("segments"))
    return chats.select(F.col("__id").alias(id_column),
                        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text: every turn it was made of, unescaped."""
    def of_message(message: Column) -> Column:
        head_and_parts = F.split(F.substr(message, F.lit(len(START) + 1)), r"<\|text\|>", 2)
        return _let(head_and_parts, lambda hp: F.transform(
            F.split(F.get(hp, F.lit(1)), r"<\|part\|>", -1),
            lambda part: F.struct(unescape(F.get(hp, F.lit(0))).alias("role"), unescape(part).alias("text"))))

    whole = F.split(formatted, r"<\|end\|>", -1)  # the last piece is what follows the last mark: nothing
    return F.flatten(F.transform(F.filter(whole, lambda m: m != ""), of_message))


def loss_text(masked: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(masked, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
