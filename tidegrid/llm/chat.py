"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, runs of one role
are merged to messages by array functions, and the messages are concatenated.
Control strings begin with ``<`` or ``[``; texts and roles are escaped so that they
hold neither, and no text can imitate a control string. The loss mask is an array
of spans (start, length) in bytes of UTF-8, one for each trained text.

A conversation is one output row, so its turns meet in one task; nothing else does.
Null texts are empty, null roles are the empty role, a null ``conv_id`` is a
conversation of its own and null turns come first. Equal turn numbers are ordered
by role, then text; repeated rows are repeated turns. Other columns are not read,
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that one step of a running sum copies; the next level copies blocks.
BLOCK = 1_000
#: What stands for the escape character itself and for the first characters of control strings.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


@dataclass(frozen=True)
class Template:
    """Control strings, each beginning with ``<`` or ``[``, and the roles that are trained on."""

    begin: str = "<s>"
    open_role: str = "[INST]"
    close_role: str = "[/INST]"
    between: str = "[TURN]"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = (self.begin, self.open_role, self.close_role, self.between, self.end)
        if any(not c or c[0] not in "<[" for c in controls):
            raise ValueError("a control string begins with < or [")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_lists(rows: DataFrame) -> DataFrame:
    """``conv_id`` and its sorted ``turns``."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    by = F.col("conv_id").cast("long").alias("conv_id")
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merge_turns(turns: Column) -> Column:
    """Adjacent turns of one role as one message: ``role`` and the array of its ``texts``."""
    n = F.size(turns)
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))

    def message(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), n)
        own = F.slice(turns, start + 1, stop - start)
        return F.struct(
            F.get(turns, start)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts")
        )

    return F.transform(starts, message)


def running_sums(lengths: Column) -> Column:
    """The sum before each element; in two levels, so that long arrays aren't copied at each step."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    empty = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def inside(total: Column, block: Column) -> Column:
        start = F.struct(total.alias("total"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(
            F.slice(lengths, block * BLOCK + 1, BLOCK), start,
            lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")),
        )

    outer = F.struct(
        empty["total"].alias("total"), F.array().cast("array<array<bigint>>").alias("before")
    )

    def step(a: Column, block: Column) -> Column:
        # one struct per block; its parts are taken out of a one-element array, so it is built once
        return F.element_at(
            F.transform(
                F.array(inside(a["total"], block)),
                lambda b: F.struct(b["total"].alias("total"), F.concat(a["before"], F.array(b["before"])).alias("before")),
            ),
            1,
        )

    return F.flatten(F.aggregate(blocks, outer, step)["before"])


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` of each conversation."""
    t = template

    def pieces(message: Column) -> Column:
        role, texts = message["role"], message["texts"]
        head = F.concat(F.lit(t.begin + t.open_role), escape(role), F.lit(t.close_role))
        return F.transform(texts, lambda text, i: F.struct(
            F.when(i == 0, head).otherwise(F.lit(t.between)).alias("before"),
            escape(text).alias("text"),
            F.when(i == F.size(texts) - 1, F.lit(t.end)).otherwise(F.lit("")).alias("after"),
            role.isin(*t.trained).alias("trained"),
        ))

    cut = turn_lists(rows).select("conv_id", merge_turns(F.col("turns")).alias("messages"))
    cut = cut.select("conv_id", F.flatten(F.transform("messages", pieces)).alias("pieces"))
    length = F.transform("pieces", lambda p: F.octet_length(F.concat(p["before"], p["text"], p["after"])).cast("long"))
    cut = cut.select("conv_id", "pieces", running_sums(length).alias("starts"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    spans = F.transform("pieces", lambda p, i: F.struct(
        p["trained"].alias("trained"),
        (F.get("starts", i) + F.octet_length(p["before"])).alias("start"),
        F.octet_length(p["text"]).cast("long").alias("length"),
    ))
    trained = F.transform(
        F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
    )
    return cut.select("conv_id", formatted.alias("formatted"), trained.alias("loss_spans"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds ``turns`` (role, text), as they were before merging, and ``loss_text``, the text under the mask."""
    t = template
    messages = F.split("formatted", re.escape(t.end), -1)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def turns(message: Column) -> Column:
        halves = F.split(message, re.escape(t.close_role), 2)
        role = unescape(F.substr(F.get(halves, F.lit(0)), F.lit(len(t.begin + t.open_role) + 1)))
        return F.transform(
            F.split(F.get(halves, F.lit(1)), re.escape(t.between), -1),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    masked = F.transform("loss_spans", lambda s: F.decode(
        F.substr(F.col("formatted").cast("binary"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"
    ))
    return formatted.select(
        "*",
        F.flatten(F.transform(messages, turns)).alias("turns"),
        F.array_join(F.transform(masked, unescape), "").alias("loss_text"),
    )
