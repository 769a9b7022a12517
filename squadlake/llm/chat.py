"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one
role are merged by an array aggregation, and the blocks are concatenated:

    <s>role newline text <turn> text </s><s>role ...

Control strings inside roles and texts are escaped reversibly: a backslash becomes
``\\z``, the i-th control string ``\\i``, a line break in a role ``\\n``; so in
escaped text every backslash starts exactly one of these codes.  The loss mask is
an array of spans (start, length) in code points of the formatted text, one for
each text of an assistant.

The fold copies the blocks gathered so far with each turn: cheap for the some
hundred turns of a long conversation, quadratic beyond ten thousands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<s>", "</s>", "<turn>"
CONTROLS = (OPEN, CLOSE, NEXT, "[INST]", "[/INST]")
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    start = F.replace(text, F.lit("\\"), F.lit("\\z"))
    return reduce(lambda c, i: F.replace(c, F.lit(CONTROLS[i]), F.lit(f"\\{i}")), range(len(CONTROLS)), start)


def unescaped(text: Column) -> Column:
    restored = reduce(lambda c, i: F.replace(c, F.lit(f"\\{i}"), F.lit(CONTROLS[i])), range(len(CONTROLS)), text)
    return F.replace(restored, F.lit("\\z"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


BLOCKS = "array<struct<role: string, texts: array<string>>>"


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role."""
    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        alone = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
        grown = F.struct(last.role.alias("role"), F.concat(last.texts, F.array(turn.text)).alias("texts"))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1)).role == turn.role),
                      F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(alone)))

    return F.aggregate(turns, F.array().cast(BLOCKS), add)


def loss_spans(blocks: Column) -> Column:
    """(start, length) of each text of LOSS_ROLE in the formatted conversation."""
    def parts(block: Column) -> Column:
        return F.transform(block.texts, lambda text, i: F.struct(
            F.when(i == 0, F.length(block.role) + len(OPEN) + 1).otherwise(len(NEXT)).alias("before"),
            F.length(text).alias("size"),
            F.when(i == F.size(block.texts) - 1, len(CLOSE)).otherwise(0).alias("after"),
            (block.role == LOSS_ROLE).alias("counts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def add(state: Column, part: Column) -> Column:
        span = F.struct((state.at + part.before).alias("start"), part["size"].alias("length"))
        return F.struct((state.at + part.before + part["size"] + part.after).alias("at"),
                        F.when(part.counts, F.concat(state.spans, F.array(span))).otherwise(state.spans).alias("spans"))

    return F.aggregate(F.flatten(F.transform(blocks, parts)), start, add).spans


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): conv_id, formatted, loss_spans.

    Null roles and texts count as empty.  Turns with one number are ordered by
    role and text, a missing number comes first, and repeated rows are turns of
    their own.  Rows without a conv_id are one conversation.  Other columns are
    left out.
    """
    turn = F.struct("turn", escaped_role(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    plain = F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), turn.alias("escaped"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(plain)).alias("turns"))
    blocks = gathered.select("conv_id", merged(F.col("turns.escaped")).alias("blocks"))
    block = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b.role, F.lit("\n"), F.array_join(b.texts, NEXT), F.lit(CLOSE)))
    return blocks.select("conv_id", F.array_join(block, "").alias("formatted"), loss_spans(F.col("blocks")).alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, from the output alone."""
    raw = F.split("formatted", CLOSE, -1)
    blocks = F.slice(raw, 1, F.size(raw) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        texts = F.split(F.substr(block, F.length(head) + 2), NEXT, -1)
        role = unescaped_role(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(texts, lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    spans = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s.start + 1, s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(spans, "").alias("loss_text"))
