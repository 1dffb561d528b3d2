"""Conversations through the tokeniser: one token map for all messages of a conversation.

Messages are text, lists of typed parts, and tool calls whose arguments are JSON text; all of
them share the map of their conversation, in the order of turns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismveil.operators.detection import Engine
from prismveil.operators.tokenisation import sanitize_scoped

HINT = "Square-bracketed tokens such as [EMAIL_0] stand for values. Repeat them exactly as they are."


def skipped_model(model: Column, prefixes: Sequence[str]) -> Column:
    """Is the model among those that see plain text?"""
    out = F.lit(False)
    for p in prefixes:
        out |= F.coalesce(model.startswith(p), F.lit(False))
    return out


def sanitize_messages(messages: DataFrame, engine: Engine | None = None, conv: str = "conv_id", turn: str = "turn", content: str = "content", arguments: str | None = "tool_arguments") -> tuple[DataFrame, DataFrame]:
    """``conv, turn, content[, arguments]`` in tokens, and the table of tokens.

    Contents and tool arguments are texts of their turn, contents first.  Null stays null; a
    re-sent message is one message.
    """
    columns = [content, *([arguments] if arguments else [])]
    distinct = messages.select(conv, turn, *columns).distinct()
    texts = distinct.select(conv, turn, F.posexplode(F.array(*columns)).alias("_part", "_text"))
    safe, tokens = sanitize_scoped(texts, [conv, turn, "_part"], [conv], [turn, "_part"], "_text", engine)
    wide = safe.groupBy(conv, turn).agg(*[F.max(F.when(F.col("_part") == i, F.col("sanitized"))).alias(c) for i, c in enumerate(columns)])
    return wide, tokens


def sanitize_parts(messages: DataFrame, engine: Engine | None = None, conv: str = "conv_id", turn: str = "turn", parts: str = "parts") -> tuple[DataFrame, DataFrame]:
    """``conv, turn, parts`` with the texts, arguments and results of
    ``array<struct<type,text,args,result>>`` in tokens, and the table of tokens.  Other fields of
    a part do not pass; null texts stay null."""
    fields = ("text", "args", "result")
    rows = messages.select(conv, turn, F.posexplode(parts).alias("_p", "_part"))
    long = rows.select(conv, turn, "_p", F.col("_part.type").alias("_type"), F.posexplode(F.array(*[F.col(f"_part.{f}") for f in fields])).alias("_f", "_text"))
    safe, tokens = sanitize_scoped(long.select(conv, turn, "_p", "_f", "_text"), [conv, turn, "_p", "_f"], [conv], [turn, "_p", "_f"], "_text", engine)
    types = rows.select(conv, turn, "_p", F.col("_part.type").alias("_type")).distinct()
    wide = safe.groupBy(conv, turn, "_p").agg(*[F.max(F.when(F.col("_f") == i, F.col("sanitized"))).alias(f) for i, f in enumerate(fields)])
    one = wide.join(types, [conv, turn, "_p"]).select(conv, turn, F.struct("_p", F.struct(F.col("_type").alias("type"), *fields).alias("v")).alias("_s"))
    out = one.groupBy(conv, turn).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["v"]).alias(parts))
    return out, tokens


def with_hint(messages: DataFrame, tokens: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """``conv, turn, role, content`` with the hint in the first system message of each
    conversation that has tokens, or in a system message of its own before the first turn."""
    used = tokens.select(conv).distinct().withColumn("_used", F.lit(True))
    rows = messages.select(conv, turn, role, content)
    first = rows.groupBy(conv).agg(F.min(F.when(F.col(role) == "system", F.col(turn))).alias("_system"), F.min(turn).alias("_first")).join(used, conv)
    marked = rows.join(first.select(conv, "_system"), conv, "left")
    hinted = marked.withColumn(content, F.when(F.col("_system") == F.col(turn), F.concat_ws("\n", content, F.lit(HINT))).otherwise(F.col(content))).drop("_system")
    own = first.filter(F.col("_system").isNull()).select(conv, (F.col("_first") - 1).alias(turn), F.lit("system").alias(role), F.lit(HINT).alias(content))
    return hinted.unionByName(own)


def restore_messages(replies: DataFrame, tokens: DataFrame, conv: str = "conv_id", text: str = "content", out: str = "restored") -> DataFrame:
    """``replies`` with the tokens of their conversation restored."""
    from prismveil.operators.tokenisation import desanitize

    maps = tokens.groupBy(conv).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_map"))
    return desanitize(replies.join(maps, conv, "left"), text, "_map", out).drop("_map")


def present_tokens(text: Column, tokens: Column) -> Column:
    """The tokens of an array that stand in a text, letter by letter, in order."""
    return F.array_sort(F.filter(tokens, lambda t: F.contains(text, t)))
