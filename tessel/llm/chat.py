"""Chat formatting after cumulative snapshots are collapsed.

A log often holds a conversation many times, each time with a few turns more. Every turn has a rolling hash of all turns
up to it; a conversation whose hash and length equal those of a longer one's inner turn is a prefix of that one. An
anti-join drops such prefixes, another drops all but the first of equal conversations; what remains is rendered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.runtime import cut


@dataclass(frozen=True)
class ChatParams:
    """How a turn is written: open, role, middle, text, close."""

    open: str = "<|"
    middle: str = "|>\n"
    close: str = "<|end|>\n"


def rolling(conversations: DataFrame) -> DataFrame:
    """Distinct turns with n (place), turns (of the conversation) and h1, h2: the hash of all turns up to this one."""
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("n", F.row_number().over(order))
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)")).over(upto)
    return turns.withColumns({"h1": hashed(1), "h2": hashed(2), "last": F.lead("n").over(order).isNull()})


def maximal_chats(conversations: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """(conv_id, n_turns, chat) of each conversation that isn't a prefix of, nor equal to one with a smaller id.

    Turns go by turn, then role and text; repeated rows count once; null roles and texts are rendered empty but differ
    from empty ones. Rows without a conv_id are in no conversation. Other columns are ignored; an empty table gives an
    empty one. A conversation is rendered in one task, as its text is one value.
    """
    p = params or ChatParams()
    turns = cut(rolling(conversations), "chat-turns")
    ends = turns.where("last").select("conv_id", "n", "h1", "h2")
    inner = turns.where("NOT last").select("n", "h1", "h2").distinct()
    long = ends.join(inner, ["n", "h1", "h2"], "left_anti")
    first = long.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id")).select("conv_id", F.col("n").cast("long").alias("n_turns"))
    line = F.concat(F.lit(p.open), F.coalesce("role", F.lit("")), F.lit(p.middle), F.coalesce("text", F.lit("")), F.lit(p.close))
    of = turns.join(first, "conv_id").groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    return of.select("conv_id", "n_turns", F.array_join(F.col("lines.line"), "").alias("chat"))
