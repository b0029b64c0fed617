"""The conversation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def new_turns(log: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Only the turns to add: per exchange the user's message and then the reply.

    ``log`` is ``(conv_id, turn, role, text)``. ``exchanges`` is ``(conv_id,
    question, answer)`` plus, where a conversation has several, their position
    ``exchange_no`` from 0; two exchanges at one place are refused. Turns continue
    after the conversation's last one (from 0 in a new conversation). The last turn
    comes from a partial aggregate, so a conversation of any length costs no big group.
    """
    return turns_after(log.groupBy("conv_id").agg(F.max("turn").alias("turn")), exchanges)


def turns_after(last: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The same from the last turn of each conversation, ``(conv_id, turn)``, without the log."""
    last = last.select("conv_id", F.col("turn").alias("_last"))
    if "exchange_no" not in exchanges.columns:
        exchanges = exchanges.withColumn("exchange_no", F.lit(0))
    clash = exchanges.groupBy("conv_id", "exchange_no").count().where("count > 1")
    if not clash.isEmpty():
        raise ValueError("several exchanges of one conversation need different exchange_no")
    first_turn = F.coalesce(F.col("_last"), F.lit(-1)) + 1 + 2 * F.col("exchange_no")

    def message(offset: int, role: str, text: str):
        return F.struct(
            (first_turn + offset).cast("bigint").alias("turn"),
            F.lit(role).alias("role"),
            F.col(text).alias("text"),
        )

    return (
        exchanges.join(last, "conv_id", "left")
        .select(
            "conv_id",
            F.explode(
                F.array(message(0, "user", "question"), message(1, "assistant", "answer"))
            ).alias("message"),
        )
        .select("conv_id", "message.*")
    )


def append_exchanges(log: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The log with the turns that :func:`new_turns` adds."""
    old = log.select("conv_id", "turn", "role", "text")
    return old.unionByName(new_turns(log, exchanges))
