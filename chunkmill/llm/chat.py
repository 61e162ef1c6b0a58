"""Chat formatting: logged snapshots of growing conversations collapse to the maximal ones, which are rendered.

DataFrame operations only. Turns are dealt out by (conversation, run of turn numbers), so that a conversation of any
length is ordered in pieces. A turn's hash takes in its place, role and text; the hash of a prefix is the xor of its
turns' hashes, so it rolls within a run and runs add up. A conversation's key is a struct, which is never null: plain
equality keeps the turns where they are dealt out, and their texts move once more only if they are rendered. Conversations whose full hash is a proper prefix's hash of
another are dropped by an anti-join, equal ones keep the smallest conv_id.

Defined cases: turns are ordered by number (null last), role, text, and only equal turns tie; a turn that is repeated
counts as often as it stands there; null roles and texts differ from empty ones and are rendered empty; a null conv_id
is a conversation like others; texts and conversations of any length are rendered whole; extra columns are passed over,
whatever their names; no rows give none. Turns of a conversation without a number, or of one number, are one run and
meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers to a run.
RUN = 256
#: The marks of a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]


def prefixes(conversations: DataFrame) -> DataFrame:
    """(id, run, turn, role, text, place, n_turns, h1, h2, last; id: a struct of conv_id): every turn with the hash of the prefix that it ends."""
    run = F.floor(F.col("turn") / RUN)
    turns = conversations.select(F.struct("conv_id").alias("id"), F.coalesce(run, F.lit(2**62)).alias("run"), "turn", "role", "text")
    inside = Window.partitionBy("id", "run").orderBy(*_ordered()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    same = F.expr("id = i and run = r")

    def with_runs(rows: DataFrame, per_run: dict[str, Column], over: dict[str, Column]) -> DataFrame:
        runs = rows.groupBy("id", "run").agg(*[v.alias(k) for k, v in per_run.items()])
        for k, v in over.items():
            runs = runs.withColumn(k, v)
        return rows.join(runs.select(F.col("id").alias("i"), F.col("run").alias("r"), *over), same).drop("i", "r")

    turns = with_runs(turns, {"k": F.count("*")}, {"n_before": F.coalesce(F.sum("k").over(earlier), F.lit(0)), "n_turns": F.sum("k").over(Window.partitionBy("id"))})
    turns = turns.withColumn("place", F.col("n_before") + F.count("*").over(inside))
    for h, seed in (("h1", 1), ("h2", 2)):
        turns = turns.withColumn(f"{h}_own", F.xxhash64(F.lit(seed), "place", F.isnull("role"), "role", F.isnull("text"), "text"))
    turns = with_runs(turns, {"x1": F.bit_xor("h1_own"), "x2": F.bit_xor("h2_own")}, {"b1": F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)), "b2": F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0))})
    for h, b in (("h1", "b1"), ("h2", "b2")):
        turns = turns.withColumn(h, F.col(b).bitwiseXOR(F.bit_xor(f"{h}_own").over(inside)))
    return turns.select("id", "run", "turn", "role", "text", "place", "n_turns", "h1", "h2", (F.col("place") == F.col("n_turns")).alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(id, n_turns) of the conversations that are no prefix of another; turns: of prefixes()."""
    whole = turns.where("last").groupBy("h1", "h2", "n_turns").agg(F.min(F.struct(F.isnull("id.conv_id").alias("no"), "id")).alias("best"))
    inner = turns.where("not last").select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select(F.col("best.id").alias("id"), "n_turns")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and chat of every maximal conversation."""
    turns = prefixes(conversations)
    kept = maximal(turns).select(F.col("id").alias("i"))
    # the runs to be rendered, found by their keys alone
    runs = turns.select("id", "run").distinct().join(kept, F.expr("id = i")).select("i", F.col("run").alias("r"))
    mine = turns.join(runs, F.expr("id = i and run = r")).drop("i", "r")
    block = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{END}\n"))
    # runs first: a hot conversation is put together from pieces, only its final text is one row
    pieces = mine.groupBy("id", "run", "n_turns").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "").alias("b"))
    chat = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "b"))), lambda x: x["b"]), "")
    return pieces.groupBy("id", "n_turns").agg(chat.alias("chat")).select("id.conv_id", "n_turns", "chat")
