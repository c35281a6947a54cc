"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

The hash of a conversation's first n turns is the exclusive or of position-dependent turn hashes, rolled over its turns by
a window (two lanes of 64 bits). A conversation is a snapshot of a longer one if its last prefix hash is a
proper prefix hash of another; anti-joins keep the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text, p1, p2, n): every turn with the hash of the turns up to it and the number of turns."""
    own = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    roll = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumn("pos", F.row_number().over(own))
    hashed = rows.withColumns({"h1": F.xxhash64("pos", "role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "pos", "role")})
    return hashed.select("conv", "pos", "role", "text", F.expr("bit_xor(h1)").over(roll).alias("p1"), F.expr("bit_xor(h2)").over(roll).alias("p2"), F.count("*").over(Window.partitionBy("conv")).alias("n"))


def collapse(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_same, rendered): the maximal conversations, each rendered once.

    A conversation whose turns (role and text) are the first turns of a longer one goes; of equal conversations the smallest id
    stays and ``n_same`` counts them. Turns are in the order of turn, role, text, nulls first. A null role or text counts as
    empty; rows with a null conversation id are left out; rows repeated in all four columns count once. ``<|`` in
    a role or text is rendered as ``< |``, so no text can close a turn. Other columns are ignored; no rows give no rows."""
    turns = (
        conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        .where("conv is not null")
        .distinct()
    )
    rows = prefixes(turns)
    whole = rows.where("pos = n").groupBy("p1", "p2", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("n_same"))
    proper = rows.where("pos < n").select("p1", "p2", F.col("pos").cast("long").alias("n")).distinct()
    kept = whole.join(proper, ["p1", "p2", "n"], "left_anti").select("conv", "n_same")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit(START), safe("role"), F.lit("\n"), safe("text"), F.lit(END + "\n"))
    parts = rows.join(kept, "conv").groupBy("conv").agg(F.max("n").alias("n_turns"), F.max("n_same").alias("n_same"), F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("parts"))
    return parts.select(F.col("conv").alias("conv_id"), "n_turns", "n_same", F.array_join(F.col("parts.said"), "").alias("rendered"))
