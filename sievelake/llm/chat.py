"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once, as the prompt; what follows on each side is that side's completion, in
which only the assistant's words are trained on. The result has a row for each rendered turn, so a conversation of any
length is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm._rows import with_row_number
from sievelake.llm._session import checkpoint

START, END = "<|im_start|>", "<|im_end|>"


def _clean(column: str) -> Column:
    """A null is empty; the template's markers are broken up, so that a text can't close its own turn."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def turns_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(pair_id, turn, sub, role, text): repeated rows are one turn; different rows with one turn number follow each other by role and text."""
    rows = conversations.select(F.col(id_col).alias("pair_id"), "turn", _clean("role").alias("role"), _clean("text").alias("text"))
    # one exchange serves both steps, and a long conversation is spread by its turns
    rows = rows.repartition("pair_id", "turn").distinct()
    return rows.withColumn("sub", F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text")))


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for training from single conversations: chosen is a conversation up to its last assistant turn, rejected has the last answer of the
    next conversation (by conv_id; the first follows the last) in that place. Conversations without an assistant turn, and null ids, make no pair.
    """
    # each of the steps below reads the turns again
    turns = checkpoint(turns_of(conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())))
    place = F.struct("turn", "sub")
    answers = turns.where(F.col("role") == "assistant").groupBy("pair_id").agg(F.max(place).alias("last"))
    numbered, n = with_row_number(answers, ["pair_id"])
    of_next = numbered.select(F.pmod(F.col("row_number") - 1, F.lit(max(1, n))).alias("row_number"), F.col("pair_id").alias("source"), F.col("last").alias("source_last"))
    plan = checkpoint(numbered.join(of_next, "row_number").select("pair_id", "last", "source", "source_last"))
    kept = turns.join(plan.select("pair_id", "last"), "pair_id").where(place <= F.col("last"))
    chosen = kept.drop("last")
    texts = turns.select(F.col("pair_id").alias("source"), F.struct("turn", "sub").alias("source_last"), "role", "text")
    swapped = plan.join(texts, ["source", "source_last"]).select("pair_id", "last.turn", "role", "text", "last.sub")
    return chosen, kept.where(place < F.col("last")).drop("last").unionByName(swapped)


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, part, turn, sub, role, rendered, trainable, loss_from, loss_to, prompt_turns) from two frames as of ``turns_of``.

    part: prompt, chosen or rejected. Read in the order of (turn, sub), the prompt followed by a side's rows is that side's
    whole conversation. Characters loss_from .. loss_to of a trainable row (its text and end marker) bear the loss. Equal
    conversations are all prompt; a pair with one side has no prompt. Null roles and texts are empty, and texts of any length are rendered whole; pairs with a
    null id are left out. ``turns_of`` makes repeated rows one turn, breaks ties, and drops other columns; empty frames give no rows.
    """
    both = chosen.withColumn("side", F.lit("chosen")).unionByName(rejected.withColumn("side", F.lit("rejected")))
    slots = both.groupBy("pair_id", "turn", "sub").agg(F.count("*").alias("n"), F.count_distinct("role", F.xxhash64("text"), F.crc32("text")).alias("kinds"))
    place = F.struct("turn", "sub")
    same = (F.col("n") == 2) & (F.col("kinds") == 1)
    split = slots.groupBy("pair_id").agg(F.min(F.when(~same, place)).alias("split"))
    marked = both.join(split, "pair_id").withColumn("in_prompt", F.col("split").isNull() | (place < F.col("split")))
    prompt_turns = marked.where("in_prompt and side = 'chosen'").groupBy("pair_id").agg(F.count("*").alias("prompt_turns"))
    rows = marked.where("not (in_prompt and side = 'rejected')").join(prompt_turns, "pair_id", "left")
    trainable = ~F.col("in_prompt") & (F.col("role") == "assistant")
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    return rows.select(
        "pair_id",
        F.when(F.col("in_prompt"), "prompt").otherwise(F.col("side")).alias("part"),
        "turn",
        F.col("sub").cast("long").alias("sub"),
        "role",
        F.concat(head, F.col("text"), F.lit(END + "\n")).alias("rendered"),
        trainable.alias("trainable"),
        F.when(trainable, F.length(head)).cast("long").alias("loss_from"),
        F.when(trainable, F.length(head) + F.length("text") + len(END)).cast("long").alias("loss_to"),
        F.coalesce("prompt_turns", F.lit(0)).alias("prompt_turns"),
    )
