"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

The longest common prefix of turns (role and text) is rendered once as the prompt; what is left of either conversation is
its completion. Masks are spans [start, end) of characters of the completion that count for training: the assistant's
turns with their end marks. Built-in functions only; a conversation is put together after its repeated turns are merged
by partial aggregation.

Defined results: of several rows for one turn the least (role, text) counts; null roles read as "user" and null texts as
empty; turns without a number or conversation are dropped; a pair without one of its conversations gets an empty prompt
and null for that side; equal conversations give two empty completions, and is_preference is false; texts are rendered as
they are, so a text may hold the marks of roles and ends itself: masks are places, not searched for, and stay right; other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, pick, sums_before

TURN_END = "<|end|>"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(TURN_END + "\n"))


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<turn, role, text>> by turn)."""
    rows = pick(turns, id=id_col, turn=turn_col, role=role_col, text=text_col).where("id is not null and turn is not null")
    said = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    merged = rows.groupBy("id", "turn").agg(F.min(said).alias("said"))
    return merged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "said.role", "said.text"))).alias("turns"))


def _completion(turns: Column) -> Column:
    """struct<text, mask> of the rendered turns; the places are sums of lengths, so long conversations cost no more a turn."""

    def spans(pieces: Column) -> Column:
        end = F.zip_with(sums_before(F.transform(pieces, F.length)), pieces, lambda a, p: a + F.length(p))
        spoken = F.zip_with(turns, end, lambda t, e: F.when(t["role"] == "assistant", F.struct((e - F.length(t["text"]) - len(TURN_END) - 1).cast("int").alias("start"), (e - 1).cast("int").alias("end"))))
        return F.array_compact(spoken)

    return let(F.transform(turns, lambda t: render(t["role"], t["text"])), lambda pieces: F.struct(F.array_join(pieces, "").alias("text"), spans(pieces).alias("mask")))


def preference_pairs(turns: DataFrame, pairs: DataFrame, **columns: str) -> DataFrame:
    """turns and pairs (pair_id, chosen_id, rejected_id) to one row for each pair.

    Returns pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, is_preference.
    """
    talks = conversations(turns, **columns)
    both = (
        pick(pairs, pair_id="pair_id", chosen_id="chosen_id", rejected_id="rejected_id")
        .join(talks.select(F.col("id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left")
        .join(talks.select(F.col("id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
    )
    alike = F.zip_with(F.coalesce("a", F.array().cast(talks.schema["turns"].dataType)), F.coalesce("b", F.array().cast(talks.schema["turns"].dataType)), lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(alike, F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.size(alike)).cast("int")
    left = both.withColumn("n", n)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    done = left.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        F.coalesce(F.array_join(F.transform(F.slice("a", 1, F.col("n")), lambda t: render(t["role"], t["text"])), ""), F.lit("")).alias("prompt"),
        F.when(F.col("a").isNotNull(), _completion(rest("a"))).alias("x"),
        F.when(F.col("b").isNotNull(), _completion(rest("b"))).alias("y"),
    )
    return done.select(
        "pair_id", "n_prompt_turns", "prompt", F.col("x.text").alias("chosen"), F.col("x.mask").alias("chosen_mask"), F.col("y.text").alias("rejected"), F.col("y.mask").alias("rejected_mask"),
        F.coalesce(F.col("x.text") != F.col("y.text"), F.lit(False)).alias("is_preference"),
    )
