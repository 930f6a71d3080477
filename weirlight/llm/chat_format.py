"""Preference formatting: prompt once, then paired masked completions.

A pair has a chosen and a rejected conversation, each a table of turns. Their longest common prefix of
turns is the prompt; the turns after it are the two completions. All are rendered by one template,
and a completion comes with a mask in run-length form, ``<characters>:<0 or 1>`` for each piece of its
text in order, 1 where a loss counts: on the words of the assistant and their end mark.

The first turn at which the sides differ is a minimum over the pair's turns, so it is summed up before
any shuffle. Turns are joined to strings in blocks of ``turns_per_block`` first and the blocks to the
whole after, so that a very long conversation is spread over many tasks up to its last, short step.

Cases: turns are in the order of ``turn``; several rows of one turn are one turn, in the order of role
and text. A null turn comes first. Null roles are rendered as ``unknown`` and null texts as empty, and
such values equal each other. A side without turns has an empty completion; a pair whose sides are
equal has two empty completions. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import with_next


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """(head, body) of one turn's text: the mask tells them apart."""
    head = F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))
    return head, F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame, pair_col: str = "pair_id", turns_per_block: int = 64) -> DataFrame:
    """One row per pair: (pair, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    ``turns`` has pair_col, chosen (boolean: the side), turn, role and text.
    """
    rows = turns.select(F.col(pair_col).alias("pair"), "chosen", F.col("turn").cast("long").alias("turn"), "role", "text")
    # One row per turn of a pair, with what either side says in it.
    said = F.struct("role", "text")
    both = rows.groupBy("pair", "turn").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), said))).alias("yes"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), said))).alias("no"),
    )
    differs = both.where(~F.col("yes").eqNullSafe(F.col("no")))
    # A null turn stands before all others.
    place = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    splits = differs.groupBy(F.col("pair").alias("of")).agg(F.min(place).alias("split"))
    told = both.join(splits, both["pair"].eqNullSafe(splits["of"]), "left").withColumn("in_prompt", F.col("split").isNull() | (place < F.col("split")))

    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(side).alias("said"))
    parts = F.when(F.col("in_prompt"), F.array(part(0, "yes"))).otherwise(F.array(part(1, "yes"), part(2, "no")))
    pieces = told.select("pair", "turn", F.explode(parts).alias("p")).select("pair", "turn", "p.part", F.col("p.said").alias("said"))

    def text_of(s: Column) -> Column:
        return F.concat(*rendered(s["role"], s["text"]))

    def mask_of(s: Column) -> Column:
        head, body = rendered(s["role"], s["text"])
        loss = F.when(s["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.length(head).cast("string"), F.lit(":0,"), F.length(body).cast("string"), F.lit(":"), loss)

    pieces = pieces.where(F.size("said") > 0).select(
        "pair",
        "part",
        "turn",
        F.floor(F.col("turn") / turns_per_block).alias("block"),
        F.size("said").alias("n"),
        F.array_join(F.transform("said", text_of), "").alias("text"),
        F.array_join(F.transform("said", mask_of), ",").alias("mask"),
    )
    ordered = lambda key: F.array_sort(F.collect_list(F.struct(key, "text", "mask")))
    joined = lambda: (F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"), F.array_join(F.transform("all", lambda x: x["mask"]), ",").alias("mask"))
    blocks = pieces.groupBy("pair", "part", "block").agg(ordered("turn").alias("all"), F.count("*").alias("n")).select("pair", "part", "block", "n", *joined())
    whole = blocks.groupBy("pair", "part").agg(ordered("block").alias("all"), F.sum("n").alias("n")).select("pair", "part", "n", *joined())
    pick = lambda column, n: F.coalesce(F.max(F.when(F.col("part") == n, F.col(column))), F.lit(""))
    parts_of = whole.groupBy("pair").agg(
        F.coalesce(F.max(F.when(F.col("part") == 0, F.col("n"))), F.lit(0)).alias("n_prompt_turns"),
        pick("text", 0).alias("prompt"),
        pick("text", 1).alias("chosen"),
        pick("mask", 1).alias("chosen_mask"),
        pick("text", 2).alias("rejected"),
        pick("mask", 2).alias("rejected_mask"),
    )
    return parts_of.withColumnRenamed("pair", pair_col)


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs for preference training, as turns of format_preferences.

    Chosen is each conversation as it is; rejected is the same with its last assistant turn answered by
    the last assistant turn of the next lower conv_id (after the lowest: the highest), a plausible
    answer to another question. Conversations without an assistant turn stay as they are on both sides.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    asked = turns.where(F.col("role") == "assistant")
    last = turns.select("conv_id").distinct().join(
        asked.groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")), "conv_id", "left"
    )
    last = last.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("last.turn").alias("last_turn"), F.coalesce("last.text", F.lit("")).alias("answer"), F.lit(0).cast("long").alias("tie"))
    other = with_next(last, "conv_id", "tie", ["answer"]).select(F.col("conv_id").alias("of"), "last_turn", "next_answer")
    told = turns.join(other, turns["conv_id"].eqNullSafe(other["of"]), "left")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    side = lambda chosen, text: F.struct(F.lit(chosen).alias("chosen"), text.alias("text"))
    sides = F.array(side(True, F.col("text")), side(False, F.when(swap, F.col("next_answer")).otherwise(F.col("text"))))
    return told.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.chosen", "turn", "role", "s.text")


ORACLE_SQL = r"""
WITH last AS (
  SELECT c.conv_id, a.turn AS last_turn, coalesce(a.text, '') AS answer
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (
    SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) = 1) a USING (conv_id)),
other AS (
  SELECT conv_id, last_turn,
         coalesce(lead(answer) OVER (ORDER BY conv_id DESC), first_value(answer) OVER (ORDER BY conv_id DESC)) AS next_answer
  FROM last),
sides AS (
  SELECT c.conv_id AS pair_id, c.turn, c.role, c.text AS yes,
         CASE WHEN c.role = 'assistant' AND c.turn = o.last_turn THEN o.next_answer ELSE c.text END AS no
  FROM conversations c JOIN other o USING (conv_id)),
splits AS (
  SELECT pair_id, min(CASE WHEN yes IS DISTINCT FROM no THEN turn END) AS split FROM sides GROUP BY pair_id),
told AS (
  SELECT s.*, coalesce(s.turn < p.split, true) AS in_prompt,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head,
         coalesce(yes, '') || '<|end|>' || chr(10) AS yes_body, coalesce(no, '') || '<|end|>' || chr(10) AS no_body,
         CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS loss
  FROM sides s JOIN splits p USING (pair_id))
SELECT pair_id, count(*) FILTER (WHERE in_prompt) AS n_prompt_turns,
  coalesce(string_agg(head || yes_body, '' ORDER BY turn) FILTER (WHERE in_prompt), '') AS prompt,
  coalesce(string_agg(head || yes_body, '' ORDER BY turn) FILTER (WHERE NOT in_prompt), '') AS chosen,
  coalesce(string_agg(length(head) || ':0,' || length(yes_body) || ':' || loss, ',' ORDER BY turn) FILTER (WHERE NOT in_prompt), '') AS chosen_mask,
  coalesce(string_agg(head || no_body, '' ORDER BY turn) FILTER (WHERE NOT in_prompt), '') AS rejected,
  coalesce(string_agg(length(head) || ':0,' || length(no_body) || ':' || loss, ',' ORDER BY turn) FILTER (WHERE NOT in_prompt), '') AS rejected_mask
FROM told GROUP BY pair_id
"""
