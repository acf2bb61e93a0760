"""Preference formatting of chosen and rejected conversations, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The turn markup.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"

#: Role whose turns are learned from.
LEARNED = "assistant"


def _turns(rows: DataFrame, name: str) -> DataFrame:
    """One array of turns a pair, ordered by turn number; ties by role and text, nulls first."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias(name))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def _render(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END)))
    return F.array_join(parts, "")


def _masked(turns: Column, prompt: Column) -> Column:
    """Stretches (start, length, learned) of a rendered completion, in characters behind the prompt.

    The markup before a turn's text is never learned from; the text and its end mark are where the
    role is LEARNED."""
    def add(state: Column, t: Column) -> Column:
        head = F.length(F.concat(F.lit(START), t["role"], F.lit(MIDDLE)))
        body = F.length(F.concat(t["text"], F.lit(END)))
        spans = F.concat(state["spans"], F.array(
            F.struct(state["at"].alias("start"), head.alias("length"), F.lit(False).alias("learned")),
            F.struct((state["at"] + head).alias("start"), body.alias("length"), (t["role"] == LEARNED).alias("learned")),
        ))
        return F.struct((state["at"] + head + body).alias("at"), spans.alias("spans"))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,length:int,learned:boolean>>")
    return F.aggregate(turns, F.struct(F.length(prompt).alias("at"), empty.alias("spans")), add, lambda s: s["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Prompt and paired masked completions of each pair of conversations.

    chosen, rejected: pair_id, turn, role, text, a row for each turn; other columns are ignored. The
    longest run of first turns with equal role and text is the prompt, rendered once; the rest of
    either conversation is its completion. A null role or text counts as empty; a null turn comes
    first; repeated rows are repeated turns; a null pair_id, or a pair that one side lacks, gives no
    row; equal conversations have empty completions; empty tables give none.
    Returns pair_id, prompt, prompt_turns, chosen, rejected (completions) and chosen_mask,
    rejected_mask (their stretches, learned from or not)."""
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda i: ~_same(F.element_at("c", i), F.element_at("r", i)))
    both = both.withColumn("prompt_turns", F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, shorter))
    rest = both.select(
        "pair_id", "prompt_turns",
        F.slice("c", F.lit(1), F.col("prompt_turns")).alias("p"),
        F.slice("c", F.col("prompt_turns") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("prompt_turns") + 1, F.size("r")).alias("r"),
    )
    prompt = _render(F.col("p"))
    return rest.select(
        "pair_id", prompt.alias("prompt"), "prompt_turns", _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _masked(F.col("c"), prompt).alias("chosen_mask"), _masked(F.col("r"), prompt).alias("rejected_mask"),
    )


def weakened(conversations: DataFrame) -> DataFrame:
    """A rejected version of each conversation: its last learned turn says what the one before said.

    conversations: conv_id, turn, role, text. The reply that a conversation ends with is replaced by
    its previous reply, or by nothing where there is none, a fault that preference training is to
    mend. Conversations without such a turn stay as they are."""
    own = Window.partitionBy("conv_id", F.col("role") == LEARNED).orderBy(F.col("turn").asc_nulls_first(), F.coalesce("text", F.lit("")))
    back = Window.partitionBy("conv_id", F.col("role") == LEARNED).orderBy(F.col("turn").desc_nulls_last(), F.coalesce("text", F.lit("")).desc())
    marked = conversations.select("conv_id", "turn", "role", "text", F.lag("text").over(own).alias("before"), F.row_number().over(back).alias("left"))
    last = (F.col("role") == LEARNED) & (F.col("left") == 1)
    return marked.select("conv_id", "turn", "role", F.when(last, F.coalesce("before", F.lit(""))).otherwise(F.col("text")).alias("text"))
