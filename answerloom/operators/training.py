"""Training-set preparation: pairs, examples, batches, padding, chat prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerloom.functions.common import is_blank
from answerloom.functions.prompts import distilled_answer, prompt
from answerloom.functions.text import token_count, token_ids
from answerloom.operators.ordering import row_blocks
from answerloom.plans.skew import with_group_stats

# fixed values: the label that a loss ignores, and the chat markup
IGNORE_LABEL = -100
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def user_assistant_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn right after it, by an equi-join."""
    ask = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return ask.join(reply, ["conv_id", "turn"])


def build_examples(
    df: DataFrame,
    keys: Sequence[str],
    problem: str,
    thinking: str,
    content: str,
    eos_id: int,
    encode=token_ids,
    cap_prompt: bool = False,
) -> DataFrame:
    """Prompt ids + answer ids + end id with the prompt length.

    ``valid`` is false for rows with a missing or blank field; they carry no ids. With
    ``cap_prompt`` the prompt length stays below the sequence length.
    """
    answer = distilled_answer(thinking, content)
    staged = df.select(
        *keys,
        F.when(F.col(problem).isNotNull(), prompt("problem", prompt=problem)).alias("__p"),
        answer.alias("__a"),
    ).select(*keys, encode("__p").alias("__pi"), encode("__a").alias("__ai"))
    ids = F.concat("__pi", "__ai", F.array(F.lit(eos_id)))
    built = staged.select(*keys, F.size("__pi").alias("prompt_len"), ids.alias("token_ids"))
    valid = F.coalesce(F.size("token_ids") >= 2, F.lit(False)) & F.col("token_ids").isNotNull()
    length = F.col("prompt_len")
    if cap_prompt:
        length = F.least(length, F.size("token_ids") - 1)
    return built.select(
        *keys,
        F.when(valid, F.col("token_ids")).alias("token_ids"),
        F.when(valid, length).alias("prompt_len"),
        valid.alias("valid"),
    )


def length_sorted_batches(
    df: DataFrame, size: Column, ties: Sequence[Column], batch_size: int, **plan
) -> DataFrame:
    """Sort by length, ties by a shuffle key, and cut into batches."""
    sized = df.withColumn("__len", size)
    return row_blocks(sized, [F.col("__len"), *ties], batch_size, **plan).drop(
        "__len"
    ).withColumnRenamed("block", "batch")


def padded_batches(df: DataFrame, pad_id: int) -> DataFrame:
    """D3: input, mask and label arrays, padded on the left to the widest row of the batch.

    Inputs and labels are the sequence shifted by one; padding and prompt positions carry
    the ignored label. A batch holds ``batch_size`` rows, so the window over it is small.
    """
    seq = F.size("token_ids") - 1
    width = F.max(seq).over(W.partitionBy("batch"))
    staged = df.withColumns({"__seq": seq, "width": width})
    pad = F.col("width") - F.col("__seq")
    hidden = F.least(F.greatest(F.col("prompt_len") - 1, F.lit(0)), F.col("__seq"))
    n = F.greatest(F.col("__seq"), F.lit(0))
    inputs = F.concat(F.array_repeat(F.lit(pad_id), pad), F.slice("token_ids", F.lit(1), n))
    mask = F.concat(F.array_repeat(F.lit(False), pad), F.array_repeat(F.lit(True), n))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_LABEL), pad + hidden),
        F.slice("token_ids", hidden + 2, F.greatest(n - hidden, F.lit(0))),
    )
    supervised = F.greatest(F.size("token_ids") - F.col("prompt_len"), F.lit(0))
    return staged.withColumns(
        {"input_ids": inputs, "attn_mask": mask, "labels": labels, "supervised": supervised}
    ).drop("__seq")


def chat_prompts(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_part: int | None = None,
) -> DataFrame:
    """Turns in order with role markup, ended by an open assistant turn.

    One conversation is one prompt, part 0. Asked for with ``turns_per_part``, longer ones
    come as several parts in order; put together they are the whole prompt.
    """
    part = F.lit(0).cast("long")
    if turns_per_part is not None:
        part = F.floor(F.col(turn) / turns_per_part).cast("long")
    line = F.concat(
        F.lit(TURN_OPEN), F.col(role), F.lit("\n"), F.col(text), F.lit(TURN_CLOSE + "\n")
    )
    cut = turns.select(conversation, part.alias("part"), F.col(turn).alias("__t"), line.alias("__l"))
    ordered = F.array_sort(F.collect_list(F.struct("__t", "__l")))
    pieces = cut.groupBy(conversation, "part").agg(
        F.array_join(F.transform(ordered, lambda x: x["__l"]), "").alias("prompt")
    )
    ended = with_group_stats(pieces, [conversation], {"__last": F.max("part")})
    tail = F.when(F.col("part") == F.col("__last"), f"{TURN_OPEN}assistant\n").otherwise("")
    return ended.withColumn("prompt", F.concat("prompt", tail)).drop("__last")


def repaired_history(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Blank turns dropped, message types mapped to user and assistant."""
    mapped = F.when(F.col(role).isin("user", "user_message"), "user").otherwise("assistant")
    return turns.where(~is_blank(F.col(text))).withColumn(role, mapped)


def generation_cost(
    df: DataFrame, prompt_col: str, reply: str, price_in: float, price_out: float
) -> DataFrame:
    """Token averages and the price of a run; prices are per million tokens."""
    asked, made = token_count(prompt_col), token_count(reply)
    return df.agg(
        F.count("*").alias("examples"),
        F.avg(asked).alias("avg_in"),
        F.avg(made).alias("avg_out"),
        ((F.sum(asked) * price_in + F.sum(made) * price_out) / 1e6).alias("cost"),
    )
