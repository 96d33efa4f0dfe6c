"""Prompt columns, answer records and chat markup."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.common import col_of, strip

# fixed values: prompt texts; {name} marks a column
PROMPTS: dict[str, str] = {
    "problem": (
        "You are a helpful math assistant.\n"
        "Answer the question and write the final result on a new line as:\n"
        "\\boxed{ANSWER}\n\n"
        "Question:\n{prompt}\n\nAnswer:"
    ),
    "problem_short": (
        "You are a helpful math assistant.\n"
        "Provide a short explanation, and then write the final result on a new line as:\n"
        "\\boxed{ANSWER}\n\n"
        "Question:\n{prompt}\n\nAnswer:"
    ),
    "step_by_step": "{prompt}\n\nExplain step by step.",
    "critique": (
        "You are a meticulous reviewer. Identify logical errors, missing "
        "steps, or arithmetic mistakes. If the answer seems correct, "
        "say so briefly. Then propose a concise plan to fix issues.\n\n"
        "Question:\n{prompt}\n\n"
        "Draft answer:\n{draft}\n\n"
        "Write a short critique and bullet-point fix plan (under ~120 words).\n"
        "Critique:"
    ),
    "refine": (
        "Revise the answer using the critique. Keep it concise and "
        "end with a final boxed result: \\boxed{ANSWER}\n\n"
        "Question:\n{prompt}\n\n"
        "Previous answer:\n{draft}\n\n"
        "Critique:\n{critique}\n\n"
        "Revised answer:"
    ),
    "rubric": (
        "You are a fair judge assistant. You will be given an instruction, "
        "a reference answer, and a candidate answer to evaluate, according "
        "to the following rubric:\n\n"
        "1: The response fails to address the instruction, providing "
        "irrelevant, incorrect, or excessively verbose content.\n"
        "2: The response partially addresses the instruction but contains "
        "major errors, omissions, or irrelevant details.\n"
        "3: The response addresses the instruction to some degree but is "
        "incomplete, partially correct, or unclear in places.\n"
        "4: The response mostly adheres to the instruction, with only minor "
        "errors, omissions, or lack of clarity.\n"
        "5: The response fully adheres to the instruction, providing a "
        "clear, accurate, and relevant answer in a concise and efficient manner.\n\n"
        "Now here is the instruction, the reference answer, and the response.\n\n"
        "Instruction:\n{prompt}\n\n"
        "Reference Answer:\n{reference}\n\n"
        "Answer:\n{answer}\n\n"
        "Evaluation: "
    ),
    "four_options": (
        "{prompt}\nA. {option_a}\nB. {option_b}\nC. {option_c}\nD. {option_d}\nAnswer: "
    ),
}


def render(template: str, **columns: Column | str) -> Column:
    """Fill a prompt text with columns. Unknown names in braces stay as they are."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        elif piece in columns:
            parts.append(F.coalesce(col_of(columns[piece]).cast("string"), F.lit("")))
        else:
            parts.append(F.lit("{" + piece + "}"))
    return F.concat(*parts)


def prompt(name: str, **columns: Column | str) -> Column:
    return render(PROMPTS[name], **columns)


def boxed(answer: Column | str) -> Column:
    """Wrap a prediction in a box."""
    return F.concat(F.lit("\\boxed{"), col_of(answer).cast("string"), F.lit("}"))


def distilled_answer(thinking: Column | str, content: Column | str) -> Column:
    """Thinking in tags in front of the content; NULL when the content is blank or a side is missing."""
    body = F.nullif(strip(col_of(content)), F.lit(""))
    return F.concat(F.lit("<think>"), strip(col_of(thinking)), F.lit("</think>\n\n"), body)


def distilled_answer_plain(
    thinking: Column | str, content: Column | str, use_think_tokens: bool = False
) -> Column:
    """X25 variant: existing tags are stripped first and empty thinking is left out."""

    def clean(text: Column) -> Column:
        return strip(F.regexp_replace(strip(text), "</?think>", ""))

    body = F.when(strip(col_of(content)) != "", clean(col_of(content)))
    thought = clean(F.coalesce(col_of(thinking), F.lit("")))
    if use_think_tokens:
        return F.concat(F.lit("<think>"), thought, F.lit("</think>\n\n"), body)
    return F.when(thought != "", F.concat(thought, F.lit("\n\n"), body)).otherwise(body)


def tag_order_reward(
    text: Column | str, start: str = "<think>", end: str = "</think>"
) -> Column:
    """X12 on text: 1.0 when the first start tag stands before the first end tag."""
    body = col_of(text)
    first, last = F.locate(start, body), F.locate(end, body)
    return F.when((first > 0) & (last > 0) & (first < last), 1.0).otherwise(0.0)


def tag_order_reward_ids(
    ids: Column | str, prompt_len: Column | str, start: int = 151667, end: int = 151668
) -> Column:
    """X12 on token ids: only the part behind the prompt counts."""
    array = col_of(ids)
    made = F.slice(array, col_of(prompt_len) + 1, F.greatest(F.size(array), F.lit(1)))
    first, last = F.array_position(made, start), F.array_position(made, end)
    return F.when((first > 0) & (last > 0) & (first < last), 1.0).otherwise(0.0)
