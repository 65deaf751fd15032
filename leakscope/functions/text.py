"""Text expressions: answer extraction, masks, labels and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wording and answer patterns that results depend on.
BOXED = r"\\boxed\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
STEP_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed"
SYSTEM_TEXT = "You are a helpful assistant."
STEP_LEAD = " Let's think step by step.\nA:"
SHOT_CLOSING = "\nThe final answer is \\boxed{"
ZERO_SHOT_TEMPLATE = (
    "\nI have a math probelm. Please provide your answer to that problem in the following format:\n"
    "1. Present the detailed calculations and reasoning in line with the problem. Think step by step.\n"
    "2. Conclude with the final answer preceded by '####'. For example: The final answer is #### 56.\n"
    "Here is the problem:\n{question}"
)


def boxed_items(text: Column) -> Column:
    """Contents of every boxed answer; one level of inner braces is allowed."""
    return F.regexp_extract_all(text, F.lit(BOXED), F.lit(1))


def mask_symbols(values: Column) -> Column:
    return F.transform(values, lambda s: F.regexp_replace(s, "[^A-Za-z0-9]", "*"))


def model_name(model_id: Column) -> Column:
    return F.element_at(F.split(model_id, "/"), -1)


def method_label(method: Column, parameters: Column) -> Column:
    """``method_k1=v1_k2=v2`` with sorted keys; a null value prints as None."""
    parts = F.transform(
        F.array_sort(F.map_entries(parameters)),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
    )
    return F.when(
        F.coalesce(F.size(parts), F.lit(0)) > 0,
        F.concat_ws("_", method, F.array_join(parts, "_")),
    ).otherwise(method)


def plus_minus(mean: Column, deviation: Column) -> Column:
    return F.concat_ws(
        " ± ",
        F.coalesce(mean.cast("string"), F.lit("nan")),
        F.coalesce(deviation.cast("string"), F.lit("nan")),
    )


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")


def theta_text(values: Column) -> Column:
    return F.to_json(values)


def theta_from_text(text: Column) -> Column:
    """One threshold or a pair, as an array of doubles."""
    many = F.from_json(text, "array<double>")
    one = F.array(text.try_cast("double"))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), many).otherwise(one)


def detector_text(problem: Column, solution: Column, mode: str = "joined") -> Column:
    """Text a detector scores: the problem alone, or followed by the solution."""
    if mode == "problem":
        return problem
    if mode == "joined":
        return F.concat(problem, F.coalesce(solution, F.lit("")))
    if mode == "spaced":
        return F.concat_ws(" ", problem, solution)
    raise ValueError(f"unknown text mode: {mode}")


def format_shot(answer: Column, extracted: Column) -> Column:
    """Worked answer, closed by the boxed result when one is known."""
    closing = F.concat(answer, F.lit(SHOT_CLOSING), extracted, F.lit("}."))
    return F.when(F.length(extracted) > 0, closing).otherwise(answer)


def fill_template(template: str, question: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{question}"), question)


def prompt_plain(shots: Column, question: Column) -> Column:
    """Question/answer blocks parted by blank lines; ``shots`` holds (q, a) structs."""
    lead = F.lit(STEP_LEAD)
    solved = F.transform(
        shots, lambda s: F.concat(F.lit("Q: "), s["q"], lead, F.lit(" "), s["a"])
    )
    return F.array_join(
        F.concat(solved, F.array(F.concat(F.lit("Q: "), question, lead))), "\n\n"
    )


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_chat(
    shots: Column, question: Column, system: str | None = None, suffix: str = STEP_SUFFIX
) -> Column:
    """Chat turns as an array of (role, content)."""
    tail = F.lit(suffix)
    worked = F.flatten(
        F.transform(
            shots,
            lambda s: F.array(
                _turn("user", F.concat(s["q"], tail)), _turn("assistant", s["a"])
            ),
        )
    )
    final = F.array(_turn("user", F.concat(question, tail)))
    if system is None:
        return F.concat(worked, final)
    return F.concat(F.array(_turn("system", F.lit(system))), worked, final)


def build_prompt(model: Column, shots: Column, question: Column) -> Column:
    """Prompt by model family: plain text, chat, or chat with a system turn.

    Always an array of turns; the plain text form is one turn without a role.
    """
    lowered = F.lower(model)
    plain = F.array(
        F.struct(
            F.lit(None).cast("string").alias("role"),
            prompt_plain(shots, question).alias("content"),
        )
    )
    return (
        F.when(F.contains(lowered, F.lit("llemma")), plain)
        .when(F.contains(lowered, F.lit("deepseek")), prompt_chat(shots, question))
        .otherwise(prompt_chat(shots, question, SYSTEM_TEXT))
    )
