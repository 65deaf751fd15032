"""Prompt building and answer records."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.text import build_prompt, format_shot, prompt_plain
from leakscope.operators.ordering import join_null_safe, top_k
from leakscope.session import fits_broadcast


def add_shots(
    df: DataFrame, n: int, order: str, by: str = "CATEGORY", key: str = "ID", donors: str = "true"
) -> DataFrame:
    """Adds ``shots`` (array of q, a) and ``shot_ids``; both are empty for n = 0.

    The first n rows of a category are the shots of all others; those first n
    get the last n instead. Rows are ordered by ``order``, then by ``key``; a
    null category is one of its own. Only rows where ``donors`` holds serve as
    shots. Only 2n rows per category are gathered.
    """
    if n == 0:
        return df.withColumns(
            {
                "shots": F.array().cast("array<struct<q:string,a:string>>"),
                "shot_ids": F.array().cast("array<string>"),
            }
        )
    place = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    shot = F.struct(
        place.alias("p"),
        F.col("PROBLEM").alias("q"),
        format_shot(F.col("SOLUTION"), F.coalesce("EXTRACTED_ANSWER", F.lit(""))).alias("a"),
        F.col(key).cast("string").alias("id"),
    )
    slim = df.where(donors).select(by, F.col(order).alias("_o"), F.col(key).alias("_k"), shot.alias("s"))

    def gather(direction: Callable[[str], Column], name: str) -> DataFrame:
        chosen = top_k(slim, [by], [direction("_o"), direction("_k")], n)
        return chosen.groupBy(by).agg(F.array_sort(F.collect_list("s")).alias(name))

    picks = join_null_safe(gather(F.asc, "_head"), gather(F.desc, "_tail"), [by])
    joined = join_null_safe(df, F.broadcast(picks) if fits_broadcast(picks) else picks, [by], "left")
    enough = F.when(
        F.coalesce(F.size("_head"), F.lit(0)) < n,
        F.raise_error(F.lit(f"fewer than {n} rows in a category")),
    ).otherwise(
        F.when(F.exists("_head", lambda s: s["p"].eqNullSafe(place)), F.col("_tail")).otherwise(F.col("_head"))
    )
    return joined.withColumn("_use", enough).select(
        *df.columns,
        F.transform("_use", lambda s: F.struct(s["q"].alias("q"), s["a"].alias("a"))).alias("shots"),
        F.transform("_use", lambda s: s["id"]).alias("shot_ids"),
    )


def add_prompts(
    df: DataFrame, n: int, model: str, order: str, by: str = "CATEGORY", donors: str = "true"
) -> DataFrame:
    """Adds ``formatted_prompt`` for the model family and ``shot_ids``."""
    return (
        add_shots(df, n, order, by, donors=donors)
        .withColumn("formatted_prompt", build_prompt(F.lit(model), F.col("shots"), F.col("PROBLEM")))
        .drop("shots")
    )


def add_plain_prompts(
    df: DataFrame, n: int, order: str, by: str = "CATEGORY", donors: str = "true"
) -> DataFrame:
    return (
        add_shots(df, n, order, by, donors=donors)
        .withColumn("formatted_prompt", prompt_plain(F.col("shots"), F.col("PROBLEM")))
        .drop("shots")
    )


def answer_record(df: DataFrame, prompt: str, response: str) -> DataFrame:
    """One answer per row in the shape of the run output."""
    return df.select(
        "ID",
        "PROBLEM",
        "CATEGORY",
        "LABEL",
        F.col(prompt).cast("string").alias("PROMPT"),
        F.col("EXTRACTED_ANSWER").alias("SOLUTION_KEY"),
        F.col("SOLUTION").alias("SOLUTION_TEXT"),
        F.col(response).alias("LLM_RESPONSE"),
        F.struct(
            F.col("start_time").cast("string").alias("start_time"),
            F.col("end_time").cast("string").alias("end_time"),
        ).alias("attributes"),
    )


def run_metadata(experiment: str, description: str, info: Mapping[str, str]) -> Column:
    pairs = [F.lit(v) for kv in info.items() for v in kv]
    extra = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array(), F.array())
    return F.struct(
        F.lit(experiment).alias("experiment_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(description).alias("description"),
        extra.cast("map<string,string>").alias("additional_info"),
    )
