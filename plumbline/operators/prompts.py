"""Texts for and answers from a reviewing model: profile formatting, batches of prompts, answers brought to the batch's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import batches


def short(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def profile_prompt(about: Column, headline: Column, experience: Column, education: Column, about_chars: int = 300, entry_chars: int = 200) -> Column:
    """Labelled lines of a profile; entries shortened and joined by '; ', empty sections left out."""

    def entries(rows: Column, fields: list[str]) -> Column:
        lines = F.transform(rows, lambda e: short(F.concat_ws(", ", *[F.nullif(e[f], F.lit("")) for f in fields]), entry_chars))
        return F.nullif(F.array_join(F.filter(lines, lambda x: x != ""), "; "), F.lit(""))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit("")))

    return F.concat_ws(
        "\n", line("Headline", headline), line("About", short(about, about_chars)), line("Experience", entries(experience, ["title", "company", "description"])), line("Education", entries(education, ["degree", "field", "description"]))
    )


def batch_prompts(df: DataFrame, order: str, key: str, text: str, size: int, preamble: str) -> DataFrame:
    """(batch, prompt, ids): every ``size`` rows as one prompt after the preamble, rows numbered by their id."""
    rows = df.select(order, F.struct(F.col(key).alias("id"), F.col(text).alias("text")).alias("row"))
    packed = batches(rows, order, size, "row")
    bodies = F.array_join(F.transform("items", lambda r: F.concat(F.lit("["), r["id"].cast("string"), F.lit("]\n"), F.coalesce(r["text"], F.lit("")))), "\n\n")
    return packed.select("batch", F.concat(F.lit(preamble + "\n\n"), bodies).alias("prompt"), F.transform("items", lambda r: r["id"]).alias("ids"))


def settle_answers(df: DataFrame, answers: str, size: str, missing: str = "RETRY_FAILED") -> DataFrame:
    """Answers cut or padded to the batch's size, and whether their number was right."""
    pad = F.array_repeat(F.lit(missing), F.col(size))
    settled = F.slice(F.concat(F.coalesce(F.col(answers), F.array().cast("array<string>")), pad), 1, F.col(size))
    return df.withColumn("complete", F.coalesce(F.size(answers) == F.col(size), F.lit(False))).withColumn(answers, settled)
