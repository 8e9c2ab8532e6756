"""Writers by format, and the JSON shapes other tools expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, kind: str, mode: str = "overwrite") -> None:
    """Write as csv, tsv, json (lines), parquet or orc; an unknown kind is an error."""
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "parquet", "orc"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind of output: {kind}")


def append_metrics(df: DataFrame, path: str) -> None:
    save(df, path, "csv", "append")


def split_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Comma-separated texts as arrays of trimmed, non-empty parts."""
    return df.withColumns({c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "") for c in columns})


def as_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_json_array(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A small table as one text, a JSON array of its rows; more than ``most`` rows are an error, as one task holds them all."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one JSON text; write lines instead")
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))


def samples_long(df: DataFrame, key: str, samples: str) -> DataFrame:
    """Ragged arrays of samples as rows (key, sample, value), the form in which distributions are kept."""
    return df.select(key, F.posexplode(samples).alias("sample", "value"))


def samples_wide(df: DataFrame, key: str, length: int) -> DataFrame:
    """Back to arrays in the order of their samples, padded with null to ``length``."""
    arrays = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda s: s["value"]).alias("v"))
    pad = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(length) - F.size("v")))
    return arrays.select(key, F.concat(F.col("v").cast("array<double>"), pad).alias("samples"))
