"""Embedding similarity: stated queries against all rows, and all pairs for duplicates, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BLOCK = 1024


def dot(a, b):
    """Dot product of two arrays, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def top_neighbours(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 20, cosine: bool = True) -> DataFrame:
    """(query, neighbour, similarity, place): the ``k`` most similar other rows of each query row, exactly.

    ``queries`` (a stated set, such as the rows whose id is divisible by 100)
    is cut into blocks of ``QUERY_BLOCK``; every task multiplies its rows with
    one block after another and keeps ``k`` per query, so what is shuffled is
    k rows per query and task. Rows without a vector are left out; ties go to
    the smaller key.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("vec")).filter("key is not null and vec is not null and size(vec) > 0")
    asked = queries.select(F.col(key).alias("key"), F.col(vector).alias("vec")).filter("key is not null and vec is not null and size(vec) > 0")
    blocks = asked.groupBy(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK)))).alias("block")).agg(F.collect_list(F.struct("key", "vec")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                a = np.array([x["vec"] for x in entry["asked"]], dtype=np.float64)
                b = np.array([x["vec"] for x in entry["rows"]], dtype=np.float64)
                if cosine:
                    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
                    b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
                sims = a @ b.T
                keys = np.array([x["key"] for x in entry["rows"]])
                q, n, s = [], [], []
                for i, x in enumerate(entry["asked"]):
                    line = np.where(keys == x["key"], -np.inf, np.round(sims[i], 9))
                    best = np.lexsort((keys, -line))[:k]
                    best = best[np.isfinite(line[best])]
                    q += [x["key"]] * len(best)
                    n += keys[best].tolist()
                    s += line[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(s, pa.float64())], names=["query", "neighbour", "similarity"])

    per = rows.groupBy(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, rows.count() // 4096))).alias("part")).agg(F.collect_list(F.struct("key", "vec")).alias("rows"))
    found = per.crossJoin(blocks).select("asked", "rows").mapInArrow(run, f"query {kind}, neighbour {kind}, similarity double")
    from plumbline.operators.relational import top_per_group

    return top_per_group(found, ["query"], [F.desc("similarity"), F.asc("neighbour")], k)


def _near_cells(rows: DataFrame, threshold: float, cosine: bool, pairs: bool) -> DataFrame:
    """Over all pairs of the rows (key, vec), exactly: (a, b) of similar pairs with a before b, or (key, best) the smallest similar key, itself included.

    Rows are cut into blocks of about ``QUERY_BLOCK`` and every pair of blocks
    is one product of matrices, so work grows with the square of the rows and
    memory does not. Similarities are rounded to nine digits.
    """
    kind = dict(rows.dtypes)["key"]
    parts = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(1, -(-rows.count() // QUERY_BLOCK))))
    blocks = rows.groupBy(parts.alias("part")).agg(F.array_sort(F.collect_list(F.struct("key", "vec"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                entry = batch.slice(at, 1).to_pylist()[0]
                sides = []
                for side in (entry["left"], entry["right"]):
                    v = np.array([x["vec"] for x in side], dtype=np.float64)
                    sides.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if cosine else v)
                near = np.round(sides[0] @ sides[1].T, 9) >= threshold
                keys = [[x["key"] for x in entry[side]] for side in ("left", "right")]
                first, second = [], []
                if pairs:
                    for i, j in zip(*np.nonzero(near), strict=True):
                        x, y = keys[0][i], keys[1][j]
                        if x != y and (x < y or entry["i"] != entry["j"]):
                            first.append(min(x, y))
                            second.append(max(x, y))
                else:  # both sides are in order of the key, so the first hit is the smallest
                    for hit, own, other in ((near, keys[0], keys[1]), (near.T, keys[1], keys[0])):
                        some = hit.any(axis=1)
                        best = hit.argmax(axis=1)
                        first += [own[i] for i in np.flatnonzero(some)]
                        second += [other[best[i]] for i in np.flatnonzero(some)]
                yield pa.RecordBatch.from_arrays([pa.array(first, told), pa.array(second, told)], names=list(names))

    names = ("a", "b") if pairs else ("key", "best")
    told = to_arrow_type(rows.schema["key"].dataType)
    left = blocks.select(F.col("part").alias("i"), F.col("rows").alias("left"))
    right = blocks.select(F.col("part").alias("j"), F.col("rows").alias("right"))
    cells = left.join(right, F.col("i") <= F.col("j")).repartition(F.col("i"), F.col("j"))
    return cells.mapInArrow(run, f"{names[0]} {kind}, {names[1]} {kind}")


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.filter("key is not null and vec is not null and size(vec) > 0")


def near_pairs(df: DataFrame, key: str, vector: str, threshold: float, cosine: bool = True) -> DataFrame:
    """(a, b): all pairs of rows, a before b, whose cosine, or dot product, is at least ``threshold``."""
    return _near_cells(_usable(df, key, vector), threshold, cosine, True).distinct()


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = 0.95, cosine: bool = True) -> DataFrame:
    """(key, keeper): the earliest row before this one whose cosine, or dot product, is at least ``threshold``; null where there is none.

    Every pair of distinct vectors is compared exactly; equal vectors are one
    row from the start. A row's comparison is with all earlier rows, not only
    kept ones.
    """
    usable = _usable(df, key, vector)
    distinct = usable.groupBy("vec").agg(F.min("key").alias("key"))
    best = _near_cells(distinct.select("key", "vec"), threshold, cosine, False).groupBy("key").agg(F.min("best").alias("best"))
    first = distinct.join(best, "key").select("vec", "best")
    found = usable.join(first, "vec").select("key", F.when(F.col("best") < F.col("key"), F.col("best")).alias("keeper"))
    found = found.groupBy("key").agg(F.min("keeper").alias("keeper"))
    return df.select(F.col(key).alias("key")).join(found, "key", "left").select(F.col("key").alias(key), "keeper")
