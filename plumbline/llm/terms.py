"""Problem 1: how often every distinct value or term occurs, and in how many records.

Each task takes its records in blocks and builds the suffix array of a block's
tokens by prefix doubling, each record closed by a mark of its own, so that no
common prefix runs from one record into the next. The ranks of the doubling
rounds give the common-prefix length of any two suffixes by binary lifting, and
with it two arrays: that of neighbours in the suffix array, and that of each
suffix and the one before it that lies in the same record. For any n, the runs
of neighbours whose common prefix is at least n are the n-grams: their length
is the number of occurrences, and taking off the within-record adjacencies of
at least n leaves the number of records. Length has no bound; all n asked for
are read from the same arrays. A record lies in one block, so both counts add
up over blocks; only one row per distinct term and block is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

RARE_BELOW = 3
COMMON_ABOVE = 0.30
BLOCK_TOKENS = 2_000_000
WORD = regex.compile(r"[\p{L}\p{N}]+")
PART_SCHEMA = "field string, n int, term string, occurrences bigint, records bigint"


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits of the text in NFC and lower case."""
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, ranks) of the suffixes of ``ids``; ``ranks[k]`` is equal for two suffixes where their first 2**k tokens are.

    Prefix doubling: a round sorts only the suffixes whose rank others share.
    ``ids`` must end in a value that occurs nowhere else.
    """
    n = len(ids)
    first = np.argsort(ids, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ids[first][1:] != ids[first][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[first] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks = [rank]
    order = first
    width = 1
    while True:
        held = rank[order]
        alone = np.ones(n, dtype=bool)  # in a class of its own, as the array is ordered by rank
        alone[1:] &= held[1:] != held[:-1]
        alone[:-1] &= held[1:] != held[:-1]
        spots = np.flatnonzero(~alone)
        if not len(spots):
            return order, ranks
        some = order[spots]
        own, after = rank[some], rank[some + width]  # a shared prefix of ``width`` tokens ends before the last mark
        by = np.lexsort((after, own))
        some, own, after = some[by], own[by], after[by]
        place = np.arange(len(some))
        new_class = np.ones(len(some), dtype=bool)
        new_class[1:] = own[1:] != own[:-1]
        new_part = new_class.copy()
        new_part[1:] |= after[1:] != after[:-1]
        start = np.maximum.accumulate(np.where(new_class, place, 0))
        part = np.maximum.accumulate(np.where(new_part, place, 0))
        rank = rank.copy()
        rank[some] = own + part - start
        order = order.copy()
        order[spots] = some
        ranks.append(rank)
        width *= 2


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes ``a`` and ``b`` (of different places), by binary lifting."""
    length = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        length += np.where(ranks[k][a + length] == ranks[k][b + length], 1 << k, 0)
    return length


def suffix_counts(records: list[list[str]], lengths: Iterable[int]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """For each n of ``lengths``: (n, terms, occurrences, records) of the block's n-grams."""
    ids: dict[str, int] = {}
    sizes = np.fromiter((len(r) for r in records), dtype=np.int64, count=len(records))
    total = int(sizes.sum())
    if not total:
        return
    flat = np.fromiter((ids.setdefault(w, len(ids)) for r in records for w in r), dtype=np.int64, count=total)
    names = np.array([*ids, None], dtype=object)[:-1]
    record = np.repeat(np.arange(len(records)), sizes)
    at = np.arange(total) + record  # a mark after each record
    tokens = np.empty(total + len(records), dtype=np.int64)
    tokens[at] = flat
    ends = np.cumsum(sizes + 1) - 1
    tokens[ends] = len(names) + np.arange(len(records))
    order, ranks = suffix_array(tokens)
    order = order[tokens[order] < len(names)]  # the marks' own suffixes sort last
    owner = np.searchsorted(ends, order)
    left = ends[owner] - order  # tokens up to the record's end
    prefix = np.zeros(len(order), dtype=np.int64)
    prefix[1:] = common_prefix(ranks, order[:-1], order[1:])
    by_record = np.argsort(owner, kind="stable")
    same = owner[by_record][1:] == owner[by_record][:-1]
    later, earlier = by_record[1:][same], by_record[:-1][same]  # neighbours within a record, in the order of the array
    shared = common_prefix(ranks, order[earlier], order[later])
    for n in lengths:
        starts = np.flatnonzero((prefix < n) & (left >= n))
        if not len(starts):
            continue
        opens = np.flatnonzero(prefix < n)
        sizes_of = np.diff(np.append(opens, len(order)))
        occurrences = sizes_of[np.searchsorted(opens, starts)]
        again = later[shared >= n]
        repeats = np.bincount(np.searchsorted(starts, again, side="right") - 1, minlength=len(starts))
        spots = order[starts]
        if n == 1:
            terms = names[tokens[spots]].tolist()
        else:
            terms = [" ".join(row) for row in names[tokens[spots[:, None] + np.arange(n)]].tolist()]
        yield n, terms, occurrences, occurrences - repeats


def _count_part(field: str, lengths: tuple[int, ...], whole_value: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(records: list[list[str]]) -> Iterator[pa.RecordBatch]:
            parts = [(0, [""], np.array([0]), np.array([len(records)])), *suffix_counts(records, lengths)]
            for n, terms, occurrences, seen in parts:
                k = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([field] * k, type=pa.string()),
                        pa.array([n] * k, type=pa.int32()),
                        pa.array(terms, type=pa.string()),
                        pa.array(occurrences, type=pa.int64()),
                        pa.array(seen, type=pa.int64()),
                    ],
                    names=["field", "n", "term", "occurrences", "records"],
                )

        records: list[list[str]] = []
        size = 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value is None or not whole_value and not value.strip():
                    continue
                record = [value] if whole_value else words(value)
                records.append(record)
                size += len(record)
                if size >= BLOCK_TOKENS:
                    yield from block(records)
                    records, size = [], 0
        if records:
            yield from block(records)

    return run


def latest(df: DataFrame, key: str, columns: list[str], newest: list[Column | str]) -> DataFrame:
    """One row per ``key``: that of the largest ``newest``, ties by the columns' own values.

    Aggregated with a map-side part, so a key with many rows is no hot spot.
    Rows whose key is null count as one record.
    """
    order = F.struct(*newest, *columns)
    best = F.max_by(F.struct(*columns), order)
    return df.groupBy(key).agg(best.alias("__best")).select(key, "__best.*")


def term_counts(
    df: DataFrame,
    fields: dict[str, str],
    lengths: Iterable[int] = (1,),
    rare_below: int = RARE_BELOW,
    common_above: float = COMMON_ABOVE,
) -> DataFrame:
    """Occurrences, records and mark of every distinct term or value.

    ``fields`` maps a column to ``"text"`` (terms: runs of letters and digits of
    the NFC lower-case text, n-grams of the ``lengths`` asked for, of any size)
    or ``"value"`` (the whole string unchanged). One row of ``df`` is one record. Result: field, n, term,
    occurrences, records, of_records (records of the field), mark ("rare":
    fewer than ``rare_below`` records, otherwise "common": more than
    ``common_above`` of the field's records, otherwise null).

    Nulls, and texts of white space only, are no records of their field; an
    empty value is a value. Long texts are taken whole. An empty table gives
    an empty result; other columns are not read.
    """
    asked = tuple(sorted(set(lengths)))
    if not asked or asked[0] < 1:
        raise ValueError("lengths of n-grams start at 1")
    parts = None
    for column, kind in fields.items():
        one = df.select(F.col(f"`{column}`").cast("string").alias("v"))
        one = one.mapInArrow(_count_part(column, asked if kind == "text" else (1,), kind == "value"), PART_SCHEMA)
        parts = one if parts is None else parts.unionAll(one)
    summed = parts.groupBy("field", "n", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )
    table = materialize(summed, "terms")
    totals = {r["field"]: r["records"] for r in table.filter("n = 0").collect()}  # one row per field
    known = [F.lit(x) for pair in totals.items() for x in pair]
    of = F.try_element_at(F.create_map(*known), F.col("field")) if known else F.lit(None).cast("bigint")
    mark = F.when(F.col("records") < rare_below, "rare").when(
        F.col("records") > F.lit(common_above) * F.col("of_records"), "common"
    )
    return table.filter("n > 0").withColumn("of_records", of).withColumn("mark", mark)


def cv_records(spark, sf_dir: str) -> DataFrame:
    cvs = spark.read.parquet(f"{sf_dir}/cv_data.parquet").select("cv_id", "cv_text", "category", "rated_at", "ingested_at")
    return latest(cvs, "cv_id", ["cv_text", "category"], ["rated_at", "ingested_at"])


def p1_found(spark, sf_dir: str) -> DataFrame:
    counts = term_counts(materialize(cv_records(spark, sf_dir), "cvs"), {"cv_text": "text", "category": "value"})
    return counts.filter("mark is not null").select("field", "term", "mark")


def p1_terms(spark, sf_dir: str) -> DataFrame:
    """Every term and value with its counts."""
    counts = term_counts(materialize(cv_records(spark, sf_dir), "cvs"), {"cv_text": "text", "category": "value"})
    return counts.select("field", "term", "occurrences", "records", "mark")


NGRAMS = (1, 2, 3, 4, 5)


def p1_ngrams(spark, sf_dir: str) -> DataFrame:
    """All n-grams of ``NGRAMS`` words of the CVs with their counts."""
    counts = term_counts(materialize(cv_records(spark, sf_dir).select("cv_text"), "cvs"), {"cv_text": "text"}, NGRAMS)
    return counts.select("n", "term", "occurrences", "records", "mark")
