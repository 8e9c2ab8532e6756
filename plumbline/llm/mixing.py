"""Problem 8: mix sources to target shares of the tokens.

A document's place in its source is the hash of its id and text. A source whose
budget holds its tokens k whole times takes every document k times; the rest of
the budget goes to the documents whose hash lies below a threshold. The
threshold comes from a histogram of tokens by source and leading hash bits: the
bucket in which the budget runs out is cut into finer buckets, and only its
rows are read again, until it holds one document. Rows alike in id and text
share a place; where the budget runs out among them, a second hash, of the row,
is refined in the same way. Nothing is sorted, thresholds of growing budgets
are nested, and the driver holds one number per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import DEFAULT_DIR, DEFAULT_NAME, count_tokens
from plumbline.session import materialize

BITS = 12
LEVELS = 5
HASH_BITS = BITS * LEVELS


def _thresholds(sized: DataFrame, rest: dict[str, int], place: str) -> tuple[dict[str, int], dict[str, int]]:
    """(found, shared): for each source the hash below which its documents' tokens stay within ``rest``.

    ``shared`` are the sources with several documents at that very hash, with
    what is left of their budget there.
    """
    spark = sized.sparkSession
    found: dict[str, int] = {}
    shared: dict[str, int] = {}
    low = {s: 0 for s in rest}  # everything below is in the mix
    left = dict(rest)
    for level in range(1, LEVELS + 1):
        if not low:
            break
        shift = HASH_BITS - BITS * level
        width = 1 << (shift + BITS)
        open_ = spark.createDataFrame([(s, low[s], low[s] + width - 1, left[s]) for s in low], "source string, __low bigint, __high bigint, __budget bigint")
        rows = sized.join(F.broadcast(open_), "source").filter(F.col(place).between(F.col("__low"), F.col("__high")))  # one row per target source
        bins = rows.groupBy("source", "__budget", F.shiftright(place, shift).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        # at most 2**BITS bins per source: the running sum is over bins, not rows
        over = bins.withColumn("upto", F.sum("tokens").over(_in_order())).filter("upto > __budget")
        edge = over.groupBy("source").agg(
            F.min_by(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("below"), "docs"), "bucket").alias("b")
        )
        cut = {r["source"]: r["b"] for r in edge.collect()}  # one row per source
        for source in list(low):
            if source not in cut:  # all of it fits
                found[source] = low.pop(source) + width
                continue
            b = cut[source]
            low[source] = b["bucket"] << shift
            left[source] -= b["below"]
            if b["docs"] == 1 or level == LEVELS:
                found[source] = low.pop(source)
                if b["docs"] > 1:
                    shared[source] = left[source]
    return found, shared


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy("bucket")


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    total_tokens: int | None = None,
    seed: int = 42,
    tokenizer_dir: str = DEFAULT_DIR,
    name: str = DEFAULT_NAME,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: ``doc_id``, source, copies, n_tokens of every document used. shares:
    per target source its target_share, available tokens and documents, the
    budget, the tokens reached, reached_share (of the mix), share_of_total (of
    the total asked for) and whether the budget is ``served``: reached but for
    less than the source's largest document.

    The total is ``total_tokens``, or the tokens of all documents of the
    targets' sources. A source's budget is its share of that total; copies per
    document differ by one at most and never exceed max_repeats. A source
    misses its budget by less than the document at the threshold, unless its
    documents at max_repeats fall short; then it gives all of them. Its
    shortfall is not passed to others.

    Documents without source or id, or of a source without target, are in no
    mix (one doc_id may hold any share of them); null and empty texts have no tokens and take no budget. Targets with
    a null or negative share or max_repeats count as 0. A source named twice
    among the targets keeps its largest share. A repeated doc_id counts once
    per row. Empty tables give an empty mix.
    """
    spark = docs.sparkSession
    wanted = (
        targets.filter("source is not null")
        .groupBy("source")
        .agg(
            F.max_by(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.coalesce("target_share", F.lit(0.0))).alias("share"),
            F.max_by(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)), F.coalesce("target_share", F.lit(0.0))).alias("cap"),
        )
        .collect()  # the targets: one row per source
    )
    share = {r["source"]: float(r["share"]) for r in wanted}
    cap = {r["source"]: int(r["cap"]) for r in wanted}
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), "source", F.col(f"`{text}`").alias("text"))
    named = named.filter(F.col("doc_id").isNotNull() & F.col("source").isin(list(share)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 64 - HASH_BITS)
    row = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), 64 - HASH_BITS)  # only rows alike in id and text are told apart by it
    sized = count_tokens(named.withColumns({"place": place, "row": row}), "text", tokenizer_dir=tokenizer_dir, name=name)
    sized = materialize(sized, "sized")
    have = {
        r["source"]: (r["tokens"], r["docs"], r["largest"])
        for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.max("n_tokens").alias("largest")).collect()
    }
    total = total_tokens if total_tokens is not None else sum(t for t, *_ in have.values())
    whole, rest = {}, {}
    for source, (tokens, *_) in have.items():
        budget = int(share[source] * total)
        whole[source] = min(budget // tokens, cap[source]) if tokens else 0
        if tokens and whole[source] < cap[source]:
            rest[source] = budget - whole[source] * tokens
    edge, shared = _thresholds(sized, {s: r for s, r in rest.items() if r > 0}, "place")
    # of the rows that share the place at the threshold, those below a second one
    at_edge = spark.createDataFrame([(s, edge[s]) for s in shared], "source string, place bigint")
    second, _ = _thresholds(sized.join(F.broadcast(at_edge), ["source", "place"]), shared, "row") if shared else ({}, {})
    taken = spark.createDataFrame(
        [(s, whole[s], edge.get(s, 0), second.get(s, 0)) for s in have], "source string, __whole bigint, __edge bigint, __second bigint"
    )
    below = (F.col("place") < F.col("__edge")) | (F.col("place") == F.col("__edge")) & (F.col("row") < F.col("__second"))
    mix = sized.join(F.broadcast(taken), "source").withColumn("copies", F.col("__whole") + below.cast("bigint")).filter("copies > 0 and n_tokens > 0")
    used = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"))
    rows = [(s, share[s], cap[s], *have.get(s, (0, 0, 0)), int(share[s] * total)) for s in share]
    plan = spark.createDataFrame(
        rows, "source string, target_share double, max_repeats bigint, available_tokens bigint, available_docs bigint, __largest bigint, budget_tokens bigint"
    )
    reached = F.coalesce("reached_tokens", F.lit(0))
    everything = F.sum(reached).over(_all_sources())
    shares = plan.join(used, "source", "left").select(
        *[c for c in plan.columns if c != "__largest"],
        reached.alias("reached_tokens"),
        F.coalesce(F.try_divide(reached, everything), F.lit(0.0)).alias("reached_share"),
        F.when(F.lit(total) > 0, reached / F.lit(float(total))).otherwise(0.0).alias("share_of_total"),
        ((reached >= F.col("budget_tokens")) | (F.col("budget_tokens") - reached < F.col("__largest"))).alias("served"),
    )
    return mix.select("doc_id", "source", "copies", "n_tokens"), shares


def _all_sources():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # over the target sources, one row each


def _tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return docs, spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p8_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(*_tables(spark, sf_dir))[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    return mix_sources(*_tables(spark, sf_dir))[1]
