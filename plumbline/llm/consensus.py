"""Problem 4: consensus, agreement and reliability from labels of several annotators.

Labels are centred by each annotator's own rate, so that the mean product of
two annotators' labels on shared items is their agreement beyond chance. For
annotators who err independently that matrix is of rank one off its diagonal,
and its leading eigenvector is their reliability. Power iteration finds it
without forming the matrix: one aggregate of the votes by item and one by
annotator give, for each annotator, the agreement with all others on shared
items and the weight of that overlap, by which it is divided. The vector
yields each annotator's sensitivity and specificity, hence the weight of a
vote; only the share of items of label 1 is settled against the weighted
consensus, one number. Raters whose errors are related (several models of one
kind) enter together: the weight of their joint pattern of votes is counted
against the consensus of the independent annotators.

Totals of a few raters have their agreement matrix formed in one aggregate: the
leading eigenvector of their logs weighs the others of a record to the total
expected of each.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, release

#: How a vote may be typed (after trimming, in lower case).
YES = ("1", "y", "yes", "true")
NO = ("0", "n", "no", "false")

BROADCAST_ROWS = 500_000
UNRELIABLE_BELOW = 0.15
MOST_ROUNDS = 500  # a vector or share that has not settled by then is an error
TOLERANCE = 1e-4
CLIP = 0.01


def vote(label: Column) -> Column:
    """1, 0, or null where the label is no vote."""
    word = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    return F.when(word.isin(*YES), 1.0).when(word.isin(*NO), 0.0)


def last_votes(labels: DataFrame, item: str, annotator: str, label: str, when: list[str]) -> DataFrame:
    """(item, annotator, y): each annotator's last label of an item, where that is a vote.

    Ties of time go to the label greater by the remaining columns, so repeated
    rows change nothing. Rows without item or annotator are left out.
    """
    known = labels.filter(F.col(item).isNotNull() & F.col(annotator).isNotNull())
    order = F.struct(*when, label)
    last = known.groupBy(F.col(item).alias("item"), F.col(annotator).cast("string").alias("annotator")).agg(
        F.max_by(F.coalesce(F.col(label), F.lit("")), order).alias("label")
    )
    return last.select("item", "annotator", vote(F.col("label")).alias("y")).filter("y is not null")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _clip(value: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), value))


def reliability(votes: DataFrame) -> tuple[DataFrame, int]:
    """(annotator, votes, rate, u) and their number: u is the scaled leading eigenvector, u_i u_j the expected agreement beyond chance."""
    stats = materialize(votes.groupBy("annotator").agg(F.count("*").alias("votes"), F.avg("y").alias("rate")), "raters")
    annotators = stats.count()
    centred = votes.join(_small(stats, annotators), "annotator").select("item", "annotator", (F.col("y") - F.col("rate")).alias("x"))
    centred = materialize(centred, "centred")
    vector = stats.select("annotator", F.lit(1.0).alias("u"))
    held = None
    for turn in range(MOST_ROUNDS + 1):
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"the eigenvector did not settle within {MOST_ROUNDS} rounds")
        weighted = centred.join(_small(vector, annotators), "annotator")
        items = weighted.groupBy("item").agg(F.sum(F.col("x") * F.col("u")).alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))
        sums = weighted.join(items, "item").groupBy("annotator").agg(
            F.first("u").alias("before"),
            F.sum(F.col("x") * (F.col("s") - F.col("x") * F.col("u"))).alias("shared"),
            F.sum(F.col("q") - F.col("u") * F.col("u")).alias("overlap"),
        )
        step = materialize(
            sums.select("annotator", "before", F.coalesce(F.try_divide("shared", "overlap"), F.lit(0.0)).alias("raw"), "shared", "overlap"), "power"
        )
        if held is not None:
            release(held)
        held = step
        # the best scale of the old vector, and of the new one relative to it
        row = step.agg(
            F.sum(F.col("before") * F.col("shared")).alias("top"),
            F.sum(F.col("before") * F.col("before") * F.col("overlap")).alias("bottom"),
            F.sum(F.col("raw") * F.col("raw")).alias("rr"),
            F.sum(F.col("before") * F.col("before")).alias("bb"),
            F.sum(F.col("raw") * F.col("before")).alias("rb"),
        ).first()
        if not row["rr"] or not row["bottom"]:
            vector = step.select("annotator", F.lit(0.0).alias("u"))
            break
        length = math.sqrt(max(row["top"], 0.0) / row["bottom"] * row["bb"])
        vector = step.select("annotator", (F.col("raw") * F.lit((length or math.sqrt(row["rr"])) / math.sqrt(row["rr"]))).alias("u"))
        cosine = row["rb"] / math.sqrt(row["rr"] * row["bb"])
        if 1 - abs(cosine) < TOLERANCE**2 / 2:
            break
    joined = stats.join(_small(vector, annotators), "annotator")
    side = joined.agg(F.sum(F.col("u") * F.col("votes")).alias("s")).first()["s"]
    if side is not None and side < 0:
        joined = joined.withColumn("u", -F.col("u"))
    return materialize(joined, "vector"), annotators


def weigh(votes: DataFrame, raters: DataFrame, annotators: int, prior: float) -> DataFrame:
    """(item, score): log odds of each item by its votes, weighted by the raters' sens and fpr."""
    weights = raters.select(
        "annotator",
        F.ln(_clip(F.col("sens")) / _clip(F.col("fpr"))).alias("for_yes"),
        F.ln((1 - _clip(F.col("sens"))) / (1 - _clip(F.col("fpr")))).alias("for_no"),
    )
    voted = votes.join(_small(weights, annotators), "annotator")
    weight = F.when(F.col("y") == 1, F.col("for_yes")).otherwise(F.col("for_no"))
    return voted.groupBy("item").agg((F.sum(weight) + F.lit(math.log(prior / (1 - prior)))).alias("score"))


def _share(mean: float | None) -> float:
    return min(max(mean if mean is not None else 0.5, 0.02), 0.98)


def rates(vector: DataFrame, prior: float) -> DataFrame:
    """annotator, votes, rate, sens, fpr of every annotator, from the vector: their gap is u over the deviation of the true label."""
    gap = F.col("u") / F.lit(math.sqrt(prior * (1 - prior)))
    return vector.select("annotator", "votes", "rate", (F.col("rate") + (1 - F.lit(prior)) * gap).alias("sens"), (F.col("rate") - F.lit(prior) * gap).alias("fpr"))


def _p(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def consensus(votes: DataFrame, items: DataFrame | None = None, related: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    ``votes``: item, annotator, y (0 or 1), one row per item and annotator.
    ``items``: further items, with the columns ``related`` (0, 1 or null) of
    raters whose errors are related.

    items: item, p (of the label 1), verdict (1 where p is at least a half),
    votes, agreement (share of its votes that equal the verdict; null without
    votes). annotators: annotator, votes, rate, sens, fpr, informed (sens -
    fpr: 1 for a perfect annotator, 0 for one whose votes say nothing, below
    for one who says the opposite).

    An item without votes has the prior, or what the related raters say. With
    one annotator there is no agreement to learn from: informed is 0. Empty
    tables give empty results.
    """
    vector, annotators = reliability(votes)
    row = votes.agg(F.avg("y").alias("rate")).first()
    prior = _share(row["rate"])
    for turn in range(MOST_ROUNDS + 1):  # the share of the label 1: that at which the weighted consensus has it
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"the share of the label did not settle within {MOST_ROUNDS} rounds")
        raters = rates(vector, prior)
        mean = weigh(votes, raters, annotators, prior).agg(F.avg(_p(F.col("score"))).alias("p")).first()["p"]
        moved, prior = abs(_share(mean) - prior), _share(mean)
        if moved < TOLERANCE * 10:
            break
    raters = rates(vector, prior)
    scored = weigh(votes, raters, annotators, prior)
    base = math.log(prior / (1 - prior))
    if items is not None:
        pattern = F.concat_ws("", *[F.coalesce(F.col(c).cast("int").cast("string"), F.lit("_")) for c in related or []])
        every = items.select("item", pattern.alias("pattern")).dropDuplicates(["item"])
        both = materialize(every.join(scored, "item", "left").select("item", "pattern", F.col("score").isNotNull().alias("voted"), F.coalesce("score", F.lit(base)).alias("score")), "both")
        with_votes = both.filter("voted")
        # at most 3 ** len(related) patterns
        table = with_votes.groupBy("pattern").agg(F.sum(_p(F.col("score"))).alias("yes"), F.sum(1 - _p(F.col("score"))).alias("no"))
        gain = F.ln((F.col("yes") + 5 * prior) / (F.col("no") + 5 * (1 - prior))) - F.lit(base)
        table = table.select("pattern", gain.alias("gain"))
        scored = both.join(_small(table, 3 ** len(related or [])), "pattern", "left").select(
            "item", (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score")
        )
    cast = votes.groupBy("item").agg(F.count("*").alias("votes"), F.avg("y").alias("share"))
    verdict = (F.col("score") >= 0).cast("int")
    told = scored.join(cast, "item", "left").select(
        "item",
        _p(F.col("score")).alias("p"),
        verdict.alias("verdict"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        F.when(verdict == 1, F.col("share")).otherwise(1 - F.col("share")).alias("agreement"),
    )
    return told, raters.withColumn("informed", F.col("sens") - F.col("fpr"))


TOTALS = ("claude_total_accepted", "gpt5_total_accepted", "gemini_total_accepted")


def leading_vector(matrix: np.ndarray) -> np.ndarray:
    """The leading eigenvector of a small agreement matrix by power iteration, of sum 1 and without negative parts; equal parts where nothing agrees."""
    size = len(matrix)
    vector = np.full(size, 1 / size)
    for _ in range(MOST_ROUNDS):
        new = np.maximum(matrix @ vector, 0.0)
        if not new.sum() > 0:
            return np.full(size, 1 / size)
        new /= new.sum()
        if abs(new - vector).max() < 1e-9:
            return new
        vector = new
    raise RuntimeError(f"the eigenvector did not settle within {MOST_ROUNDS} rounds")


def expected_totals(companies: DataFrame, totals: tuple[str, ...] = TOTALS) -> DataFrame:
    """(company_id, total, value, weight, expected, residual, low, high) of companies whose totals are all present.

    The totals' logs, centred by their column's mean, have their products
    averaged over the companies; that matrix without its diagonal has the
    totals' reliability as its leading eigenvector. ``expected`` is the mean of
    the other totals' logs by these weights, ``residual`` the log over it;
    ``low`` and ``high`` bound the others. A total of 0 has no log: it is left
    out of the matrix, and its residual is minus infinity. Companies with
    another total of 0 or less give no row for this one, those without id or
    with a null or NaN total none at all. Repeated rows count once.
    """
    rows = companies.select("company_id", *[F.col(c).cast("double").alias(c) for c in totals]).filter("company_id is not null").distinct()
    for c in totals:
        rows = rows.filter(F.col(c).isNotNull() & ~F.isnan(c))
    logs = {c: F.ln(F.when(F.col(c) > 0, F.col(c))) for c in totals}
    pairs = [(i, j) for i in range(len(totals)) for j in range(i + 1, len(totals))]
    told = rows.agg(*[F.covar_pop(logs[totals[i]], logs[totals[j]]).alias(f"c{i}_{j}") for i, j in pairs]).first()  # one number per pair of totals
    matrix = np.zeros((len(totals), len(totals)))
    for i, j in pairs:
        value = told[f"c{i}_{j}"]
        matrix[i, j] = matrix[j, i] = value if value is not None and math.isfinite(value) else 0.0
    # any convex weights keep the expected total between the others; a floor keeps each of them in it
    weights = np.maximum(leading_vector(matrix), 1e-3)
    out = []
    for i, name in enumerate(totals):
        others = [j for j in range(len(totals)) if j != i]
        mass = sum(weights[j] for j in others)
        expected = sum((F.lit(float(weights[j] / mass)) * logs[totals[j]] for j in others), F.lit(0.0))
        residual = F.when(F.col(name) > 0, F.ln(F.when(F.col(name) > 0, F.col(name))) - expected).otherwise(F.lit(float("-inf")))
        own = [F.col(totals[j]) for j in others]
        entry = F.struct(
            F.lit(name).alias("total"), F.col(name).alias("value"), F.lit(float(weights[i])).alias("weight"), F.exp(expected).alias("expected"), residual.alias("residual"),
            F.least(*own).alias("low"), F.greatest(*own).alias("high"),
        )
        out.append(entry)
    return rows.select("company_id", F.explode(F.array(*out)).alias("t")).select("company_id", "t.*").filter("low > 0")


def totals_apart(companies: DataFrame, totals: tuple[str, ...] = TOTALS, near: float = 1.5, far: float = 4.0) -> DataFrame:
    """(company_id, total): totals whose residual against the weighted others reaches ``far``.

    Checked exactly after that: the others agree within ``near``, and the total
    is ``far`` times above the larger or below the smaller of them. As the
    expected total lies between the others, the first step loses none of these.
    """
    told = expected_totals(companies, totals).filter(F.abs("residual") >= math.log(far) - 1e-9)
    apart = (F.col("value") >= far * F.col("high")) | (F.col("value") <= F.col("low") / far)
    return told.filter((F.col("high") <= near * F.col("low")) & apart).select("company_id", "total").distinct()


RELATED = [
    "llm_gemini_2_5_flash",
    "llm_sonnet_4",
    "llm_gpt_5_mini",
    "filter_broad_yes",
    "filter_strict_no",
    "filter_broad_yes_strict_no",
]


def cv_consensus(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cvs = spark.read.parquet(f"{sf_dir}/validation_cvs.parquet").filter("cv_id is not null")
    cvs = cvs.groupBy("cv_id").agg(*[F.max(c).alias(c) for c in ["category", *RELATED]])
    labels = spark.read.parquet(f"{sf_dir}/cv_annotations.parquet")
    votes = last_votes(labels, "cv_id", "annotator_id", "label", ["labelled_at", "received_at", "annotation_id"])
    rater = cvs.filter("category in (0, 1)").select(F.col("cv_id").alias("item"), F.lit("category").alias("annotator"), F.col("category").cast("double").alias("y"))
    votes = materialize(votes.unionByName(rater), "votes")
    return consensus(votes, cvs.withColumnRenamed("cv_id", "item"), RELATED)


def p4_found(spark, sf_dir: str) -> DataFrame:
    items, raters = cv_consensus(spark, sf_dir)
    cvs = spark.read.parquet(f"{sf_dir}/validation_cvs.parquet").select(F.col("cv_id").alias("item"))
    item = items.join(cvs, "item", "left_semi").select(
        F.lit("item").alias("kind"), F.col("item").cast("string").alias("case_key"), F.col("verdict").cast("string").alias("verdict")
    )
    poor = raters.filter(F.col("informed") < UNRELIABLE_BELOW).filter("annotator <> 'category'")
    poor = poor.select(F.lit("annotator").alias("kind"), F.col("annotator").alias("case_key"), F.lit("unreliable").alias("verdict"))
    companies = spark.read.parquet(f"{sf_dir}/log_debias_company_aggregates.parquet")
    apart = totals_apart(companies).select(F.lit("company").alias("kind"), F.col("company_id").alias("case_key"), F.col("total").alias("verdict"))
    return item.unionByName(poor).unionByName(apart)


def p4_items(spark, sf_dir: str) -> DataFrame:
    """Consensus, confidence and agreement of every validation CV."""
    return cv_consensus(spark, sf_dir)[0].withColumnRenamed("item", "cv_id")


def p4_annotators(spark, sf_dir: str) -> DataFrame:
    """Reliability of every annotator; the CVs' own category counts as one more."""
    return cv_consensus(spark, sf_dir)[1]


def p4_totals(spark, sf_dir: str) -> DataFrame:
    """Totals of a company that stand apart from the two others."""
    return totals_apart(spark.read.parquet(f"{sf_dir}/log_debias_company_aggregates.parquet"))
