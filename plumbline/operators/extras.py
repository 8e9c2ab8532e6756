"""Smaller operators: titles, weighted keyword classes, clusters, robust regression, group tests, loose name lookup."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.relational import first_wins


def keyword_classes(df: DataFrame, key: str, terms: str, weights: DataFrame, least: int = 3) -> DataFrame:
    """(key, category, confidence, matches): the category of the largest summed weight of the matched keywords.

    ``terms``: an array of the row's terms. Rows with fewer than ``least``
    matches have no category.
    """
    hits = df.select(key, F.explode(F.array_distinct(terms)).alias("keyword")).join(weights, "keyword")
    sums = hits.groupBy(key, "category").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    best = sums.groupBy(key).agg(F.max_by("category", F.struct("s", "category")).alias("category"), (F.max("s") / F.sum("s")).alias("confidence"), F.sum("n").alias("matches"))
    told = df.select(key).join(best, key, "left")
    enough = F.coalesce(F.col("matches") >= least, F.lit(False))
    return told.select(key, F.when(enough, F.col("category")).alias("category"), F.when(enough, F.col("confidence")).otherwise(0.0).alias("confidence"), F.coalesce("matches", F.lit(0)).alias("matches"))


def clusters(df: DataFrame, key: str, vector: str, k: int, score: str, seed: int = 1) -> DataFrame:
    """(cluster, members, average, representative): k-means on vectors; the representative has the highest score."""
    data = df.select(key, score, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    told = model.transform(data)
    return told.groupBy("cluster").agg(F.count("*").alias("members"), F.avg(score).alias("average"), F.max_by(key, F.struct(score, key)).alias("representative"))


def theil_sen(df: DataFrame, x: str, y: str, partners: int = 32, seed: int = 3) -> tuple[float | None, float | None]:
    """(slope, intercept) of the median slope over random pairs of rows: each row meets the row next to it in ``partners`` hash orders.

    An estimate of the median over all pairs: every row takes part in about
    twice ``partners`` pairs at any size, so work grows with the rows, not
    their square. On a few thousand rows it lies within a hundredth of the
    median over all pairs (test).
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop().withColumn("id", F.monotonically_increasing_id())
    n = rows.count()
    if n < 2:
        return None, None
    ordered = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(partners)))).withColumn("h", F.xxhash64("id", "round", F.lit(seed)))
    buckets = max(1, n // 1000)
    from pyspark.sql import Window

    w = Window.partitionBy("round", F.pmod("h", F.lit(buckets))).orderBy("h")
    slopes = ordered.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).filter("px is not null and x <> px")
    slope = exact_quantiles(slopes.select(((F.col("y") - F.col("py")) / (F.col("x") - F.col("px"))).alias("s")), "s", [0.5])[0]
    if slope is None:
        return None, None
    return slope, exact_quantiles(rows.select((F.col("y") - slope * F.col("x")).alias("b")), "b", [0.5])[0]


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, f, eta2) of a one-way analysis of variance, from the groups' moments."""
    g = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    return t.select(
        F.col("k").alias("groups"),
        F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"),
        F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta2"),
    )


def loose_lookup(names: DataFrame, name: str, known: DataFrame, known_name: str, known_id: str, least: int = 4) -> DataFrame:
    """(name, id): the known row of the same name in letters and digits only, else the shortest that contains it.

    What contains a name holds its first ``least`` characters somewhere, so the
    second step is an equi-join on the known names' windows of that length with
    a residual; shorter names are only looked up as they are.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    a = names.select(F.col(name), norm(F.col(name)).alias("__n"))
    b = first_wins(known.select(norm(F.col(known_name)).alias("__m"), F.col(known_id)), ["__m"], [known_id])
    exact = a.join(b, F.col("__n") == F.col("__m"), "left").select(name, "__n", F.col(known_id).alias("__exact"))
    rest = exact.filter((F.col("__exact").isNull()) & (F.length("__n") >= least)).select(F.col(name).alias("__name"), "__n", F.substring("__n", 1, least).alias("__w"))
    starts = F.sequence(F.lit(1), F.length("__m") - (least - 1))
    windows = b.filter(F.length("__m") >= least).withColumn("__w", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("__m", i, F.lit(least))))))
    held = rest.join(windows, "__w").filter(F.col("__m").contains(F.col("__n")))
    first = held.groupBy("__name").agg(F.min_by(known_id, F.struct(F.length("__m"), "__m")).alias("__loose"))
    return exact.join(first, F.col(name) == F.col("__name"), "left").select(name, F.coalesce("__exact", "__loose").alias("id"))
