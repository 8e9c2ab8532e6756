"""Scores of terms by category: TF-IDF means and discriminative shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relational import top_per_group
from plumbline.session import materialize


def _counted(df: DataFrame, doc: str, category: str, terms: str) -> DataFrame:
    return df.select(doc, category, F.explode(terms).alias("term")).groupBy(doc, category, "term").agg(F.count("*").alias("tf"))


def tfidf_means(df: DataFrame, doc: str, category: str, terms: str, min_docs: int = 1) -> DataFrame:
    """category, term, score: mean over the category's documents of TF-IDF with smooth idf and rows of unit length.

    ``df``: one row per document with an array of terms. Terms in fewer than
    ``min_docs`` documents are left out. Documents without category count for
    idf only.
    """
    tf = materialize(_counted(df, doc, category, terms), "tf")
    return _means(df, tf, doc, category, min_docs)


def _means(df: DataFrame, tf: DataFrame, doc: str, category: str, min_docs: int) -> DataFrame:
    total = df.agg(F.count("*").alias("n")).first()["n"]
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_docs)
    idf = idf.select("term", (F.ln((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select(doc, category, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    size = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("n"))  # one row per category
    sums = weighted.join(length, doc).groupBy(category, "term").agg(F.sum(F.col("w") / F.col("l")).alias("s"))
    return sums.join(size, category).select(category, "term", (F.col("s") / F.col("n")).alias("score"))


def discriminative(df: DataFrame, doc: str, category: str, terms: str, min_docs: int = 1, least: float = 0.6, top: int = 20) -> DataFrame:
    """Terms whose frequency and TF-IDF lie mostly in one category: half the share of each, above ``least``, the ``top`` per category.

    The other categories enter by their mean.
    """
    tf = materialize(_counted(df, doc, category, terms), "tf")
    scores = _means(df, tf, doc, category, min_docs)
    freq = tf.filter(F.col(category).isNotNull()).groupBy(category, "term").agg(F.sum("tf").alias("frequency"))
    both = scores.join(freq, [category, "term"])
    others = both.groupBy("term").agg(F.sum("frequency").alias("all_f"), F.sum("score").alias("all_s"))
    k = max(df.filter(F.col(category).isNotNull()).select(category).distinct().count() - 1, 1)

    def share(own, everyone):
        own, everyone = F.col(own), F.col(everyone)
        return own / (own + (everyone - own) / k)

    told = both.join(others, "term").withColumn("mark", F.lit(0.5) * share("frequency", "all_f") + F.lit(0.5) * share("score", "all_s"))
    told = told.filter(F.col("mark") > least).select(category, "term", F.round("mark", 9).alias("score"), "frequency")
    return top_per_group(told, [category], [F.desc("score"), F.desc("frequency"), F.asc("term")], top).select(category, "term", "score", "frequency")
