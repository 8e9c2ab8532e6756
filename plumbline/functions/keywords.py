"""Keyword predicates over text: whole-word alternations in one pass, and the flags made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of the base filter (regular expressions).
BASE_TERMS = [r"machine[\s-]?learning", "ml", r"deep[\s-]?learning", r"reinforcement[\s-]?learning", "rl"]
#: Terms of the broad-yes filter.
BROAD_YES = (
    "augmented generation|agent reinforcement|mats scholar|mats|research scientist|evals|interpretability|feature engineering"
    "|research intern|candidate|graduate research assistant|science institute|staff research scientist|doctor"
).split("|")
#: Terms of the strict-no filter.
STRICT_NO = (
    "certificate|programmer|council|companies|capital|proven track record|pilot|money|specialist|chief|udemy|track record|customer"
    "|management|today|cross functional|administrator|excellence|commerce|linkedin|leader|incident|tier|brand|investment|hr|sites"
    "|offerings|prior|centers|advising|certified information|key responsibilities|master data|anti|deadlines|physiology|carbon"
    "|impacts|certified machine|qualification"
).split("|")
#: Parts of words that make an affiliation look academic.
ACADEMIC = (
    "university|univ|universit|college|institute|institut|inst|academy|faculty|facult|school|department|depart|dept|laboratory"
    "|laboratoire|collaboration|centre|center|observatory|observatoire|polytechnic|polytechnique|hochschule|forschung|physik|astronom"
    "|national|state|federal|space flight center|cern|slac|infn|desy|cnrs|cea|kek|riken|jaxa|esa|nasa|jpl|gsfc|msfc|fermilab|argonne"
    "|brookhaven|bnl|los alamos|lanl|lawrence berkeley|lbnl|lbl|nist|noaa|nrc|max-planck|max planck|niels bohr|helmholtz"
    "|forschungszentrum|trieste|ictp"
).split("|")


def escaped(term: str) -> str:
    return "".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in term)


def word_pattern(terms: list[str], literal: bool = True) -> str:
    """One alternation that finds any term as a whole word in lower-case text.

    Word limits are spelt out in ASCII, so engines whose word classes differ agree.
    """
    inner = "|".join(escaped(t.lower()) if literal else t for t in terms)
    return f"(^|[^a-z0-9_])({inner})([^a-z0-9_]|$)"


def has_word(text: Column, terms: list[str], literal: bool = True) -> Column:
    """Whether the text holds one of the terms; False for null text or no terms."""
    if not terms:
        return F.lit(False)
    return F.coalesce(F.lower(text).rlike(word_pattern(terms, literal)), F.lit(False))


def base_match(text: Column) -> Column:
    return has_word(text, BASE_TERMS, literal=False)


def broad_yes_match(text: Column, terms: list[str] = BROAD_YES) -> Column:
    return has_word(text, terms)


def strict_no_match(text: Column, terms: list[str] = STRICT_NO) -> Column:
    """True where none of the terms occurs, for a null text too."""
    return ~has_word(text, terms)


def keyword_flags(df: DataFrame, text: str, keep: list[str], broad: list[str] = BROAD_YES, strict: list[str] = STRICT_NO) -> DataFrame:
    """The primitive and the compound flags of each row, as 0 or 1."""
    told = df.select(*keep, base_match(F.col(text)).alias("b"), broad_yes_match(F.col(text), broad).alias("y"), strict_no_match(F.col(text), strict).alias("n"))
    return told.select(
        *keep,
        F.col("b").cast("int").alias("ml_match"),
        F.col("y").cast("int").alias("broad_match"),
        F.col("n").cast("int").alias("strict_no_match"),
        (F.col("b") & F.col("y")).cast("int").alias("filter_broad_yes"),
        (F.col("b") & F.col("n")).cast("int").alias("filter_strict_no"),
        (F.col("b") & F.col("y") & F.col("n")).cast("int").alias("filter_broad_yes_strict_no"),
    )


def score_columns(df: DataFrame, text: str, keep: list[str], lists: dict[str, list[str]]) -> DataFrame:
    """The eight method columns: base and a yes-list (or none) and no word of a no-list (or none).

    ``lists``: strict_yes, broad_yes, strict_no, broad_no. An empty list finds nothing.
    """
    base = base_match(F.col(text))
    found = {k: has_word(F.col(text), v) for k, v in lists.items()}
    out = {
        "strict_yes_strict_no": base & found["strict_yes"] & ~found["strict_no"],
        "strict_yes_broad_no": base & found["strict_yes"] & ~found["broad_no"],
        "broad_yes_strict_no": base & found["broad_yes"] & ~found["strict_no"],
        "broad_yes_broad_no": base & found["broad_yes"] & ~found["broad_no"],
        "strict_yes_only": base & found["strict_yes"],
        "broad_yes_only": base & found["broad_yes"],
        "strict_no_only": base & ~found["strict_no"],
        "broad_no_only": base & ~found["broad_no"],
    }
    return df.select(*keep, *[c.cast("int").alias(n) for n, c in out.items()])


def is_academic(affiliation: Column, parts: list[str] = ACADEMIC) -> Column:
    """Whether the affiliation holds one of the parts, anywhere; True for null."""
    return F.coalesce(F.lower(affiliation).rlike("|".join(escaped(p) for p in parts)), F.lit(True))
