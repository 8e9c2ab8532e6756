"""Preparation and scoring of multiple-choice questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")


def mcq_prompt(question: Column, choices: Column, answer: Column | None = None) -> Column:
    """The question, a line per choice, and the answer's letter, or an open 'Answer:'."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(choices, lambda c, i: F.concat(F.get(letters, i), F.lit(". "), c))
    end = F.lit("Answer:") if answer is None else F.concat(F.lit("Answer: "), F.get(letters, answer), F.lit(". "), F.get(choices, answer))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"), end)


def wrong_answers(choices: Column, answer: Column) -> Column:
    """All choices but the answer, and but those of the same text."""
    return F.filter(choices, lambda c, i: (i != answer) & (c != F.get(choices, answer)))


def seeded_wrong(question: Column, choices: Column, answer: Column, seed: int = 0) -> Column:
    """One wrong choice, fixed by the question's text."""
    wrong = wrong_answers(choices, answer)
    return F.get(wrong, F.pmod(F.xxhash64(question, F.lit(seed)), F.greatest(F.size(wrong), F.lit(1))).cast("int"))


def splits(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``split``: rows in ``k`` parts by the key's hash."""
    return df.withColumn("split", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def leave_one_out(df: DataFrame, k: int) -> DataFrame:
    """A row for every fold that trains on it: all folds but its own."""
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("split"))
    return df.withColumn("fold", F.explode(folds))


def calibrated_accuracy(scores: DataFrame, file: str, logits: str, answer: str) -> DataFrame:
    """(file, accuracy, calibrated, balanced): argmax of the logits, and of the logits less their mean per choice and file.

    ``balanced`` is the mean over classes of the calibrated accuracy.
    """
    wide = scores.select(file, answer, *[F.get(logits, F.lit(i)).cast("double").alias(f"l{i}") for i in range(4)])
    w = Window.partitionBy(file)
    centred = wide.withColumns({f"c{i}": F.col(f"l{i}") - F.avg(f"l{i}").over(w) for i in range(4)})

    def argmax(prefix: str) -> Column:
        values = F.array(*[F.col(f"{prefix}{i}") for i in range(4)])
        return (F.array_position(values, F.array_max(values)) - 1).cast("int")

    told = centred.select(file, answer, (argmax("l") == F.col(answer)).cast("double").alias("hit"), (argmax("c") == F.col(answer)).cast("double").alias("chit"))
    by_class = told.groupBy(file, answer).agg(F.count("*").alias("n"), F.sum("hit").alias("h"), F.sum("chit").alias("ch"))
    return by_class.groupBy(file).agg(
        (F.sum("h") / F.sum("n")).alias("accuracy"), (F.sum("ch") / F.sum("n")).alias("calibrated"), F.avg(F.col("ch") / F.col("n")).alias("balanced")
    )


def strided_splits(df: DataFrame, key: str, most: int, held: int, k: int, seed: int = 42) -> DataFrame:
    """The first ``most`` rows of a seeded shuffle with ``split``: -1 for the ``held`` first ones, then 0 to k - 1 in turn.

    Only ``most`` rows are put in order: Spark keeps as many per task.
    """
    first = df.select(key).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)
    place = F.row_number().over(Window.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)) - 1  # over at most ``most`` rows
    return first.withColumn("split", F.when(place < held, -1).otherwise(F.pmod(place - held, F.lit(k))).cast("int"))


def true_false(question: Column, choices: Column, answer: Column) -> Column:
    """For each choice the question with it as a statement, and whether it is true."""
    return F.transform(
        choices, lambda c, i: F.concat(question, F.lit("\n"), c, F.lit("\nTrue or false? Answer: "), F.when(i == answer, "True").otherwise("False"))
    )


def k_shot(df: DataFrame, key: str, question: str, choices: str, answer: str, k: int) -> DataFrame:
    """(key, prompt, completion, text): the ``k`` questions of the smallest keys, solved by letter, before every other question.

    The shots are ``k`` rows and joined to all as one.
    """
    letters = F.array(*[F.lit(x) for x in LETTERS])
    rows = df.select(key, mcq_prompt(F.col(question), F.col(choices)).alias("open"), F.get(letters, F.col(answer)).alias("completion"))
    first = rows.orderBy(key).limit(k)
    solved = F.transform(F.array_sort(F.collect_list(F.struct(key, F.concat("open", F.lit(" "), "completion").alias("t")))), lambda s: s["t"])
    head = first.agg(F.array_join(solved, "\n\n").alias("head"))  # one row
    others = rows.join(first.select(key), key, "left_anti").crossJoin(F.broadcast(head))
    prompt = F.concat("head", F.lit("\n\n"), "open")
    return others.select(key, prompt.alias("prompt"), "completion", F.concat(prompt, F.lit(" "), "completion").alias("text"))


def seeded_wrongs(key: Column, choices: Column, answer: Column, n: int, seed: int = 0) -> Column:
    """Up to ``n`` different wrong choices in an order fixed by the key: one for each phrasing of a question."""
    wrong = F.array_distinct(wrong_answers(choices, answer))
    placed = F.array_sort(F.transform(wrong, lambda c: F.struct(F.xxhash64(key, c, F.lit(seed)).alias("h"), c.alias("c"))))
    return F.slice(F.transform(placed, lambda s: s["c"]), 1, n)
