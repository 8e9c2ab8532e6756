import pytest

from plumbline.llm.names import blocking_keys, similarity


@pytest.mark.parametrize(
    "a, b",
    [
        ("rboafus", "broafus"),
        ("ulshavosfuzike", "lushavosfuzike"),
        ("ulshavosfuzike", "lushavos fuzike"),
        ("dekeneru", "kedeneru"),
        ("silver loom 50", "silber lom 50"),
        ("silver loom 50", "silvr loom 50"),
        ("silverloom 50", "silver loom 50"),
        ("alpha bravo kilo", "bravo kilo alpha"),
        ("dekenu", "kedenu"),
    ],
)
def test_slips_share_a_block_and_are_accepted(a, b):
    a, b = tuple(a.split(" ")), tuple(b.split(" "))
    assert set(blocking_keys(a)) & set(blocking_keys(b))
    assert similarity(a, b) >= 0.85


def test_numbers_stay_apart():
    assert not set(blocking_keys(("silver", "loom", "50"))) & set(blocking_keys(("silver", "loom", "18")))


def test_pairs_surely_not_alike_never_meet_and_no_alike_pair_is_lost(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from plumbline.llm import variants
    from plumbline.llm.names import marks

    draw = random.Random(5)
    letters = "aeioubdfklmnprst7ß"

    def slip(word):
        at = draw.randrange(len(word))
        return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[: at - 1] + word[at - 1 : at + 1][::-1] + word[at + 1 :], word[: draw.randint(3, 5)], word]) or word

    cores = [("rboafus",), ("broafus",), ("word" * 30,), ("silver", "loom", "50"), ("silvr", "loom", "50")]
    for _ in range(40):
        words = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 8))) for _ in range(draw.choice((1, 2, 2, 2, 3)))]
        cores.append(tuple(words))
        for _ in range(4):
            other = [slip(slip(w)) for w in words]
            cores.append(draw.choice([tuple(other), tuple(reversed(other)), ("".join(other),), tuple(sorted(other))]))
    rows = [(i, 1, *marks(c)) for i, c in enumerate(cores)]  # all in one block
    keyed = spark.createDataFrame(rows, f"id bigint, block bigint, {variants.MARKS_DDL}")
    met = {tuple(r) for r in variants.block_pairs(keyed).collect()}
    pairs = list(itertools.combinations(range(len(cores)), 2))
    alike = {(i, j) for i, j in pairs if similarity(cores[i], cores[j]) > 0}
    assert alike <= met and len(alike) > 50
    assert len(met) < 0.6 * len(pairs)
    several = keyed.unionByName(keyed.withColumn("letters", F.lit(0)))  # ids with a second name
    assert met <= {tuple(r) for r in variants.block_pairs(several).collect()}
