"""Problem 3: spellings of names that mean the same organisation.

What the words of names mean is learned first: a word in many names, no one
other word of a proper name with it in most of them, tells a kind of body or
nothing. It tells a known kind where it is a short or misspelt way to write it,
nothing where it stands beside words of kinds, else a kind of its own.

Entries are parsed into the kind of body and the proper name; alike parses are
one name from there on. Names share blocks by phonetic codes of their sorted
words, candidates are compared with Jaro-Winkler and a nickname table (short
forms that entries give beside a name, and those made from a name's openings),
and accepted pairs form connected components. Bodies of different kinds stay
apart: a name without a kind, or cut short, joins a component only where just
one fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.names import FILLERS, PLAIN, WORD_KIND, Vocabulary, _words, blocking_keys, kind_of_word, marks, parse_name, short_forms, similarity
from plumbline.session import materialize, release

ACCEPT = 0.85
MOST_ROUNDS = 200  # rounds grow with the logarithm of the longest path
WORDS_OF_A_NAME = 16  # longer entries do not teach what words mean; they are parsed like all
LEAST_NAMES = 5
LEAST_SHARE = 0.001
ONE_PROPER_NAME = 0.1
BESIDE_KINDS = 0.2
SPLIT_BLOCK = 2_000
MARKS = ("letters", "length", "least")
MARKS_DDL = "letters bigint, length int, least int"


def learn_vocabulary(names: DataFrame, text: str) -> Vocabulary:
    """The vocabulary of distinct names: :data:`~plumbline.llm.names.PLAIN` and what their words tell.

    Words of at least ``LEAST_SHARE`` of the names (and ``LEAST_NAMES``) are
    considered; with at most ``WORDS_OF_A_NAME`` words in a name there are at
    most ``WORDS_OF_A_NAME / LEAST_SHARE`` of them, however many names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for value in batch.column(0).to_pylist():
                words = sorted({w for w, _ in _words(value.split(",")[0])})
                if 0 < len(words) <= WORDS_OF_A_NAME:
                    told.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.list_(pa.string()))], names=["words"])

    distinct = names.select(F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null").distinct()
    words = materialize(distinct.mapInArrow(run, "words array<string>"), "words")
    total = words.count()
    least = max(LEAST_NAMES, LEAST_SHARE * total)
    counted = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    known = [*WORD_KIND, *FILLERS]
    frequent = counted.filter(~F.col("w").isin(known))
    beside = F.exists("words", lambda x: x.isin(list(WORD_KIND)))
    near = words.select("words", beside.alias("beside"), F.explode("words").alias("w")).join(F.broadcast(frequent), "w")  # a bounded number of words
    pairs = near.select("w", F.explode("words").alias("c")).filter(F.col("w") != F.col("c")).filter(~F.col("c").isin(known)).groupBy("w", "c").agg(F.count("*").alias("k"))
    tops = pairs.groupBy("w").agg(F.max("k").alias("top"))
    told = near.groupBy("w", "n").agg(F.count_if("beside").alias("beside")).join(tops, "w", "left").collect()
    kinds, fillers = dict(PLAIN.kinds), set(PLAIN.fillers)
    for row in sorted(told):
        if (row["top"] or 0) > max(2, ONE_PROPER_NAME * row["n"]):
            continue  # a proper name's word, as it stands with one other
        kind = kind_of_word(row["w"])
        if kind is not None:
            kinds[row["w"]] = kind
        elif row["beside"] > BESIDE_KINDS * row["n"]:
            fillers.add(row["w"])
        elif row["w"].isalpha():
            kinds[row["w"]] = row["w"]
    return Vocabulary(kinds, frozenset(fillers))


def parsed(rows: DataFrame, key: str, text: str, vocabulary: Vocabulary = PLAIN) -> DataFrame:
    """key, kind, core, weak, nick of the entries that name one organisation."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, kinds, cores, weak, nicks = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                name = parse_name(value, vocabulary)
                if name.found:
                    owner.append(i)
                    kinds.append(name.kind)
                    cores.append(" ".join(name.core))
                    weak.append(name.kind is None or name.short or len(name.core) == 1 and len(name.core[0]) <= 12)
                    nicks.append(name.nick)
            columns = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(kinds, pa.string()), pa.array(cores, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weak, pa.bool_()), pa.array(nicks, pa.string())], names=["key", "kind", "core", "weak", "nick"])

    source = rows.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, f"key {kind}, kind string, core string, weak boolean, nick string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, keys, told = [], [], []
        for i, core in enumerate(batch.column("core").to_pylist()):
            words = tuple(core.split(" "))
            own = blocking_keys(words)
            owner += [i] * len(own)
            keys += own
            told += [marks(words)] * len(own)
        taken = batch.select(["id", "sort"]).take(pa.array(owner, pa.int32()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys, pa.string()), *mark_columns(told)], names=["id", "sort", "block", *MARKS])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [
            similarity(tuple(a.split(" ")), tuple(b.split(" ")))
            for a, b in zip(batch.column("core_a").to_pylist(), batch.column("core_b").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, forms = [], []
        for i, core in enumerate(batch.column("core").to_pylist()):
            own = short_forms(tuple(core.split(" ")))
            owner += [i] * len(own)
            forms += own
        taken = batch.select(["name", "kind"]).take(pa.array(owner, pa.int32()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(forms, pa.string())], names=["name", "kind", "form"])


def mark_columns(told: list[tuple[int, int, int]]) -> list[pa.Array]:
    return [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]


def may_be_alike() -> Column:
    """False only where ``names.similarity`` of two names is 0, by their marks (columns of ``names.marks``, ending in _a and _b).

    An edit adds and takes at most one letter, so the sets of words two edits
    apart differ by four letters and their lengths by two. Of two words one at
    most is cut, to four letters or fewer; the other is two edits apart, so the
    difference of the whole lengths tells how many letters the cut took, to two.
    Few operations, as code of a join beyond 8,000 bytes is not compiled.
    """
    low = F.lit((1 << 32) - 1)
    a, b = F.col("letters_a"), F.col("letters_b")
    gap = F.abs(F.col("length_a") - F.col("length_b"))
    most = F.when(F.least("least_a", "least_b") <= 4, gap + 4).otherwise(F.when(gap <= 4, 4).otherwise(-1))

    def words(one: Column, two: Column) -> Column:
        other = one.bitwiseXOR(two)
        return F.greatest(F.bit_count(F.shiftrightunsigned(other, 32)), F.bit_count(other.bitwiseAND(low))) <= most

    def whole(letters: Column) -> Column:
        return letters.bitwiseOR(F.shiftrightunsigned(letters, 32)).bitwiseAND(low)

    turned = F.shiftleft(b, 32).bitwiseOR(F.shiftrightunsigned(b, 32))
    joined = (gap <= 2) & (F.bit_count(whole(a).bitwiseXOR(whole(b))) <= 4)
    return words(a, b) | joined | words(a, turned) | (F.col("least_a") + F.col("least_b") <= 0)


def block_pairs(keyed: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """(a, b): distinct pairs of ids that share a block. ``keyed``: id, block (a hash) and, with ``left`` and ``right``, side.

    Without sides the pairs are of one table, a < b. A block of more than
    ``SPLIT_BLOCK`` rows is cut into parts by hash; each part of the left side
    meets each part of the right in a cell of its own, so no task gets a whole
    large block and every pair meets once. Only hashes, ids and marks are shuffled.
    Rows of a different ``sort``, where ``keyed`` has one and neither is null,
    are no pair, nor are rows whose names surely are not alike by their marks,
    where it has them; ids of several names have a row for each in a block. It is
    read more than once.
    """
    sizes = keyed.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT_BLOCK)
    # materialised, its few rows are broadcast, so what they are joined with is not shuffled for them
    parts = materialize(sizes.select("block", F.ceil(F.col("n") / SPLIT_BLOCK).cast("int").alias("parts")), "large")
    extra = [c for c in ("sort", *MARKS) if c in keyed.columns]

    def meet(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
        one = one.withColumnsRenamed({"id": "a"} | {c: f"{c}_a" for c in extra})
        two = two.withColumnsRenamed({"id": "b"} | {c: f"{c}_b" for c in extra})
        pairs = one.join(two, by)
        if left == right:
            pairs = pairs.filter("a < b")
        if "sort" in extra:
            pairs = pairs.filter(F.coalesce(F.col("sort_a") == F.col("sort_b"), F.lit(True)))
        if "letters" in extra:
            pairs = pairs.filter(may_be_alike())
        return pairs.select("a", "b")

    def side(rows: DataFrame, which: str | None) -> DataFrame:
        return rows if which is None else rows.filter(F.col("side") == which)

    whole = keyed.join(parts, "block", "left_anti")
    split = keyed.join(parts, "block")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    small = meet(*(side(whole, w).select("block", "id", *extra) for w in (left, right)), ["block"])
    large = meet(
        side(split, left).select("block", own.alias("i"), every.alias("j"), "id", *extra),
        side(split, right).select("block", every.alias("i"), own.alias("j"), "id", *extra),
        ["block", "i", "j"],
    )
    return small.unionByName(large).distinct()


def nickname_table(entries: DataFrame) -> DataFrame:
    """(name, kind, form, given): short forms of the names that are not weak; ``given`` ones stand beside the name in some entry.

    ``entries``: name, kind, core, weak, nick. A form that entries give to one
    name is taken for every name of that core and kind.
    """
    names = entries.filter("not weak").groupBy("name").agg(F.first("kind").alias("kind"), F.first("core").alias("core"))
    given = entries.filter("not weak and nick is not null").select("name", "kind", F.col("nick").alias("form")).distinct()
    made = names.mapInArrow(_forms, "name string, kind string, form string")
    both = given.withColumn("given", F.lit(True)).unionByName(made.withColumn("given", F.lit(False)))
    return both.groupBy("name", "kind", "form").agg(F.bool_or("given").alias("given"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the smallest node of each component.

    Labels fall to the smallest among the neighbours', then to their label's
    label, so rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    held = labels
    for turn in range(MOST_ROUNDS + 1):
        if turn == MOST_ROUNDS:
            raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        step = lower.join(target, "new", "left").select("node", F.col("component").alias("before"), F.least("new", F.coalesce("next", "new")).alias("component"))
        step = materialize(step, "labels")
        changed = step.filter("component <> before").limit(1).count()
        release(held)
        held, labels = step, step.select("node", "component")
        if not changed:
            break
    return labels


def name_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, organisation) of every entry that names exactly one organisation.

    Null, blank and placeholder entries and entries naming two organisations
    give no row; a name alike to no other is an organisation of its own.
    Repeated entries share their organisation. Extra columns are not read.
    """
    vocabulary = learn_vocabulary(rows, text)
    entries = materialize(parsed(rows, key, text, vocabulary), "parsed").withColumn(
        "name", F.concat_ws("|", F.coalesce("kind", F.lit("")), "core", F.when(F.col("weak"), "w").otherwise(""))
    )
    names = entries.groupBy("name").agg(F.first("kind").alias("kind"), F.first("core").alias("core"), F.first("weak").alias("weak"), F.count("*").alias("entries"))
    names = materialize(names.withColumn("id", F.monotonically_increasing_id()), "names")

    sort = F.when(F.col("kind").isNotNull(), F.hash("kind"))  # kinds of one hash are told apart below
    keyed = names.select("id", sort.alias("sort"), "core").mapInArrow(_keys, f"id bigint, sort int, block string, {MARKS_DDL}")
    keyed = materialize(keyed.withColumn("block", F.xxhash64("block")), "blocks")
    fits = (F.col("kind_a") == F.col("kind_b")) | F.col("kind_a").isNull() | F.col("kind_b").isNull()
    one = names.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("name", "kind", "core", "weak")])
    two = names.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("name", "kind", "core", "weak")])
    pairs = block_pairs(keyed).join(one, "a").join(two, "b").filter(fits).drop("a", "b")
    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", score double"
    alike = pairs.mapInArrow(_scores, schema).filter(F.col("score") >= ACCEPT)
    alike = materialize(alike, "alike")
    release(keyed)

    strong = alike.filter("not weak_a and not weak_b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    found = connected_components(strong)
    settled = names.filter("not weak").select(F.col("name").alias("node"), "kind").join(found, "node", "left")
    settled = materialize(settled.select("node", "kind", F.coalesce("component", "node").alias("component")), "settled")

    # names without kind or cut short: by spelling, or by a short form
    by_spelling = alike.filter("weak_a <> weak_b").select(
        F.when(F.col("weak_a"), F.col("name_a")).otherwise(F.col("name_b")).alias("weak_name"),
        F.when(F.col("weak_a"), F.col("name_b")).otherwise(F.col("name_a")).alias("node"),
        "score",
    )
    forms = nickname_table(entries).select("name", "kind", "form")
    single = names.filter("weak and not contains(core, ' ')").select(F.col("name").alias("weak_name"), F.col("kind").alias("weak_kind"), F.col("core").alias("form"))
    by_form = single.join(forms, "form").filter("weak_kind is null or kind is null or weak_kind = kind").select("weak_name", F.col("name").alias("node"), F.lit(0.95).alias("score"))
    links = by_spelling.unionByName(by_form).join(settled.select("node", "component"), "node")
    # each candidate component by its best score; a name joins only where one component fits best
    best = links.groupBy("weak_name", "component").agg(F.max("score").alias("score"))
    top = best.groupBy("weak_name").agg(F.max("score").alias("top"))
    fitting = best.join(top, "weak_name").filter("score >= top - 0.03").groupBy("weak_name").agg(F.count("*").alias("n"), F.min("component").alias("component"))
    joined = fitting.filter("n = 1").select(F.col("weak_name").alias("node"), "component")
    joined = materialize(joined, "joined")

    # weak names that fit nowhere hold together among themselves
    loose = names.filter("weak").select(F.col("name").alias("node")).join(fitting.select(F.col("weak_name").alias("node")), "node", "left_anti")
    among = alike.filter("weak_a and weak_b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    among = among.join(loose.select(F.col("node").alias("a")), "a", "left_semi").join(loose.select(F.col("node").alias("b")), "b", "left_semi")
    apart = connected_components(among)
    everyone = settled.select("node", "component").unionByName(joined).unionByName(apart.select("node", "component"))
    return entries.join(everyone.withColumnRenamed("node", "name"), "name", "left").select("key", F.coalesce("component", "name").alias("organisation"))


def affiliation_groups(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/affiliations.parquet").select("affiliation_id", "affiliation")
    return materialize(name_groups(rows, "affiliation_id", "affiliation"), "groups")


def p3_found(spark, sf_dir: str) -> DataFrame:
    groups = affiliation_groups(spark, sf_dir)
    a = groups.select("organisation", F.col("key").alias("affiliation_id_a"))
    b = groups.select("organisation", F.col("key").alias("affiliation_id_b"))
    return a.join(b, "organisation").filter("affiliation_id_a < affiliation_id_b").select("affiliation_id_a", "affiliation_id_b")


def p3_groups(spark, sf_dir: str) -> DataFrame:
    """The organisation of every entry that names one."""
    return affiliation_groups(spark, sf_dir).withColumnRenamed("key", "affiliation_id")


def p3_nicknames(spark, sf_dir: str) -> DataFrame:
    """The nickname table of the affiliations: kind, form, whether some entry gives it, and of how many names."""
    rows = spark.read.parquet(f"{sf_dir}/affiliations.parquet").select("affiliation_id", "affiliation")
    told = materialize(parsed(rows, "affiliation_id", "affiliation", learn_vocabulary(rows, "affiliation")), "parsed")
    named = told.withColumn("name", F.concat_ws("|", F.coalesce("kind", F.lit("")), "core"))
    return nickname_table(named).groupBy("kind", "form").agg(F.bool_or("given").alias("given"), F.count("*").alias("names"))


def p3_totals(spark, sf_dir: str) -> DataFrame:
    """Entries and summed counts of every organisation."""
    rows = spark.read.parquet(f"{sf_dir}/affiliations.parquet").select(F.col("affiliation_id").alias("key"), "count")
    told = affiliation_groups(spark, sf_dir).join(rows, "key")
    return told.groupBy("organisation").agg(F.count("*").alias("entries"), F.sum("count").alias("total"))
