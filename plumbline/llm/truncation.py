"""Problem 9: texts that lost their end to a field limit or a broken transfer.

Lengths: per source and unit (characters, bytes), log-normal lengths are fitted
by maximum likelihood with the rows at suspected limits (lengths far more
frequent than their neighbours) as right-censored observations. What a limit
holds beyond the fitted density gives the odds that a text of that length was
cut; the length before a limit, where a blank at the cut was stripped, has odds
of its own. Other lengths have the source's rate of broken transfers.

Endings: a logistic model tells how much likelier an ending is in a cut text
than in a whole one. It learns from a bounded sample of the texts themselves:
texts as they are against the same texts cut at random places within a
sentence. It is told whether the last word is known or the beginning of a known
one; words are counted over all texts and kept as bits of two tables of fixed
size. A sign that a cut may leave is taken off before; what it tells is learned
from the endings before it. The odds multiply to the posterior; the rate of
broken transfers and the signs' odds are settled by expectation maximisation
over a histogram of all texts' evidence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

SAMPLE_ROWS = 40_000
SAMPLE_PARTS = 16  # tasks that make the sample's features
CUTS_PER_TEXT = 2
BITS = 18
EPOCHS = 8
#: A text is taken for cut above this posterior.
CUT_ABOVE = 0.5
RATES = (1e-4, 0.9)  # bounds of a source's rate of broken transfers
WORD_BITS = 26  # the tables of words have 2**26 bits, 8 MB each
#: Fixed value: signs that a cut may leave behind; how much each of them tells is learned.
SIGN = regex.compile(r"(?P<sign>\s*(?:…\s*see more|\[truncated\]|\.\.\.|…|�+|<[a-zA-Z/]*))\s*$")
CLOSERS = "\"'”’»)]}>`*_"
ENDS = ".!?。！？｡"
TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}]+)*|[^\s\p{L}\p{N}]")
TAIL = 400  # the window in which the sign of a cut, the last sentence and the last words are looked for


def _bucket(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(word: str) -> str:
    if word[:1].isdigit():
        return "9"
    if word.isupper():
        return "A" if len(word) > 1 else "U"
    return "Aa" if word[:1].isupper() else "a" if word.isalpha() else "x"


def ends_whole(text: str) -> bool:
    """The text ends in a sentence end, perhaps followed by closing marks, and bears no sign of a cut."""
    body = text.rstrip()
    if not body or SIGN.search(body[-TAIL:]):
        return False
    body = body.rstrip(CLOSERS)
    return bool(body) and body[-1] in ENDS


class Words:
    """Known words, and beginnings of known words, as bits at their CRC-32; unknown ones pass for known at the rate of set bits."""

    def __init__(self, whole: bytes = bytes(1 << (WORD_BITS - 3)), begun: bytes = bytes(1 << (WORD_BITS - 3))):
        self.whole, self.begun = whole, begun

    @staticmethod
    def _bit(table: bytes, word: str) -> bool:
        at = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
        return bool(table[at >> 3] >> (at & 7) & 1)

    def state(self, word: str) -> str:
        """"known", "begun" (unknown, but known words begin with it), "new", or "-" for what is no word."""
        if not word.isalpha():
            return "-"
        return "known" if self._bit(self.whole, word) else "begun" if self._bit(self.begun, word) else "new"


def sign_of(text: str) -> tuple[str, str]:
    """(kind of sign, the sign as it stands with the blanks before it) at the end of a text; empty where there is none."""
    found = SIGN.search(text[-TAIL:])
    if not found:
        return "", ""
    plain = found["sign"].strip()
    return ("<" if plain[0] == "<" else "\ufffd" if plain[0] == "\ufffd" else regex.sub(r"\s", "", plain)), found[0]


def ending(text: str, source: str, known: Words = Words()) -> list[int]:  # noqa: B008
    """Hashed features of a text's ending; ``known``: words that occur elsewhere, so that a word cut short stands out."""
    body = text.rstrip()
    gone = "space" if len(body) < len(text) else ""
    body = body[: len(body) - len(sign_of(body)[1])]
    tail = body[-TAIL:]
    line = body.rsplit("\n", 1)[-1].rsplit("\r", 1)[-1]
    tokens = [("0" if t[0].isdigit() else t).lower() for t in TOKEN.findall(line[-160:])]
    raw = TOKEN.findall(tail[-60:]) or [""]
    last = tokens[-1] if tokens else ""
    two, three = tuple(tokens[-2:]), tuple(tokens[-3:])
    sentence = regex.split(r"[.!?。！？;]\s*", line[-TAIL:])[-1]
    since = len(TOKEN.findall(sentence))
    items = sum(line.count(c) for c in ",|•")
    begin = [("0" if t[0].isdigit() else t).lower() for t in TOKEN.findall(line[:80])[:2]]
    first = (begin[0] if begin else "", begin[1] if len(begin) > 1 else "")
    opener = TOKEN.findall(sentence)[:2]
    opening = tuple(w.lower() for w in opener)
    plain = "" if tail[-1:].isalnum() else tail[-1:]
    balance = (line.count("(") > line.count(")")) + 2 * (line.count("«") > line.count("»")) + 4 * (line.count('"') % 2)
    json_like = body.count("{") - body.count("}") if body.lstrip()[:1] in "{`" else 0
    whole_word = known.state(last)
    shapes = tuple(t.lower() if len(t) < 4 and t.isalpha() else _shape(t) for t in raw[-4:])
    facts = [
        ("gone", gone),
        ("char", plain),
        ("c2", tail[-2:].lower()),
        ("c3", tail[-3:].lower()),
        ("w", last),
        ("w2", two),
        ("w3", three),
        ("shape", _shape(raw[-1]), plain),
        ("len", len(raw[-1]), _shape(raw[-1])),
        ("since", min(since, 12), plain),
        ("items", min(items, 6), min(since, 6)),
        ("first", first),
        ("open", opening),
        ("opensince", opening, min(since, 6)),
        ("lastopen", opening, last),
        ("line", min(len(line) // 20, 8), "\n" in tail),
        ("balance", balance, json_like != 0),
        ("script", "L" if regex.search(r"\p{Latin}", raw[-1]) else "O", plain),
        ("wshape", last if len(last) > 3 else "", _shape(raw[-1])),
        ("known", whole_word),
        ("knownshape", whole_word, _shape(raw[-1]), min(len(raw[-1]), 8)),
        ("shapes", shapes, plain),
        ("begun", whole_word, _shape(raw[-1]), plain, since > 1),
    ]
    by_source = ("char", "w", "w2", "shape", "since", "items", "first", "line", "known", "knownshape", "shapes", "begun")
    out = [_bucket(*f) for f in facts]
    out += [_bucket("src", source, *f) for f in facts if f[0] in by_source]
    return out


WIDTH = 35


def random_cut(text: str, draw: np.random.Generator) -> str | None:
    """The text cut within a sentence at a random place; None where none is found."""
    size = len(text)
    for _ in range(6):
        if size < 12:
            return None
        at = int(draw.integers(max(5, size // 8), size))
        head = text[:at]
        body = head.rstrip()
        if len(body) < 5 or text[at:].strip() == "" or ends_whole(head) or body[-1] in ";|•\n":
            continue
        if text[len(body)] in ".!?。！？\r\n;,|" and body[-1].isalnum():
            continue  # the end of a sentence, line or item: hardly within a sentence
        return head if draw.random() < 0.92 else body + "\n"
    return None


def limit_odds(text: str, source: str, limits: dict[tuple[str, str], dict[int, float]]) -> float:
    """Odds that a text of this length was cut at a limit of its source; 0 at other lengths."""
    wide = len(text.encode("utf-8", "replace"))
    return max(limits.get((source, "chars"), {}).get(len(text), 0.0), limits.get((source, "bytes"), {}).get(wide, 0.0))


def _bits(values: DataFrame) -> bytes:
    """A table of ``2 ** WORD_BITS`` bits, set at the CRC-32 of the column ``w``; built in parts of 4 KB by the tasks."""
    place = F.crc32(F.encode("w", "utf-8")).bitwiseAND((1 << WORD_BITS) - 1) + 1
    parts = values.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at"))
    told = parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # at most 2 ** (WORD_BITS - 15) parts
    table = bytearray(1 << (WORD_BITS - 3))
    for row in told:
        start = (row["part"] - 1) * 4096
        table[start : start + 4096] = row["bits"]
    return bytes(table)


def known_words(texts: DataFrame, least: int = 3) -> Words:
    """The words that other words follow ``least`` times or more in all the texts, in lower case, and their beginnings of two letters or more.

    A word before the sign of a cut is not followed by a word.
    """
    followed = r"(?<![\p{L}\p{M}])([\p{L}\p{M}]++)(?=[ ,;:.!?'’)\-/，、；：]{1,3}[\p{L}\p{N}]|[。！？]|[.!?]\s)"
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(followed), F.lit(1))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counted = materialize(counted.select("w"), "words")
    begun = counted.filter(F.length("w") > 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.length("w") - 1), lambda n: F.substring("w", F.lit(1), n))).alias("w"))
    return Words(_bits(counted), _bits(begun))


def _sampler(shipped):
    """Features of texts as they are (label 0; not those that a limit probably cut) and of random cuts (label 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, known = shipped.value
        for batch in batches:
            flat, labels, halves = [], [], []
            for key, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                draw = np.random.default_rng(key & ((1 << 64) - 1))
                if ends_whole(text) or limit_odds(text, source, limits) < 0.5:
                    flat += ending(text, source, known)
                    labels.append(0.0)
                    halves.append(key & 1)
                for _ in range(CUTS_PER_TEXT):
                    cut = random_cut(text, draw)
                    if cut is not None:
                        flat += ending(cut, source, known)
                        labels.append(1.0)
                        halves.append(key & 1)
            features = pa.FixedSizeListArray.from_arrays(pa.array(flat, type=pa.int32()), WIDTH)
            columns = [pa.array(labels, pa.float64()), features.cast(pa.list_(pa.int32())), pa.array(halves, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "features", "half"])

    return run


@dataclass
class Endings:
    """The ending model: hashed weights learned from each half of the texts, and the log of the likelihood ratio of a cut by their sum."""

    weights: tuple[np.ndarray, np.ndarray]
    bias: tuple[float, float]
    sums: np.ndarray
    ratios: np.ndarray

    def ratio(self, features: list[int], half: int) -> float:
        """A text of one half is judged by the model of the other, which has not seen its ending."""
        return float(np.interp(self.weights[1 - half][features].sum() + self.bias[1 - half], self.sums, self.ratios))


NO_ENDINGS = Endings((np.zeros(1 << BITS, dtype=np.float32),) * 2, (0.0, 0.0), np.zeros(1), np.zeros(1))


def learn_endings(features: np.ndarray, labels: np.ndarray, half: np.ndarray) -> Endings:
    """Fit random cuts (label 1) against texts as they are (0), one model for each half of the texts; ratios come from the scores by the other half's model."""
    whole = labels == 0
    if any(not len(np.unique(labels[half == k])) == 2 for k in (0, 1)):
        return NO_ENDINGS
    models = [fit_endings(features[half == k], labels[half == k]) for k in (0, 1)]
    scores = np.zeros(len(labels))
    for k in (0, 1):
        weights, bias = models[1 - k]
        scores[half == k] = weights[features[half == k]].sum(axis=1) + bias
    sums, ratios = likelihood_ratio(scores[whole], scores[~whole])
    return Endings(tuple(w for w, _ in models), tuple(b for _, b in models), sums, ratios)


def likelihood_ratio(as_they_are: np.ndarray, cut: np.ndarray, bins: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(scores, log ratios): how much likelier a score is for a cut text than for a whole one.

    Texts as they are mix whole ones with a share of cut ones: the ratio of
    both beyond the score that nine in ten cut ones exceed, where whole texts
    are few. Without the cut ones' part the mix is that of the whole texts.
    Ratios do not fall with the score.
    """
    both = np.concatenate([as_they_are, cut])
    edges = np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, bins)) for x in (as_they_are, cut)]))
    if len(edges) < 3:
        return np.array([both.mean()]), np.zeros(1)
    mixed = np.histogram(as_they_are, edges)[0].astype(float)
    told = np.histogram(cut, edges)[0].astype(float)
    tail_mixed, tail_cut = mixed[::-1].cumsum()[::-1] / mixed.sum(), told[::-1].cumsum()[::-1] / told.sum()
    at = np.flatnonzero(tail_cut >= 0.9)[-1]
    share = float(np.clip(tail_mixed[at] / tail_cut[at], *RATES))
    p_cut = (told + 0.5) / (told.sum() + 0.5 * len(told))
    p_whole = np.maximum((mixed + 0.5) / (mixed.sum() + 0.5 * len(mixed)) - share * p_cut, 0.25 / mixed.sum())
    values, mass = list(np.log(p_cut / p_whole)), list(told + mixed + 1e-9)
    blocks: list[list[float]] = []  # pool neighbours that fall
    for value, weight in zip(values, mass, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + n]
    ratios = np.concatenate([np.full(int(n), v) for v, _, n in blocks])
    return (edges[:-1] + edges[1:]) / 2, ratios


def fit_endings(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of a logistic model, balanced so that its score is a log of a likelihood ratio."""
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    bias = 0.0
    mass = [max(float((labels == k).sum()), 1e-6) for k in (0, 1)]
    importance = np.where(labels == 1, len(labels) / 2 / mass[1], len(labels) / 2 / mass[0])
    draw = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = 0.3 / (1 + epoch)
        order = draw.permutation(len(labels))
        for start in range(0, len(order), 256):
            part = order[start : start + 256]
            at = features[part]
            p = 1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1) + bias, -30, 30)))
            gap = (p - labels[part]) * importance[part]
            used, inverse = np.unique(at, return_inverse=True)
            slope = np.bincount(inverse.ravel(), np.repeat(gap, at.shape[1]), minlength=len(used)) / 16 + 1e-6 * weights[used]
            squares[used] += slope * slope
            weights[used] -= rate * slope / np.sqrt(squares[used])
            bias -= 0.02 * gap.mean()
    return weights.astype(np.float32), float(bias)


def _phi(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _upper(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)


def fit_lengths(free: list[tuple[float, float]], censored: list[tuple[float, float]]) -> tuple[float, float]:
    """(mean, deviation) of log lengths by maximum likelihood: (log length, rows) observed, and at least reached."""
    n = sum(c for _, c in free)
    if n < 2:
        return 6.0, 1.0
    m = sum(x * c for x, c in free) / n
    s = max(math.sqrt(sum((x - m) ** 2 * c for x, c in free) / n), 0.05)
    everyone = n + sum(c for _, c in censored)
    for _ in range(50):  # expectation maximisation: a censored row counts as its expected length beyond the limit
        first = sum(x * c for x, c in free)
        second = sum(x * x * c for x, c in free)
        for x, c in censored:
            z = (x - m) / s
            hazard = _phi(z) / _upper(z)
            mean = m + s * hazard
            first += c * mean
            second += c * (s * s * (1 + z * hazard - hazard * hazard) + mean * mean)
        new_m = first / everyone
        new_s = max(math.sqrt(max(second / everyone - new_m * new_m, 0.0)), 0.05)
        if abs(new_m - m) + abs(new_s - s) < 1e-6:
            break
        m, s = new_m, new_s
    return m, s


def find_limits(lengths: DataFrame, least: int = 5, times: float = 3.0) -> dict[tuple[str, str], dict[int, float]]:
    """{(source, unit): {length: odds of a cut}}.

    ``lengths``: source, unit ("chars" or "bytes"), length, rows, whole (rows
    that end in a sentence end). A suspected limit stands out from its
    neighbours, the three highest of them left out. Only such lengths come to
    the driver, with the length before each, and one histogram of log bins a
    source and unit.
    """
    from pyspark.sql import Window

    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-12, 12)
    told = lengths.withColumn("open", F.col("rows") - F.col("whole"))
    listed = F.sort_array(F.collect_list("open").over(near), asc=False)  # at most 25 lengths
    around = F.aggregate(F.slice(listed, 4, 25), F.lit(0).cast("bigint"), lambda a, x: a + x) / 22
    told = told.withColumn("around", around)
    in_order = Window.partitionBy("source", "unit").orderBy("length")
    before = F.lag("length").over(in_order) == F.col("length") - 1
    told = told.withColumn("open_before", F.when(before, F.lag("open").over(in_order)).otherwise(0))
    spikes = told.filter((F.col("open") >= least) & (F.col("open") > times * (F.col("around") + 0.5)) & (F.col("length") > 3))
    spikes = spikes.select("source", "unit", "length", "open", "around", "open_before").collect()  # lengths that stand out
    bins = (
        lengths.filter("length > 0")
        .groupBy("source", "unit", F.floor(F.ln("length") * 12).alias("bin"))
        .agg(F.sum("rows").alias("rows"))
        .collect()
    )
    out: dict[tuple[str, str], dict[int, float]] = {}
    for source, unit in {(r["source"], r["unit"]) for r in bins}:
        own = sorted((s for s in spikes if (s["source"], s["unit"]) == (source, unit)), key=lambda s: s["length"])
        held: dict[int, float] = {}
        for spike in own:
            at = math.floor(math.log(spike["length"]) * 12)
            held[at] = held.get(at, 0.0) + spike["open"]
        censored = [(math.log(s["length"]), float(s["open"])) for s in own]
        free = [((r["bin"] + 0.5) / 12, max(r["rows"] - held.get(r["bin"], 0.0), 0.0)) for r in bins if (r["source"], r["unit"]) == (source, unit)]
        m, s = fit_lengths(free, censored)
        total = sum(c for _, c in free) + sum(c for _, c in censored)
        for spike in own:
            density = total * _phi((math.log(spike["length"]) - m) / s) / (s * spike["length"])  # rows expected by chance at this very length
            # of those, as many end open as do around; where the fit has none, what is around
            chance = max(min(density, spike["around"] + 0.5), spike["around"], 0.5)
            told = out.setdefault((source, unit), {})
            told[spike["length"]] = max(spike["open"] - chance, 0.1) / chance
            beyond = spike["open_before"] - chance
            if beyond > 0 and spike["length"] - 1 not in told:
                told[spike["length"] - 1] = beyond / chance
    return out


def settle(evidence: list[tuple[str, str, float, int]], total: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """(rate of broken transfers by source, odds told by sign) from counts (source, sign, log ratio of the ending, texts) by expectation maximisation.

    ``total`` counts all texts of a source, those that end whole among them.
    """
    rates = dict.fromkeys(total, 0.03)
    signs = {sign: 1.0 for _, sign, _, _ in evidence}
    for _ in range(500):
        cut_of: dict[str, float] = dict.fromkeys(total, 0.0)
        cut_with, whole_with = dict.fromkeys(signs, 0.5), dict.fromkeys(signs, 0.5)
        for source, sign, ratio, n in evidence:
            rate = rates[source]
            p = 1 / (1 + math.exp(-ratio) / signs[sign] * (1 - rate) / rate)
            cut_of[source] += n * p
            cut_with[sign] += n * p
            whole_with[sign] += n * (1 - p)
        new_rates = {s: min(max(cut_of[s] / max(total[s], 1), RATES[0]), RATES[1]) for s in total}
        cuts, wholes = sum(cut_with.values()), sum(whole_with.values())
        new_signs = {s: (cut_with[s] / cuts) / (whole_with[s] / wholes) for s in signs}
        moved = max([abs(new_rates[s] - rates[s]) for s in total] + [abs(math.log(new_signs[s] / signs[s])) for s in signs] + [0.0])
        rates, signs = new_rates, new_signs
        if moved < 1e-4:
            break
    return rates, signs


def truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, source, n_chars, limit_odds, ending (log likelihood ratio), posterior, cut of every text.

    ``cut``: the posterior is above ``CUT_ABOVE`` and the text does not end in a
    sentence end. Null, empty and white texts, and those of three characters
    or fewer, are not cut (posterior 0).
    Texts without source are a source of their own, shown as null. Rows that repeat stay.
    Long texts count whole for their length; their ending is their last line.
    ``sample_rows`` bounds the rows the ending model learns from; all rows are
    scored, and all count for words, limits and rates.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{source}`"), F.lit("\x00")).alias("source"), F.col(f"`{text}`").alias("text")
    )
    filled = base.filter(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 3)
    sized = filled.select(
        "source",
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
        (F.col("text").rlike(r"[.!?。！？][\"'”’»)\]}>`*_\s]*$") & ~F.col("text").rlike(r"\.\.\.\s*$")).cast("int").alias("whole"),
    )
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    lengths = sized.select("source", "whole", unit.alias("u")).groupBy("source", "u.unit", "u.length").agg(F.count("*").alias("rows"), F.sum("whole").alias("whole"))
    lengths = materialize(lengths, "lengths")
    rows = lengths.filter("unit = 'chars'").agg(F.sum("rows").alias("n")).first()["n"] or 0
    limits = find_limits(lengths)

    part = min(1.0, sample_rows / max(rows, 1))
    # copies of a row count once: a row that fills the table does not fill the sample
    h = F.xxhash64("source", "text")
    place = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    sample = filled.filter(place < part).groupBy(h.alias("h")).agg(F.first("source").alias("source"), F.first("text").alias("text"))
    sample = sample.orderBy("h").limit(sample_rows).select("h", "source", "text").repartition(SAMPLE_PARTS)
    known = known_words(filled)
    found = spark.sparkContext.broadcast((limits, known))
    learned = sample.mapInArrow(_sampler(found), "label double, features array<int>, half int").toPandas()
    if len(learned):
        features, labels, half = np.stack(learned["features"].to_numpy()), learned["label"].to_numpy(), learned["half"].to_numpy()
        del learned
        endings = learn_endings(features, labels, half)
    else:
        endings = NO_ENDINGS
    shipped = spark.sparkContext.broadcast((endings, limits, known))  # 2 MB of weights, the limits, two tables of 8 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, limits, known = shipped.value
        for batch in batches:
            ids, names, texts, hashes = batch.columns
            odds, scores, whole, chars, signs = [], [], [], [], []
            for name, value, h in zip(names.to_pylist(), texts.to_pylist(), hashes.to_pylist(), strict=True):
                size = len(value) if value is not None else None
                chars.append(size)
                if value is None or len(value.strip()) <= 3:
                    odds.append(0.0), scores.append(-30.0), whole.append(True), signs.append("")
                    continue
                odds.append(limit_odds(value, name, limits))
                scores.append(endings.ratio(ending(value, name, known), h & 1))
                whole.append(ends_whole(value))
                signs.append(sign_of(value.rstrip())[0])
            yield pa.RecordBatch.from_arrays(
                [ids, names, pa.array(chars, pa.int64()), pa.array(odds, pa.float64()), pa.array(scores, pa.float64()), pa.array(whole), pa.array(signs, pa.string())],
                names=["doc_id", "source", "n_chars", "limit_odds", "ending", "whole", "sign"],
            )

    kind = dict(base.dtypes)["doc_id"]
    scored = base.withColumn("h", h).mapInArrow(score, f"doc_id {kind}, source string, n_chars bigint, limit_odds double, ending double, whole boolean, sign string")
    scored = materialize(scored, "endings")
    off = scored.filter("limit_odds = 0 and not whole")
    bins = off.groupBy("source", "sign", F.round(F.greatest(F.least("ending", F.lit(15.0)), F.lit(-15.0)) * 2).alias("e"))
    evidence = [(r["source"], r["sign"], r["e"] / 2, r["n"]) for r in bins.agg(F.count("*").alias("n")).collect()]  # sources x signs x 61 bins
    total = {r["source"]: r["n"] for r in scored.filter("limit_odds = 0").groupBy("source").agg(F.count("*").alias("n")).collect()}
    rates, signs = settle(evidence, total)
    odds_of = [F.lit(x) for name, rate in rates.items() for x in (name, rate / (1 - rate))]
    sign_of_cut = [F.lit(x) for name, ratio in signs.items() for x in (name, ratio)]
    prior = F.coalesce(F.try_element_at(F.create_map(*odds_of), F.col("source")), F.lit(0.02)) if odds_of else F.lit(0.02)
    told_by_sign = F.coalesce(F.try_element_at(F.create_map(*sign_of_cut), F.col("sign")), F.lit(1.0)) if sign_of_cut else F.lit(1.0)
    odds = F.greatest(F.col("limit_odds"), prior) * told_by_sign * F.exp(F.greatest(F.least("ending", F.lit(30.0)), F.lit(-30.0)))
    posterior = F.when(F.col("whole"), F.lit(0.0)).otherwise(odds / (1 + odds))
    told = scored.withColumn("posterior", posterior).withColumn("cut", (F.col("posterior") > CUT_ABOVE) & ~F.col("whole"))
    return told.withColumn("source", F.nullif("source", F.lit("\x00"))).select("doc_id", "source", "n_chars", "limit_odds", "ending", "posterior", "cut")


def _documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return truncated(_documents(spark, sf_dir)).filter("cut").select("doc_id").distinct()


def p9_scores(spark, sf_dir: str) -> DataFrame:
    """The evidence of every document."""
    return truncated(_documents(spark, sf_dir))


def p9_sources(spark, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    told = truncated(_documents(spark, sf_dir))
    return told.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.sum(F.col("cut").cast("bigint")).alias("cut"),
        F.avg(F.col("cut").cast("double")).alias("rate"),
        F.sum((F.col("cut") & (F.col("limit_odds") > 0)).cast("bigint")).alias("at_limit"),
    )
