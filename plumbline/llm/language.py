"""Problem 6: the language of each text and of each segment of it, with a confidence.

A segment is a sentence of a line; names, quoted and bracketed titles and
markup are taken out first. Its hashed character n-grams (one to four
characters, within and across words) are averaged as embeddings and go through
a linear softmax. The model is trained by stochastic gradient descent in numpy
on a bounded sample of distinct labelled texts; segments whose label the first
pass contradicts are set aside before the second.

Rejection is calibrated on texts held out whole, those with contradicted labels
among them. Labels are wrong at some rate whatever the model says; that rate,
measured where the model is most certain, is taken off before precision is
read. Two things reject a segment: a confidence below the level that gives the
wanted precision, and n-grams so rare in the language found that the segment is
likely in none of the languages. A text none of whose segments are accepted has
no language unless it is accepted as a whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

#: Code, then the codes and names that mean the language.
LANGUAGES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn japanese 日本語",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "sv": "sv swe swedish svenska",
    "zh": "zh zho chi chinese 中文 mandarin",
}
CODES = tuple(LANGUAGES)
LEAST_LETTERS = 20
SAMPLE_TEXTS = 9_000
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
DIM = 16
EPOCHS = 3
PRECISION = 0.995
HELD_OUT = 0.15
SEGMENTS_PER_TEXT = 40  # of a sample text, drawn by hash from all of it
SEGMENT_LETTERS = 12
BLOCK_CHARS = 150_000

MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|&(?:[a-zA-Z]{2,8}|#[0-9]{2,6});|<\|[a-z]+\|>|https?://\S+|\S+@\S+\.\w+|\"[A-Za-z_]\w*\"\s*:")
MARKS = re.compile(r"[<&@]|://|\"\s*:")
QUOTED = re.compile(
    r"\([^()\n]{0,160}\)|（[^（）\n]{0,160}）|\[[^\[\]\n]{0,160}\]|«[^«»\n]{0,160}»|“[^“”\n]{0,160}”|„[^„“”\n]{0,160}[“”]|「[^「」\n]{0,160}」"
    r"|『[^『』\n]{0,160}』|《[^《》\n]{0,160}》|\"[^\"\n]{0,160}\"|‘[^‘’\n]{0,160}’"
)
OPENERS = re.compile("[(（[«“„「『《\"‘]")
BREAK = re.compile(r"(?<=[.!?…])(?=\s)|(?<=[。！？｡])|\s/\s|[\r\n]+")
WHOLE = re.compile(r"[.!?…。！？｡][\"'”’»)\]}*_`]*$")
DIGITS = re.compile("[0-9]+")


def _every(pattern: str) -> str:
    """All characters that match."""
    points = (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return "".join(regex.findall(pattern, "".join(map(chr, points))))


@cache
def hidden() -> dict[int, None]:
    """Control and format characters but line ends and tabs, as a table that deletes them."""
    return dict.fromkeys(map(ord, _every(r"(?![\n\r\t])[\p{Cf}\p{Cc}]")))


@cache
def hidden_characters() -> frozenset[str]:
    return frozenset(map(chr, hidden()))


@cache
def letter_weights() -> np.ndarray:
    """By code point: 1 for a letter, 3 for an ideograph or kana, as it tells as much, else 0."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for pattern, weight in ((r"\p{L}", 1), (r"[\p{Han}\p{Hiragana}\p{Katakana}]", 3)):
        out[[ord(c) for c in _every(pattern)]] = weight
    return out


def canonical(label: Column) -> Column:
    """The language of ``LANGUAGES`` that a label means, as a two-letter code; null for none."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([^-_\s]+)(?:[-_][a-z0-9]{2,8})*$", 1)
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for name in names.split(" ") for x in (name, code)])
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, head))


def segments(text: str) -> list[tuple[str, bool]]:
    """(segment, whole): the text's sentences and lines, titles taken out; whole ones end in a sentence end."""
    plain = text if text.isascii() else unicodedata.normalize("NFC", text)
    if MARKS.search(plain):
        plain = MARKUP.sub(" ", plain)
    if not hidden_characters().isdisjoint(plain):
        plain = plain.translate(hidden())
    bare = QUOTED.sub(" ", plain) if OPENERS.search(plain) else plain
    if len(bare) < len(plain) and letter_counts([bare])[0] < LEAST_LETTERS:
        bare = plain
    out = []
    for part in BREAK.split(bare):
        part = " ".join(part.split())
        if part:
            out.append((part, WHOLE.search(part) is not None))
    return out


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all parts, each closed by a zero; the part of each)."""
    points = np.frombuffer("\x00".join([*(p.replace("\x00", " ") for p in parts), ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.cumsum(points == 0)
    return points, ends - (points == 0)


def letter_counts(parts: list[str], weighted: bool = False) -> np.ndarray:
    """Letters of each part; ``weighted``: as :func:`letter_weights`."""
    if not parts:
        return np.zeros(0, dtype=np.int64)
    points, owner = code_points(parts)
    told = letter_weights()[points]
    return np.bincount(owner, told if weighted else told > 0, minlength=len(parts)).astype(np.int64)


def ngram_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, part of each): all n-grams of all parts, computed over one array of code points."""
    folded = DIGITS.sub("0", "\x00".join(f" {p.lower()} " for p in parts))
    points = np.frombuffer(folded.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 0)
    hashes, owners = [], []
    value = np.zeros(len(points), dtype=np.uint64)
    broken = np.zeros(len(points), dtype=bool)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            break
        shifted = points[n - 1 :]
        value = value[: len(shifted)] * np.uint64(1000003) + shifted + np.uint64(n)
        broken = broken[: len(shifted)] | (shifted == 0)
        mixed = value ^ (value >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        keep = ~broken
        hashes.append((mixed[keep] & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(owner[: len(shifted)][keep].astype(np.int32))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], o[order]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    scale: float
    level: float
    usual: np.ndarray | None = None  # BUCKETS x languages: log frequency of an n-gram in the language
    strange: float = float("inf")  # deviations below what is usual in its language at which a segment is in none
    norm: np.ndarray = field(default_factory=lambda: np.zeros((len(CODES), 2)))  # by language: mean of a segment's average log frequency, its deviation

    def predict(self, parts: list[str]) -> np.ndarray:
        """Calibrated probabilities of every part."""
        return self.judge(parts)[0]

    def judge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities, deviations below what is usual in the likeliest language) of every part."""
        out = np.zeros((len(parts), len(CODES)))
        strange = np.zeros(len(parts))
        start = 0
        while start < len(parts):
            end, chars = start + 1, len(parts[start])
            while end < len(parts) and chars + len(parts[end]) < BLOCK_CHARS:
                chars += len(parts[end])
                end += 1
            chunk = parts[start:end]
            h, o = ngram_hashes(chunk)
            sums = np.zeros((len(chunk), len(CODES)))
            slices = range(0, len(h), 4 * BLOCK_CHARS)  # a very long part goes through in slices
            for at in slices:
                some, owner = h[at : at + 4 * BLOCK_CHARS], o[at : at + 4 * BLOCK_CHARS]
                own, first = np.unique(owner, return_index=True)
                sums[own] += np.add.reduceat(self.table[some], first, axis=0)
            counts = np.bincount(o, minlength=len(chunk))
            logits = (sums / counts[:, None] + self.bias) * self.scale
            logits -= logits.max(axis=1, keepdims=True)
            e = np.exp(logits)
            out[start:end] = e / e.sum(axis=1, keepdims=True)
            if self.usual is not None:
                best = logits.argmax(axis=1)
                told = np.zeros(len(chunk))
                for at in slices:
                    some, owner = h[at : at + 4 * BLOCK_CHARS], o[at : at + 4 * BLOCK_CHARS]
                    told += np.bincount(owner, self.usual[some, best[owner]], minlength=len(chunk))
                strange[start:end] = self.strangeness(told / counts, counts, best)
            start = end
        return out, strange

    def strangeness(self, average: np.ndarray, counts: np.ndarray, best: np.ndarray) -> np.ndarray:
        mean, deviation = self.norm[best, 0], self.norm[best, 1]
        return np.where(deviation > 0, (mean - average) * np.sqrt(np.minimum(counts, NGRAMS_TOLD)) / np.maximum(deviation, 1e-9), 0.0)

    def accepted(self, guess: np.ndarray, strange: np.ndarray) -> np.ndarray:
        """Which parts have a language."""
        return (guess.max(axis=1, initial=0.0) >= self.level) & (strange < self.strange)


WITHIN, WITHOUT = 0.999, 0.5
LEAST_SPREAD = 1.0  # of a language whose held-out segments are nearly alike
NGRAMS_TOLD = 300  # beyond as many n-grams a segment's average is no steadier


def _train(parts: list[str], labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(CODES)), dtype=np.float32)
    soft += draw.normal(0, 0.1, soft.shape)
    bias = np.zeros(len(CODES), dtype=np.float32)
    share = np.bincount(labels, minlength=len(CODES)) / max(len(labels), 1)
    weight = np.where(share > 0, 1 / np.sqrt(np.maximum(share, 1e-4)), 0)
    weight /= max((weight * share).sum(), 1e-9)
    order = draw.permutation(len(parts))
    steps = []  # by mini-batch: n-grams, their parts, labels, and the n-grams' order by bucket, which sums a bucket's gradients in one pass
    for at in range(0, len(order), 4096):
        block = order[at : at + 4096]
        h, o = ngram_hashes([parts[i] for i in block])
        starts = np.searchsorted(o, np.arange(len(block) + 1))
        for s in range(0, len(block), 64):
            e = min(s + 64, len(block))
            idx = h[starts[s] : starts[e]]
            by_bucket = np.argsort(idx.astype(np.uint16), kind="stable")
            used, first = np.unique(idx[by_bucket], return_index=True)
            part = (o[starts[s] : starts[e]] - s)[by_bucket]
            steps.append((idx, starts[s:e] - starts[s], np.diff(starts[s : e + 1])[:, None].astype(np.float32), labels[block[s:e]], used, first, part))
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for idx, cut, size, y, used, first, part in steps:
            hidden = np.add.reduceat(embed[idx], cut, axis=0) / size
            logits = hidden @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None]
            grad_h = ((p @ soft.T) / size * 8).astype(np.float32)
            soft -= (rate * (hidden.T @ p) / 8).astype(np.float32)
            bias -= (rate * p.mean(axis=0)).astype(np.float32)
            embed[used] -= rate * np.add.reduceat(grad_h[part], first, axis=0)
    return embed, soft, bias


def train(parts: list[str], labels: list[int], texts: list[int] | None = None, seed: int = 5) -> Model:
    """The model of labelled segments. ``texts`` says which text each is of: texts are held out whole for calibration."""
    y = np.array(labels, dtype=np.int64)
    owner = np.array(texts, dtype=np.int64) if texts is not None else np.arange(len(parts))
    flat = Model(np.zeros((BUCKETS, len(CODES)), dtype=np.float32), np.zeros(len(CODES)), 1.0, 1.1)
    if len(parts) < 2 or len(set(labels)) < 2:
        if labels:
            flat.bias[labels[0]] = 20.0
            flat.level = 0.5
        return flat
    draw = np.random.default_rng(seed)
    names, at = np.unique(owner, return_inverse=True)
    held = (draw.random(len(names)) < HELD_OUT)[at]
    if held.all() or not held.any():
        held = draw.random(len(parts)) < HELD_OUT
    kept = np.flatnonzero(~held)
    for turn in range(2):
        embed, soft, bias = _train([parts[i] for i in kept], y[kept], seed + turn)
        model = Model((embed @ soft).astype(np.float32), bias, 1.0, 0.0)
        if turn == 0:  # set aside segments whose label the model contradicts
            guess = model.predict([parts[i] for i in kept])
            doubtful = (guess.argmax(axis=1) != y[kept]) & (guess.max(axis=1) > 0.6)
            kept = kept[~doubtful]
    out = np.flatnonzero(held)
    model.level = 0.5
    if len(out):
        calibrate(model, [parts[i] for i in out], y[out])
        learn_usual(model, [parts[i] for i in kept], y[kept], [parts[i] for i in out], y[out])
    return model


def wrong_labels(guess: np.ndarray, y: np.ndarray) -> float:
    """The share of wrong labels: that of contradictions among the half of the parts the model is most certain of."""
    sure = np.argsort(-guess.max(axis=1), kind="stable")[: max(len(y) // 2, 1)]
    return float((guess[sure].argmax(axis=1) != y[sure]).mean())


def calibrate(model: Model, parts: list[str], y: np.ndarray) -> None:
    """Set the scale of the logits and the level below which a part is rejected, on held-out parts with labels as they are."""
    guess = model.predict(parts)
    noise = wrong_labels(guess, y)
    logits = np.log(np.maximum(guess, 1e-12))
    best = None
    for candidate in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0):
        z = np.exp(candidate * (logits - logits.max(axis=1, keepdims=True)))
        p = z / z.sum(axis=1, keepdims=True)
        told = (1 - noise) * p[np.arange(len(y)), y] + noise / len(CODES)  # a wrong label may be any
        loss = -np.log(np.maximum(told, 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, candidate)
    model.scale = best[1]
    guess = model.predict(parts)
    sure = guess.max(axis=1)
    order = np.argsort(-sure, kind="stable")
    taken = np.arange(1, len(order) + 1)
    wrong = np.cumsum(guess.argmax(axis=1)[order] != y[order]) / taken
    chance = 2 * np.sqrt(noise * (1 - noise) / taken)  # how far labels wrong by chance may lie above their rate
    precision = 1 - np.maximum(wrong - noise - chance, 0.0) / max(1 - noise, 1e-9)
    good = np.flatnonzero(precision >= PRECISION)
    model.level = float(max(sure[order][good[-1]], 0.5)) if len(good) else float(sure.max())


def learn_usual(model: Model, parts: list[str], y: np.ndarray, others: list[str], told: np.ndarray) -> None:
    """Log frequencies of n-grams by language from ``parts``; what is usual, from ``others`` whose language the model finds as told.

    What is strange is learned by taking each segment's own language away: the
    limit lies midway between what all but ``1 - WITHIN`` of the segments keep
    below in their language and what ``WITHOUT`` of them exceed in the next.
    """
    size = len(CODES)
    counts = np.zeros(BUCKETS * size)
    for start in range(0, len(parts), 4096):
        h, o = ngram_hashes(parts[start : start + 4096])
        counts += np.bincount(h.astype(np.int64) * size + y[start + o], minlength=len(counts))
    counts = counts.reshape(BUCKETS, size)
    usual = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    guess = model.predict(others)
    right = np.flatnonzero(guess.argmax(axis=1) == told)
    if len(right) < 2:
        return
    masked = guess[right].copy()
    masked[np.arange(len(right)), told[right]] = -1.0
    elsewhere = masked.argmax(axis=1)  # where a segment would go if its language were unknown
    n, own_average, other_average = (np.zeros(len(right)) for _ in range(3))
    for start in range(0, len(right), 4096):
        some = slice(start, start + 4096)
        h, o = ngram_hashes([others[i] for i in right[some]])
        n[some] = np.bincount(o)
        own_average[some] = np.bincount(o, usual[h, told[right][some][o]]) / n[some]
        other_average[some] = np.bincount(o, usual[h, elsewhere[some][o]]) / n[some]
    root = np.sqrt(np.minimum(n, NGRAMS_TOLD))
    for k in range(size):
        own = told[right] == k
        own = own if own.sum() >= 20 else np.ones(len(right), dtype=bool)
        mean = np.average(own_average[own], weights=root[own] ** 2)
        model.norm[k] = mean, max(np.sqrt((((own_average[own] - mean) * root[own]) ** 2).mean()), LEAST_SPREAD)
    model.usual = usual
    within = np.quantile(model.strangeness(own_average, n, told[right]), WITHIN)
    without = np.quantile(model.strangeness(other_average, n, elsewhere), 1 - WITHOUT)
    model.strange = float(max(within, (within + without) / 2))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sentences of each text, or its segments where it has none; of more than ``SEGMENTS_PER_TEXT`` those of the smallest hashes."""
    for batch in batches:
        parts, labels, owners = [], [], []
        for text, label, owner in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            every = segments(text)
            own = [part for part, whole in every if whole] or [part for part, _ in every]
            own = [part for part, size in zip(own, letter_counts(own, weighted=True), strict=True) if size >= SEGMENT_LETTERS]
            if len(own) > SEGMENTS_PER_TEXT:
                own = sorted(own, key=lambda part: zlib.crc32(part.encode("utf-8", "replace")))[:SEGMENTS_PER_TEXT]
            parts += own
            labels += [CODES.index(label)] * len(own)
            owners += [owner] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(labels, pa.int32()), pa.array(owners, pa.int64())], names=["part", "label", "owner"])


def learn(texts: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Train on ``texts`` (text, lang): at most ``sample_texts`` distinct texts, a
    language's share in proportion to the root of its labelled distinct texts.

    Copies of a text count as one, so no text that fills a table fills the
    sample. A language takes the texts of the smallest hashes.
    """
    told = texts.select(canonical(F.col("lang")).alias("code"), F.col("text"), F.xxhash64("text", F.lit(17)).alias("h")).filter("code is not null and text is not null")
    distinct = told.groupBy("code", "h").agg(F.lit(1).alias("one"))
    have = {r["code"]: r["n"] for r in distinct.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not have:
        return train([], [])
    roots = sum(n**0.5 for n in have.values())
    most = {code: max(int(sample_texts * n**0.5 / roots), 1) for code, n in have.items()}
    # a little more than wanted by threshold, then exactly by rank within the sample
    part = F.lit(0.0)
    for code, n in have.items():
        part = F.when(F.col("code") == code, F.lit(min(1.0, (most[code] + 5 * most[code] ** 0.5 + 5) / n))).otherwise(part)
    bound = F.lit(0)
    for code, n in most.items():
        bound = F.when(F.col("code") == code, F.lit(n)).otherwise(bound)
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    few = told.filter(place < part).groupBy("code", "h").agg(F.first("text").alias("text"))
    few = few.withColumn("nr", F.row_number().over(Window.partitionBy("code").orderBy(F.shiftrightunsigned("h", 11), "h"))).filter(F.col("nr") <= bound)
    sample = few.select("text", "code", "h").mapInArrow(_learned, "part string, label int, owner bigint").toPandas().sort_values(["owner", "part"], kind="stable")
    return train(sample["part"].tolist(), sample["label"].tolist(), sample["owner"].tolist())


TOLD = "main string, confidence double, langs array<string>, n_letters bigint"
SEGMENT = "place int, segment string, whole boolean, lang string, confidence double"


def _shares(model: Model, parts: list[tuple[str, bool]], guess: np.ndarray, strange: np.ndarray, size: np.ndarray) -> tuple[str | None, float, list[str]]:
    if not parts:
        return None, 0.0, []
    whole = np.array([w for _, w in parts])
    weight = size * np.where(whole, 1.0, 0.25)
    if not weight.sum():
        return None, 0.0, []
    accepted = model.accepted(guess, strange)
    clear = whole & (size >= SEGMENT_LETTERS) & accepted
    found = {int(k) for k in guess[clear].argmax(axis=1)}
    some = accepted if accepted.any() else strange < model.strange  # strange segments speak for no language
    mean = (guess * (weight * some)[:, None]).sum(axis=0) / max((weight * some).sum(), 1e-9)
    main = max(found, key=lambda k: mean[k]) if found else int(mean.argmax())
    share = float(mean[main])
    if not found and share < model.level:
        return None, share, []
    return CODES[main], share, sorted({CODES[k] for k in found} | {CODES[main]})


def identify(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add main, confidence, langs and n_letters to every row.

    ``main`` is the language of most of the text, ``langs`` those of its whole
    sentences and the main one. Null, empty and short texts (fewer than
    ``LEAST_LETTERS`` letters), and those the model rejects, have no language
    and an empty list. Columns of these names are replaced. Rows that repeat
    stay; whole texts are read.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size, 6 MB
    kept = [c for c in texts.columns if c not in (text, "main", "confidence", "langs", "n_letters")]
    source = texts.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in texts.select(*[f"`{c}`" for c in kept]).dtypes], TOLD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            values = batch.column(len(kept)).to_pylist()
            for start in range(0, len(values), 1000):
                some = values[start : start + 1000]
                count = letter_counts([v or "" for v in some])
                parts = [segments(v) if n >= LEAST_LETTERS else [] for v, n in zip(some, count, strict=True)]
                every = [p for ps in parts for p, _ in ps]
                guess, strange = model.judge(every)
                size = letter_counts(every, weighted=True)
                told, at = [], 0
                for ps in parts:
                    own = slice(at, at + len(ps))
                    told.append(_shares(model, ps, guess[own], strange[own], size[own]))
                    at += len(ps)
                here = batch.slice(start, len(some))
                columns = [
                    pa.array([t[0] for t in told], pa.string()),
                    pa.array([t[1] for t in told], pa.float64()),
                    pa.array([t[2] for t in told], pa.list_(pa.string())),
                    pa.array(count, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[here.column(i) for i in range(len(kept))], *columns], names=[*kept, "main", "confidence", "langs", "n_letters"]
                )

    return source.mapInArrow(run, schema)


def identify_segments(texts: DataFrame, model: Model, key: str | list[str], text: str = "text") -> DataFrame:
    """One row per segment: key column or columns, place, segment, whole, lang (null where the model rejects), confidence."""
    shipped = texts.sparkSession.sparkContext.broadcast(model)
    keys = [key] if isinstance(key, str) else key
    kinds = dict(texts.dtypes)
    source = texts.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.slice(start, 1000)
                owner, place, part, whole = [], [], [], []
                for i, value in enumerate(some.column(len(keys)).to_pylist()):
                    for k, (p, w) in enumerate(segments(value) if value else []):
                        owner.append(i), place.append(k), part.append(p), whole.append(w)
                guess, strange = model.judge(part)
                sure = guess.max(axis=1, initial=0.0)
                lang = [CODES[b] if fits else None for b, fits in zip(guess.argmax(axis=1), model.accepted(guess, strange), strict=True)]
                columns = [
                    *[some.column(i).take(pa.array(owner, pa.int32())) for i in range(len(keys))],
                    pa.array(place, pa.int32()),
                    pa.array(part, pa.string()),
                    pa.array(whole, pa.bool_()),
                    pa.array(lang, pa.string()),
                    pa.array(sure, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "place", "segment", "whole", "lang", "confidence"])

    return source.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], SEGMENT]))


def label_cases(told: DataFrame) -> DataFrame:
    """rec_kind, rec_id, lang of the rows of ``told`` whose label is missing or wrong or whose text is mixed."""
    code = canonical(F.col("lang"))
    wrong = code.isNull() | (F.size("langs") > 1) | (code != F.col("main"))
    cases = told.filter((F.size("langs") > 0) & wrong)
    return cases.select("rec_kind", "rec_id", F.explode("langs").alias("lang")).distinct()


def count_cases(told: DataFrame, companies: DataFrame, apart: int = 3) -> DataFrame:
    """Companies whose count of non-English CVs differs by ``apart`` or more from that of the CVs' main languages."""
    cvs = told.filter("main <> 'en' and comparator_id is not null").select("comparator_id", "rec_id").distinct()
    counts = cvs.groupBy("comparator_id").agg(F.count("*").alias("n"))
    stated = companies.filter("filter_non_english_keywords_cv is not null and id is not null").select("id", "filter_non_english_keywords_cv")
    both = stated.join(counts, F.col("id") == F.col("comparator_id"), "left")
    gap = F.abs(F.col("filter_non_english_keywords_cv") - F.coalesce("n", F.lit(0)))
    return both.filter(gap >= apart).select(F.lit("comparator").alias("rec_kind"), F.col("id").alias("rec_id"), F.lit("count").alias("lang")).distinct()


def corpus_texts(spark, sf_dir: str) -> DataFrame:
    cvs = spark.read.parquet(f"{sf_dir}/cv_data.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cvs.select(
        F.lit("cv").alias("rec_kind"), F.col("cv_id").alias("rec_id"), F.col("cv_text").alias("text"), "lang", "comparator_id"
    ).unionAll(docs.select(F.lit("doc"), "doc_id", "text", "lang", F.lit(None).cast("bigint")))


def told_corpus(spark, sf_dir: str) -> DataFrame:
    texts = corpus_texts(spark, sf_dir)
    return materialize(identify(texts, learn(texts)), "languages")


def p6_found(spark, sf_dir: str) -> DataFrame:
    told = told_corpus(spark, sf_dir)
    companies = spark.read.parquet(f"{sf_dir}/final_results_comparator_ml.parquet")
    return label_cases(told).unionByName(count_cases(told.filter("rec_kind = 'cv'"), companies))


def p6_texts(spark, sf_dir: str) -> DataFrame:
    """Main language, confidence and languages of every text."""
    return told_corpus(spark, sf_dir).select("rec_kind", "rec_id", "lang", "main", "confidence", "langs")


def p6_segments(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of the CVs and documents."""
    texts = corpus_texts(spark, sf_dir)
    return identify_segments(texts, learn(texts), ["rec_kind", "rec_id"])
