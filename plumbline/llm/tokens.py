"""Problem 7: encode a corpus with a public byte-level BPE tokenizer.

The vocabulary's byte strings are mapped to Latin-1 and put into one
Aho-Corasick automaton. A piece of text (the tokenizer's own split pattern) is
scanned once, which yields every token at every start. From the longest match
on, tokens are laid side by side as long as neighbours are compatible, that
is, as long as merging the two tokens' bytes gives back just these two; at a
dead end the next shorter token is taken. Compatibility is memoised, and a
position found dead is never entered again, so the work is linear in the
piece. A sequence whose neighbours are all compatible is the one the merge
rules produce, so ids are exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
#: Fixed value: the split pattern of this family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_PIECES = 200_000
MEMO_PAIRS = 1_000_000
MEMO_CHARS = 48


def _printable_bytes() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Tokens by id, and merges (left id, right id, merged id) in their order of rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    back = _printable_bytes()
    ids = model["vocab"]
    tokens = [b""] * (max(ids.values()) + 1)
    for text, number in ids.items():
        if all(ch in back for ch in text):
            tokens[number] = bytes(back[ch] for ch in text)
    merges = []
    for pair in model["merges"]:
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges.append((ids[left], ids[right], ids[left + right]))
    return tokens, merges


class Encoder:
    """Exact byte-level BPE ids by backtracking over an Aho-Corasick scan."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.split = regex.compile(SPLIT)
        self.bytes_of = tokens
        self.length = [len(t) for t in tokens]
        self.merged = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges)}
        self.single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, token in enumerate(tokens):
            if token:
                self.scan.add_word(token.decode("latin-1"), number)
        self.scan.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def by_merging(self, data: bytes) -> list[int]:
        """The merge rules applied one by one: the definition, used on two tokens at a time."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = self.merged.get((ids[i], ids[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.by_merging(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8").decode("latin-1")
        end = len(data)
        at: list[list[int]] = [[] for _ in range(end)]  # tokens by start, short to long
        length = self.length
        for last, number in self.scan.iter(data):
            at[last + 1 - length[number]].append(number)
        ids: list[int] = []
        left_to_try: list[int] = []  # for each token of ids, how many shorter ones remain
        dead = bytearray(end + 1)
        pos, rest = 0, len(at[0]) if end else 0
        while pos < end:
            options = at[pos]
            while rest:
                rest -= 1
                token = options[rest]
                after = pos + length[token]
                if not dead[after] and (not ids or self.compatible(ids[-1], token)):
                    ids.append(token)
                    left_to_try.append(rest)
                    pos = after
                    rest = len(at[pos]) if pos < end else 0
                    break
            else:
                dead[pos] = 1
                token = ids.pop()
                pos -= length[token]
                rest = left_to_try.pop()
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for part in self.split.findall(text):
            ids = known.get(part)
            if ids is None:
                ids = self.piece(part)
                if len(part) <= MEMO_CHARS:
                    if len(known) >= MEMO_PIECES:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shipped) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*shipped.value)
    return _ENCODERS[key]


def ship_vocabulary(spark: SparkSession, tokenizer_dir: str = DEFAULT_DIR, name: str = DEFAULT_NAME):
    """The vocabulary as a broadcast: its size is that of the file (about 1 MB), whatever the data."""
    path = f"{tokenizer_dir}/{name}.json"
    return path, spark.sparkContext.broadcast(read_vocabulary(path))


def encode(
    docs: DataFrame,
    text: str = "text",
    out: str = "ids",
    tokenizer_dir: str = DEFAULT_DIR,
    name: str = DEFAULT_NAME,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out``, the token ids of column ``text``, to the columns ``keep`` (default: all others).

    Special tokens are neither added nor recognised. A null and an empty text
    have the empty list. An input column named like ``out`` is replaced. Rows
    that repeat stay as many; an empty table gives an empty one. No shuffle:
    one pass over the rows with Arrow batches.
    """
    key, shipped = ship_vocabulary(docs.sparkSession, tokenizer_dir, name)
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c != out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(key, shipped)
        for batch in batches:
            offsets = np.zeros(batch.num_rows + 1, dtype=np.int32)
            flat: list[int] = []
            for i, value in enumerate(batch.column(len(kept)).to_pylist()):
                if value:
                    flat += coder.encode(value)
                offsets[i + 1] = len(flat)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], lists], names=[*kept, out])

    return source.mapInArrow(run, schema)


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    out: str = "n_tokens",
    tokenizer_dir: str = DEFAULT_DIR,
    name: str = DEFAULT_NAME,
    keep: list[str] | None = None,
) -> DataFrame:
    """As :func:`encode`, but ``out`` is only the number of ids (0 for a null or empty text)."""
    key, shipped = ship_vocabulary(docs.sparkSession, tokenizer_dir, name)
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c != out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.LongType())])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(key, shipped)
        for batch in batches:
            counts = [coder.count(v) if v else 0 for v in batch.column(len(kept)).to_pylist()]
            columns = [*[batch.column(i) for i in range(len(kept))], pa.array(counts, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return source.mapInArrow(run, schema)
