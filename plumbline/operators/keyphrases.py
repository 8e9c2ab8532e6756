"""Keyphrases of a text by similarity of embeddings, kept apart by maximal marginal relevance."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str], dims: int = 256) -> np.ndarray:
    """Unit vectors of hashed character trigrams and words: the stand-in where no model is at hand."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for g in [*t.split(" "), *[t[j : j + 3] for j in range(max(len(t) - 2, 1))]]:
            h = zlib.crc32(g.encode())
            out[i, h % dims] += 1.0 if h & 0x10000 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def marginal_relevance(doc: np.ndarray, terms: np.ndarray, top: int, diversity: float) -> list[int]:
    """Places of ``top`` terms near the document and, by ``diversity``, far from those taken before."""
    near = terms @ doc
    taken: list[int] = []
    left = list(range(len(terms)))
    while left and len(taken) < top:
        if taken:
            close = (terms[left] @ terms[taken].T).max(axis=1)
            score = (1 - diversity) * near[left] - diversity * close
        else:
            score = near[left]
        taken.append(left.pop(int(np.argmax(score))))
    return taken


def keyphrases(df: DataFrame, key: str, text: str, terms: str, top: int = 30, diversity: float = 0.5, embed: Embed = hashed_embedding) -> DataFrame:
    """(key, keyword, score): the text's terms nearest to it. ``embed`` may be any model that gives unit vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, ws in zip(batch[key], batch[text], batch[terms], strict=True):
                names = list(dict.fromkeys(ws)) if ws is not None else []
                if not names or t is None:
                    continue
                vectors = embed([t, *names])
                for i in marginal_relevance(vectors[0], vectors[1:], top, diversity):
                    rows.append((k, names[i], float(vectors[0] @ vectors[i + 1])))
            yield pd.DataFrame(rows, columns=[key, "keyword", "score"])

    return df.select(key, text, terms).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, keyword string, score double")
