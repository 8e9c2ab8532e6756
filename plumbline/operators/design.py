"""Experiment grids, fractions of layers, prior densities, column lookup."""

from __future__ import annotations

import math
import re
from itertools import product

from pyspark.sql import DataFrame, SparkSession


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """Every combination of the choices, one row each: as many rows as the product of the few choices."""
    names = list(choices)
    return spark.createDataFrame([tuple(c) for c in product(*choices.values())], names)


def fractions_to_layers(fractions: list[float], layers: int) -> list[int]:
    return sorted({min(layers - 1, max(0, int(f * layers))) for f in fractions})


def geometric(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)] if n > 1 else [low]


def beta_density(a: float, b: float, points: int = 200) -> list[tuple[float, float]]:
    """(x, density) of a Beta prior inside (0, 1)."""
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    xs = [(i + 0.5) / points for i in range(points)]
    return [(x, math.exp(norm + (a - 1) * math.log(x) + (b - 1) * math.log(1 - x))) for x in xs]


def flatten(config: dict, prefix: str = "") -> dict:
    """A nested mapping as dotted names."""
    out = {}
    for k, v in config.items():
        name = f"{prefix}{k}"
        out |= flatten(v, f"{name}.") if isinstance(v, dict) else {name: v}
    return out


def find_column(columns: list[str], *wanted: str) -> str | None:
    """The first column whose letters and digits equal, else hold, one of the wanted names."""
    plain = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in columns}
    targets = [re.sub(r"[^a-z0-9]", "", w.lower()) for w in wanted]
    for test in (lambda p, t: p == t, lambda p, t: t in p):
        for t in targets:
            for c, p in plain.items():
                if test(p, t):
                    return c
    return None
