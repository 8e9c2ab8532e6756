"""Contracts of tables: columns, types, nulls and ranges, all checked in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str
    nullable: bool = True
    low: float | None = None
    high: float | None = None


_COUNT = dict(kind="bigint", nullable=False, low=0)
CONTRACTS: dict[str, list[Rule]] = {
    "cv_data": [Rule("cv_text", "string", False), Rule("category", "string", False)],
    "affiliations": [Rule("affiliation", "string", False), Rule("count", **_COUNT)],
    "company_base": [Rule("id", "string", False), Rule("employees", **_COUNT), Rule("company_size", "string", False), Rule("employees_in_linkedin", **_COUNT)],
    "profiles": [Rule("public_identifier", "string", False), Rule("profile_summary", "string", False), Rule("company_id", "string", False), Rule("company_name", "string")],
    "keyword_frequencies": [Rule("phrase", "string", False), Rule("count", "bigint", False, 1)],
    "keyword_results": [Rule("keyword", "string", False), Rule("category", "int", False), Rule("frequency", "bigint", False, 1), Rule("score", "double", False, -1, 1)],
    "titles": [Rule("title", "string", False), Rule("count", "bigint", False, 1)],
    "confusion_metrics": [Rule("method", "string", False), *[Rule(c, **_COUNT) for c in ("TP", "FP", "FN", "TN")], *[Rule(c, "double", False, 0, 1) for c in ("sensitivity", "specificity", "precision", "recall", "f1", "accuracy")]],
}


def contract(name: str) -> list[Rule]:
    if name not in CONTRACTS:
        raise ValueError(f"no contract named {name}; there are {', '.join(sorted(CONTRACTS))}")
    return CONTRACTS[name]


def violations(df: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """Number of offending rows per broken rule; a missing or wrongly typed column counts -1. Further columns are allowed."""
    types = dict(df.dtypes)
    out, checks = {}, []
    for r in rules:
        if r.column not in types:
            out[f"{r.column}: missing"] = -1
            continue
        if types[r.column] != r.kind:
            out[f"{r.column}: {types[r.column]} instead of {r.kind}"] = -1
            continue
        c = F.col(r.column)
        if not r.nullable:
            checks.append(F.count_if(c.isNull()).alias(f"{r.column}: null"))
        if r.low is not None:
            checks.append(F.count_if(c < r.low).alias(f"{r.column}: below {r.low:g}"))
        if r.high is not None:
            checks.append(F.count_if(c > r.high).alias(f"{r.column}: above {r.high:g}"))
    if checks:
        row = df.agg(*checks).first().asDict()
        out |= {k: n for k, n in row.items() if n}
    return out


def validated(df: DataFrame, name: str) -> DataFrame:
    """The table itself, or an error that names every broken rule."""
    broken = violations(df, contract(name))
    if broken:
        raise ValueError(f"{name}: " + "; ".join(f"{k} ({n})" for k, n in broken.items()))
    return df
