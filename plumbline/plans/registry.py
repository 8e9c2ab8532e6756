"""Names of the core queries: name -> builder of a lazy DataFrame, and name -> SQL."""

from __future__ import annotations

from plumbline.operators import nested_records
from plumbline.plans import companies, files, labels, more, nested_sql, profiles, tables, texts  # noqa: F401  (they register their queries)
from plumbline.plans.base import QUERIES, SQL, Builder

KINDS = ("experience", "position", "project", "education", "certification")


def queries() -> dict[str, Builder]:
    out: dict[str, Builder] = {"p5_found": nested_records.p5_found, "p5_shapes": nested_records.p5_shapes}
    for kind in KINDS:
        out[f"p5_{kind}"] = nested_records.p5_table(kind)
    return out | QUERIES


def oracle_sql() -> dict[str, str]:
    nested = {f"p5_{kind}": nested_sql.table_sql(kind) for kind in KINDS}
    return {"p5_found": nested_sql.found_sql(), "p5_shapes": nested_sql.shapes_sql()} | nested | SQL
