"""Queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import consensus, language, matching, mixing, terms, tokens, truncation, variants


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return tokens.encode(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": terms.p1_found,
        "p1_terms": terms.p1_terms,
        "p1_ngrams": terms.p1_ngrams,
        "p2_found": matching.p2_found,
        "p2_matches": matching.p2_matches,
        "p3_found": variants.p3_found,
        "p3_groups": variants.p3_groups,
        "p3_nicknames": variants.p3_nicknames,
        "p3_totals": variants.p3_totals,
        "p4_found": consensus.p4_found,
        "p4_items": consensus.p4_items,
        "p4_annotators": consensus.p4_annotators,
        "p4_totals": consensus.p4_totals,
        "p6_found": language.p6_found,
        "p6_texts": language.p6_texts,
        "p6_segments": language.p6_segments,
        "p7_ids": p7_ids,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p9_found": truncation.p9_found,
        "p9_scores": truncation.p9_scores,
        "p9_sources": truncation.p9_sources,
    }


_LATEST = """
with cv as (
  select cv_id, cv_text, category from (
    select *, row_number() over (partition by cv_id order by rated_at desc nulls last, ingested_at desc nulls last,
                                 cv_text desc nulls last, category desc nulls last) as place
    from cv_data) where place = 1),
texts as (select cv_id, regexp_extract_all(lower(nfc_normalize(cv_text)), '[\\p{L}\\p{N}]+') as words
          from cv where cv_text is not null and regexp_matches(cv_text, '\\S')),
counts as (
  select 'cv_text' as field, term, count(*) as occurrences, count(distinct cv_id) as records
  from (select cv_id, unnest(words) as term from texts) group by term
  union all
  select 'category', category, count(*), count(*) from cv where category is not null group by category),
sizes as (select 'cv_text' as field, count(*) as n from texts
          union all select 'category', count(*) from cv where category is not null),
marked as (
  select c.field, c.term, c.occurrences, c.records,
         case when c.records < 3 then 'rare' when c.records > 0.3 * s.n then 'common' end as mark
  from counts c join sizes s on c.field = s.field)
"""


def _ngrams() -> str:
    """Counts of the n-grams of the lengths of ``p1_ngrams``: windows of the word lists, unrolled."""
    grams = " union all ".join(
        f"select {n}::int as n, cv_id, unnest([array_to_string(words[i:i + {n - 1}], ' ') for i in range(1, len(words) - {n} + 2)]) as term from texts"
        for n in terms.NGRAMS
    )
    return f"""{_LATEST}, grams as ({grams}), total as (select count(*) as n from texts)
select g.n, g.term, count(*) as occurrences, count(distinct g.cv_id) as records,
       case when count(distinct g.cv_id) < 3 then 'rare' when count(distinct g.cv_id) > 0.3 * any_value(t.n) then 'common' end as mark
from grams g, total t group by g.n, g.term"""


def oracle_sql() -> dict[str, str]:
    totals = ["claude_total_accepted", "gpt5_total_accepted", "gemini_total_accepted"]
    apart = []
    for name in totals:
        a, b = (t for t in totals if t != name)
        apart.append(f"""
select distinct company_id, '{name}' as total from log_debias_company_aggregates
where company_id is not null and {name} is not null and {a} is not null and {b} is not null
  and least({a}, {b}) > 0 and greatest({a}, {b}) <= 1.5 * least({a}, {b})
  and ({name} >= 4 * greatest({a}, {b}) or {name} <= least({a}, {b}) / 4)""")
    return {
        "p1_found": _LATEST + "select field, term, mark from marked where mark is not null",
        "p1_terms": _LATEST + "select field, term, occurrences, records, mark from marked",
        "p1_ngrams": _ngrams(),
        "p4_totals": " union all ".join(apart),
    }
