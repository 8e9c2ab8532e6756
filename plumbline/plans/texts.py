"""Queries over texts: keyword flags, tokens, scores of terms, addresses, cleaning, verdict parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import keywords, text as tx
from plumbline.operators import relational, term_scores
from plumbline.plans.base import query, table

_WORD = "(^|[^a-z0-9_])({})([^a-z0-9_]|$)"
_BASE = _WORD.format("|".join(keywords.BASE_TERMS)).replace("'", "''")
_YES = keywords.word_pattern(keywords.BROAD_YES)
_NO = keywords.word_pattern(keywords.STRICT_NO)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "keyword_flags",
    f"""with f as (select doc_id, coalesce(regexp_matches(lower(text), '{_BASE}'), false) as b, coalesce(regexp_matches(lower(text), '{_YES}'), false) as y,
  not coalesce(regexp_matches(lower(text), '{_NO}'), false) as n from documents)
select doc_id, b::int as ml_match, y::int as broad_match, n::int as strict_no_match, (b and y)::int as filter_broad_yes, (b and n)::int as filter_strict_no,
  (b and y and n)::int as filter_broad_yes_strict_no from f""",
)
def keyword_flags(spark, sf_dir):
    return keywords.keyword_flags(documents(spark, sf_dir), "text", ["doc_id"])


LISTS = {
    "strict_yes": ["research on", "published on"],
    "broad_yes": ["research", "paper", "thesis", "published on"],
    "strict_no": ["clients", "budgets"],
    "broad_no": ["clients", "team", "handbook"],
}


def _cv_scores_sql() -> str:
    found = ", ".join(f"coalesce(regexp_matches(lower(cv_text), '{keywords.word_pattern(v)}'), false) as {k}" for k, v in LISTS.items())
    return f"""with f as (select cv_id, coalesce(regexp_matches(lower(cv_text), '{_BASE}'), false) as b, {found} from validation_cvs)
select cv_id, (b and strict_yes and not strict_no)::int as strict_yes_strict_no, (b and strict_yes and not broad_no)::int as strict_yes_broad_no,
  (b and broad_yes and not strict_no)::int as broad_yes_strict_no, (b and broad_yes and not broad_no)::int as broad_yes_broad_no, (b and strict_yes)::int as strict_yes_only,
  (b and broad_yes)::int as broad_yes_only, (b and not strict_no)::int as strict_no_only, (b and not broad_no)::int as broad_no_only from f"""


@query("keyword_cv_scores", _cv_scores_sql())
def keyword_cv_scores(spark, sf_dir):
    return keywords.score_columns(table(spark, sf_dir, "validation_cvs"), "cv_text", ["cv_id"], LISTS)




@query(
    "text_preprocess",
    r"""select doc_id, regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), '(^|[^a-z0-9_])[0-9]{1,2}\b', '\1', 'g') as processed from documents""",
)
def text_preprocess(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.preprocess(F.col("text")).alias("processed"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TOKENS = f"""words as (select cv_id, category, list_filter(regexp_extract_all(regexp_replace(lower(coalesce(cv_text, '')), '[a-z0-9_]*[0-9_][a-z0-9_]*', ' ', 'g'), '[a-z]{{2,}}'),
  lambda w: not list_contains([{_STOP}], w)) as ws from (select distinct cv_id, cv_text, category from validation_cvs)),
grams as (select cv_id, category, unnest(list_concat(ws, list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]))) as term from words)"""


def cv_terms(spark, sf_dir):
    cvs = table(spark, sf_dir, "validation_cvs").select("cv_id", "cv_text", "category").distinct()
    worded = cvs.select("cv_id", "category", tx.tokens(F.col("cv_text")).alias("words"))  # a column of its own, so words are cut once
    return worded.select("cv_id", "category", tx.ngrams(F.col("words"), [1, 2]).alias("terms"))


@query("ngram_counts", f"with {_TOKENS} select term, count(*) as n from grams where term is not null group by term having count(*) > 4")
def ngram_counts(spark, sf_dir):
    """1- and 2-grams without stop words that occur more than four times."""
    return cv_terms(spark, sf_dir).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter("n > 4")


_TFIDF = f"""with {_TOKENS}, docs as (select count(*) as n from words), tf as (select cv_id, category, term, count(*) as tf from grams where term is not null group by 1, 2, 3),
df as (select term, count(*) as df from tf group by term having count(*) >= 5), w as (select cv_id, category, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df on tf.term = df.term cross join docs),
norm as (select cv_id, sqrt(sum(w * w)) as l from w group by cv_id), size as (select category, count(*) as n from words where category is not null group by category),
mean as (select w.category, w.term, sum(w.w / norm.l) / max(size.n) as score from w join norm on w.cv_id = norm.cv_id join size on w.category = size.category group by 1, 2)"""


@query("tfidf_by_category", _TFIDF + " select category, term, round(score, 9) as score from mean")
def tfidf_by_category(spark, sf_dir):
    told = term_scores.tfidf_means(cv_terms(spark, sf_dir), "cv_id", "category", "terms", min_docs=5)
    return told.select("category", "term", F.round("score", 9).alias("score"))


@query(
    "discriminative_keywords",
    _TFIDF
    + """, freq as (select category, term, sum(tf) as f from tf where category is not null and term in (select term from df) group by 1, 2),
pair as (select mean.category, mean.term, f, score from mean join freq on mean.category = freq.category and mean.term = freq.term),
total as (select term, sum(f) as tf, sum(score) as ts from pair group by term),
k as (select count(distinct category) as k from size),
s as (select b.category, b.term, 0.5 * b.f / (b.f + (t.tf - b.f) / (k - 1)) + 0.5 * b.score / (b.score + (t.ts - b.score) / (k - 1)) as score, b.f from pair b join total t on b.term = t.term cross join k)
select category, term, round(score, 9) as score, f::bigint as frequency from (select *, row_number() over (partition by category order by round(score, 9) desc, f desc, term) as place from s where score > 0.6) where place <= 20""",
)
def discriminative_keywords(spark, sf_dir):
    return term_scores.discriminative(cv_terms(spark, sf_dir), "cv_id", "category", "terms", min_docs=5, least=0.6, top=20)


@query(
    "keyword_report",
    f"""with {_TOKENS}, f as (select category, term, count(*) as n from grams where category is not null and term is not null group by 1, 2)
select category, term, n from (select *, row_number() over (partition by category order by n desc, term) as place from f) where place <= 5""",
)
def keyword_report(spark, sf_dir):
    f = cv_terms(spark, sf_dir).filter("category is not null").select("category", F.explode("terms").alias("term")).groupBy("category", "term").agg(F.count("*").alias("n"))
    return relational.top_per_group(f, ["category"], [F.desc("n"), F.asc("term")], 5).select("category", "term", "n")


_ACADEMIC = "|".join(keywords.escaped(p) for p in keywords.ACADEMIC)


@query("affiliation_filter", f"select affiliation_id, affiliation from affiliations where not coalesce(regexp_matches(lower(affiliation), '{_ACADEMIC}'), true)")
def affiliation_filter(spark, sf_dir):
    a = table(spark, sf_dir, "affiliations")
    return a.filter(~keywords.is_academic(F.col("affiliation"))).select("affiliation_id", "affiliation")


@query(
    "affiliation_split",
    r"""with p as (select affiliation_id, affiliation, list_filter(list_transform(regexp_split_to_array(affiliation, '[,/]'), lambda x: trim(x, ' ')), lambda x: x <> '') as parts from affiliations),
s as (select affiliation_id, unnest(case when len(parts) > 1 then parts else [affiliation] end) as part from p)
select affiliation_id, regexp_replace(trim(regexp_replace(part, '[ \t\n\r\f\v]+', ' ', 'g'), ' '), '[^\p{L}\p{M}\p{N}_ ,.\-]', '', 'g') as part from s""",
)
def affiliation_split(spark, sf_dir):
    """Split at commas and slashes first, then clean, so that slashes count."""
    a = table(spark, sf_dir, "affiliations").select("affiliation_id", F.col("affiliation").alias("part"))
    return tx.split_rows(a, "part").select("affiliation_id", tx.clean(F.col("part")).alias("part"))


@query(
    "top_affiliations",
    "select affiliation, sum(count)::bigint as total from affiliations where count is not null and affiliation is not null group by 1 order by 2 desc, 1 limit 30",
)
def top_affiliations(spark, sf_dir):
    a = table(spark, sf_dir, "affiliations").na.drop(subset=["affiliation", "count"])
    return a.groupBy("affiliation").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "affiliation").limit(30)


@query(
    "url_slug",
    r"""with u as (select distinct result_id, 'https://www.linkedin.com/company/' || linkedin_id as url from correlated_probit_bootstrap_results)
select result_id, nullif(regexp_extract(url, '/(?:company|showcase)/([^/]+)/?$', 1), '') as slug, trim(url_decode(nullif(regexp_extract(url, '/(?:company-beta|company|showcase|school|organization-guest/company)/([^/?#]+)', 1), '')), ' ') as id from u""",
)
def url_slug(spark, sf_dir):
    r = table(spark, sf_dir, "correlated_probit_bootstrap_results").select("result_id", F.concat(F.lit("https://www.linkedin.com/company/"), "linkedin_id").alias("url")).distinct()
    return r.select("result_id", tx.company_slug(F.col("url")).alias("slug"), F.trim(tx.any_route_id(F.col("url"))).alias("id"))


@query(
    "id_repair",
    """with raw as (select raw_id, json_extract_string(try_cast(current_company as json), '$.company_id') as cid from raw_profiles where json_valid(current_company)),
known as (select distinct company_slug from documents where company_slug is not null),
t as (select raw_id, cid, trim(cid, ' ') as t0, lower(trim(cid, ' ')) as t1, lower(trim(url_decode(trim(cid, ' ')), ' ')) as t2, replace(lower(trim(url_decode(trim(cid, ' ')), ' ')), ' ', '-') as t3 from raw where cid is not null)
select distinct raw_id, cid, coalesce(a.company_slug, b.company_slug, c.company_slug, d.company_slug) as repaired from t
left join known a on t0 = a.company_slug left join known b on t1 = b.company_slug left join known c on t2 = c.company_slug left join known d on t3 = d.company_slug""",
)
def id_repair(spark, sf_dir):
    """Ids with blanks or escapes, brought back to known ones in order of trust."""
    raw = table(spark, sf_dir, "raw_profiles").select("raw_id", F.get_json_object("current_company", "$.company_id").alias("cid")).filter("cid is not null").distinct()
    known = documents(spark, sf_dir).select("company_slug").filter("company_slug is not null")
    return relational.repair_ids(raw, "cid", known, "company_slug")


@query(
    "verdict_lines",
    r"""select doc_id, nullif(regexp_extract(text, '\[([a-z0-9-]+)\]: (ACCEPT|REJECT)', 1), '') as profile, nullif(regexp_extract(text, '\[([a-z0-9-]+)\]: (ACCEPT|REJECT)', 2), '') as verdict
from documents where source = 'llm_rationale' and text is not null""",
)
def verdict_lines(spark, sf_dir):
    """Verdicts in the form "[id]: ACCEPT"."""
    d = documents(spark, sf_dir).filter("source = 'llm_rationale' and text is not null")
    p = r"\[([a-z0-9-]+)\]: (ACCEPT|REJECT)"
    return d.select("doc_id", F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("profile"), F.nullif(F.regexp_extract("text", p, 2), F.lit("")).alias("verdict"))


@query(
    "verdict_answers",
    r"""with d as (select doc_id, text, coalesce(nullif(regexp_extract(text, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1), ''), nullif(regexp_extract(text, '(?s)(\{[^{}]*\})', 1), '')) as o from documents where source = 'llm_rationale' and text is not null),
j as (select doc_id, text, case when json_valid(o) then o::json end as j from d)
select doc_id, coalesce(j->>'linkedin_id', nullif(regexp_extract(text, '\[([A-Za-z0-9-]+)\]: *(ACCEPT|REJECT)', 1), '')) as profile,
  coalesce(j->>'evaluation', nullif(regexp_extract(text, '\[([A-Za-z0-9-]+)\]: *(ACCEPT|REJECT)', 2), ''), 'RETRY_FAILED') as verdict from j""",
)
def verdict_answers(spark, sf_dir):
    """Verdicts in any form a model answers in: JSON, fenced JSON, an object within text, or lines."""
    d = documents(spark, sf_dir).filter("source = 'llm_rationale' and text is not null").select("doc_id", "text")
    schema = "struct<linkedin_id string, evaluation string, reason string>"
    fenced = F.nullif(F.regexp_extract("text", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    inner = F.nullif(F.regexp_extract("text", r"(?s)(\{[^{}]*\})", 1), F.lit(""))
    parsed = F.from_json(F.coalesce(fenced, inner), schema)
    line = r"\[([A-Za-z0-9-]+)\]: *(ACCEPT|REJECT)"
    return d.select(
        "doc_id",
        F.coalesce(parsed["linkedin_id"], F.nullif(F.regexp_extract("text", line, 1), F.lit(""))).alias("profile"),
        F.coalesce(parsed["evaluation"], F.nullif(F.regexp_extract("text", line, 2), F.lit("")), F.lit("RETRY_FAILED")).alias("verdict"),
    )


@query("crosstab_category", "select coalesce(source, 'none') as source, count_if(lang = 'en') as en, count_if(lang = 'de') as de, count_if(lang = 'fr') as fr, count_if(lang = 'es') as es, count(*) as total from documents group by 1")
def crosstab_category(spark, sf_dir):
    """Counts by source and language with totals: conditional counts in one aggregate."""
    d = documents(spark, sf_dir)
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(*[F.count_if(F.col("lang") == k).alias(k) for k in ("en", "de", "fr", "es")], F.count("*").alias("total"))


@query(
    "first_wins_profiles",
    "select public_identifier, raw_id, source_file from (select *, row_number() over (partition by public_identifier order by source_file nulls first, raw_id nulls first) as place from (select distinct public_identifier, raw_id, source_file from raw_profiles)) where place = 1",
)
def first_wins_profiles(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_profiles").select("public_identifier", "raw_id", "source_file")
    return relational.first_wins(raw, ["public_identifier"], ["source_file", "raw_id"])


@query("events_props", "select event_type, count(*) as n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by event_type")
def events_props(spark, sf_dir):
    """A field of a JSON column, summed by type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("total"))


@query("truncated_texts", "select doc_id, substring(text, 1, 200) as head, length(text) > 200 as cut from documents where text is not null and length(text) > 20")
def truncated_texts(spark, sf_dir):
    """Texts over a minimal length, shortened for display."""
    d = documents(spark, sf_dir).filter(F.length("text") > 20)
    return d.select("doc_id", F.substring("text", 1, 200).alias("head"), (F.length("text") > 200).alias("cut"))
