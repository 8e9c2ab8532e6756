"""Queries over nested profiles, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import extras
from plumbline.operators.nested_records import VariantTables, flatten_records, profile_nodes
from plumbline.operators.relational import first_wins
from plumbline.plans.base import query, table
from plumbline.plans.companies import companies, results
from plumbline.plans.nested_sql import NODES
from plumbline.plans.texts import _TOKENS, cv_terms


_KEYED = NODES[:-1].replace("from raw_profiles", "from (select distinct profile_data as raw_id, profile_data from raw_profiles where json_valid(profile_data))")


@query(
    "profile_summary",
    _KEYED
    + """, e as (select raw_id as record, list((j->>'description') order by place) as told from experience_rows where place < 3 and json_type((j->'description')) not in ('OBJECT', 'ARRAY', 'NULL') group by 1),
p as (select distinct raw_id, profile_data from raw_profiles where json_valid(profile_data))
select p.raw_id, array_to_string(list_filter(list_concat([json_extract_string(profile_data, '$.summary'), json_extract_string(profile_data, '$.headline')], coalesce(e.told, [])), lambda x: x is not null and x <> ''), ' ') as profile_summary
from p left join e on p.profile_data = e.record""",
)
def profile_summary(spark, sf_dir):
    """Summary, headline and the descriptions of the first three experiences, whatever layout they are stored in."""
    p = table(spark, sf_dir, "raw_profiles").select("raw_id", "profile_data").distinct().filter(F.try_parse_json("profile_data").isNotNull())
    first = flatten_records(p.withColumn("key", F.struct("raw_id", F.xxhash64("profile_data").alias("record"))), "key", "profile_data")
    first = first.filter("kind = 'experience' and place < 3").select("key", F.struct("place", F.get_json_object("payload", "$.description").alias("d")).alias("e"))
    told = first.groupBy("key.raw_id", "key.record").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["d"]).alias("told"))
    told = told.select(F.col("raw_id").alias("owner"), F.col("record").alias("own"), "told")
    both = p.join(told, F.col("raw_id").eqNullSafe(F.col("owner")) & (F.xxhash64("profile_data") == F.col("own")), "left")
    parts = F.concat(F.array(*[F.get_json_object("profile_data", path) for path in ("$.summary", "$.headline")]), F.coalesce("told", F.array().cast("array<string>")))
    return both.select("raw_id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ").alias("profile_summary"))


_FLAT = ", ".join(f"(j->>'{k}')" for k in ("title", "company", "name", "authority", "field_of_study", "degree_name", "degree", "school", "description"))


@query(
    "profile_flatten",
    NODES
    + f"""select raw_id, string_agg(section, ' || ' order by s) as profile from (select raw_id, s, string_agg(t, ' | ' order by place, t) as section from (
  select distinct raw_id, place, t, case kind when 'experience' then 0 when 'certification' then 1 else 2 end as s from (select raw_id, kind, place,
    array_to_string(list_filter(list_transform([{_FLAT}], lambda x: nullif(trim(x, ' '), '')), lambda x: x is not null), ', ') as t from (select raw_id, kind, place, j from experience_rows union all select raw_id, kind, place, j from education_rows union all select raw_id, kind, place, j from certification_rows))
  where t <> '') group by 1, 2) group by 1""",
)
def profile_flatten(spark, sf_dir):
    """One text per profile from its sections, whatever layout they are stored in."""
    nodes = profile_nodes(spark, sf_dir)
    text = F.concat_ws(", ", *[F.nullif(F.trim(F.get_json_object("payload", f"$.{k}")), F.lit("")) for k in ("title", "company", "name", "authority", "field_of_study", "degree_name", "degree", "school", "description")])
    top = nodes.filter("parent_path is null").select("raw_id", "kind", "place", text.alias("t")).distinct().filter("t <> ''")
    order = F.when(F.col("kind") == "experience", 0).when(F.col("kind") == "certification", 1).otherwise(2)
    rows = top.groupBy("raw_id", order.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), " | ").alias("section"))
    return rows.groupBy("raw_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "section"))), lambda x: x["section"]), " || ").alias("profile"))


_TITLES = "titles as (select distinct raw_id, path, place, (j->>'title') as title, storage from experience_rows where json_type((j->'title')) not in ('OBJECT', 'ARRAY', 'NULL') and trim(j->>'title', ' ') <> '')"


@query(
    "profile_titles",
    NODES[:-1] + f""", t as (select distinct raw_id, path, place, storage, title from ({_TITLES[len('titles as (') : -1]})), last as (select raw_id, max(place) as last from t group by 1)
select t.raw_id, title, place, place = last as is_last from t join last on t.raw_id = last.raw_id""",
)
def profile_titles(spark, sf_dir):
    """All titles of a profile, and which is its last."""
    e = VariantTables(profile_nodes(spark, sf_dir), "raw_id").kind("experience").distinct().filter("title is not null and trim(title) <> ''")
    last = e.groupBy("raw_id").agg(F.max("place").alias("last"))
    return e.join(last, "raw_id").select("raw_id", "title", "place", (F.col("place") == F.col("last")).alias("is_last"))


@query("title_counts", NODES[:-1] + f", {_TITLES} select title, count(*) as count from titles group by 1")
def title_counts(spark, sf_dir):
    e = VariantTables(profile_nodes(spark, sf_dir), "raw_id").kind("experience").distinct()
    return e.filter("title is not null and trim(title) <> ''").groupBy("title").agg(F.count("*").alias("count"))


@query(
    "keyword_classes",
    f"""with {_TOKENS}, k as (select * from (values ('research', 'yes', 0.9), ('networks', 'yes', 0.8), ('published', 'yes', 0.9), ('learning', 'yes', 0.5), ('budgets', 'no', 0.8), ('clients', 'no', 0.7), ('team', 'no', 0.5), ('python', 'yes', 0.3)) as t(keyword, cls, score)),
hits as (select cv_id, unnest(list_distinct(ws)) as term from words), s as (select cv_id, cls, sum(score) as s, count(*) as n from hits join k on term = keyword group by 1, 2),
best as (select cv_id, arg_max(cls, (s, cls)) as category, max(s) / sum(s) as confidence, sum(n)::bigint as matches from s group by 1)
select w.cv_id, case when matches >= 3 then b.category end as category, case when matches >= 3 then confidence else 0.0 end as confidence, coalesce(matches, 0)::bigint as matches from words w left join best b on w.cv_id = b.cv_id""",
)
def keyword_classes(spark, sf_dir):
    """Category of each CV by weighted keywords, at least three of them."""
    weights = spark.createDataFrame(
        [("research", "yes", 0.9), ("networks", "yes", 0.8), ("published", "yes", 0.9), ("learning", "yes", 0.5), ("budgets", "no", 0.8), ("clients", "no", 0.7), ("team", "no", 0.5), ("python", "yes", 0.3)],
        "keyword string, category string, score double",
    )
    return extras.keyword_classes(cv_terms(spark, sf_dir), "cv_id", "terms", weights)


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("score", F.col("embedding")[0].cast("double"))
    return extras.clusters(e, "vec_id", "embedding", 10, "score")


@query("robust_slope")
def robust_slope(spark, sf_dir):
    """Median slope of log employees on log head count."""
    r = table(spark, sf_dir, "final_results_comparator_ml").filter("total_headcount > 0 and claude_total_employees > 0")
    slope, intercept = extras.theil_sen(r.select(F.log10("total_headcount").alias("x"), F.log10(F.col("claude_total_employees")).alias("y")), "x", "y")
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


@query(
    "group_variance",
    """with g as (select category, count(*) as n, avg(total_headcount) as m, var_pop(total_headcount) as v from (select distinct * from log_debias_company_aggregates)
  where category is not null and total_headcount is not null group by 1),
t as (select count(*) as k, sum(n) as n, sum(n * m * m) - power(sum(n * m), 2) / sum(n) as b, sum(n * v) as w from g)
select k as groups, round((b / (k - 1)) / (w / (n - k)), 6) as f, round(b / (b + w), 6) as eta2 from t""",
)
def group_variance(spark, sf_dir):
    told = extras.eta_squared(companies(spark, sf_dir), "category", "total_headcount")
    return told.select("groups", F.round("f", 6).alias("f"), F.round("eta2", 6).alias("eta2"))


@query(
    "loose_lookup",
    """with a as (select distinct company_name, regexp_replace(lower(company_name), '[^\\p{L}\\p{N}]', '', 'g') as n from log_debias_company_aggregates where company_name is not null),
b as (select regexp_replace(lower(company_name), '[^\\p{L}\\p{N}]', '', 'g') as m, min(result_id) as id from correlated_probit_bootstrap_results where company_name is not null group by 1),
c as (select a.company_name, arg_min(b.id, (length(b.m), b.m)) as id from a join b on contains(b.m, a.n) where length(a.n) >= 4 group by 1)
select a.company_name, coalesce(e.id, c.id) as id from a left join b e on a.n = e.m left join c on a.company_name = c.company_name""",
)
def loose_lookup(spark, sf_dir):
    names = companies(spark, sf_dir).select("company_name").filter("company_name is not null").distinct()
    return extras.loose_lookup(names, "company_name", results(spark, sf_dir).filter("company_name is not null"), "company_name", "result_id")


@query("keyphrases")
def keyphrases(spark, sf_dir):
    """Keyphrases of each CV, five per text, diverse."""
    from plumbline.operators.keyphrases import keyphrases as nearest

    # text and terms of the same row: the first text of each CV
    cvs = first_wins(table(spark, sf_dir, "validation_cvs").select("cv_id", "cv_text"), ["cv_id"], ["cv_text"])
    worded = cvs.select("cv_id", "cv_text", tx.tokens(F.col("cv_text")).alias("words"))
    return nearest(worded.select("cv_id", "cv_text", tx.ngrams(F.col("words"), [1, 2]).alias("terms")), "cv_id", "cv_text", "terms", top=5)


@query(
    "review_batches",
    """with d as (select doc_id, row_number() over (order by doc_id) as nr, substring(text, 1, 200) || case when length(text) > 200 then '...' else '' end as t from documents where source = 'recruiter_note' and text is not null)
select floor((nr - 1) / 10)::bigint as batch, count(*) as n, 'Judge each profile.' || chr(10) || chr(10) || string_agg('[' || doc_id || ']' || chr(10) || t, chr(10) || chr(10) order by nr) as prompt from d group by 1""",
)
def review_batches(spark, sf_dir):
    """Prompts of ten notes each, in order."""
    from plumbline.operators.prompts import batch_prompts, short
    from plumbline.operators.relational import group_index

    d = table(spark, sf_dir, "documents").filter("source = 'recruiter_note' and text is not null").select("doc_id", short(F.col("text"), 200).alias("t"))
    numbered = group_index(d, "doc_id", "nr", base=1)
    told = batch_prompts(numbered, "nr", "doc_id", "t", 10, "Judge each profile.")
    return told.select("batch", F.size("ids").cast("bigint").alias("n"), "prompt")
