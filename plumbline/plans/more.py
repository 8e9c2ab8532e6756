"""Queries of filters, lookups, assemblies and formats, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import evalprep, metrics, relational, selection
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.base import query, table
from plumbline.plans.companies import companies, debiased, results
from plumbline.plans.labels import ANNOTATORS, validation
from plumbline.plans.sql import COMPANIES, LOGS
from plumbline.plans.texts import _TFIDF, _TOKENS, cv_terms, documents

RESULTS = "(select distinct * from correlated_probit_bootstrap_results)"
FORBIDDEN = ["might", "method", "problem", "best", "potential impact", "most effective"]


@query(
    "size_filters",
    "select c_custkey from (select c_custkey, concat_ws(chr(9), c_custkey, c_name, c_mktsegment) as line, c_name, c_mktsegment, c_acctbal from customer) where not contains(line, 'BUILDING') and (c_mktsegment = 'MACHINERY' or c_acctbal > 5000) and contains(c_name, '01')",
)
def size_filters(spark, sf_dir):
    """Rows whose whole line lacks a text, with one of two ratings, and whose name holds another."""
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    rated = (F.col("c_mktsegment") == "MACHINERY") | (F.col("c_acctbal") > 5000)
    return c.filter(~line.contains("BUILDING") & rated & F.col("c_name").contains("01")).select("c_custkey")


@query(
    "forbidden_parts",
    "select doc_id from documents where not (" + " or ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in FORBIDDEN) + ") and length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) < 8",
)
def forbidden_parts(spark, sf_dir):
    """Texts without any of some parts and with fewer than eight digits."""
    d = documents(spark, sf_dir)
    return d.filter(~selection.holds_any(F.col("text"), FORBIDDEN) & (selection.digits(F.col("text")) < 8)).select("doc_id")


@query("has_number", "select doc_id, regexp_matches(text, '[0-9]') as has_number, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits from documents where text is not null")
def has_number(spark, sf_dir):
    d = documents(spark, sf_dir).filter("text is not null")
    return d.select("doc_id", F.col("text").rlike("[0-9]").alias("has_number"), selection.digits(F.col("text")).cast("bigint").alias("digits"))


_SPECIFIC = (
    _TFIDF
    + """, freq as (select category, term, sum(tf) as f from tf where category is not null and term in (select term from df) group by 1, 2),
pair as (select mean.category, mean.term, f, score from mean join freq on mean.category = freq.category and mean.term = freq.term),
total as (select term, sum(f) as tf, sum(score) as ts from pair group by term),
s as (select b.category, b.term, b.f as frequency, round(b.score / t.ts, 9) as score, round(b.f / t.tf, 9) as specificity from pair b join total t on b.term = t.term)"""
)


def _specific(spark, sf_dir) -> DataFrame:
    from plumbline.operators.term_scores import tfidf_means

    terms = cv_terms(spark, sf_dir)
    scores = tfidf_means(terms, "cv_id", "category", "terms", min_docs=5)
    freq = terms.filter("category is not null").select("category", F.explode("terms").alias("term")).groupBy("category", "term").agg(F.count("*").alias("frequency"))
    both = scores.join(freq, ["category", "term"])
    total = both.groupBy("term").agg(F.sum("frequency").alias("tf"), F.sum("score").alias("ts"))
    return both.join(total, "term").select("category", "term", "frequency", F.round(F.col("score") / F.col("ts"), 9).alias("score"), F.round(F.col("frequency") / F.col("tf"), 9).alias("specificity"))


@query(
    "keyword_lists",
    _SPECIFIC
    + """ select term as keyword, category, list from (select *, unnest(['broad', 'strict']) as list from s where frequency >= 5)
where score >= case list when 'broad' then 0.8 else 0.9 end and specificity >= case list when 'broad' then 0.7 else 0.8 end""",
)
def keyword_lists(spark, sf_dir):
    """Broad and strict keywords of each category by score, specificity and frequency."""
    return selection.keyword_lists(_specific(spark, sf_dir).withColumnRenamed("term", "keyword"), "category", "keyword", "frequency", "score", "specificity")


@query(
    "keyword_exclusion",
    f"with {_TOKENS}, n as (select term, count(*) as n from grams where term is not null group by 1) select term, n from n where lower(term) not in (select lower(company_slug) from documents where company_slug is not null) and term not in (select t.term from n t order by t.n desc, t.term limit 100)",
)
def keyword_exclusion(spark, sf_dir):
    """Keywords that two lists leave out: known company names, and the hundred commonest."""
    n = cv_terms(spark, sf_dir).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    common = n.orderBy(F.desc("n"), "term").limit(100)
    kept = selection.without_listed(n, "term", documents(spark, sf_dir), "company_slug")
    return kept.join(common.select("term"), "term", "left_anti")


@query("stop_word_union", "select term from (select unnest([" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS[:40]) + "]) as term union select lower(category) from cv_data where category is not null)")
def stop_word_union(spark, sf_dir):
    """Two sets of words as one."""
    words = spark.createDataFrame([(w,) for w in tx.STOP_WORDS[:40]], "term string")
    return words.union(table(spark, sf_dir, "cv_data").select(F.lower("category")).filter("lower(category) is not null")).distinct()


@query(
    "first_known_profiles",
    """with r as (select distinct public_identifier, raw_id, source_file, fetched_at from raw_profiles where public_identifier is not null)
select public_identifier, arg_min(raw_id, (coalesce(source_file, ''), raw_id)) as raw_id, arg_min(source_file, (coalesce(source_file, ''), raw_id)) filter (where source_file is not null) as source_file,
  arg_min(fetched_at, (coalesce(source_file, ''), raw_id)) filter (where fetched_at is not null) as fetched_at from r group by 1""",
)
def first_known_profiles(spark, sf_dir):
    """Of each column the first value that is not null."""
    raw = table(spark, sf_dir, "raw_profiles").select("public_identifier", "raw_id", "source_file", "fetched_at").distinct()
    return relational.first_known(raw, ["public_identifier"], [F.coalesce("source_file", F.lit("")), "raw_id"])


@query(
    "headcount_lookup",
    f"""with c as (select company_id, total_headcount as employees from {COMPANIES}), db as (select organization_name, max(total_headcount) as total_headcount from final_results_comparator_ml where organization_name is not null group by 1),
n as (select distinct company_id, organization_name, total_headcount from {COMPANIES})
select n.company_id, n.total_headcount, db.total_headcount as total_headcount_db, db.total_headcount is null as unknown,
  coalesce(db.total_headcount > 3 * n.total_headcount or db.total_headcount * 3 < n.total_headcount, false) as mismatch from n left join db on n.organization_name = db.organization_name""",
)
def headcount_lookup(spark, sf_dir):
    """Head counts looked up in another table whose column has the same name, which gets the suffix ``_db``."""
    n = companies(spark, sf_dir).select("company_id", "organization_name", "total_headcount").distinct()
    db = table(spark, sf_dir, "final_results_comparator_ml").filter("organization_name is not null").groupBy(F.col("organization_name").alias("__name")).agg(F.max("total_headcount").alias("total_headcount_db"))
    joined = n.join(db, F.col("organization_name") == F.col("__name"), "left")
    far = (F.col("total_headcount_db") > 3 * F.col("total_headcount")) | (F.col("total_headcount_db") * 3 < F.col("total_headcount"))
    return joined.select("company_id", "total_headcount", "total_headcount_db", F.col("total_headcount_db").isNull().alias("unknown"), F.coalesce(far, F.lit(False)).alias("mismatch"))


_REAL = f"select linkedin_id, mean, q10, q50, q90 from (select *, row_number() over (partition by linkedin_id order by result_id) as place from {RESULTS} where linkedin_id is not null) where place = 1"
_SYNTHETIC = f"select linkedin_id, mean, q10, q50, q90 from (select *, row_number() over (partition by linkedin_id order by result_id desc) as place from {RESULTS} where linkedin_id is not null) where place = 1"


def _estimates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = results(spark, sf_dir).filter("linkedin_id is not null").select("linkedin_id", "result_id", "mean", "q10", "q50", "q90")
    first = relational.first_wins(r, ["linkedin_id"], ["result_id"])
    last = r.groupBy("linkedin_id").agg(F.max_by(F.struct("mean", "q10", "q50", "q90"), "result_id").alias("l")).select("linkedin_id", "l.*")
    return first.drop("result_id"), last


@query(
    "final_results_full",
    f"""with real as ({_REAL}), synthetic as ({_SYNTHETIC}),
ratio as (select s.mean / r.q50 as ratio from synthetic s join real r using (linkedin_id) where r.q50 >= 1 and s.mean > 0), factor as (select coalesce(quantile_cont(ratio, 0.5), 1.0) as f from ratio),
c as (select distinct id, linkedin_id, 'ml' as dataset from final_results_comparator_ml)
select c.id, c.dataset, r.mean as real_mean, r.q50 as real_q50, coalesce(s.mean, 0) as synthetic_mean, coalesce(s.q50, 0) as synthetic_q50,
  round(coalesce(s.mean, 0) / f, 6) as adjusted_mean, round(coalesce(s.q50, 0) / f, 6) as adjusted_q50,
  (dense_rank() over (order by c.linkedin_id nulls last) - 1)::bigint as grp
from c left join real r on c.linkedin_id = r.linkedin_id left join synthetic s on c.linkedin_id = s.linkedin_id cross join factor where c.linkedin_id is not null""",
)
def final_results_full(spark, sf_dir):
    """Master, real and synthetic estimates, the latter divided by the median ratio of both, tagged by dataset and numbered by company."""
    real, synthetic = _estimates(spark, sf_dir)
    s = synthetic.select("linkedin_id", F.col("mean").alias("s"))
    ratios = s.join(real, "linkedin_id").filter("q50 >= 1 and s > 0").select((F.col("s") / F.col("q50")).alias("ratio"))
    factor = exact_quantiles(ratios, "ratio", [0.5])[0]
    c = table(spark, sf_dir, "final_results_comparator_ml").select("id", "linkedin_id", F.lit("ml").alias("dataset")).filter("linkedin_id is not null").distinct()
    told = selection.final_results(c, "linkedin_id", real, synthetic, 1.0 if factor is None else factor, ["mean", "q50"])
    told = relational.group_index(told, "linkedin_id", "grp")
    return told.select("id", "dataset", "real_mean", "real_q50", "synthetic_mean", "synthetic_q50", F.round("adjusted_mean", 6).alias("adjusted_mean"), F.round("adjusted_q50", 6).alias("adjusted_q50"), "grp")


@query(
    "ratio_extraction",
    f"""with real as ({_REAL}), synthetic as ({_SYNTHETIC}) select f.id, round(s.mean / r.q50, 9) as ratio from final_results_comparator_ml f
left join real r on f.linkedin_id = r.linkedin_id left join synthetic s on f.linkedin_id = s.linkedin_id where r.q50 >= 1 and s.mean > 0""",
)
def ratio_extraction(spark, sf_dir):
    real, synthetic = _estimates(spark, sf_dir)
    f = table(spark, sf_dir, "final_results_comparator_ml").select("id", "linkedin_id")
    both = f.join(real.select("linkedin_id", "q50"), "linkedin_id", "left").join(synthetic.select("linkedin_id", F.col("mean").alias("s")), "linkedin_id", "left")
    return both.filter("q50 >= 1 and s > 0").select("id", F.round(F.col("s") / F.col("q50"), 9).alias("ratio"))


@query(
    "prevalence_comparison",
    f"with b as (select linkedin_id, avg(mean) as estimate from {RESULTS} where linkedin_id is not null group by 1) select f.id, round(f.claude_total_accepted / nullif(f.total_headcount, 0), 9) as stored, round(b.estimate, 6) as estimate from final_results_comparator_ml f join b on f.linkedin_id = b.linkedin_id",
)
def prevalence_comparison(spark, sf_dir):
    """Two sources joined on keys of different names, each with its own rate."""
    b = results(spark, sf_dir).filter("linkedin_id is not null").groupBy(F.col("linkedin_id").alias("company")).agg(F.avg("mean").alias("estimate"))
    f = table(spark, sf_dir, "final_results_comparator_ml")
    stored = F.round(F.try_divide("claude_total_accepted", F.nullif("total_headcount", F.lit(0))), 9)
    return f.join(b, F.col("linkedin_id") == F.col("company")).select("id", stored.alias("stored"), F.round("estimate", 6).alias("estimate"))


@query(
    "verdict_enrichment",
    """with dim as (select company_slug, arg_min(source, (doc_id)) as source from documents where company_slug is not null and source is not null group by 1),
r as (select distinct raw_id, json_extract_string(try_cast(current_company as json), '$.company_id') as cid from raw_profiles where json_valid(current_company))
select r.raw_id, r.cid, dim.source from r left join dim on r.cid = dim.company_slug""",
)
def verdict_enrichment(spark, sf_dir):
    """Records with the first known entry of their company."""
    dim = documents(spark, sf_dir).filter("company_slug is not null and source is not null").groupBy("company_slug").agg(F.min_by("source", "doc_id").alias("source"))
    valid = table(spark, sf_dir, "raw_profiles").filter(F.try_parse_json("current_company").isNotNull())
    r = valid.select("raw_id", F.get_json_object("current_company", "$.company_id").alias("cid")).distinct()
    return r.join(dim, F.col("cid") == F.col("company_slug"), "left").select("raw_id", "cid", "source")


@query(
    "plot_estimates",
    f"""with {LOGS}, r as (select company_name, max(q50) as probit, max(q90) as q90, max(q10) as q10 from {RESULTS} where company_name is not null group by 1)
select d.company_id, d.total_headcount, d.ml_consensus_round as debiased, r.probit, case when r.probit is not null then 'probit' when d.ml_consensus_round is not null then 'log_debias' else 'none' end as origin,
  coalesce(r.probit, d.ml_consensus_round) as estimate, round(coalesce(r.q90, d.ml_upper80_round) / nullif(coalesce(r.q10, d.ml_lower80_round), 0), 6) as uncertainty,
  case when d.total_headcount >= 500 and d.ml_share >= 0.005 then 'Giant' when d.total_headcount >= 50 and d.ml_share >= 0.01 then 'Powerhouse' when d.ml_share >= 0.05 then 'Emerging' else 'Other' end as landscape
from debiased d left join r on d.company_name = r.company_name""",
)
def plot_estimates(spark, sf_dir):
    """What the charts show: the estimate of each company with its origin, its uncertainty and its place in the landscape."""
    d = debiased(spark, sf_dir)
    r = results(spark, sf_dir).filter("company_name is not null").groupBy(F.col("company_name").alias("__name")).agg(F.max("q50").alias("probit"), F.max("q90").alias("q90"), F.max("q10").alias("q10"))
    j = d.join(r, F.col("company_name") == F.col("__name"), "left")
    share, size = F.col("ml_share"), F.col("total_headcount")
    spread = F.try_divide(F.coalesce("q90", F.col("ml_upper80_round").cast("double")), F.nullif(F.coalesce("q10", F.col("ml_lower80_round").cast("double")), F.lit(0.0)))
    return j.select(
        "company_id",
        "total_headcount",
        F.col("ml_consensus_round").alias("debiased"),
        "probit",
        F.when(F.col("probit").isNotNull(), "probit").when(F.col("ml_consensus_round").isNotNull(), "log_debias").otherwise("none").alias("origin"),
        F.coalesce("probit", F.col("ml_consensus_round").cast("double")).alias("estimate"),
        F.round(spread, 6).alias("uncertainty"),
        F.when((size >= 500) & (share >= 0.005), "Giant").when((size >= 50) & (share >= 0.01), "Powerhouse").when(share >= 0.05, "Emerging").otherwise("Other").alias("landscape"),
    )


_GROUPS = "select c_mktsegment as g, c_acctbal::double as v from customer where c_mktsegment is not null and c_acctbal is not null"


@query(
    "predictive_check",
    f"""with x as ({_GROUPS}), m as (select avg(v) as obs from x)
select g, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high,
  round(least(1, 2 * least(avg((v >= obs)::int), avg((v <= obs)::int))), 9) as p, max(obs) between quantile_cont(v, 0.025) and quantile_cont(v, 0.975) as in_ci from x cross join m group by g""",
)
def predictive_check(spark, sf_dir):
    """Draws of each group against an observed value: mean, deviation, 95 % interval, two-sided p and whether the value lies inside."""
    x = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").cast("double").alias("v")).na.drop()
    observed = x.agg(F.avg("v")).first()[0]
    return metrics.predictive_check(x, "g", "v", F.lit(observed))


@query(
    "estimator_ranking",
    f"""with l as (select m, e, mean as truth from (select mean, unnest(['q10', 'q50', 'q90']) as m, unnest([q10, q50, q90]) as e from {RESULTS}) where e is not null and mean is not null),
a as (select m as estimator, round(sqrt(avg(power(e - truth, 2))), 6) as rmse, round(avg(abs(e - truth)), 6) as mae, round(max(abs(e - truth)), 6) as worst, round(avg((abs(e - truth) <= 0.1 * abs(truth))::int), 9) as near from l group by 1)
select *, rank() over (order by rmse) as place from a""",
)
def estimator_ranking(spark, sf_dir):
    """Estimators by their error against a known value."""
    r = results(spark, sf_dir).filter("mean is not null")
    return metrics.rank_estimators(r, "mean", ["q10", "q50", "q90"])


@query(
    "covariance_summary",
    "with r as (" + " union all ".join(f"select category, '{a}' as a, '{b}' as b, covar_pop({a}, {b}) as c from (select distinct * from validation_cvs) where category is not null group by 1" for i, a in enumerate(ANNOTATORS) for b in ANNOTATORS[i + 1 :]) + """)
select a, b, round(avg(c), 9) as mean, round(stddev_pop(c), 9) as std, round(min(c), 9) as low, round(max(c), 9) as high from r group by 1, 2""",
)
def covariance_summary(spark, sf_dir):
    """Covariance of each pair of annotators over the categories: mean, deviation, least and largest."""
    v = validation(spark, sf_dir).filter("category is not null")
    pairs = [(a, b) for i, a in enumerate(ANNOTATORS) for b in ANNOTATORS[i + 1 :]]
    wide = v.groupBy("category").agg(*[F.covar_pop(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("c")) for i, (a, b) in enumerate(pairs)])
    long = wide.select(F.explode(entries).alias("e")).select("e.*")
    return long.groupBy("a", "b").agg(*[F.round(f("c"), 9).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))])


_RHO = " union all ".join(f"select category, '{a}_{b}' as pair, round(coalesce(corr({a}, {b}), 0), 6) as rho from (select distinct * from validation_cvs) where category is not null group by 1" for i, a in enumerate(ANNOTATORS) for b in ANNOTATORS[i + 1 :])


@query("upper_triangle", f"pivot ({_RHO}) on pair using first(rho) group by category")
def upper_triangle(spark, sf_dir):
    """The upper triangle of each class's correlation matrix as named columns."""
    v = validation(spark, sf_dir).filter("category is not null")
    return v.groupBy("category").agg(*[F.round(F.coalesce(F.corr(a, b), F.lit(0.0)), 6).alias(f"{a}_{b}") for i, a in enumerate(ANNOTATORS) for b in ANNOTATORS[i + 1 :]])


_FILTERS = ANNOTATORS[3:]


@query(
    "filter_distance",
    "with r as (" + " union all ".join(f"select category, '{a}_{b}' as pair, coalesce(corr({a}, {b}), 0) as rho from (select distinct * from validation_cvs) where category is not null group by 1" for i, a in enumerate(_FILTERS) for b in _FILTERS[i + 1 :]) + """)
select round(avg(abs(x.rho - y.rho)), 9) as mean_abs, count(*) as pairs from r x join r y using (pair) where x.category = 0 and y.category = 1""",
)
def filter_distance(spark, sf_dir):
    """Mean distance of two classes over the three pairs of filters."""
    v = validation(spark, sf_dir).filter("category in (0, 1)")
    pairs = [(a, b) for i, a in enumerate(_FILTERS) for b in _FILTERS[i + 1 :]]
    wide = v.groupBy("category").agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    one = wide.select("category", F.posexplode(F.array(*[F.col(f"`{i}`") for i in range(len(pairs))])).alias("pair", "rho"))
    both = one.groupBy("pair").agg(F.abs(F.max(F.when(F.col("category") == 0, F.col("rho"))) - F.max(F.when(F.col("category") == 1, F.col("rho")))).alias("gap"))
    return both.agg(F.round(F.avg("gap"), 9).alias("mean_abs"), F.count("gap").alias("pairs"))


@query(
    "discrepancy_top",
    """with a as (select comparator_id as id, count(distinct cv_id) as actual from cv_data where comparator_id is not null group by 1),
d as (select f.id, f.total_headcount - a.actual as diff from final_results_comparator_ml f join a on f.id = a.id where f.total_headcount - a.actual > 10)
select id, diff from d order by diff desc, id limit 10""",
)
def discrepancy_top(spark, sf_dir):
    """The ten largest signed differences between stored and counted totals."""
    actual = table(spark, sf_dir, "cv_data").filter("comparator_id is not null").groupBy(F.col("comparator_id").alias("cid")).agg(F.countDistinct("cv_id").alias("actual"))
    d = table(spark, sf_dir, "final_results_comparator_ml").join(actual, F.col("id") == F.col("cid")).select("id", (F.col("total_headcount") - F.col("actual")).alias("diff"))
    return d.filter("diff > 10").orderBy(F.desc("diff"), "id").limit(10)


_ARGMAX = "select label as file, (vec_id % 4)::int as answer, list_position([sin(vec_id), sin(vec_id * 2.0), sin(vec_id * 3.0)], list_max([sin(vec_id), sin(vec_id * 2.0), sin(vec_id * 3.0)])) - 1 as guess from embeddings"


@query("class_shares", f"select guess::int as guess, round(count(*) / sum(count(*)) over (), 9) as share from ({_ARGMAX}) group by 1")
def class_shares(spark, sf_dir):
    """Shares of the classes that are guessed."""
    v = F.col("vec_id").cast("double")
    logits = F.array(F.sin(v), F.sin(v * 2.0), F.sin(v * 3.0))
    counts = table(spark, sf_dir, "embeddings").groupBy((F.array_position(logits, F.array_max(logits)) - 1).cast("int").alias("guess")).agg(F.count("*").alias("n"))
    everyone = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the classes
    return counts.select("guess", F.round(F.col("n") / everyone, 9).alias("share"))


@query("group_prevalence", "select annotator_id, count(*) as n, count_if(lower(trim(label, ' ')) in ('1', 'y', 'yes', 'true')) as positives, round(coalesce(count_if(lower(trim(label, ' ')) in ('1', 'y', 'yes', 'true')) / nullif(count(label), 0), 0), 9) as prevalence from cv_annotations group by 1")
def group_prevalence(spark, sf_dir):
    """Totals, positives and observed prevalence per group; 0 for a group without labels."""
    yes = F.count_if(F.lower(F.trim("label")).isin("1", "y", "yes", "true"))
    return table(spark, sf_dir, "cv_annotations").groupBy("annotator_id").agg(
        F.count("*").alias("n"), yes.alias("positives"), F.round(F.coalesce(F.try_divide(yes, F.count("label")), F.lit(0.0)), 9).alias("prevalence")
    )


@query("md5_groups", "select distinct company_id, list_reduce(list_transform(range(8), lambda i: ('0x' || substr(md5(company_id), i::int * 4 + 1, 4))::bigint), lambda a, b: (a * 65536 + b) % 1000000000)::bigint as grp from log_debias_company_aggregates where company_id is not null")
def md5_groups(spark, sf_dir):
    """A group number that any process derives from the id."""
    c = table(spark, sf_dir, "log_debias_company_aggregates").select("company_id").filter("company_id is not null").distinct()
    return c.select("company_id", selection.md5_group(F.col("company_id")).alias("grp"))


@query("ranged_read", "select doc_id, nr from (select doc_id, row_number() over (order by doc_id) as nr from documents where trim(text) <> '') where nr between 101 and 300")
def ranged_read(spark, sf_dir):
    """Rows 101 to 300 of those that are not blank."""
    d = documents(spark, sf_dir).filter("trim(text) <> ''").select("doc_id")
    return selection.ranged(relational.group_index(d, "doc_id", "nr", base=1), "nr", 101, 300)


@query(
    "stratified_split",
    "select c_mktsegment as segment, floor(count(*) * 0.2)::bigint as test, (count(*) - floor(count(*) * 0.2))::bigint as train from customer group by 1",
)
def stratified_split(spark, sf_dir):
    """Rows of either part by stratum: a fifth of each is held out."""
    told = selection.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2)
    return told.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train").alias("train"))


@query(
    "shuffled_splits",
    "select s.split::int as split, (select count(*) from range(200) r where r.range % 4 = s.split)::bigint as n from (select unnest(range(4)) as split) s",
)
def shuffled_splits(spark, sf_dir):
    """A seeded shuffle cut to 250 rows, the first 50 held out, the rest dealt in turn to four parts."""
    c = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return evalprep.strided_splits(c, "o_orderkey", most=250, held=50, k=4).filter("split >= 0").groupBy("split").agg(F.count("*").alias("n"))


_Q = """q as (select n_nationkey as id, 'Which region is ' || n_name || ' in?' as question, c.choices, n_regionkey::int as answer from nation
  cross join (select list(r_name order by r_regionkey) as choices from region where r_regionkey < 4) c where n_regionkey < 4)"""


@query(
    "true_false_prompts",
    f"with {_Q}, e as (select id, question, answer, choices, unnest(range(4))::int as i from q) select id, i as choice, question || chr(10) || choices[i + 1] || chr(10) || 'True or false? Answer: ' || case when i = answer then 'True' else 'False' end as prompt from e",
)
def true_false_prompts(spark, sf_dir):
    """Each choice of a question as a statement to judge."""
    from plumbline.plans.tables import questions

    return questions(spark, sf_dir).select("id", F.posexplode(evalprep.true_false(F.col("question"), F.col("choices"), F.col("answer"))).alias("choice", "prompt"))


@query(
    "k_shot_prompts",
    f"""with {_Q}, p as (select id, question || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4] || chr(10) || 'Answer:' as open,
  ' ' || ['A', 'B', 'C', 'D'][answer + 1] as letter from q), shots as (select string_agg(open || letter, chr(10) || chr(10) order by id) as head from (select * from p order by id limit 3))
select p.id, head || chr(10) || chr(10) || open as prompt, trim(letter) as completion, head || chr(10) || chr(10) || open || letter as text from p cross join shots where p.id not in (select id from p order by id limit 3)""",
)
def k_shot_prompts(spark, sf_dir):
    """Prompts with three solved questions before the open one, the letter to complete them with, and both merged."""
    from plumbline.plans.tables import questions

    return evalprep.k_shot(questions(spark, sf_dir), "id", "question", "choices", "answer", 3)


@query(
    "share_texts",
    """with t as (select o_orderkey as id, case o_orderkey % 4 when 0 then (o_orderkey % 100)::varchar || '%' when 1 then '0,' || (o_orderkey % 90 + 10)::varchar when 2 then (o_orderkey % 100)::varchar else 'n/a' end as raw from orders),
p as (select id, raw, replace(trim(raw, ' '), ',', '.') as plain from t), n as (select id, plain, try_cast(regexp_replace(plain, '%$', '') as double) as x from p)
select id, round(case when plain like '%\\%' escape '\\' then x / 100 when x > 1 then x / 100 else x end, 6) as share from n""",
)
def share_texts(spark, sf_dir):
    """Shares from texts with a percent sign, a decimal comma, a percentage or nothing usable."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat((k % 100).cast("string"), F.lit("%"))).when(k % 4 == 1, F.concat(F.lit("0,"), (k % 90 + 10).cast("string"))).when(k % 4 == 2, (k % 100).cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.round(tx.to_share(raw), 6).alias("share"))


@query(
    "share_column",
    """with s as (select c_custkey as id, c_nationkey % 3 as col, case when c_nationkey % 3 = 0 then c_custkey % 100 else (c_custkey % 100) / 100.0 end as x from customer),
m as (select col, count_if(x > 1) * 2 > count(*) as percent from s group by col) select s.id, round(case when percent then x / 100 else x end, 9) as share from s join m on s.col = m.col""",
)
def share_column(spark, sf_dir):
    """A column is of percentages where most of its values exceed 1; then all are divided."""
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_nationkey") % 3).alias("col"), F.when(F.col("c_nationkey") % 3 == 0, (k % 100).cast("double")).otherwise((k % 100) / 100.0).alias("x"))
    return metrics.column_shares(s, "col", "x").select("id", F.round("x", 9).alias("share"))


@query(
    "number_texts",
    """with t as (select c_custkey as id, case when c_custkey % 7 = 0 then '#N/A' when c_custkey % 7 = 1 then '' else format('{:,}', (c_custkey * 1234)::bigint) end as raw from customer)
select id, try_cast(regexp_replace(nullif(nullif(raw, '#N/A'), ''), '[,\\s]', '', 'g') as double) as number, lower(trim(raw)) in ('true', 't', '1', 'yes') as flag from t""",
)
def number_texts(spark, sf_dir):
    """Numbers typed with thousands commas; spreadsheet marks of nothing are null."""
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, "#N/A").when(k % 7 == 1, "").otherwise(F.format_number((k * 1234).cast("double"), 0))
    return table(spark, sf_dir, "customer").select(k.alias("id"), tx.to_number(tx.without_sentinels(raw)).alias("number"), tx.to_flag(raw).alias("flag"))


@query(
    "year_texts",
    """with t as (select o_orderkey as id, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then 'Founded in ' || strftime(o_orderdate, '%Y') || '.' when 2 then 'since 99' else '3021' end as raw from orders)
select id, case when y between 1700 and 2100 then y end as year from (select id, try_cast(nullif(regexp_extract(raw, '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1), '') as int) as y from t)""",
)
def year_texts(spark, sf_dir):
    """Years from dates and from sentences, inside a range."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.concat(F.lit("Founded in "), F.date_format(d, "yyyy"), F.lit("."))).when(k % 4 == 2, "since 99").otherwise("3021")
    return table(spark, sf_dir, "orders").select(k.alias("id"), tx.year_of(raw).alias("year"))


@query(
    "employee_ranges",
    """with t as (select c_custkey as id, c_custkey % 900 as n, c_custkey % 4 as k from customer)
select id, case k when 0 then (n + n + 100) / 2.0 when 1 then (n + n + 50) / 2.0 when 2 then n else n * 1000 + 1 end::double as employees from t""",
)
def employee_ranges(spark, sf_dir):
    """Middles of ranges typed in four ways."""
    n, k = F.col("c_custkey") % 900, F.col("c_custkey") % 4
    text = lambda c: c.cast("string")
    raw = F.when(k == 0, F.concat(text(n), F.lit(" – "), text(n + 100))).when(k == 1, F.concat(text(n), F.lit(" to "), text(n + 50))).when(k == 2, F.concat(text(n), F.lit("+"))).otherwise(F.format_number((n * 1000 + 1).cast("double"), 0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.range_midpoint(raw).alias("employees"))


@query(
    "number_strings",
    """select c_custkey as id, '[' || replace(format('{:,}', c_custkey::bigint), ',', ' ') || ', ' || case when c_custkey % 3 = 0 then '-' else replace(format('{:,}', (c_custkey * 1000)::bigint), ',', ' ') end || ']' as list,
  case when c_custkey % 5 = 0 then '-' else format('{:.1f} %', (c_custkey % 100) / 7.0) end as percent from customer""",
)
def number_strings(spark, sf_dir):
    """Lists of numbers and percentages as text."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), tx.number_list([k, F.when(k % 3 != 0, k * 1000)]).alias("list"), tx.percent_text(F.when(k % 5 != 0, (k % 100) / 700.0)).alias("percent")
    )


@query("control_characters", r"select doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g') as text from documents where text is not null")
def control_characters(spark, sf_dir):
    return documents(spark, sf_dir).filter("text is not null").select("doc_id", tx.without_controls(F.col("text")).alias("text"))


@query(
    "answers_settled",
    """with o as (select l_orderkey, list(l_returnflag order by l_linenumber, l_returnflag) as a from lineitem group by 1)
select l_orderkey, len(a) = 4 as complete, case when len(a) >= 4 then a[1:4] else list_concat(a, list_transform(range(4 - len(a)), lambda i: 'RETRY_FAILED')) end as answers from o""",
)
def answers_settled(spark, sf_dir):
    """Answers of a batch cut or padded to four, and whether there were four."""
    from plumbline.operators.prompts import settle_answers

    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: s["l_returnflag"])
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("answers")).withColumn("size", F.lit(4))
    return settle_answers(o, "answers", "size").select("l_orderkey", "complete", "answers")


@query("ragged_samples", "with s as (select l_suppkey, list(l_quantity::double order by l_orderkey, l_linenumber, l_quantity) as v from lineitem group by 1) select l_suppkey, list_concat(v, list_transform(range(greatest(0, 700 - len(v))), lambda i: null::double)) as samples from s")
def ragged_samples(spark, sf_dir):
    """Samples of each group as rows and back as arrays, padded to 700."""
    from plumbline.sources.writers import samples_long, samples_wide

    items = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))), lambda s: s["l_quantity"].cast("double"))
    wide = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(items.alias("samples"))
    return samples_wide(samples_long(wide, "l_suppkey", "samples"), "l_suppkey", 700)


@query(
    "category_maps",
    "select c_mktsegment as category, n_name as keyword, count(*) as frequency from customer join nation on c_nationkey = n_nationkey group by 1, 2",
)
def category_maps(spark, sf_dir):
    """A map of counts per category turned into rows."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("n"))
    maps = counts.groupBy(F.col("c_mktsegment").alias("category")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n"))).alias("m"))
    return maps.select("category", F.explode("m").alias("keyword", "frequency"))


@query(
    "anova_tests",
    f"with x as ({_GROUPS}), g as (select g, count(*) as n, avg(v) as m, var_pop(v) as s from x group by 1), r as (select g, (rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0) as r, count(*) over (partition by v) as tie from x), "
    "k as (select sum(sr * sr / n) as b, sum(n) as n from (select g, sum(r) as sr, count(*) as n from r group by 1)), t as (select sum(tie * tie - 1) as ties from r), f as (select count(*) as groups, sum(n) as n, sum(n * m * m) - power(sum(n * m), 2) / sum(n) as between_, sum(n * s) as within_ from g) "
    "select f.groups, round((between_ / (groups - 1)) / (within_ / (f.n - groups)), 6) as f, round(between_ / (between_ + within_), 9) as eta2, round((12.0 / (k.n * (k.n + 1)) * k.b - 3 * (k.n + 1)) / (1 - t.ties / (power(k.n, 3) - k.n)), 6) as h from f cross join k cross join t",
)
def anova_tests(spark, sf_dir):
    """F, eta squared and the Kruskal-Wallis H of a value over groups; :func:`group_tests` has the p-values."""
    x = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").cast("double").alias("v"))
    return metrics.group_tests(x, "g", "v").select("groups", F.round("f", 6).alias("f"), F.round("eta2", 9).alias("eta2"), F.round("h", 6).alias("h"))


@query(
    "company_base",
    """with c as (select distinct company_id, total_headcount from log_debias_company_aggregates)
select coalesce(company_id, 'unknown') as id, coalesce(total_headcount, 0)::bigint as employees, coalesce(total_headcount, 0)::bigint as total_headcount,
  case when total_headcount is null or total_headcount = 0 then 'Unknown' when total_headcount < 10 then 'Startup' when total_headcount < 50 then 'Small' when total_headcount < 200 then 'Medium' when total_headcount < 1000 then 'Large' else 'Enterprise' end as company_size from c""",
)
def company_base(spark, sf_dir):
    """The base table of companies: id and head count by the first column that has them, size class, nulls as 0."""
    from plumbline.sources.readers import company_base as derive

    c = table(spark, sf_dir, "log_debias_company_aggregates").select("company_id", F.col("total_headcount").alias("employees_in_linkedin")).distinct()
    return derive(c).select(F.coalesce("id", F.lit("unknown")).alias("id"), "employees", "total_headcount", "company_size")


@query(
    "employee_extract",
    """with r as (select distinct raw_id, try_cast(profile_data as json) as j from raw_profiles where json_valid(profile_data)),
p as (select raw_id, case when json_type(e) = 'ARRAY' then json_array_length(e) else 0 end as n from (select raw_id, try_cast((j->>'experiences') as json) as e from r)), w as (select distinct comparator_id as id from cv_data where comparator_id is not null)
select w.id, max(p.n)::bigint as positions from w join p on w.id = p.raw_id group by 1""",
)
def employee_extract(spark, sf_dir):
    """Length of an array of the records whose key is on a list."""
    wanted = table(spark, sf_dir, "cv_data").select(F.col("comparator_id").alias("id")).filter("id is not null").distinct()
    r = table(spark, sf_dir, "raw_profiles").select("raw_id", "profile_data").distinct().filter(F.try_parse_json("profile_data").isNotNull())
    size = F.coalesce(F.json_array_length(F.get_json_object("profile_data", "$.experiences")), F.lit(0))
    return r.join(wanted, F.col("raw_id") == F.col("id"), "left_semi").groupBy(F.col("raw_id").alias("id")).agg(F.max(size).cast("bigint").alias("positions"))



_ML = r"(machine[\s-]?learning|[^a-z]ml[^a-z]|deep[\s-]?learning|reinforcement[\s-]?learning|[^a-z]rl[^a-z])"
#: What the looser flags look for anywhere in a record's text, in any case.
LOOSE_YES = [
    "augmented generation", "agent reinforcement", "mats scholar", "[^a-z]mats[^a-z]", "research scientist", "evals", "interpretability",
    "feature engineering", "research intern", "candidate", "graduate research assistant", "science institute", "staff research scientist", "doctor",
]
LOOSE_NO = [
    "certificate", "programmer", "council", "companies", "capital", "proven track record", "pilot", "money", "specialist", "chief", "udemy",
    "track record", "customer", "management", "today", "cross functional", "administrator", "excellence", "commerce", "linkedin", "leader",
    "incident", "tier", "brand", "investment", "[^a-z]hr[^a-z]", "sites", "offerings", "prior", "centers", "advising", "certified information",
    "key responsibilities", "master data", "anti", "deadlines", "physiology", "carbon", "impacts", "certified machine", "qualification",
]
_LOOSE = [("ml_match", _ML), ("broad_match", "(" + "|".join(LOOSE_YES) + ")"), ("strict_no_match", "(" + "|".join(LOOSE_NO) + ")")]


@query(
    "loose_flags",
    "select raw_id, coalesce(bool_or(ml), false)::int as ml_match, coalesce(bool_or(yes), false)::int as broad_match, (not coalesce(bool_or(no), false))::int as strict_no_match from (select raw_id, "
    + ", ".join(f"regexp_matches(t, '{p}') as {n}" for n, (_, p) in zip(("ml", "yes", "no"), _LOOSE))
    + " from (select raw_id, lower(coalesce((j->>'about'), '') || ' ' || coalesce((j->>'summary'), '')) as t from (select raw_id, try_cast(profile_data as json) as j from raw_profiles where json_valid(profile_data)))) group by raw_id",
)
def loose_flags(spark, sf_dir):
    """Flags by parts of words over a record's texts, against the word-wise ones of ``keyword_flags``."""
    p = table(spark, sf_dir, "raw_profiles").select("raw_id", "profile_data").filter(F.try_parse_json("profile_data").isNotNull())
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.get_json_object("profile_data", f"$.{k}"), F.lit("")) for k in ("about", "summary")]))
    found = [F.bool_or(F.col("t").rlike(pattern)) for _, pattern in _LOOSE]
    told = p.select("raw_id", text.alias("t")).groupBy("raw_id").agg(*[c.alias(n) for c, (n, _) in zip(found, _LOOSE, strict=True)])
    return told.select("raw_id", F.col("ml_match").cast("int").alias("ml_match"), F.col("broad_match").cast("int").alias("broad_match"), (~F.col("strict_no_match")).cast("int").alias("strict_no_match"))


@query(
    "keyword_frequencies",
    _TFIDF + ", n as (select category, term, sum(tf)::bigint as frequency from tf where category is not null and term in (select term from df) group by 1, 2) select n.category, n.term as keyword, frequency, round(mean.score, 9) as score from n join mean on n.category = mean.category and n.term = mean.term",
)
def keyword_frequencies(spark, sf_dir):
    """Frequency and average score of every keyword of a category."""
    from plumbline.operators.term_scores import tfidf_means

    terms = cv_terms(spark, sf_dir)
    scores = tfidf_means(terms, "cv_id", "category", "terms", min_docs=5)
    freq = terms.filter("category is not null").select("category", F.explode("terms").alias("term")).groupBy("category", "term").agg(F.count("*").alias("frequency"))
    return freq.join(scores, ["category", "term"]).select("category", F.col("term").alias("keyword"), "frequency", F.round("score", 9).alias("score"))


@query(
    "interval_coverage",
    f"select round(avg((mean between q10 and q90)::int), 9) as covered, round(1 - sum(power(q50 - mean, 2)) / (var_pop(mean) * count(*)), 6) as r2, round(avg((abs(mean - q50) <= 1.6448536 * std)::int), 9) as covered90 from {RESULTS} where q10 is not null and q50 is not null and q90 is not null and mean is not null and std is not null",
)
def interval_coverage(spark, sf_dir):
    """How often a known value lies in an estimate's 80 % and 90 % intervals."""
    r = results(spark, sf_dir).na.drop(subset=["q10", "q50", "q90", "mean", "std"])
    gap = F.col("q50") - F.col("mean")
    return r.agg(
        F.round(metrics.coverage(F.col("mean"), F.col("q10"), F.col("q90")), 9).alias("covered"),
        F.round(1 - F.sum(gap * gap) / (F.var_pop("mean") * F.count("*")), 6).alias("r2"),
        F.round(F.avg((F.abs(gap) <= 1.6448536 * F.col("std")).cast("double")), 9).alias("covered90"),
    )


@query(
    "size_sections",
    f"""with {LOGS}, b as (select *, case when total_headcount < 100 then '<100' when total_headcount < 1000 then '100-999' when total_headcount < 10000 then '1000-9999' when total_headcount is not null then '>=10000' end as band from debiased)
select coalesce(band, case when grouping(band) = 1 then 'Total' else 'unknown' end) as section, count(*) as n, sum(ml_consensus_round)::bigint as consensus, sum(ml_lower80_round)::bigint as low, sum(ml_upper80_round)::bigint as high,
  round(100.0 * sum(ml_consensus_round) / nullif(sum(total_headcount), 0), 6) as share from b group by grouping sets ((), (band))""",
)
def size_sections(spark, sf_dir):
    """Sums of the debiased estimates by size band and in all, and their share of the employees."""
    told = debiased(spark, sf_dir).withColumn("band", metrics.size_band(F.col("total_headcount"))).rollup("band").agg(
        F.grouping("band").alias("g"),
        F.count("*").alias("n"),
        F.sum("ml_consensus_round").alias("consensus"),
        F.sum("ml_lower80_round").alias("low"),
        F.sum("ml_upper80_round").alias("high"),
        F.sum("total_headcount").alias("employees"),
    )
    share = F.round(F.lit(100.0) * F.try_divide("consensus", F.nullif("employees", F.lit(0))), 6)
    return told.select(F.coalesce("band", F.when(F.col("g") == 1, "Total").otherwise("unknown")).alias("section"), "n", "consensus", "low", "high", share.alias("share"))


@query(
    "distinct_wrong_answers",
    """with q as (select n_nationkey as id, c.choices, n_regionkey::int as answer from nation cross join (select list(r_name order by r_regionkey) as choices from region where r_regionkey < 4) c where n_regionkey < 4)
select id, len(list_distinct(list_filter(choices, lambda c: c <> choices[answer + 1])))::int as n from q""",
)
def distinct_wrong_answers(spark, sf_dir):
    """One wrong answer for each of three phrasings, all different, in the order of a seeded hash."""
    from plumbline.plans.tables import questions

    q = questions(spark, sf_dir)
    return q.select("id", F.size(F.array_distinct(evalprep.seeded_wrongs(F.col("id"), F.col("choices"), F.col("answer"), 3))).alias("n"))
