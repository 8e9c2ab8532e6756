"""Queries over company tables: debiasing, bands, classes, summaries, comparisons of estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import debias, metrics, relational
from plumbline.operators.quantiles import exact_quantiles
from plumbline.plans.base import query, table
from plumbline.plans.sql import COMPANIES, LOGS, METHODS


def companies(spark, sf_dir):
    return table(spark, sf_dir, "log_debias_company_aggregates").distinct()


def results(spark, sf_dir):
    return table(spark, sf_dir, "correlated_probit_bootstrap_results").distinct()


def debiased(spark, sf_dir):
    return debias.log_debias(debias.zero_as_missing(companies(spark, sf_dir)))


@query(
    "log_debias",
    f"""with {LOGS}
select company_id, ml_consensus_round, ml_lower80_round, ml_upper80_round, round(uncertainty_factor_x, 6) as uncertainty_factor_x,
  k_methods, outlier_flag_gt3x, round(ml_share, 9) as ml_share from debiased""",
)
def log_debias(spark, sf_dir):
    return debiased(spark, sf_dir).select(
        "company_id",
        "ml_consensus_round",
        "ml_lower80_round",
        "ml_upper80_round",
        F.round("uncertainty_factor_x", 6).alias("uncertainty_factor_x"),
        "k_methods",
        "outlier_flag_gt3x",
        F.round("ml_share", 9).alias("ml_share"),
    )


BANDS_SQL = f"""with {LOGS},
bands as (
  select *, coalesce(ml_consensus_round >= 500 and ml_share >= 0.005, false) as band_enterprise,
    coalesce(ml_consensus_round >= 50 and ml_share >= 0.01, false) as band_midscale,
    coalesce(ml_consensus_round >= 10 and ml_consensus_round < 50 and ml_share >= 0.05, false) as band_boutique,
    coalesce(max_headcount, false) and coalesce(max_population, false) as orgs_ml
  from debiased)
"""


@query("log_debias_subsets", BANDS_SQL + "select company_id, ml_consensus_round, band_enterprise, band_midscale, band_boutique, orgs_ml from bands")
def log_debias_subsets(spark, sf_dir):
    told = debias.scale_bands(debiased(spark, sf_dir))
    ml = F.coalesce(F.col("max_headcount"), F.lit(False)) & F.coalesce(F.col("max_population"), F.lit(False))
    return told.select("company_id", "ml_consensus_round", "band_enterprise", "band_midscale", "band_boutique", ml.alias("orgs_ml"))


_SUBSETS = {"all_orgs": "true", "orgs_ml": "orgs_ml", "enterprise": "band_enterprise", "midscale": "band_midscale", "boutique": "band_boutique"}


@query(
    "log_debias_summary",
    BANDS_SQL
    + " union all ".join(
        f"""select '{n}' as subset, count(*) as n, sum(ml_consensus_round)::bigint as total, round(avg(ml_consensus_round), 6) as mean,
  quantile_cont(ml_consensus_round, 0.5)::double as median, coalesce(count_if(outlier_flag_gt3x), 0) as outliers from bands where {c}"""
        for n, c in _SUBSETS.items()
    ),
)
def log_debias_summary(spark, sf_dir):
    told = debias.scale_bands(debiased(spark, sf_dir))
    ml = F.coalesce(F.col("max_headcount"), F.lit(False)) & F.coalesce(F.col("max_population"), F.lit(False))
    told = told.withColumn("orgs_ml", ml)
    # every row goes to each subset that holds it: one pass instead of one per subset
    subsets = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in _SUBSETS.items()]))
    long = told.select(F.explode(subsets).alias("subset"), "ml_consensus_round", "outlier_flag_gt3x")
    names = spark.createDataFrame([(n,) for n in _SUBSETS], "subset string")
    stats = long.groupBy("subset").agg(
        F.count("*").alias("n"),
        F.sum("ml_consensus_round").alias("total"),
        F.round(F.avg("ml_consensus_round"), 6).alias("mean"),
        F.percentile("ml_consensus_round", F.lit(0.5)).alias("median"),
        F.count_if("outlier_flag_gt3x").alias("outliers"),
    )
    return names.join(stats, "subset", "left").select(
        "subset", F.coalesce("n", F.lit(0)).alias("n"), "total", "mean", "median", F.coalesce("outliers", F.lit(0)).alias("outliers")
    )


@query("debias_long_counts", " union all ".join(f"select company_id, '{m}' as method, {m} as accepted from {COMPANIES} where {m} is not null" for m in METHODS))
def debias_long_counts(spark, sf_dir):
    """Wide counts as rows (unpivot), nulls left out."""
    wide = companies(spark, sf_dir).select("company_id", *METHODS)
    return wide.unpivot(["company_id"], METHODS, "method", "accepted").filter("accepted is not null")


@query(
    "size_rating",
    f"""with {LOGS} select company_id, case when total_headcount < 10 then 'micro' when total_headcount < 50 then 'small'
  when total_headcount < 200 then 'medium' when total_headcount < 1000 then 'large' else 'enterprise' end as size_bucket,
  case when total_headcount < 100 then '<100' when total_headcount < 1000 then '100-999' when total_headcount < 10000 then '1000-9999'
  when total_headcount is not null then '>=10000' end as size_band,
  case when ml_consensus_round >= 500 and ml_share >= 0.005 then 'Enterprise' when ml_consensus_round >= 50 and ml_share >= 0.01 then 'Mid-scale'
  when ml_consensus_round >= 10 and ml_consensus_round < 50 and ml_share >= 0.05 then 'Boutique' else '-' end as rating,
  case when ml_consensus_round >= 500 and ml_share >= 0.005 then 'Giant' when ml_consensus_round >= 50 and ml_share >= 0.01 then 'Powerhouse'
  when ml_consensus_round >= 10 and ml_share >= 0.05 then 'Emerging' else 'Other' end as cluster from debiased""",
)
def size_rating(spark, sf_dir):
    told = debiased(spark, sf_dir)
    n, share = F.col("ml_consensus_round"), F.col("ml_share")
    rating = F.when((n >= 500) & (share >= 0.005), "Enterprise").when((n >= 50) & (share >= 0.01), "Mid-scale")
    rating = rating.when((n >= 10) & (n < 50) & (share >= 0.05), "Boutique").otherwise("-")
    cluster = F.when((n >= 500) & (share >= 0.005), "Giant").when((n >= 50) & (share >= 0.01), "Powerhouse").when((n >= 10) & (share >= 0.05), "Emerging").otherwise("Other")
    return told.select(
        "company_id", metrics.size_bucket(F.col("total_headcount")).alias("size_bucket"), metrics.size_band(F.col("total_headcount")).alias("size_band"), rating.alias("rating"), cluster.alias("cluster")
    )


@query(
    "confidence_class",
    """select result_id, case when q10 is null or q50 is null or q90 is null then 'Not Detected' when q10 > 0 then 'Probable' when q50 > 0 then 'Possible'
  when q90 > 0 then 'Non-zero' else 'Not Detected' end as confidence from (select distinct * from correlated_probit_bootstrap_results)""",
)
def confidence_class(spark, sf_dir):
    return results(spark, sf_dir).select("result_id", metrics.confidence_class(F.col("q10"), F.col("q50"), F.col("q90")).alias("confidence"))


@query(
    "fallback_estimates",
    """select result_id, case when q50 is not null then q10 else mean end as low, coalesce(q50, mean) as centre, coalesce(q10, mean) as low_own
from (select distinct * from correlated_probit_bootstrap_results)""",
)
def fallback_estimates(spark, sf_dir):
    """A triple that falls back as one on its centre, against a fallback column by column."""
    return results(spark, sf_dir).select(
        "result_id", F.when(F.col("q50").isNotNull(), F.col("q10")).otherwise(F.col("mean")).alias("low"), F.coalesce("q50", "mean").alias("centre"), F.coalesce("q10", "mean").alias("low_own")
    )


@query(
    "headcount_mismatch",
    """select id, case when claude_total_employees is null then true
  else coalesce(total_headcount / nullif(greatest(claude_total_employees, 0), 0) > 3 or total_headcount / nullif(greatest(claude_total_employees, 0), 0) < 1.0 / 3, false) end as mismatch
from final_results_comparator_ml""",
)
def headcount_mismatch(spark, sf_dir):
    f = table(spark, sf_dir, "final_results_comparator_ml")
    return f.select("id", metrics.headcount_mismatch(F.col("total_headcount"), F.col("claude_total_employees")).alias("mismatch"))


_NULLED = [f"{model}_total_{kind}" for kind in ("accepted", "rejected", "employees") for model in ("claude", "gpt5", "gemini")]


@query(
    "outlier_nulling",
    "select id, "
    + ", ".join(f"case when claude_total_employees >= 3 * total_headcount or claude_total_employees <= total_headcount / 3.0 then null else {c} end as {c}" for c in _NULLED)
    + " from final_results_comparator_ml",
)
def outlier_nulling(spark, sf_dir):
    f = table(spark, sf_dir, "final_results_comparator_ml")
    return relational.null_outliers(f, "claude_total_employees", "total_headcount", _NULLED).select("id", *_NULLED)


@query(
    "summary_grouping_sets",
    f"""with b as (select *, case when total_headcount < 100 then '<100' when total_headcount < 1000 then '100-999' when total_headcount < 10000 then '1000-9999'
  when total_headcount is not null then '>=10000' end as band from {COMPANIES}), n as (select count(*) as everyone from b)
select coalesce(band, case when grouping(band) = 1 then 'Total' else 'unknown' end) as section, count(*) as n, round(100.0 * count(*) / max(everyone), 6) as share,
  sum(total_headcount)::bigint as employees, quantile_cont(founded_year, 0.5)::double as median_year, quantile_cont(total_headcount, 0.5)::double as median_employees
from b cross join n group by grouping sets ((), (band))""",
)
def summary_grouping_sets(spark, sf_dir):
    b = companies(spark, sf_dir).withColumn("band", metrics.size_band(F.col("total_headcount")))
    told = b.rollup("band").agg(
        F.grouping("band").alias("g"),
        F.count("*").alias("n"),
        F.sum("total_headcount").alias("employees"),
        F.percentile("founded_year", F.lit(0.5)).alias("median_year"),
        F.percentile("total_headcount", F.lit(0.5)).alias("median_employees"),
    )
    # the grand total is one of the few rows of the roll-up
    from pyspark.sql import Window

    everyone = F.max(F.when(F.col("g") == 1, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return told.select(
        F.coalesce("band", F.when(F.col("g") == 1, "Total").otherwise("unknown")).alias("section"),
        "n",
        F.round(F.lit(100.0) * F.col("n") / everyone, 6).alias("share"),
        "employees",
        "median_year",
        "median_employees",
    )


@query(
    "weighted_share",
    f"""select category, round(sum(case when claude_total_accepted is not null and total_headcount is not null then claude_total_accepted * total_headcount end)
  / nullif(sum(case when claude_total_accepted is not null and total_headcount is not null then total_headcount end), 0), 4) as weighted
from {COMPANIES} group by category""",
)
def weighted_share(spark, sf_dir):
    return companies(spark, sf_dir).groupBy("category").agg(F.round(metrics.weighted_mean(F.col("claude_total_accepted"), F.col("total_headcount")), 4).alias("weighted"))


_COUNTRY = """coalesce(map_extract_value(map {'USA': 'United States', 'US': 'United States', 'UK': 'United Kingdom',
 'United Kingdom of Great Britain and Northern Ireland': 'United Kingdom', 'The Netherlands': 'Netherlands', 'Russian Federation': 'Russia'},
 trim(string_split(coalesce(headquarters_location, ''), ',')[-1])), trim(string_split(coalesce(headquarters_location, ''), ',')[-1]))"""


@query("country_of_location", f"select company_id, {_COUNTRY} as country from {COMPANIES}")
def country_of_location(spark, sf_dir):
    return companies(spark, sf_dir).select("company_id", tx.country_of(F.col("headquarters_location")).alias("country"))


@query(
    "country_subregion",
    f"""with dim as (select n_name as country, r_name as subregion from nation join region on n_regionkey = r_regionkey),
c as (select id, upper(trim(country)) as country from final_results_comparator_ml)
select c.id, coalesce(dim.subregion, 'Unknown') as subregion from c left join dim on c.country = dim.country""",
)
def country_subregion(spark, sf_dir):
    """Subregion through a dimension table, a parameter; here the nations and regions."""
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = dim.select(F.col("n_name").alias("key"), F.col("r_name").alias("subregion"))
    c = table(spark, sf_dir, "final_results_comparator_ml").select("id", F.upper(F.trim("country")).alias("key"))
    return c.join(dim, "key", "left").select("id", F.coalesce("subregion", F.lit("Unknown")).alias("subregion"))


@query(
    "regional_breakdown",
    """with f as (select distinct id, coalesce(subregion, 'Unknown') as subregion, total_headcount from final_results_comparator_ml),
dim as (select distinct subregion from f union select 'Antarctica'), n as (select count(*) as everyone from f)
select dim.subregion, count(f.id) as n, round(100.0 * count(f.id) / nullif(max(everyone), 0), 6) as share, coalesce(sum(f.total_headcount), 0)::bigint as employees
from dim left join f on dim.subregion = f.subregion cross join n group by dim.subregion""",
)
def regional_breakdown(spark, sf_dir):
    """Counts per region of a list, regions without rows too."""
    f = table(spark, sf_dir, "final_results_comparator_ml").select("id", F.coalesce("subregion", F.lit("Unknown")).alias("subregion"), "total_headcount").distinct()
    told = f.groupBy("subregion").agg(F.count("id").alias("n"), F.sum("total_headcount").alias("employees"))
    dim = told.select("subregion").union(spark.createDataFrame([("Antarctica",)], "subregion string")).distinct()
    from pyspark.sql import Window

    joined = dim.join(told, "subregion", "left").select("subregion", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("employees", F.lit(0)).alias("employees"))
    everyone = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the regions
    return joined.select("subregion", "n", F.round(F.lit(100.0) * F.col("n") / F.nullif(everyone, F.lit(0)), 6).alias("share"), "employees")


@query(
    "dataset_pivot",
    f"""with u as (select 'consulting' as dataset, total_headcount as h from {COMPANIES} union all select 'comparator', total_headcount from final_results_comparator_ml
  union all select 'results', n_employees from (select distinct * from correlated_probit_bootstrap_results)),
m as (select dataset, count(*)::double as n, sum(h)::double as employees, quantile_cont(h, 0.5)::double as median from u group by dataset),
l as (select dataset, unnest(['n', 'employees', 'median']) as metric, unnest([n, employees, median]) as value from m)
select metric, max(case when dataset = 'comparator' then value end) as comparator, max(case when dataset = 'consulting' then value end) as consulting,
  max(case when dataset = 'results' then value end) as results from l group by metric""",
)
def dataset_pivot(spark, sf_dir):
    """One column per dataset: union with a tag, aggregate, unpivot, pivot over known names."""
    parts = [
        companies(spark, sf_dir).select(F.lit("consulting").alias("dataset"), F.col("total_headcount").alias("h")),
        table(spark, sf_dir, "final_results_comparator_ml").select(F.lit("comparator"), "total_headcount"),
        results(spark, sf_dir).select(F.lit("results"), "n_employees"),
    ]
    u = parts[0].union(parts[1]).union(parts[2])
    m = u.groupBy("dataset").agg(F.count("*").cast("double").alias("n"), F.sum("h").cast("double").alias("employees"), F.percentile("h", F.lit(0.5)).alias("median"))
    long = m.unpivot(["dataset"], ["n", "employees", "median"], "metric", "value")
    return long.groupBy("metric").pivot("dataset", ["comparator", "consulting", "results"]).agg(F.max("value"))


@query(
    "org_report",
    f"""with {LOGS}, f as (select *, case when ml_share is null then '-' else format('{{:.1f}} %', ml_share * 100) end as share_text from debiased)
select company_id, replace(format('{{:,}}', total_headcount::bigint), ',', ' ') as employees,
  case when ml_consensus_round is null then '-' else replace(format('{{:,}}', ml_consensus_round), ',', ' ') || ' (' || replace(format('{{:,}}', ml_lower80_round), ',', ' ')
    || ' - ' || replace(format('{{:,}}', ml_upper80_round), ',', ' ') || ')' end as estimate, founded_year as year,
  concat_ws(' ', stage_reached, category) as stage_category
from f where total_headcount is not null""",
)
def org_report(spark, sf_dir):
    """Report columns as text: spaced integers, intervals, joined labels."""
    told = debiased(spark, sf_dir).filter("total_headcount is not null")
    return told.select(
        "company_id",
        tx.spaced_integer(F.col("total_headcount")).alias("employees"),
        tx.interval_text(F.col("ml_consensus_round"), F.col("ml_lower80_round"), F.col("ml_upper80_round")).alias("estimate"),
        F.col("founded_year").alias("year"),
        F.concat_ws(" ", "stage_reached", "category").alias("stage_category"),
    )


@query(
    "any_estimate_summary",
    f"""with e as (select (claude_total_accepted is not null)::int + (gpt5_total_accepted is not null)::int + (gemini_total_accepted is not null)::int as have,
  claude_total_accepted as c from {COMPANIES} where total_headcount <= 10000)
select count(*) as n, count_if(have > 0) as with_any, round(avg(c), 6) as mean, quantile_cont(c, 0.5) as median, round(stddev_samp(c), 6) as std, min(c) as low, max(c) as high from e""",
)
def any_estimate_summary(spark, sf_dir):
    e = companies(spark, sf_dir).filter("total_headcount <= 10000")
    have = F.greatest(*[F.col(c).isNotNull().cast("int") for c in debias.MODEL_METHODS])
    c = F.col("claude_total_accepted")
    return e.agg(
        F.count("*").alias("n"),
        F.count_if(have > 0).alias("with_any"),
        F.round(F.avg(c), 6).alias("mean"),
        F.percentile(c, F.lit(0.5)).alias("median"),
        F.round(F.stddev_samp(c), 6).alias("std"),
        F.min(c).alias("low"),
        F.max(c).alias("high"),
    )


@query(
    "adjustment_factor",
    """with r as (select linkedin_id, mean, n_employees, headcount_ratio, row_number() over (partition by linkedin_id order by result_id) as place
  from (select distinct * from correlated_probit_bootstrap_results) where linkedin_id is not null),
p as (select q50, linkedin_id, row_number() over (partition by linkedin_id order by result_id) as place from (select distinct * from correlated_probit_bootstrap_results) where linkedin_id is not null)
select round(coalesce(quantile_cont(mean / q50, 0.5), 1.0), 9) as factor, count(*) as companies from r join p using (linkedin_id, place) where place = 1 and q50 >= 1 and mean > 0""",
)
def adjustment_factor(spark, sf_dir):
    """Median ratio of two estimates over unique ids; 1 where there is none."""
    r = results(spark, sf_dir).filter("linkedin_id is not null").select("linkedin_id", "result_id", "mean", "q50")
    unique = relational.first_wins(r, ["linkedin_id"], ["result_id"]).filter("q50 >= 1 and mean > 0")
    told = unique.withColumn("ratio", F.col("mean") / F.col("q50"))
    factor = exact_quantiles(told, "ratio", [0.5])[0]
    return told.agg(F.count("*").alias("companies")).select(F.round(F.lit(1.0 if factor is None else factor), 9).alias("factor"), "companies")


@query(
    "loglog_regression",
    """select category_ml_org as category, round(regr_slope(log10(claude_total_employees), log10(total_headcount)), 6) as slope,
  round(regr_intercept(log10(claude_total_employees), log10(total_headcount)), 6) as intercept, round(regr_r2(log10(claude_total_employees), log10(total_headcount)), 6) as r2
from final_results_comparator_ml where total_headcount > 0 and claude_total_employees > 0 group by 1""",
)
def loglog_regression(spark, sf_dir):
    f = table(spark, sf_dir, "final_results_comparator_ml").filter("total_headcount > 0 and claude_total_employees > 0")
    told = f.groupBy(F.col("category_ml_org").alias("category")).agg(*metrics.log_regression(F.col("total_headcount"), F.col("claude_total_employees")))
    return told.select("category", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@query(
    "ratio_histogram",
    """select case when log10(headcount_ratio) < -2 then 0 when log10(headcount_ratio) >= 2 then 31 else floor((log10(headcount_ratio) + 2) / 4 * 30)::int + 1 end as bin, count(*) as n
from (select distinct * from correlated_probit_bootstrap_results) where headcount_ratio > 0 group by 1""",
)
def ratio_histogram(spark, sf_dir):
    told = metrics.log_histogram(results(spark, sf_dir), "headcount_ratio", -2, 2, 30)
    return told.select(F.col("bin").cast("int").alias("bin"), "n")


@query(
    "ci_coverage",
    """select round(avg((mean between q10 and q90)::int), 9) as covered, round(avg((abs(mean - q50) > 0.2 * q50)::int), 9) as far
from (select distinct * from correlated_probit_bootstrap_results) where q10 is not null and q50 is not null and q90 is not null and mean is not null""",
)
def ci_coverage(spark, sf_dir):
    r = results(spark, sf_dir).na.drop(subset=["q10", "q50", "q90", "mean"])
    far = (F.abs(F.col("mean") - F.col("q50")) > 0.2 * F.col("q50")).cast("double")
    return r.agg(F.round(metrics.coverage(F.col("mean"), F.col("q10"), F.col("q90")), 9).alias("covered"), F.round(F.avg(far), 9).alias("far"))


@query(
    "prevalence_recovery",
    """select round(1 - sum(power(q50 - mean, 2)) / nullif(sum(power(mean - m, 2)), 0), 9) as r2, round(sqrt(avg(power(q50 - mean, 2))), 6) as rmse
from (select distinct * from correlated_probit_bootstrap_results) cross join (select avg(mean) as m from (select distinct * from correlated_probit_bootstrap_results) where q50 is not null and mean is not null)
where q50 is not null and mean is not null""",
)
def prevalence_recovery(spark, sf_dir):
    """R2 and RMSE in one pass, from moments."""
    r = results(spark, sf_dir).na.drop(subset=["q50", "mean"])
    gap = F.col("q50") - F.col("mean")
    return r.agg(
        F.round(1 - F.sum(gap * gap) / F.nullif(F.var_pop("mean") * F.count("*"), F.lit(0.0)), 9).alias("r2"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse")
    )


@query(
    "estimate_discrepancies",
    """with a as (select comparator_id as id, count(distinct cv_id) as actual from cv_data where comparator_id is not null group by 1)
select f.id, f.total_headcount - coalesce(a.actual, 0) as diff, a.id is null as absent from final_results_comparator_ml f left join a on f.id = a.id
where abs(f.total_headcount - coalesce(a.actual, 0)) > 10""",
)
def estimate_discrepancies(spark, sf_dir):
    """Stored against counted totals, with signed differences."""
    actual = table(spark, sf_dir, "cv_data").filter("comparator_id is not null").groupBy(F.col("comparator_id").alias("cid")).agg(F.countDistinct("cv_id").alias("actual"))
    f = table(spark, sf_dir, "final_results_comparator_ml").join(actual, F.col("id") == F.col("cid"), "left")
    diff = F.col("total_headcount") - F.coalesce("actual", F.lit(0))
    return f.filter(F.abs(diff) > 10).select("id", diff.alias("diff"), F.col("cid").isNull().alias("absent"))


@query(
    "geographic_top",
    """select subregion, country, n from (select *, row_number() over (partition by subregion order by n desc, country) as place from (
  select trim(subregion) as subregion, trim(country) as country, count(*) as n from final_results_comparator_ml where subregion is not null and country is not null group by 1, 2)) where place <= 5""",
)
def geographic_top(spark, sf_dir):
    f = table(spark, sf_dir, "final_results_comparator_ml").na.drop(subset=["subregion", "country"])
    counts = f.groupBy(F.trim("subregion").alias("subregion"), F.trim("country").alias("country")).agg(F.count("*").alias("n"))
    return relational.top_per_group(counts, ["subregion"], [F.desc("n"), F.asc("country")], 5).select("subregion", "country", "n")


@query("company_search", f"select company_id from {COMPANIES} where contains(lower(coalesce(company_name, '')), 'systems') or contains(lower(coalesce(organization_name, '')), 'systems')")
def company_search(spark, sf_dir):
    """Case-insensitive search in several columns."""
    c = companies(spark, sf_dir)
    hit = F.lower(F.coalesce("company_name", F.lit(""))).contains("systems") | F.lower(F.coalesce("organization_name", F.lit(""))).contains("systems")
    return c.filter(hit).select("company_id")


@query(
    "name_slug",
    f"select distinct company_id, regexp_replace(trim(lower(organization_name), ' '), '[ \\t\\n\\r\\f\\v]+', '-', 'g') as slug from {COMPANIES}",
)
def name_slug(spark, sf_dir):
    return companies(spark, sf_dir).select("company_id", tx.slug(F.col("organization_name")).alias("slug")).distinct()


@query(
    "org_medians",
    f"select category, quantile_cont(total_headcount, 0.5)::double as median, bool_or(coalesce(regexp_matches(stage_reached, 'trial'), false)) as any_trial from {COMPANIES} group by category",
)
def org_medians(spark, sf_dir):
    """Medians and whether any row matches."""
    return companies(spark, sf_dir).groupBy("category").agg(
        F.percentile("total_headcount", F.lit(0.5)).alias("median"), F.bool_or(F.coalesce(F.col("stage_reached").rlike("trial"), F.lit(False))).alias("any_trial")
    )
