"""Queries over annotators' labels: metrics, patterns, probit fusion and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import bootstrap, metrics, relational
from plumbline.plans.base import query, table
from plumbline.plans.companies import companies

ANNOTATORS = ["llm_gemini_2_5_flash", "llm_sonnet_4", "llm_gpt_5_mini", "filter_broad_yes", "filter_strict_no", "filter_broad_yes_strict_no"]
_CVS = "(select distinct * from validation_cvs)"


def validation(spark, sf_dir):
    return table(spark, sf_dir, "validation_cvs").distinct()


_COUNTS = " union all ".join(
    f"""select '{m}' as method, count_if(coalesce(category, 0) = 1 and coalesce({m}, 0) = 1) as tp, count_if(coalesce(category, 0) <> 1 and coalesce({m}, 0) = 1) as fp,
  count_if(coalesce(category, 0) = 1 and coalesce({m}, 0) <> 1) as fn, count_if(coalesce(category, 0) <> 1 and coalesce({m}, 0) <> 1) as tn from {_CVS}"""
    for m in ANNOTATORS
)


@query(
    "confusion_metrics",
    f"""select method, tp as TP, fp as FP, fn as FN, tn as TN, round(tp / (tp + fn), 3) as sensitivity, round(tn / (tn + fp), 3) as specificity, round(tp / (tp + fp), 3) as precision,
  round(tp / (tp + fn), 3) as recall, round(2 * tp / (2 * tp + fp + fn), 3) as f1, round((tp + tn) / (tp + fp + fn + tn), 3) as accuracy from ({_COUNTS})""",
)
def confusion_metrics(spark, sf_dir):
    return metrics.confusion_metrics(validation(spark, sf_dir), "category", ANNOTATORS)


@query(
    "annotator_metrics_bias",
    " union all ".join(
        f"""select '{m}' as method, count(*) as n, round(count_if(category = 1 and {m} = 1) / count_if(category = 1), 9) as sensitivity, round(count_if(category = 0 and {m} = 0) / count_if(category = 0), 9) as specificity,
  round(count_if(category = {m}) / count(*), 9) as accuracy, round(avg({m}) - avg(category), 9) as bias from {_CVS} where category is not null and {m} is not null"""
        for m in ANNOTATORS
    ),
)
def annotator_metrics_bias(spark, sf_dir):
    told = metrics.annotator_bias(validation(spark, sf_dir), "category", ANNOTATORS)
    return told.select("method", "n", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "accuracy", "bias")])


_LAST = """last as (select cv_id, annotator_id, label from (select *, row_number() over (partition by cv_id, annotator_id order by labelled_at desc nulls last, received_at desc nulls last, annotation_id desc, label desc nulls last) as place
  from cv_annotations) where place = 1)"""


def last_labels(spark, sf_dir):
    a = table(spark, sf_dir, "cv_annotations").select("cv_id", "annotator_id", "label", "labelled_at", "received_at", "annotation_id")
    best = F.max_by(F.struct("label"), F.struct("labelled_at", "received_at", "annotation_id", "label"))
    return a.groupBy("cv_id", "annotator_id").agg(best.alias("b")).select("cv_id", "annotator_id", "b.label")


@query(
    "annotation_star_join",
    f"""with {_LAST}, base as (select distinct cv_id from validation_cvs)
select base.cv_id, a.label as first_label, b.label as second_label, c.label as third_label from base
left join (select * from last where annotator_id = 1) a on base.cv_id = a.cv_id left join (select * from last where annotator_id = 2) b on base.cv_id = b.cv_id
left join (select * from last where annotator_id = 3) c on base.cv_id = c.cv_id""",
)
def annotation_star_join(spark, sf_dir):
    """Keys with one column per annotator, left joined: one conditional aggregate instead of three joins of the same table."""
    picked = last_labels(spark, sf_dir).filter(F.col("annotator_id").isin(1, 2, 3))
    wide = picked.groupBy("cv_id").agg(*[F.max(F.when(F.col("annotator_id") == i, F.col("label"))).alias(n) for i, n in ((1, "first_label"), (2, "second_label"), (3, "third_label"))])
    return table(spark, sf_dir, "validation_cvs").select("cv_id").distinct().join(wide, "cv_id", "left")


@query("comparator_semi", "select cv_id, comparator_id from cv_data where comparator_id in (select id from final_results_comparator_ml where subregion is not null)")
def comparator_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "final_results_comparator_ml").filter("subregion is not null").select(F.col("id").alias("comparator_id"))
    return table(spark, sf_dir, "cv_data").select("cv_id", "comparator_id").join(ids, "comparator_id", "left_semi")


@query(
    "companies_needing_synthetic",
    """select distinct f.id, coalesce(f.linkedin_id, f.id::varchar) as key from final_results_comparator_ml f
where (f.filter_broad_yes is not null or f.claude_total_accepted is not null) and not exists (select 1 from cv_data c where c.comparator_id = f.id and c.category = 'yes')""",
)
def companies_needing_synthetic(spark, sf_dir):
    have = table(spark, sf_dir, "cv_data").filter("category = 'yes'").select(F.col("comparator_id").alias("id"))
    f = table(spark, sf_dir, "final_results_comparator_ml").filter("filter_broad_yes is not null or claude_total_accepted is not null")
    return f.join(have, "id", "left_anti").select("id", F.coalesce("linkedin_id", F.col("id").cast("string")).alias("key")).distinct()


@query(
    "final_results_left",
    """with c as (select comparator_id, count(distinct cv_id) as cvs from cv_data group by 1), n as (select comparator_id, count(distinct cv_id) as foreign_cvs from cv_data where lang <> 'en' group by 1)
select f.id, coalesce(c.cvs, 0) as cvs, coalesce(n.foreign_cvs, 0) as foreign_cvs from final_results_comparator_ml f left join c on f.id = c.comparator_id left join n on f.id = n.comparator_id""",
)
def final_results_left(spark, sf_dir):
    """A master with two left joined aggregates, missing ones as 0."""
    cvs = table(spark, sf_dir, "cv_data").filter("comparator_id is not null")
    both = cvs.groupBy(F.col("comparator_id").alias("id")).agg(
        F.countDistinct("cv_id").alias("cvs"), F.countDistinct(F.when(F.col("lang") != "en", F.col("cv_id"))).alias("foreign_cvs")
    )
    f = table(spark, sf_dir, "final_results_comparator_ml").select("id")
    return f.join(both, "id", "left").select("id", F.coalesce("cvs", F.lit(0)).alias("cvs"), F.coalesce("foreign_cvs", F.lit(0)).alias("foreign_cvs"))


@query(
    "accept_reject_counts",
    f"""with {_LAST} select cv_id, count_if(lower(trim(label, ' ')) in ('1', 'y', 'yes', 'true')) as accepted, count_if(lower(trim(label, ' ')) in ('0', 'n', 'no', 'false')) as rejected from last group by cv_id""",
)
def accept_reject_counts(spark, sf_dir):
    """Counts of both verdicts, items with neither too."""
    word = F.lower(F.trim("label"))
    return last_labels(spark, sf_dir).groupBy("cv_id").agg(
        F.count_if(word.isin("1", "y", "yes", "true")).alias("accepted"), F.count_if(word.isin("0", "n", "no", "false")).alias("rejected")
    )


@query(
    "annotator_sums",
    "select category, "
    + ", ".join(f"sum({m})::bigint as {m}_sum, count({m}) as {m}_n, round(avg({m}), 9) as {m}_rate" for m in ANNOTATORS)
    + f" from {_CVS} group by category",
)
def annotator_sums(spark, sf_dir):
    """Sum, count and rate of the present votes by group."""
    aggs = [x for m in ANNOTATORS for x in (F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"), F.round(F.avg(m), 9).alias(f"{m}_rate"))]
    return validation(spark, sf_dir).groupBy("category").agg(*aggs)


_PATTERN = " || ".join(f"coalesce({m}::varchar, '_')" for m in ANNOTATORS)


@query("pattern_counts", f"select category, {_PATTERN} as pattern, count(*) as n from {_CVS} group by 1, 2")
def pattern_counts(spark, sf_dir):
    return metrics.pattern_counts(validation(spark, sf_dir), ["category"], ANNOTATORS)


_PAIRS = [(a, b) for i, a in enumerate(ANNOTATORS) for b in ANNOTATORS[i + 1 :]]


@query(
    "contingency_pairs",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, " + ", ".join(f"count_if({a} = {i} and {b} = {j}) as n{i}{j}" for i in (0, 1) for j in (0, 1)) + f" from {_CVS}" for a, b in _PAIRS
    ),
)
def contingency_pairs(spark, sf_dir):
    return metrics.contingency(validation(spark, sf_dir), ANNOTATORS)


@query(
    "theta",
    " union all ".join(f"select category as label, '{m}' as method, round(coalesce(avg({m}), 0.5), 9) as p1 from {_CVS} where category in (0, 1) group by 1" for m in ANNOTATORS),
)
def theta(spark, sf_dir):
    return metrics.theta(validation(spark, sf_dir), "category", ANNOTATORS).select("label", "method", F.round("p1", 9).alias("p1"))


@query(
    "corr_by_class",
    " union all ".join(f"select category, '{a}' as a, '{b}' as b, round(coalesce(corr({a}, {b}), 0), 6) as rho from {_CVS} where category is not null group by 1" for a, b in _PAIRS),
)
def corr_by_class(spark, sf_dir):
    told = metrics.correlations(validation(spark, sf_dir).filter("category is not null"), ANNOTATORS, "category")
    return told.select("category", "a", "b", F.round("rho", 6).alias("rho"))


@query(
    "correlation_distance",
    "with r as (" + " union all ".join(f"select category, '{a}' as a, '{b}' as b, coalesce(corr({a}, {b}), 0) as rho from {_CVS} where category is not null group by 1" for a, b in _PAIRS) + """)
select round(avg(abs(x.rho - y.rho)), 6) as mean_abs, round(max(abs(x.rho - y.rho)), 6) as max_abs, round(sqrt(sum(power(x.rho - y.rho, 2))), 6) as frobenius
from r x join r y on x.a = y.a and x.b = y.b where x.category = 0 and y.category = 1""",
)
def correlation_distance(spark, sf_dir):
    """Distance of two classes' correlation matrices over the distinct pairs, by pivot instead of a self-join."""
    r = metrics.correlations(validation(spark, sf_dir).filter("category is not null"), ANNOTATORS, "category")
    gap = F.abs(F.col("0") - F.col("1"))
    wide = r.groupBy("a", "b").pivot("category", [0, 1]).agg(F.first("rho")).na.drop()
    return wide.agg(F.round(F.avg(gap), 6).alias("mean_abs"), F.round(F.max(gap), 6).alias("max_abs"), F.round(F.sqrt(F.sum(gap * gap)), 6).alias("frobenius"))


@query("tetrachoric_pairs")
def tetrachoric_pairs(spark, sf_dir):
    """Latent correlation of every pair of annotators by class."""
    return bootstrap.tetrachoric_table(metrics.contingency(validation(spark, sf_dir).filter("category is not null"), ANNOTATORS, ["category"]))


@query("posterior_patterns")
def posterior_patterns(spark, sf_dir):
    v = validation(spark, sf_dir)
    prior = v.filter("category in (0, 1)").agg(F.avg("category")).first()[0]
    return bootstrap.pattern_posteriors(v, "category", ANNOTATORS, prior)


ITERATIONS = 256


def company_votes(spark, sf_dir):
    """The votes of validation CVs spread over invented companies of growing size."""
    v = validation(spark, sf_dir).withColumn("company", F.concat(F.lit("c"), F.pmod(F.xxhash64("cv_id"), F.lit(40)).cast("string")))
    counts = metrics.pattern_counts(v, ["company"], ANNOTATORS)
    return counts.groupBy("company").agg((F.sum("n") * 2).alias("headcount"), F.collect_list(F.struct("pattern", "n")).alias("patterns"))


@query("bootstrap_counts")
def bootstrap_counts(spark, sf_dir):
    labelled = bootstrap.class_counts(validation(spark, sf_dir), "category", ANNOTATORS)
    draws = bootstrap.bootstrap_counts(company_votes(spark, sf_dir), "company", "headcount", labelled, len(ANNOTATORS), ITERATIONS)
    return bootstrap.summarise(draws, "company")


@query("validation_bootstrap")
def validation_bootstrap(spark, sf_dir):
    return bootstrap.validation_bootstrap(validation(spark, sf_dir), "category", ANNOTATORS, ITERATIONS, 0.3)


@query("synthetic_counts")
def synthetic_counts(spark, sf_dir):
    """Votes of companies that have only totals, by a Gaussian copula."""
    labelled = bootstrap.class_counts(validation(spark, sf_dir), "category", ANNOTATORS[3:])
    probit = bootstrap.fit_probit(labelled, 3)
    c = relational.first_wins(companies(spark, sf_dir).select("company_id", "total_headcount", *ANNOTATORS[3:]), ["company_id"], ["total_headcount"])
    return bootstrap.synthetic_patterns(c, "company_id", "total_headcount", ANNOTATORS[3:], probit)


@query("fake_annotations")
def fake_annotations(spark, sf_dir):
    return bootstrap.fake_annotations(spark, 100, 30_000, [0.8, 0.7, 0.7, 0.9, 0.75, 0.9], [0.6, 0.5, 0.9, 0.65, 0.5, 0.9])
