"""Queries that write a table in some format below the shared folder and read it back, and the streams over files."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.base import query, table
from plumbline.plans.texts import LISTS
from plumbline.session import _remove, shared_dir
from plumbline.sources import contracts, readers, writers


def _place(spark, name: str) -> str:
    """A path below the shared folder, cleared when the driver ends."""
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _companies(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "final_results_comparator_ml")
    return f.select("id", "organization_name", "country", "total_headcount", "claude_total_accepted")


_COMPANIES = "select id, organization_name, country, total_headcount, claude_total_accepted from final_results_comparator_ml"
_SCHEMA = "id bigint, organization_name string, country string, total_headcount bigint, claude_total_accepted double"


@query("csv_files", _COMPANIES)
def csv_files(spark, sf_dir):
    """A table through CSV and back."""
    path = _place(spark, "csv")
    writers.save(_companies(spark, sf_dir), path, "csv")
    return readers.read_delimited(spark, path, _SCHEMA)


@query("tsv_files", "select coalesce(source, '') as cv_text, doc_id::varchar as category from documents where source is not null")
def tsv_files(spark, sf_dir):
    """Labelled texts through tab-separated files and back."""
    path = _place(spark, "tsv")
    d = table(spark, sf_dir, "documents").filter("source is not null")
    writers.save(d.select(F.col("source").alias("profile_summary"), F.col("doc_id").cast("string").alias("category")), path, "tsv")
    return readers.read_labelled_texts(spark, path)


@query("affiliation_files", "select affiliation_id::varchar as affiliation, count from affiliations")
def affiliation_files(spark, sf_dir):
    path = _place(spark, "affiliations")
    a = table(spark, sf_dir, "affiliations").select(F.col("affiliation_id").cast("string").alias("Affiliation"), "count")
    writers.save(a, path, "csv")
    return readers.read_affiliations(spark, path)


@query("jsonl_files", "select doc_id, text, lang, source from documents")
def jsonl_files(spark, sf_dir):
    """Whole texts, dirt and all, through compressed JSON lines and back."""
    path = _place(spark, "json")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").write.option("compression", "gzip").option("ignoreNullFields", False).json(path)
    return readers.read_jsonl(spark, path, "doc_id bigint, text string, lang string, source string")


@query("json_array_file", "select n_nationkey, n_name, n_regionkey from nation")
def json_array_file(spark, sf_dir):
    """A small table as one JSON array, and back."""
    path = _place(spark, "array")
    writers.as_json_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).coalesce(1).write.text(path)
    return readers.read_json_any(spark, path, "struct<n_nationkey: bigint, n_name: string, n_regionkey: bigint>")


@query("json_lines_shape", "select n_nationkey, n_name from nation")
def json_lines_shape(spark, sf_dir):
    """The same reader on lines."""
    path = _place(spark, "lines")
    writers.as_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).coalesce(1).write.text(path)
    return readers.read_json_any(spark, path, "struct<n_nationkey: bigint, n_name: string>")


@query("appended_metrics", "select r_regionkey, count(*) as n from (select r_regionkey from region union all select r_regionkey from region) group by 1")
def appended_metrics(spark, sf_dir):
    """Two appends to one set of files."""
    path = _place(spark, "metrics")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    for _ in range(2):
        writers.append_metrics(r, path)
    return readers.read_delimited(spark, path, "r_regionkey bigint, r_name string").groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("verdict_files", "select doc_id::varchar as public_identifier, (doc_id % 3 = 0)::int as llm_a from documents")
def verdict_files(spark, sf_dir):
    """Verdicts of a model in batch files, ten to a batch, exploded to one per record."""
    path = _place(spark, "verdicts")
    d = table(spark, sf_dir, "documents").select("doc_id")
    verdict = F.struct(F.col("doc_id").cast("string").alias("linkedin_id"), F.when(F.col("doc_id") % 3 == 0, "ACCEPT").otherwise("REJECT").alias("evaluation"))
    b = d.groupBy(F.floor(F.col("doc_id") / 10).cast("int").alias("batch")).agg(F.collect_list(verdict).alias("results"))  # ten to a batch
    b.select("batch", F.size("results").alias("batch_size"), "results").write.json(path)
    return readers.read_verdicts(spark, path, "a", glob="*.json")


@query("flag_files", "select doc_id::varchar as public_identifier, (doc_id % 2 = 0 and doc_id % 3 = 0)::int as filter_broad_yes, (doc_id % 2 = 0 and doc_id % 5 = 0)::int as filter_strict_no, (doc_id % 30 = 0)::int as filter_broad_yes_strict_no from documents")
def flag_files(spark, sf_dir):
    """Keyword flags of two files, the first of each id, with their compounds."""
    d = table(spark, sf_dir, "documents")
    flag = lambda k: (F.col("doc_id") % k == 0).cast("int")
    one, two = _place(spark, "flags"), _place(spark, "flags")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), flag(2).alias("ml_match"), flag(3).alias("broad_match"), flag(5).alias("strict_no_match"))
    writers.save(rows, one, "csv")
    writers.save(rows.withColumn("ml_match", F.lit(0)), two, "csv")
    return readers.read_flags(spark, [one, two])


@query(
    "profile_files",
    """select doc_id::varchar as public_identifier, concat_ws(' ', nullif(text, ''), nullif(lang, ''), nullif(source, '')) as profile_summary, company_slug as company_id, source as company_name from documents where company_slug <> ''""",
)
def profile_files(spark, sf_dir):
    """Profiles of two sources of JSON lines, the first of each id, with summary and company."""
    d = table(spark, sf_dir, "documents")
    entry = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("company"), F.col("source").alias("description")))
    rows = d.select(
        F.lit("").alias("linkedin_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("about"), F.col("lang").alias("headline"),
        F.struct(F.col("company_slug").alias("company_id"), F.col("source").alias("name")).alias("current_company"), entry.alias("experience"),
    )
    one, two = _place(spark, "profiles"), _place(spark, "profiles")
    rows.write.json(one)
    rows.withColumn("about", F.lit("later")).write.json(two)
    return readers.read_profiles(spark, [one, two])


@query("table_contract", "select count_if(affiliation is null) as missing, count_if(count is null) as uncounted, count_if(count < 0) as negative from affiliations")
def table_contract(spark, sf_dir):
    """Rows that break each rule of a table's contract."""
    broken = contracts.violations(table(spark, sf_dir, "affiliations"), contracts.contract("affiliations"))
    row = (broken.get("affiliation: null", 0), broken.get("count: null", 0), broken.get("count: below 0", 0))
    return spark.createDataFrame([row], "missing bigint, uncounted bigint, negative bigint")


@query("list_columns", "select c_custkey, list_filter(list_transform(string_split(c_name || ' , ,' || c_mktsegment, ','), lambda x: trim(x, ' ')), lambda x: x <> '') as parts from customer")
def list_columns(spark, sf_dir):
    """Comma-separated texts as arrays of their parts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" , ,"), "c_mktsegment").alias("parts"))
    return writers.split_lists(c, ["parts"])


@query(
    "grid_rows",
    "select a as layers, b as rate, c as seed, a * b as product from (select unnest([1, 2, 4])::bigint as a) cross join (select unnest([0.1, 0.5])::double as b) cross join (select unnest([7, 8])::bigint as c)",
)
def grid_rows(spark, sf_dir):
    """Every combination of an experiment's choices."""
    from plumbline.operators.design import grid

    g = grid(spark, layers=[1, 2, 4], rate=[0.1, 0.5], seed=[7, 8])
    return g.withColumn("product", F.col("layers") * F.col("rate"))


@query("prior_density", "select i::int as i, round((i + 0.5) / 200, 9) as x, round(999.0 * power(1 - (i + 0.5) / 200, 998), 6) as density from range(200) t(i)")
def prior_density(spark, sf_dir):
    """The density of the prior of the largest companies, a Beta law."""
    from plumbline.operators.bootstrap import PRIORS
    from plumbline.operators.design import beta_density

    rows = [(i, round(x, 9), round(d, 6)) for i, (x, d) in enumerate(beta_density(*PRIORS[-1][1]))]
    return spark.createDataFrame(rows, "i int, x double, density double")


@query("layer_fractions", "select unnest([0, 8, 16, 24, 31])::int as layer")
def layer_fractions(spark, sf_dir):
    """Fractions of a number of layers as their indices."""
    from plumbline.operators.design import fractions_to_layers

    return spark.createDataFrame([(i,) for i in fractions_to_layers([0.0, 0.25, 0.5, 0.75, 1.0], 32)], "layer int")


@query("keyword_list_sets", "select * from (values " + ", ".join(f"('{k}', {len(v)}::bigint)" for k, v in LISTS.items()) + ") as t(list, n)")
def keyword_list_sets(spark, sf_dir):
    """The keyword lists through their export as comma-separated texts."""
    df = spark.createDataFrame([(k, ", ".join(v)) for k, v in LISTS.items()], "list string, words string")
    return writers.split_lists(df, ["words"]).select("list", F.size("words").cast("bigint").alias("n"))


@query("normal_quantiles", "select * from (values (1, -1.281551566), (2, -0.841621234), (3, -0.524400513), (4, -0.253347103), (5, 0.0), (6, 0.253347103), (7, 0.524400513), (8, 0.841621234), (9, 1.281551566)) as t(tenth, z)")
def normal_quantiles(spark, sf_dir):
    """Quantiles of the normal law at the tenths, over Arrow batches."""
    import numpy as np
    import pandas as pd

    from plumbline.functions.kernels import phi_inv

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"tenth": b["id"].astype("int32"), "z": np.round(phi_inv(b["id"].to_numpy() / 10.0), 9) + 0.0})

    return spark.range(1, 10).mapInPandas(run, "tenth int, z double")
