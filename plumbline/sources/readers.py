"""Schema-first readers. None infers a schema from the data, so every scan prunes columns and pushes filters down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.keywords import base_match, broad_yes_match, strict_no_match
from plumbline.operators.relational import first_wins, first_wins_union

PROFILE = """linkedin_id string, id string, about string, headline string, summary string, current_company struct<company_id string, name string>,
experience array<struct<title string, company string, description string, start_date string, end_date string>>,
education array<struct<title string, field string, degree string, description string>>, certifications array<struct<name string, authority string>>"""
BATCH = "batch int, batch_size int, timestamp string, results array<struct<linkedin_id string, evaluation string>>"
FLAGS = "id string, ml_match int, broad_match int, strict_no_match int"


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header. Columns are taken by name from the header; columns without a name are dropped."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    have = {c.lower(): c for c in raw.columns if not c.startswith("Unnamed") and not c.startswith("_c")}
    columns = []
    for f in wanted:
        found = have.get(f.name.lower())
        columns.append((F.col(f"`{found}`").try_cast(f.dataType) if found else F.lit(None).cast(f.dataType)).alias(f.name))
    return raw.select(*columns)


def read_labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated profile_summary, category as cv_text, category."""
    return read_delimited(spark, path, "profile_summary string, category string", "\t").withColumnRenamed("profile_summary", "cv_text")


def read_affiliations(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "Affiliation string, count bigint").withColumnRenamed("Affiliation", "affiliation")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, compressed or not; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_json_any(spark: SparkSession, path: str, element: str, field: str = "profiles") -> DataFrame:
    """A JSON file in any of the usual shapes: lines, an array, an object with ``field``, an object of objects."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    whole = text.withColumn("kind", F.when(F.col("v").startswith("["), "array").when(F.get_json_object("v", f"$.{field}").isNotNull(), "field").when(F.from_json("v", "map<string, string>").isNotNull() & ~F.col("v").contains("\n{"), "object").otherwise("lines"))
    kind = whole.first()["kind"]  # one small file decides the shape
    if kind == "lines":
        return lines.select(F.from_json("v", element).alias("r")).filter("r is not null").select("r.*")
    array = {
        "array": F.from_json("v", f"array<{element}>"),
        "field": F.from_json(F.get_json_object("v", f"$.{field}"), f"array<{element}>"),
        "object": F.map_values(F.from_json("v", f"map<string, {element}>")),
    }[kind]
    return whole.select(F.explode(array).alias("r")).filter("r is not null").select("r.*")


def truthy(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def profile_summary(about: Column, headline: Column, experience: Column, first: int = 3) -> Column:
    """about, headline and the first descriptions, non-empty ones joined by blanks."""
    parts = F.concat(F.array(about, headline), F.coalesce(F.transform(F.slice(experience, 1, first), lambda e: e["description"]), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def read_profiles(spark: SparkSession, sources: list[str | list[str]]) -> DataFrame:
    """Profiles of several sources in order of precedence, the first of each id, with their summary and company.

    Ids are linkedin_id, else id. Profiles without a company are left out.
    """
    tagged = []
    for source in sources:
        raw = spark.read.schema(PROFILE).option("mode", "DROPMALFORMED").json(source).withColumn("__file", F.input_file_name()).withColumn("__line", F.monotonically_increasing_id())
        tagged.append(raw.withColumn("public_identifier", F.coalesce(truthy(F.col("linkedin_id")), truthy(F.col("id")))).filter("public_identifier is not null"))
    one = first_wins_union(tagged, ["public_identifier"], ["__file", "__line"])
    told = one.select(
        "public_identifier",
        profile_summary(F.col("about"), F.col("headline"), F.col("experience")).alias("profile_summary"),
        F.col("current_company.company_id").alias("company_id"),
        F.col("current_company.name").alias("company_name"),
    )
    return told.filter(F.col("company_id").isNotNull() & (F.col("company_id") != ""))


def read_flags(spark: SparkSession, sources: list[str]) -> DataFrame:
    """Keyword flags by id with their compounds; of repeated ids the first."""
    read = [read_delimited(spark, s, FLAGS).withColumn("__line", F.monotonically_increasing_id()) for s in sources]
    one = first_wins_union(read, ["id"], ["__line"])
    ml, broad, strict = (F.col(c) == 1 for c in ("ml_match", "broad_match", "strict_no_match"))
    return one.select(
        F.col("id").alias("public_identifier"),
        (ml & broad).cast("int").alias("filter_broad_yes"),
        (ml & strict).cast("int").alias("filter_strict_no"),
        (ml & broad & strict).cast("int").alias("filter_broad_yes_strict_no"),
    )


def read_verdicts(spark: SparkSession, path: str, model: str, glob: str = "batch_results_*.jsonl") -> DataFrame:
    """Verdicts of one model's batch files: 1 for ACCEPT; the first per id by file and line."""
    raw = spark.read.schema(BATCH).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob).json(path)
    raw = raw.withColumn("__file", F.input_file_name()).withColumn("__line", F.monotonically_increasing_id())
    flat = raw.select("__file", "__line", F.posexplode("results").alias("__at", "r")).select("__file", "__line", "__at", "r.*").filter("linkedin_id is not null")
    one = first_wins(flat, ["linkedin_id"], ["__file", "__line", "__at"])
    return one.select(F.col("linkedin_id").alias("public_identifier"), (F.col("evaluation") == "ACCEPT").cast("int").alias(f"llm_{model}"))


def assemble(profiles: DataFrame, flags: DataFrame, verdicts: list[DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Profiles with flags and every model's verdict, left joined; restricted to company ids where given, before the joins."""
    out = profiles if ids is None else profiles.join(ids, "company_id", "left_semi")
    for part in (flags, *verdicts):
        out = out.join(part, "public_identifier", "left")
    return out


def text_flags(profiles: DataFrame, text: str = "profile_summary") -> DataFrame:
    """The flags computed from the text instead of read."""
    t = F.col(text)
    ml, broad, strict = base_match(t), broad_yes_match(t), strict_no_match(t)
    return profiles.select("public_identifier", (ml & broad).cast("int").alias("filter_broad_yes"), (ml & strict).cast("int").alias("filter_strict_no"), (ml & broad & strict).cast("int").alias("filter_broad_yes_strict_no"))


def company_master(raw: DataFrame, rename: dict[str, str], showcase: bool = True, numeric_fallback: bool = False) -> DataFrame:
    """A company table brought to one form: names, counts by number, flags, id from the address.

    With ``numeric_fallback`` a company without address is known by its id.
    """
    have = raw.withColumnsRenamed(rename)
    counts = [c for c in ("total_headcount", "claude_total_accepted", "gpt5_total_accepted", "gemini_total_accepted", "filter_broad_yes", "filter_strict_no", "filter_broad_yes_strict_no") if c in have.columns]
    have = have.withColumns({c: tx.to_number(F.col(c).cast("string")) for c in counts})
    have = have.withColumns({c: tx.to_flag(F.col(c)) for c in ("max_headcount", "max_population") if c in have.columns})
    have = have.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown")) for c in ("headquarters_location", "country", "subregion") if c in have.columns})
    if "linkedin_url" in have.columns:
        slug = tx.company_slug(F.col("linkedin_url"), showcase)
        have = have.withColumn("linkedin_id", F.coalesce(slug, F.col("id").cast("string")) if numeric_fallback else slug)
    return have


def company_base(raw: DataFrame, default_employees: int = 100) -> DataFrame:
    """Add id, employees, total_headcount and company_size to a table of companies.

    The id is ``company_id``, else ``linkedin_id``, else the first column; the
    employees are ``employees_in_linkedin``, else ``employees``, else
    ``default_employees`` where the table has neither. Null counts are 0 and of
    unknown size.
    """
    have = raw.columns
    key = next((c for c in ("company_id", "linkedin_id") if c in have), have[0])
    count = next((F.col(c) for c in ("employees_in_linkedin", "employees") if c in have), F.lit(default_employees)).cast("bigint")
    size = (
        F.when(count.isNull() | (count == 0), "Unknown")
        .when(count < 10, "Startup")
        .when(count < 50, "Small")
        .when(count < 200, "Medium")
        .when(count < 1000, "Large")
        .otherwise("Enterprise")
    )
    filled = F.coalesce(count, F.lit(0).cast("bigint"))
    return raw.withColumns({"id": F.col(key), "employees": filled, "total_headcount": filled, "company_size": size})
