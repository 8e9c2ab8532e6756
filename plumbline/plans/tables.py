"""Queries over the order tables, events and embeddings: ranks, cut-offs, distributions, unions, vectors, questions, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import evalprep, metrics, relational, vectors
from plumbline.plans.base import query, table


@query(
    "topk_per_group",
    """select l_returnflag, l_orderkey, l_linenumber, place from (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as place from lineitem) where place <= 5""",
)
def topk_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    top = relational.top_per_group(li, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", "place")


@query(
    "topk_companies",
    "select o_custkey, count(*) as orders from orders where o_custkey in (select o_custkey from (select o_custkey, count(*) as n from orders group by 1 having count(*) >= 3 order by n desc, o_custkey limit 10)) group by 1",
)
def topk_companies(spark, sf_dir):
    """The largest groups above a least size."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return counts.filter("orders >= 3").orderBy(F.desc("orders"), "o_custkey").limit(10)


@query("dense_group_index", "select c_custkey, (dense_rank() over (order by c_mktsegment) - 1)::bigint as grp from customer where c_mktsegment is not null")
def dense_group_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").filter("c_mktsegment is not null")
    return relational.group_index(c, "c_mktsegment", "grp").select("c_custkey", "grp")


@query(
    "running_sum_cutoff",
    """with s as (select o_custkey, count(*) as n from orders group by 1), r as (select *, coalesce(sum(n) over (order by n, o_custkey rows between unbounded preceding and 1 preceding), 0) as before from s)
select o_custkey, n from r where before < 1000""",
)
def running_sum_cutoff(spark, sf_dir):
    """Smallest groups first until the target is crossed."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return relational.running_cutoff(s, "n", ["o_custkey"], 1000)


@query(
    "rolling_mean",
    "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as mean3 from events",
)
def rolling_mean(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean3"))


@query(
    "distribution_summary",
    """select l_suppkey, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std, round(quantile_cont(l_quantity::double, 0.1), 6) as q10,
  round(quantile_cont(l_quantity::double, 0.5), 6) as q50, round(quantile_cont(l_quantity::double, 0.9), 6) as q90 from lineitem group by 1""",
)
def distribution_summary(spark, sf_dir):
    told = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*metrics.distribution(F.col("l_quantity")))
    return told.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q10", "q50", "q90")])


@query(
    "precedence_union",
    """with main as (select c_custkey as id, 'main' as source from customer where c_nationkey < 5), a as (select c_custkey as id, 'first' as source from customer where c_nationkey < 10),
b as (select c_custkey as id, 'second' as source from customer where c_nationkey < 15)
select * from main union all select * from a where id not in (select id from main) union all select * from b where id not in (select id from main)""",
)
def precedence_union(spark, sf_dir):
    """Every key of the main table, and the main table's missing keys from each of two others, which are not compared with one another."""
    c = table(spark, sf_dir, "customer")
    part = lambda top, name: c.filter(F.col("c_nationkey") < top).select(F.col("c_custkey").alias("id"), F.lit(name).alias("source"))
    return relational.precedence_union(part(5, "main"), [part(10, "first"), part(15, "second")], "id")


@query(
    "segment_pivot",
    """select n_name as nation, count_if(c_mktsegment = 'BUILDING') as building, count_if(c_mktsegment = 'MACHINERY') as machinery, count(*) as total
from customer join nation on c_nationkey = n_nationkey group by 1""",
)
def segment_pivot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("nation")).agg(
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"), F.count("*").alias("total")
    )


@query(
    "order_totals_outer",
    """select coalesce(c_custkey, o_custkey) as custkey, coalesce(n, 0) as orders, c_custkey is null as orphan from customer full outer join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey""",
)
def order_totals_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select(
        F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.coalesce("n", F.lit(0)).alias("orders"), F.col("c_custkey").isNull().alias("orphan")
    )


_SIM = """list_dot_product(a.embedding::double[], b.embedding::double[]) / greatest(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 1e-12)"""


@query(
    "embedding_neighbours",
    f"""select query, neighbour, round(similarity, 6) as similarity from (select *, row_number() over (partition by query order by round(similarity, 9) desc, neighbour) as place from (
  select a.vec_id as query, b.vec_id as neighbour, {_SIM} as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0)) where place <= 20""",
)
def embedding_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = vectors.top_neighbours(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"))
    return found.select("query", "neighbour", F.round("similarity", 6).alias("similarity"))


#: Fixed value: two embeddings whose dot product reaches it are duplicates.
DUPLICATE_DOT = 0.6
_DUPLICATES = f"a.vec_id < b.vec_id and round(list_dot_product(a.embedding::double[], b.embedding::double[]), 9) >= {DUPLICATE_DOT}"


@query("embedding_dedup", f"select b.vec_id, min(a.vec_id) as keeper from embeddings b left join embeddings a on {_DUPLICATES} group by b.vec_id")
def embedding_dedup(spark, sf_dir):
    """Rows with the earliest earlier row that is nearly the same; those without are kept."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DUPLICATE_DOT, cosine=False)


@query("embedding_pairs", f"select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on {_DUPLICATES}")
def embedding_pairs(spark, sf_dir):
    """All pairs of rows that are nearly the same."""
    return vectors.near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DUPLICATE_DOT, cosine=False)


@query("embedding_pairwise_dot", "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 5) as norm2 from embeddings")
def embedding_pairwise_dot(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"))




def questions(spark, sf_dir):
    r = table(spark, sf_dir, "region").filter("r_regionkey < 4")
    choices = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: s["r_name"]).alias("choices"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 4")
    # one row of four names
    return n.crossJoin(F.broadcast(choices)).select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lit("Which region is "), "n_name", F.lit(" in?")).alias("question"),
        "choices",
        F.col("n_regionkey").cast("int").alias("answer"),
    )


_Q = """q as (select n_nationkey as id, 'Which region is ' || n_name || ' in?' as question, c.choices, n_regionkey::int as answer from nation
  cross join (select list(r_name order by r_regionkey) as choices from region where r_regionkey < 4) c where n_regionkey < 4)"""


@query(
    "mcq_prompt",
    f"""with {_Q} select id, question || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4] || chr(10)
  || 'Answer: ' || ['A', 'B', 'C', 'D'][answer + 1] || '. ' || choices[answer + 1] as prompt from q""",
)
def mcq_prompt(spark, sf_dir):
    return questions(spark, sf_dir).select("id", evalprep.mcq_prompt(F.col("question"), F.col("choices"), F.col("answer")).alias("prompt"))


@query("wrong_answers", f"with {_Q} select id, unnest(list_filter(choices, lambda c: c <> choices[answer + 1])) as wrong from q")
def wrong_answers(spark, sf_dir):
    return questions(spark, sf_dir).select("id", F.explode(evalprep.wrong_answers(F.col("choices"), F.col("answer"))).alias("wrong"))


@query("seeded_wrong_answer")
def seeded_wrong_answer(spark, sf_dir):
    return questions(spark, sf_dir).select("id", evalprep.seeded_wrong(F.col("question"), F.col("choices"), F.col("answer")).alias("wrong"))


@query("split_rotation")
def split_rotation(spark, sf_dir):
    """Rows per fold of a leave-one-split-out rotation."""
    parts = evalprep.splits(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 5)
    return evalprep.leave_one_out(parts, 5).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query("hash_sample")
def hash_sample(spark, sf_dir):
    """A reproducible sample of 100 rows in the order of a seeded hash."""
    return table(spark, sf_dir, "customer").orderBy(F.xxhash64("c_custkey", F.lit(42)), "c_custkey").limit(100).select("c_custkey")


@query(
    "fixed_batches",
    "with r as (select n_name, row_number() over (order by n_nationkey) as nr from nation) select floor((nr - 1) / 10)::bigint as batch, list(n_name order by nr) as items from r group by 1",
)
def fixed_batches(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") + 1).alias("nr"))
    return relational.batches(n, "nr", 10, "n_name")


_LOGITS = "[sin(vec_id), sin(vec_id * 2.0), sin(vec_id * 3.0), sin(vec_id * 5.0)]"


@query(
    "calibrated_accuracy",
    f"""with s as (select label as file, (vec_id % 4)::int as answer, {_LOGITS} as l from embeddings),
m as (select file, [avg(l[1]), avg(l[2]), avg(l[3]), avg(l[4])] as m from s group by file),
c as (select s.file, answer, l, [l[1] - m[1], l[2] - m[2], l[3] - m[3], l[4] - m[4]] as c from s join m on s.file = m.file),
h as (select file, answer, (list_position(l, list_max(l)) - 1 = answer)::int as hit, (list_position(c, list_max(c)) - 1 = answer)::int as chit from c),
g as (select file, answer, count(*) as n, sum(hit) as h, sum(chit) as ch from h group by 1, 2)
select file, round(sum(h) / sum(n), 9) as accuracy, round(sum(ch) / sum(n), 9) as calibrated, round(avg(ch / n), 9) as balanced from g group by 1""",
)
def calibrated_accuracy(spark, sf_dir):
    v = F.col("vec_id").cast("double")
    s = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("file"), F.pmod("vec_id", F.lit(4)).cast("int").alias("answer"), F.array(F.sin(v), F.sin(v * 2.0), F.sin(v * 3.0), F.sin(v * 5.0)).alias("logits")
    )
    told = evalprep.calibrated_accuracy(s, "file", "logits", "answer")
    return told.select("file", *[F.round(c, 9).alias(c) for c in ("accuracy", "calibrated", "balanced")])


@query("stream_event_windows", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_event_windows(spark, sf_dir):
    """Event-time windows over a stream of the events, run to its end; an extension for streams."""
    from plumbline.streaming import run_to_table

    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir)
    w = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    told = run_to_table(w.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "complete")
    return told.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_first_seen", "select user_id from events where user_id is not null group by user_id")
def stream_first_seen(spark, sf_dir):
    from plumbline.streaming import first_seen, run_to_table

    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir).filter("user_id is not null")
    return run_to_table(first_seen(stream, "user_id")).select("user_id")
