"""SQL shared by the queries' DuckDB counterparts."""

METHODS = [
    "filter_broad_yes",
    "filter_strict_no",
    "filter_broad_yes_strict_no",
    "claude_total_accepted",
    "gpt5_total_accepted",
    "gemini_total_accepted",
]
MODEL = METHODS[3:]

COMPANIES = "(select distinct * from log_debias_company_aggregates)"

LOGS = f"""
base as (select *, row_number() over () as rid from {COMPANIES}),
num as (select * replace ({', '.join(f'nullif({c}, 0) as {c}' for c in MODEL)}) from base),
long as ({' union all '.join(f"select rid, '{c}' as method, ln(case when {c} <= 0 then 0.5 else {c} end) as x from num where {c} is not null" for c in METHODS)}),
centre as (select rid, quantile_cont(x, 0.5) as m from long group by rid),
alpha as (select method, quantile_cont(x - m, 0.5) as a from long join centre using (rid) group by method),
y as (select rid, method, x - a as y from long join alpha using (method)),
told as (select rid, quantile_cont(y, 0.5) as mu, quantile_cont(y, 0.1) as lo, quantile_cont(y, 0.9) as hi, count(*) as k from y group by rid),
dev as (select rid, max(abs(y - mu)) as d from y join told using (rid) group by rid),
debiased as (
  select n.*, round_even(exp(mu), 0)::bigint as ml_consensus_round, round_even(exp(lo), 0)::bigint as ml_lower80_round,
    round_even(exp(hi), 0)::bigint as ml_upper80_round, exp(hi) / exp(lo) as uncertainty_factor_x, coalesce(k, 0)::int as k_methods,
    coalesce(d > ln(3.0), false) as outlier_flag_gt3x,
    case when total_headcount > 0 then round_even(exp(mu), 0) / total_headcount end as ml_share
  from num n left join told using (rid) left join dev using (rid))
"""
