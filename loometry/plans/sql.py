"""Families of read-only SQL (Q1-Q18): user statements go to Spark SQL as they
are; the three that Spark lacks have operators of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from loometry.operators import ranking as rk
from loometry.operators.timeline import asof_last
from loometry.plans.registry import query
from loometry.session import shared_dir
from loometry.sources.warehouse import Warehouse

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def user_sql(m, text: str):
    """What the guard lets through, over the provided tables as views."""
    house = Warehouse(m.spark, shared_dir(m.spark, "warehouse"))
    for name in TABLES:
        if name in text:
            house.register(name, m.raw(name))
    return house.query(text)


def passthrough(name: str, text: str, oracle: str | None = None):
    query(name, oracle or text)(lambda m: user_sql(m, text))


passthrough("q1_joins", """
SELECT s_name, n_name, 'left' AS kind FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1
UNION ALL SELECT s_name, n_name, 'right' FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 2
UNION ALL SELECT s_name, n_name, 'full' FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000
UNION ALL SELECT s_name, n_name, 'inner' FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
passthrough("q2_semi_anti", """
SELECT c_custkey, 'semi' AS kind FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 400000)
UNION ALL SELECT c_custkey, 'anti' FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 400000)
""")
passthrough("q3_theta_lateral", """
SELECT r_name, n_name, k.n AS suppliers FROM region JOIN nation ON n_regionkey >= r_regionkey AND n_regionkey < r_regionkey + 2,
LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) k
""")


@query("q4_asof_join", """
SELECT p.event_id, p.user_id, coalesce(c.event_id, -1) AS click_id, coalesce(c.value, -1) AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def q4(m):
    events = m.raw("events").withColumn("t", F.unix_micros("ts"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    # Clicks of one user at the same instant: the last id stands for them.
    clicks = events.filter("event_type = 'click'").groupBy("user_id", "t").agg(
        F.max_by(F.struct("event_id", "value"), "event_id").alias("click")
    )
    out = asof_last(
        bought, clicks, keys=["user_id"], left_time="t", right_time="t", value=F.col("click"), name="click",
    )
    return out.select(
        "event_id", "user_id", F.coalesce("click.event_id", F.lit(-1)).alias("click_id"),
        F.coalesce("click.value", F.lit(-1.0)).alias("click_value"),
    )


passthrough("q5_grouping_sets", """
SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS big, 'cube' AS kind
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT coalesce(l_returnflag, 'all'), coalesce(l_linestatus, 'all'), count(*), count(*) FILTER (WHERE l_quantity > 25), 'rollup' FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT coalesce(l_returnflag, 'all'), coalesce(l_linestatus, 'all'), count(*), 0, 'sets' FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))
""")
passthrough("q5_group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
passthrough("q6_aggregates", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(sum(l_extendedprice), 2) AS total, round(stddev(l_quantity), 6) AS dev,
  round(variance(l_discount), 8) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r, count(DISTINCT l_suppkey) AS suppliers,
  abs(approx_count_distinct(l_suppkey) - count(DISTINCT l_suppkey)) <= 0.2 * count(DISTINCT l_suppkey) AS near FROM lineitem GROUP BY l_returnflag
""")


@query("q7_quantiles", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS q_0_5, quantile_cont(l_extendedprice, 0.25) AS q_0_25, quantile_cont(l_extendedprice, 0.9) AS q_0_9 FROM lineitem GROUP BY 1
""".replace("quantile_cont(l_extendedprice, 0.5)", "round(quantile_cont(l_extendedprice, 0.5), 4)")
    .replace("quantile_cont(l_extendedprice, 0.25)", "round(quantile_cont(l_extendedprice, 0.25), 4)")
    .replace("quantile_cont(l_extendedprice, 0.9)", "round(quantile_cont(l_extendedprice, 0.9), 4)"))
def q7(m):
    out = rk.exact_quantile(m.raw("lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.25, 0.9])
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q_0_5", "q_0_25", "q_0_9")])


passthrough(
    "q7_median",
    "SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY o_totalprice), 4) AS upper FROM orders GROUP BY 1",
)


@query("q8_window_functions", """
SELECT o_orderkey, row_number() OVER w AS row_number, rank() OVER (PARTITION BY o_orderstatus ORDER BY day) AS rank,
  dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY day) AS dense_rank, ntile(7) OVER w AS ntile,
  coalesce(lag(day) OVER w, -1) AS previous, coalesce(lead(day) OVER w, -1) AS following, (sum(day) OVER (PARTITION BY o_orderstatus ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS running_sum
FROM (SELECT *, epoch_us(o_orderdate) // 86400000000 AS day FROM orders) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day, o_orderkey)
""")
def q8(m):
    days = m.raw("orders").select("o_orderkey", "o_orderstatus", F.expr("unix_micros(o_orderdate) div 86400000000").alias("day"))
    out = rk.ranked(days, ["o_orderstatus"], "day", "o_orderkey", tiles=7)
    return out.select(
        "o_orderkey", "row_number", "rank", "dense_rank", "ntile", F.coalesce("previous", F.lit(-1)).alias("previous"),
        F.coalesce("following", F.lit(-1)).alias("following"), "running_sum",
    )


@query("q9_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def q9(m):
    df = m.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rk.first_per_key(df, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


passthrough("q10_set_operations", """
SELECT k, 'both' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'only' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT k, 'any' FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT n_regionkey FROM nation)
""")
passthrough("q11_recursive_cte", """
WITH RECURSIVE span(lo, hi) AS (SELECT min(c_custkey), max(c_custkey) FROM customer UNION ALL SELECT lo + (hi - lo) / 2 + 1, hi FROM span WHERE hi - lo > 10)
SELECT lo, hi, (SELECT count(*) FROM customer) AS n FROM span
""".replace("(hi - lo) / 2", "cast(floor((hi - lo) / 2) AS bigint)"))
passthrough(
    "q12_dates",
    "SELECT date_format(date_trunc('month', o_orderdate), 'yyyy-MM') AS month, extract(year FROM o_orderdate) AS year, count(*) AS n, max(date_format(o_orderdate + INTERVAL 3 DAY, 'yyyy-MM-dd')) AS last FROM orders GROUP BY 1, 2",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, extract(year FROM o_orderdate) AS year, count(*) AS n, max(strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d')) AS last FROM orders GROUP BY 1, 2",
)
passthrough(
    "q13_json_text",
    "SELECT event_type, sum(cast(get_json_object(props, '$.k') AS bigint)) AS total FROM events GROUP BY 1",
    "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1",
)
passthrough(
    "q14_unnest",
    "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM documents) GROUP BY 1",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1",
)
passthrough(
    "q15_pivot",
    "SELECT * FROM (SELECT event_type, user_id % 3 AS g, value FROM events) PIVOT (count(value) FOR g IN (0 AS a, 1 AS b, 2 AS c))",
    "SELECT event_type, count(value) FILTER (WHERE user_id % 3 = 0) AS a, count(value) FILTER (WHERE user_id % 3 = 1) AS b, count(value) FILTER (WHERE user_id % 3 = 2) AS c FROM events GROUP BY 1",
)
passthrough(
    "q16_string_aggregate",
    "SELECT c_mktsegment, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1",
    "SELECT c_mktsegment, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1",
)
passthrough(
    "q17_arithmetic_casts",
    "SELECT o_orderkey, o_orderkey / 2 AS half, -o_orderkey % 3 AS m, o_custkey::string AS s, coalesce(try_cast(o_orderpriority AS int), -1) AS bad, o_orderkey div 4 AS whole FROM orders",
    "SELECT o_orderkey, o_orderkey / 2 AS half, -o_orderkey % 3 AS m, o_custkey::VARCHAR AS s, coalesce(try_cast(o_orderpriority AS INT), -1) AS bad, o_orderkey // 4 AS whole FROM orders",
)
passthrough(
    "q18_exclude_max_by_regex",
    "SELECT c_mktsegment, max_by(c_name, c_custkey) AS newest, count(*) AS n FROM (SELECT * EXCEPT (c_acctbal) FROM customer) WHERE c_name rlike '[13579]$' GROUP BY 1",
    "SELECT c_mktsegment, arg_max(c_name, c_custkey) AS newest, count(*) AS n FROM (SELECT * EXCLUDE (c_acctbal) FROM customer) WHERE regexp_matches(c_name, '[13579]$') GROUP BY 1",
)


@query("a17_named_aggregates", """
SELECT event_type, round(avg(value), 6) AS avg, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS q95, count(*) AS count, round(sum(value), 2) AS sum FROM events GROUP BY 1
""")
def a17(m):
    events = m.raw("events")
    points = rk.exact_quantile(events, ["event_type"], "value", [0.5, 0.95])
    plain = events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("avg"), F.count(F.lit(1)).alias("count"), F.round(F.sum("value"), 2).alias("sum")
    )
    return plain.join(points, "event_type").select(
        "event_type", "avg", F.round("q_0_5", 6).alias("median"), F.round("q_0_95", 6).alias("q95"), "count", "sum"
    )


# A sample holds rows of the table, each at most once, about as many as asked for, the
# same ones when repeated and others under another seed.
passthrough("q18_table_sample", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem TABLESAMPLE (50 PERCENT) REPEATABLE (7)),
b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem TABLESAMPLE (50 PERCENT) REPEATABLE (7)),
c AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem TABLESAMPLE (50 PERCENT) REPEATABLE (8)),
t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)
SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM a) BETWEEN 0.45 * (SELECT count(*) FROM t) AND 0.55 * (SELECT count(*) FROM t) AS about_half,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM t)) AS invented, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS changed,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)) > 0 AS other_seed
""", "SELECT count(*) AS n, true AS about_half, 0::BIGINT AS invented, 0::BIGINT AS changed, true AS other_seed FROM lineitem")
