"""Queries of the telemetry engine and the SQL that checks them.

Most entries are one text in the service's dialect: Spark runs its translation, DuckDB
the text itself.  The others are built with the DataFrame API and have SQL of their own.
Sums and means of doubles are rounded, as their order of addition is free.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.engine import Engine
from tarnlight.session import configure, work_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its own name, with its DuckDB twin if there is one."""

    def put(f):
        def run(spark, sf_dir):
            return f(configure(spark), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialect_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register one text for both engines; ``oracle`` where DuckDB needs another."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return Engine(spark, work_folder(spark, "none")).sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text


def _buckets(name: str, width: str, origin: str = "") -> None:
    dialect_query(name, f"""
        SELECT CAST(time_bucket(INTERVAL '{width}', ts{origin}) AS TIMESTAMP) AS bucket, event_type,
          count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
        FROM events GROUP BY 1, 2""")


dialect_query("bucket_hour", """
    SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n,
      round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
    FROM events GROUP BY 1, 2 ORDER BY bucket, event_type""")
for _name, _width in (("bucket_7min", "7 minutes"), ("bucket_2day", "2 days"), ("bucket_week", "1 week"), ("bucket_month", "1 month"), ("bucket_quarter", "3 months"), ("bucket_90s", "90 seconds"), ("bucket_5hour", "5 hours")):
    _buckets(_name, _width)
_buckets("bucket_origin", "6 hours", ", TIMESTAMP '2024-01-01 01:30:00'")
for _unit in ("second", "minute", "day", "week", "month", "quarter", "year"):
    dialect_query(f"trunc_{_unit}", f"SELECT CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
dialect_query("bucket_before_origin", """
    SELECT event_id, CAST(time_bucket(INTERVAL '7 minutes', ts - INTERVAL '60 years') AS TIMESTAMP) AS b7,
      CAST(time_bucket(INTERVAL '5 months', ts - INTERVAL '60 years') AS TIMESTAMP) AS b5
    FROM events""")

# filters and projections
dialect_query("time_range", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
dialect_query("time_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
dialect_query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_type NOT LIKE '%2' OR p_size IN (1, 2, 3)")
dialect_query("filter_null", "SELECT count(*) AS n, count(value) AS n_value, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null FROM events")
dialect_query("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
dialect_query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
dialect_query("exists_subquery", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
dialect_query("star_exclude", "SELECT * EXCLUDE (r_name) FROM region")
dialect_query("star_replace", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
dialect_query("quoted_names", """SELECT "n_name" AS "the name", 'it''s' AS q, $$a'b$$ AS d FROM nation -- a comment
    WHERE n_regionkey = 1 /* another */""")
dialect_query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
dialect_query("lateral_alias", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY kind HAVING count(*) > 10")

# order, limit, top-k
dialect_query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
dialect_query("limit_offset", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100")
dialect_query("nulls_last", "SELECT event_id, x FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS x FROM events) ORDER BY x DESC, event_id LIMIT 300")
dialect_query("latest_per_user", "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
dialect_query("qualify_rank", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) <= 2")

# joins
dialect_query("join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
dialect_query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
dialect_query("join_right", "SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 10")
dialect_query("join_full", "SELECT a.k AS k1, b.k AS k2 FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 8) b ON a.k = b.k")
dialect_query("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
dialect_query("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
dialect_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
dialect_query("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
dialect_query("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
dialect_query("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
dialect_query("join_theta", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey > r_regionkey * 5 AND n_nationkey <> 24")
dialect_query("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect_query("join_lateral", "SELECT c_custkey, t.top FROM customer c CROSS JOIN LATERAL (SELECT max(o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t")
dialect_query("recursive_series", "WITH RECURSIVE s AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, n * n AS sq FROM s")
dialect_query("cte_chain", """WITH per AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id), big AS (SELECT * FROM per WHERE n > 2)
    SELECT big.user_id, big.n, e.event_id FROM big JOIN events e ON e.user_id = big.user_id AND e.ts = big.last""")

# aggregates
dialect_query("agg_basic", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
dialect_query("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n_big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'F'), 4) AS tax_f FROM lineitem GROUP BY l_returnflag")
dialect_query("agg_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY event_type")
dialect_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
dialect_query("agg_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(median(l_quantity), 6) AS med, quantile_disc(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY l_returnflag")
dialect_query("agg_arg", "SELECT event_type, arg_max(event_id, ts) AS last_id, arg_min(event_id, ts) AS first_id FROM events GROUP BY event_type")
dialect_query("agg_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
dialect_query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
dialect_query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
dialect_query("agg_group_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
dialect_query("agg_stats", """SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_discount), 8) AS va,
    round(corr(l_quantity, l_extendedprice), 6) AS co, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(covar_samp(l_tax, l_discount), 8) AS cv,
    round(skewness(l_extendedprice), 5) AS sk, round(kurtosis(l_extendedprice), 5) AS ku, round(geometric_mean(l_quantity), 6) AS gm FROM lineitem GROUP BY l_returnflag""")
dialect_query("agg_bool", "SELECT event_type, bool_and(value > 0) AS every, bool_or(value > 100) AS some, bit_or(user_id % 16) AS bits, count_if(value > 50) AS n FROM events GROUP BY event_type")
dialect_query("agg_strings", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
dialect_query("agg_lists", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")

# windows
dialect_query("running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS s FROM events")
dialect_query("lag_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events")
dialect_query("rank_family", """SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS rn,
    round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)""")
dialect_query("ntile_q", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
dialect_query("first_last", "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
dialect_query("zscore_rolling", """SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev(value) OVER w, 0), 5) AS z FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 144 PRECEDING AND 1 PRECEDING)""")
dialect_query("range_interval_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS a FROM events")
dialect_query("lag_ignore_nulls", "SELECT event_id, lag(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS x FROM events)")
dialect_query("plot_decimate", """SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS bin, min(value) AS lo, max(value) AS hi, arg_min(ts, struct(value, ts)) AS t_lo, arg_max(ts, struct(value, ts)) AS t_hi
    FROM events GROUP BY 1, 2""")
ORACLES["plot_decimate"] = ORACLES["plot_decimate"].replace("struct(", "row(")
dialect_query("seasonal_residual", """WITH h AS (SELECT event_type, extract('hour' FROM ts) AS hr, avg(value) AS base FROM events GROUP BY 1, 2)
    SELECT e.event_id, round(e.value - h.base, 6) AS residual FROM events e JOIN h ON h.event_type = e.event_type AND h.hr = extract('hour' FROM e.ts)""")

# set operations
_A, _B = "SELECT user_id % 50 AS k FROM events WHERE event_type = 'click'", "SELECT user_id % 70 AS k FROM events WHERE event_type = 'purchase'"
for _name, _op in (("set_union", "UNION"), ("set_union_all", "UNION ALL"), ("set_intersect", "INTERSECT"), ("set_except", "EXCEPT"), ("set_except_all", "EXCEPT ALL"), ("set_intersect_all", "INTERSECT ALL")):
    dialect_query(_name, f"SELECT k FROM ({_A} {_op} {_B})")

# scalar functions
dialect_query("fn_string", """SELECT page_id, upper(url) AS u, length(url) AS n, substr(url, 3, 7) AS s, left(url, 5) AS l, right(url, 4) AS r, split_part(url, '/', 3) AS host, strpos(url, 'w') AS at,
    starts_with(url, 'https') AS secure, replace(url, 'http', 'x') AS rep, reverse(url) AS rev, lpad(page_id::VARCHAR, 6, '0') AS pad, md5(url) AS h, trim('  a ') AS t, concat_ws('-', 'a', url) AS cw,
    'a' || url AS cat, levenshtein(url, 'https://x') AS lev FROM pages""")
dialect_query("fn_url_host", r"SELECT page_id, regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS host FROM pages")
dialect_query("fn_regexp", r"SELECT page_id, regexp_matches(url, '[0-9]+') AS m, regexp_replace(url, '[aeiou]', '_') AS r1, regexp_replace(url, '([a-z])([0-9])', '\2\1', 'g') AS r2 FROM pages")
dialect_query("fn_math", """SELECT event_id, abs(value - 50) AS a, round(sqrt(abs(value)), 6) AS q, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(ln(abs(value) + 1), 6) AS ln, round(log(abs(value) + 1), 6) AS lg,
    user_id % 7 AS m, user_id // 7 AS d, greatest(value, 10.0) AS g, least(value, 10.0) AS le, sign(value - 50)::INT AS s, round(pow(value, 2), 4) AS p, round(sin(value), 6) AS sn, round(pi(), 6) AS pi FROM events""")
dialect_query("fn_date", """SELECT event_id, extract('hour' FROM ts) AS h, extract(dow FROM ts) AS dow, extract('isodow' FROM ts) AS iso, extract(doy FROM ts) AS doy, extract(week FROM ts) AS wk, last_day(ts) AS ld,
    date_diff('hour', TIMESTAMP '2024-01-01', ts) AS dh, date_diff('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS dd, strftime(ts, '%Y-%m-%d %H:%M') AS txt, ts + INTERVAL 1 MONTH AS nm, year(ts) AS y, dayname(ts) AS dn FROM events""".replace("dayname(ts)", "strftime(ts, '%A')"))
dialect_query("fn_extract_epoch", "SELECT event_id, round(extract(epoch FROM ts), 6) AS e, round(epoch(ts), 6) AS e2, epoch_ms(ts) AS ms FROM events")
dialect_query("fn_json", "SELECT event_id, props->>'$.k' AS k, json_extract_string(props, '$.k') AS k2, try_cast(props->>'$.k' AS BIGINT) AS n FROM events")
dialect_query("fn_cast", "SELECT event_id, value::VARCHAR IS NULL AS s, try_cast('x' || event_id AS BIGINT) AS bad, CAST(event_id AS DOUBLE) / 4 AS q, CAST(ts AS DATE) AS d, coalesce(NULL, event_id) AS c, nullif(event_id % 2, 0) AS nf FROM events")
dialect_query("fn_range", "SELECT range AS i FROM range(5, 100, 7)")
dialect_query("fn_series", "SELECT generate_series AS i FROM generate_series(3, 60)")


@query("""SELECT CAST(make_timestamp((CAST(epoch(ts) AS BIGINT) - CAST(epoch(ts) AS BIGINT) % 3600) * 1000000) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 1""")
def bucket_epoch_compat(spark, sf_dir):
    """The rounded-second bucket, for those who need the old answers."""
    from tarnlight.functions.timefns import epoch_bucket_rounded

    return table(spark, sf_dir, "events").groupBy(epoch_bucket_rounded("1 hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, sum(value) FILTER (WHERE event_type = 'click') AS click, sum(value) FILTER (WHERE event_type = 'purchase') AS purchase
FROM (SELECT user_id, event_type, round(sum(value), 6) AS value FROM events GROUP BY 1, 2) GROUP BY user_id""")
def pivot_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "purchase"]).agg(F.round(F.sum("value"), 6))


@query()
def approx_distinct(spark, sf_dir):
    """Another sketch than DuckDB's, so rows only."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query()
def table_sample(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7)


# joins beyond SQL
@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, ts, max(event_id) AS pid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT c.event_id, c.user_id, p.pid AS purchase_id FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def join_asof(spark, sf_dir):
    from tarnlight.operators.joins import asof_join

    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return asof_join(clicks, bought, ["user_id"], "ts", "ts").select("event_id", "user_id", "purchase_id")


@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, ts, min(event_id) AS pid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT c.event_id, p.pid AS purchase_id FROM c ASOF JOIN p ON c.user_id = p.user_id AND c.ts <= p.ts""")
def join_asof_forward(spark, sf_dir):
    from tarnlight.operators.joins import asof_join

    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.min("event_id").alias("purchase_id"))
    return asof_join(clicks, bought, ["user_id"], "ts", "ts", how="inner", direction="forward").select("event_id", "purchase_id")


@query("SELECT n_name, r_name FROM (SELECT n_name FROM nation ORDER BY n_nationkey) POSITIONAL JOIN (SELECT r_name FROM region ORDER BY r_regionkey)")
def join_positional(spark, sf_dir):
    from tarnlight.operators.joins import positional_join

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return positional_join(n.select("n_name", "n_nationkey"), r.select("r_name", "r_regionkey"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice / 100 >= p_retailprice AND o_totalprice / 100 < p_retailprice + 0.5""")
def join_range(spark, sf_dir):
    """A band join as an equi-join on bins."""
    from tarnlight.operators.joins import range_join

    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("x"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") + 0.5).alias("hi"))
    return range_join(o, p, "x", "p_retailprice", "hi", 0.125).select("o_orderkey", "p_partkey")


# windows in time
@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    from tarnlight.operators.series import sessions

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, ["user_id"], "ts", "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("""SELECT CAST(b AS TIMESTAMP) AS start, event_type, count(*) AS n FROM
(SELECT event_type, unnest([time_bucket(INTERVAL '15 minutes', ts) - i * INTERVAL '15 minutes' FOR i IN range(0, 4)]) AS b FROM events) GROUP BY 1, 2""")
def sliding_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "15 minutes")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT event_id, CAST(sum(user_id % 10) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) GROUPS 2 PRECEDING) AS BIGINT) AS s FROM events""")
def groups_window(spark, sf_dir):
    from tarnlight.operators.series import groups_frame

    e = table(spark, sf_dir, "events").withColumn("d", F.date_trunc("day", "ts")).withColumn("m", F.col("user_id") % 10)
    return groups_frame(e, ["event_type"], "d", "m", 2, "s").select("event_id", "s")


# ingest
@query("SELECT ts AS time, CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, value, props FROM events")
def lp_roundtrip(spark, sf_dir):
    """Events rendered as line protocol and parsed back."""
    from tarnlight.sources import lineproto, points

    e = table(spark, sf_dir, "events")
    e = e.repartition(spark.sparkContext.defaultParallelism, "event_id")  # parsing is work for every core
    lines = lineproto.render(e, "events", ["user_id", "event_type"], ["event_id", "value", "props"], "ts")
    out = points.columns(lineproto.parse_lines(lines), "events", ["user_id", "event_type"], {"event_id": "long", "value": "double", "props": "string"})
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SELECT CAST(NULL AS TIMESTAMP) AS time, s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier WHERE false UNION ALL SELECT TIMESTAMP '2024-01-01', s_suppkey, s_name, s_nationkey::BIGINT, s_acctbal FROM supplier")
def csv_infer(spark, sf_dir):
    """Suppliers as untyped text columns, typed again by inference over all rows."""
    from tarnlight.sources.imports import inferred_types, instant

    s = table(spark, sf_dir, "supplier")
    text = s.select(F.lit("1704067200").alias("time"), *[F.col(c).cast("string").alias(c) for c in s.columns])
    types = inferred_types(text, ("time",))
    return text.select(instant(F.col("time")).cast("timestamp_ntz").alias("time"), *[F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c) for c, t in types.items()])


@query("SELECT ts AS time, event_type, 'host_' || (user_id % 5) AS host, value FROM events")
def msgpack_roundtrip(spark, sf_dir):
    """Events packed as MessagePack in Arrow batches and decoded as points."""
    import pyarrow as pa

    from tarnlight.sources import messages, points

    def packed(stream):
        for b in stream:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([messages.pack({"m": "e", "t": r["us"], "h": r["h"], "fields": {"value": r["value"]}, "tags": {"event_type": r["event_type"]}}) for r in rows], pa.binary())], ["value"])

    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("user_id") % 5).alias("h"), "value", "event_type")
    out = points.columns(messages.decode(e.mapInArrow(packed, "value binary"), bad="fail"), "e", ["event_type", "host"], {"value": "double"})
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


# upkeep
@query("""SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events""")
def dedup_lww(spark, sf_dir):
    """Two writes of the same keys: the later one stays."""
    from tarnlight.operators.maintain import last_write_wins

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    again = e.filter("event_id % 3 = 0").withColumn("value", F.col("value") + 1)
    return last_write_wins(e.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2))), ["event_id", "user_id", "ts"], ["seq"]).drop("seq")


@query("SELECT event_id, ts AS time FROM events")
def time_normalise(spark, sf_dir):
    """Time as text, as microseconds and as instants, brought to one type."""
    from tarnlight.operators.maintain import normalised_time

    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"))
    text = e.filter("event_id % 3 = 0").withColumn("time", F.col("time").cast("string"))
    micros = e.filter("event_id % 3 = 1").withColumn("time", F.unix_micros("time").cast("string"))
    out = normalised_time(text.unionByName(micros)).unionByName(e.filter("event_id % 3 = 2"))
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


dialect_query("agg_more", """SELECT event_type, round(var_pop(value), 5) AS vp, round(regr_r2(value, user_id), 8) AS r2, round(covar_pop(value, user_id), 4) AS cp, max(value) - min(value) AS spread,
    round(sum(value) / nullif(count(value), 0), 6) AS mean, any_value(event_type) AS kind FROM events GROUP BY event_type""")
dialect_query("fn_string2", """SELECT n_nationkey, lower(n_name) AS l, rpad(n_name, 12, '.') AS rp, repeat('ab', n_nationkey % 3) AS rr, position('A' IN n_name) AS ps, contains(n_name, 'I') AS ct, ends_with(n_name, 'A') AS ew,
    ascii(n_name) AS a, chr(65 + n_nationkey) AS ch, coalesce(nullif(n_name, 'CHINA'), '?') AS c, n_name ILIKE 'c%' AS il, ltrim('  x') AS lt, rtrim('x  ') AS rt, sha256(n_name) IS NOT NULL AS h FROM nation""".replace("sha256(n_name)", "md5(n_name)"))
dialect_query("case_between", "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'low' WHEN o_totalprice < 1000 THEN 'tiny' ELSE 'high' END AS band, o_orderstatus IS DISTINCT FROM 'F' AS open FROM orders")
dialect_query("nested_cte", "WITH a AS (WITH b AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT k, n FROM b WHERE n > 1) SELECT r_name, n FROM a JOIN region ON r_regionkey = k")
dialect_query("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
dialect_query("union_mixed", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
dialect_query("fn_array", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, round(list_sum(embedding), 5) AS total, len(list_distinct(embedding)) AS k, list_contains([1, 2], label) AS has, [label, 7][2] AS two, embedding[2:3] AS part FROM embeddings")
dialect_query("fn_map", "SELECT n_nationkey, map([n_name], [n_regionkey])[n_name] AS v, cardinality(map(['a', 'b'], [1, 2])) AS n, {'a': n_name}.a AS s FROM nation")
dialect_query("fn_cast_round", "SELECT event_id, CAST(value AS BIGINT) AS r, (value / 2)::INT AS h, trunc(value) AS t, try_cast(value AS SMALLINT) AS s FROM events")
dialect_query("fn_unnest", "SELECT n_nationkey, unnest([n_regionkey, 10]) AS u FROM nation")
dialect_query("fn_lambda", "SELECT n_nationkey, list_transform([1, 2, n_regionkey], lambda x: x * 2) AS a, list_filter([1, 2, n_regionkey], lambda x: x > 1) AS b, [x + 1 FOR x IN [n_regionkey, 5] IF x > 2] AS c FROM nation")
dialect_query("fn_from_calls", "SELECT page_id, TRIM(LEADING 'h' FROM url) AS t, SUBSTRING(url FROM 2 FOR 4) AS s, TRIM(BOTH 'x' FROM 'xax') AS b, extract('day' FROM TIMESTAMP '2024-01-05') AS d FROM pages")
dialect_query("fn_overlay", "SELECT page_id, OVERLAY(url PLACING 'X' FROM 2 FOR 3) AS o FROM pages", "SELECT page_id, url[:1] || 'X' || url[5:] AS o FROM pages")
dialect_query("fn_distinct_from", "SELECT o_orderkey, o_orderstatus IS DISTINCT FROM 'F' AS d, nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM NULL AS s FROM orders")
dialect_query("cte_columns", "WITH t(kind, n) AS (SELECT event_type, count(*) FROM events GROUP BY 1) SELECT kind, n FROM t WHERE n > 0")
dialect_query("agg_robust", "SELECT l_returnflag, round(mad(l_quantity), 6) AS m, round(entropy(l_shipdate), 6) AS e, mode(l_returnflag) AS o FROM lineitem GROUP BY l_returnflag")
dialect_query("groups_frame_text", "SELECT event_id, CAST(sum(user_id % 10) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM events")
dialect_query("fn_times", "SELECT event_id, CAST(to_timestamp(user_id) AS TIMESTAMP) AS t, epoch_ms(make_timestamptz(user_id * 1000000)) AS m, ts < now() - INTERVAL 1 DAY AS old FROM events")
dialect_query("sample_all", "SELECT event_id FROM events USING SAMPLE 100%")
dialect_query("row_functions", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END::BIGINT AS f, -o_orderkey::BIGINT AS m FROM orders")

from tarnlight.plans import services  # noqa: E402, F401
