"""Grouping, aggregates and windows."""

from pyspark.sql import functions as F

from ..registry import query, sql_query
from ..session import table

sql_query("group_having", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20")
sql_query("group_ordinal", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
sql_query("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql_query("global_aggregate", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders")
sql_query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
sql_query("count_multi", "SELECT count(nullif(o_orderstatus, 'F')) AS a, count(o_orderkey) AS b, count(nullif(o_orderstatus, 'F'), nullif(o_orderstatus, 'O')) AS c FROM orders", "SELECT count(nullif(o_orderstatus, 'F')) AS a, count(o_orderkey) AS b, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS c FROM orders")
sql_query("filter_agg", "SELECT l_suppkey % 10 AS g, count(*) FILTER (WHERE l_returnflag = 'R') AS r, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS q FROM lineitem GROUP BY 1")
sql_query("rollup_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("cube_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
sql_query("grouping_id", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, CAST(grouping(l_returnflag) AS BIGINT) AS g1, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("grouping_multiplied", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus), CUBE (o_orderpriority, year(o_orderdate))")
sql_query("listagg", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("ordered_array", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(-n_nationkey AS k, n_name AS v))), s -> s.v), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey DESC), '|') AS names FROM nation GROUP BY n_regionkey")
sql_query("array_limit", "SELECT n_regionkey, array_join(slice(array_sort(collect_list(nullif(n_name, 'NATION1'))), 1, 2), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_slice(list_sort(array_agg(nullif(n_name, 'NATION1')) FILTER (WHERE n_name <> 'NATION1')), 1, 2), '|') AS names FROM nation GROUP BY n_regionkey")
sql_query("percentiles", "SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 4) AS q1, round(median(l_extendedprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS med, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
sql_query("mode_value", "SELECT o_orderstatus, mode(year(o_orderdate), true) AS y FROM orders GROUP BY 1", "SELECT o_orderstatus, min_by(y, (-n, y)) AS y FROM (SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
sql_query("stddev_var", "SELECT l_linestatus, round(stddev(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(variance(l_discount), 6) AS v, round(var_pop(l_discount), 6) AS vp FROM lineitem GROUP BY l_linestatus")
sql_query("correlations", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_pop(l_quantity, l_extendedprice), 0) AS cp, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(skewness(l_discount), 3) AS sk FROM lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS c, round(covar_pop(l_quantity, l_extendedprice), 0) AS cp, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(avg(power((l_discount - m) / s, 3)), 3) AS sk FROM lineitem, (SELECT avg(l_discount) AS m, stddev_pop(l_discount) AS s FROM lineitem)")
sql_query("bit_aggs", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
sql_query("bool_aggs", "SELECT o_custkey % 7 AS g, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some FROM orders GROUP BY 1")
sql_query("min_by_max_by", "SELECT c_nationkey, min_by(c_custkey, struct(c_acctbal, c_custkey)) AS lo, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS hi FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, min_by(c_custkey, (c_acctbal, c_custkey)) AS lo, max_by(c_custkey, (c_acctbal, c_custkey)) AS hi FROM customer GROUP BY c_nationkey")
sql_query("keep_dense_rank", "SELECT c_nationkey, max(c_custkey) AS k FROM (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r FROM customer) WHERE r = 1 GROUP BY c_nationkey", "SELECT c_nationkey, max(c_custkey) AS k FROM customer c WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer d WHERE d.c_nationkey = c.c_nationkey) GROUP BY c_nationkey")
sql_query("json_arrayagg", "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS ks FROM nation GROUP BY n_regionkey")
sql_query("json_objectagg", "SELECT r_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS o FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
sql_query("xmlagg", "SELECT n_regionkey, concat('<r>', array_join(transform(array_sort(collect_list(n_name)), n -> concat('<n>', n, '</n>')), ''), '</r>') AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '<r>' || string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) || '</r>' AS x FROM nation GROUP BY n_regionkey")
sql_query("any_value_min", "SELECT o_custkey, min(o_orderpriority) AS p, any_value(o_custkey * 2) AS d FROM orders GROUP BY o_custkey")
sql_query("bitmap_count", "SELECT sum(n) AS n FROM (SELECT bitmap_bucket_number(o_custkey) AS b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(o_custkey))) AS n FROM orders GROUP BY 1)", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
sql_query("histogram_bucket", "SELECT width_bucket(o_totalprice, 0, 500000, 10) AS b, count(*) AS n FROM orders GROUP BY 1", "SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE CAST(floor(o_totalprice / 50000) AS BIGINT) + 1 END AS b, count(*) AS n FROM orders GROUP BY 1")
sql_query("group_as", "SELECT n_regionkey, size(g) AS n, array_max(transform(g, s -> s.n_nationkey)) AS hi FROM (SELECT n_regionkey, collect_list(struct(*)) AS g FROM nation GROUP BY n_regionkey)", "SELECT n_regionkey, count(*)::INT AS n, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey")
sql_query("olap_star", "SELECT r_name, n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderstatus)")

# Windows: orders by customer, events by user

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql_query("ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n FROM part")
sql_query("percent_ranks", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part")
sql_query("ntile", f"SELECT o_orderkey, ntile(4) OVER ({_W}) AS q FROM orders")
sql_query("lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS a, lead(o_orderkey, 2, -1) OVER ({_W}) AS b FROM orders")
sql_query("first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_W}) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_W}) AS n FROM orders")
sql_query("ignore_nulls", f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'O')) IGNORE NULLS OVER ({_W}) AS s FROM orders", f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'O') IGNORE NULLS) OVER ({_W}) AS s FROM orders")
sql_query("rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, count(*) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS n FROM orders")
sql_query("range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
sql_query("range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
sql_query("groups_frame", "SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part)", "SELECT p_partkey, CAST(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
sql_query("exclude_current", "SELECT p_partkey, (count(*) OVER w) - 1 AS n, (sum(p_size) OVER w) - p_size AS s FROM part WINDOW w AS (PARTITION BY p_brand)", "SELECT p_partkey, count(*) OVER w AS n, coalesce(CAST(sum(p_size) OVER w AS BIGINT), 0) AS s FROM part WINDOW w AS (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)")
sql_query("exclude_ties", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) - count(*) OVER (PARTITION BY p_brand, p_size) + 1 AS n FROM part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM part")
sql_query("distinct_over", "SELECT o_orderkey, size(collect_set(o_orderpriority) OVER (PARTITION BY o_custkey)) AS n FROM orders", "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey)::INT AS n FROM orders")
sql_query("filter_over", "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")
sql_query("named_window", "SELECT o_orderkey, rank() OVER w AS r, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
sql_query("window_inherit", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n, count(*) OVER (PARTITION BY p_brand) AS t FROM part", "SELECT p_partkey, count(*) OVER (w ORDER BY p_size) AS n, count(*) OVER w AS t FROM part WINDOW w AS (PARTITION BY p_brand)")
sql_query("ratio_to_total", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer")
sql_query("percentile_over", "SELECT p_partkey, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice) OVER (PARTITION BY p_brand), 4) AS m FROM part", "SELECT p_partkey, round(quantile_cont(p_retailprice, 0.5) OVER (PARTITION BY p_brand), 4) AS m FROM part")
sql_query("over_empty", "SELECT n_nationkey, count(*) OVER () AS n, max(n_regionkey) OVER () AS hi FROM nation")
sql_query("sessionize", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '1' DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session", "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '1' DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2")
sql_query("gap_fill", "SELECT d.d, coalesce(e.n, 0) AS n FROM (SELECT explode(sequence(lo, hi, INTERVAL '1' DAY)) AS d FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)) d LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) e ON e.d = d.d", "SELECT CAST(d.d AS DATE) AS d, coalesce(e.n, 0) AS n FROM (SELECT unnest(generate_series(lo, hi, INTERVAL '1' DAY)) AS d FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)) d LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) e ON e.d = d.d")
sql_query("tumbling_window", "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM (SELECT *, window(ts, '6 hours') FROM events) GROUP BY 1, 2", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
sql_query("date_bin", "SELECT event_id, CAST(window.start AS TIMESTAMP_NTZ) AS bin FROM (SELECT event_id, window(ts, '15 minutes') AS window FROM events)", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS bin FROM events")


# Estimates over distinct keys, which are those over all rows: beside a distinct count Spark would keep a sketch for each key.


def _near(keys, key, estimate):
    exact = F.count(key)
    return keys.select(key).distinct().agg((F.abs(estimate - exact) <= 0.05 * exact).alias("near"))


@query("approx_distinct_band", "SELECT true AS near")
def approx_distinct_band(spark, sf):
    return _near(table(spark, sf, "lineitem"), "l_orderkey", F.approx_count_distinct("l_orderkey", 0.01))


@query("hll_sketch", "SELECT true AS near")
def hll_sketch(spark, sf):
    return _near(table(spark, sf, "orders"), "o_custkey", F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey", 14)))
