"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins
from ..registry import query, sql_query
from ..session import table

sql_query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
sql_query("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
sql_query("right_join", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 250000")
sql_query("full_join", "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier) b ON a.k = b.k")
sql_query("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql_query("natural_join", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier)")
sql_query("using_join", "SELECT k, n_name, s_suppkey FROM (SELECT n_nationkey AS k, n_name FROM nation) a FULL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b USING (k)")
sql_query("semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
sql_query("anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
sql_query("theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
sql_query("nested_joins", "SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
sql_query("lateral_topk", "SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
sql_query("apply_outer", "SELECT n_name, t.s_suppkey FROM nation LEFT JOIN LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) t ON true")
sql_query("unnest_ordinality", "SELECT n_nationkey, pos + 1 AS pos, w FROM nation LATERAL VIEW posexplode(split(n_name, '_')) x AS pos, w", "SELECT n_nationkey, generate_subscripts(a, 1)::INT AS pos, unnest(a) AS w FROM (SELECT n_nationkey, string_split(n_name, '_') AS a FROM nation)")
sql_query("unnest_outer", "SELECT n_nationkey, e FROM nation LEFT JOIN LATERAL explode_outer(filter(array(n_regionkey, n_nationkey), x -> x > 20)) t(e) ON true", "SELECT n_nationkey, e FROM nation LEFT JOIN LATERAL (SELECT unnest(list_filter([n_regionkey, n_nationkey], lambda x: x > 20)) AS e) t ON true")
sql_query("broadcast_hint", "SELECT /*+ BROADCAST(nation) */ c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
sql_query("shuffle_hint", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o_orderkey, c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
sql_query("six_way_join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")


@query("self_join", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def self_join(spark, sf):
    return joins.pairs(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("right_semi_join", "SELECT o_orderkey FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def right_semi_join(spark, sf):
    low = table(spark, sf, "customer").where("c_acctbal < 0")
    orders = table(spark, sf, "orders")
    return joins.right_semi(low, orders, low.c_custkey == orders.o_custkey).select("o_orderkey")


@query("right_anti_join", "SELECT o_orderkey FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal < 5000) ON o_custkey = c_custkey")
def right_anti_join(spark, sf):
    low = table(spark, sf, "customer").where("c_acctbal < 5000")
    orders = table(spark, sf, "orders")
    return joins.right_anti(low, orders, low.c_custkey == orders.o_custkey).select("o_orderkey")


@query("asof_join", "SELECT e.event_id, p.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark, sf):
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", "ts", ["view_id"]).select("event_id", "view_id")


@query("range_bucket_join", "SELECT o_orderkey, band FROM orders JOIN (SELECT range AS band, range * 50000.0 AS lo, range * 50000.0 + 80000.0 AS hi FROM range(10)) b ON o_totalprice >= lo AND o_totalprice < hi")
def range_bucket_join(spark, sf):
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 50000.0).alias("lo"), (F.col("id") * 50000.0 + 80000.0).alias("hi"))
    return joins.range_join(table(spark, sf, "orders"), bands, "o_totalprice", "lo", "hi", 80000.0).select("o_orderkey", "band")


@query("partitioned_outer", "SELECT k.o_orderpriority, q.q, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderpriority FROM orders) k CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS q) q LEFT JOIN (SELECT *, quarter(o_orderdate) AS q FROM orders) o ON o.o_orderpriority = k.o_orderpriority AND o.q = q.q GROUP BY 1, 2")
def partitioned_outer(spark, sf):
    return _per_quarter(spark, table(spark, sf, "orders"), F.col("o_orderkey"))


def _per_quarter(spark, orders, counted):
    """Orders by priority and quarter over all combinations; rows count where ``counted`` is not null."""
    facts = orders.select("o_orderpriority", F.quarter("o_orderdate").alias("q"), counted.alias("counted"))
    quarters = spark.range(1, 5).select(F.col("id").cast("int").alias("q"))
    return joins.densified(facts, ["o_orderpriority"], quarters, ["q"]).groupBy("o_orderpriority", "q").agg(F.count("counted").alias("n"))


@query("lookup_array", "SELECT n_nationkey, coalesce(len(list(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)), 0)::INT AS n, coalesce(array_to_string(list_sort(list(s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL)), ','), '') AS keys FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def lookup_array(spark, sf):
    found = joins.lookup(table(spark, sf, "nation"), table(spark, sf, "supplier"), "n_nationkey", "s_nationkey", "s", ["s_suppkey"])
    return found.select("n_nationkey", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["s_suppkey"].cast("string")), ",").alias("keys"))


@query("salted_join", "SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def salted_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return joins.salted(orders, people, ["k"], 4).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("greater_than_all", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal < 4000)")
def greater_than_all(spark, sf):
    return joins.greater_than_all(table(spark, sf, "customer"), table(spark, sf, "supplier").where("s_acctbal < 4000"), "c_acctbal", "s_acctbal").select("c_custkey")
