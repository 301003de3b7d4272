"""Constructs of several dialects that meet Spark in another form: XML and JSON tables, variants, hierarchies, table states."""

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import tables as T
from ..registry import query, sql_query
from ..session import table, tables
from ..sources import scratch

# XML and JSON

sql_query("xml_table_rows", "SELECT n_nationkey, item.id AS id, item.name AS name FROM (SELECT n_nationkey, from_xml(concat('<r><i><id>', n_nationkey, '</id><name>', n_name, '</name></i><i><id>', n_regionkey, '</id></i></r>'), 'i array<struct<id: int, name: string>>').i AS items FROM nation) LATERAL VIEW explode(items) t AS item", "SELECT n_nationkey, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_regionkey, NULL FROM nation")
sql_query("xml_construct", "SELECT n_nationkey, concat('<nation key=\"', n_nationkey, '\">', '<name>', replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '</name></nation>') AS x FROM nation", "SELECT n_nationkey, '<nation key=\"' || n_nationkey || '\"><name>' || n_name || '</name></nation>' AS x FROM nation")
sql_query("json_value_default", "SELECT event_id, coalesce(try_cast(get_json_object(props, '$.absent') AS INT), -1) AS d, coalesce(get_json_object(props, '$.k'), 'none') AS k FROM events", "SELECT event_id, -1 AS d, coalesce(props->>'$.k', 'none') AS k FROM events")
sql_query("json_construct", "SELECT n_nationkey, to_json(array(n_nationkey, n_regionkey)) AS a, json_array_length(to_json(array(1, 2, n_nationkey))) AS n FROM nation", "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, 3 AS n FROM nation")
sql_query("variant_paths", "SELECT event_id, v:k::int AS k, v:none IS NULL AS missing, is_variant_null(v:n) AS json_null FROM (SELECT event_id, parse_json(concat('{\"n\":null,', substring(props, 2))) AS v FROM events)", "SELECT event_id, (props->>'$.k')::INT AS k, true AS missing, true AS json_null FROM events")
sql_query("flatten_variant", "SELECT event_id, f.key AS key, f.value::int AS value FROM (SELECT event_id, parse_json(props) AS v FROM events), LATERAL variant_explode(v) AS f", "SELECT event_id, 'k' AS key, (props->>'$.k')::INT AS value FROM events")
sql_query("is_type", "SELECT event_id, schema_of_variant(variant_get(parse_json(props), '$.k', 'variant')) = 'BIGINT' AS number, typeof(event_type) = 'string' AS text FROM events", "SELECT event_id, true AS number, true AS text FROM events")

# Expressions and subqueries

sql_query("array_subquery", "SELECT r_name, array_join((SELECT array_sort(collect_list(n_name)) FROM nation WHERE n_regionkey = r_regionkey), ',') AS names FROM region", "SELECT r_name, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name), ',') AS names FROM region")
sql_query("ternary_coalesce", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS t, coalesce(nullif(n_regionkey, 1), 9) AS c FROM nation")
sql_query("lateral_alias", "SELECT c_custkey, c_acctbal * 2 AS twice, twice + 1 AS more FROM customer", "SELECT c_custkey, c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more FROM customer")
sql_query("interval_literals", "SELECT o_orderkey, o_orderdate + INTERVAL '1-2' YEAR TO MONTH AS a, o_orderdate - INTERVAL '2 03:04:05' DAY TO SECOND AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 14 MONTH AS a, o_orderdate - INTERVAL 2 DAY - INTERVAL 3 HOUR - INTERVAL 4 MINUTE - INTERVAL 5 SECOND AS b FROM orders")
sql_query("struct_access", "SELECT s.a.b AS b, s.c[1] AS c FROM (SELECT named_struct('a', named_struct('b', n_name), 'c', array(n_nationkey, n_regionkey)) AS s FROM nation)", "SELECT n_name AS b, n_regionkey AS c FROM nation")
sql_query("map_literal", "SELECT n_nationkey, element_at(map('x', n_regionkey, 'y', n_nationkey), 'y') AS y, size(array_distinct(array(1, n_regionkey, 1))) AS d FROM nation", "SELECT n_nationkey, n_nationkey AS y, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS d FROM nation")
sql_query("group_distinct_sets", "SELECT DISTINCT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderstatus))", "SELECT DISTINCT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderstatus))")
sql_query("outer_plus_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
sql_query("search_breadth_order", "WITH RECURSIVE t(id, depth, path) AS (SELECT s_suppkey, 0, lpad(CAST(s_suppkey AS STRING), 8, '0') FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s.s_suppkey, t.depth + 1, concat(t.path, '/', lpad(CAST(s.s_suppkey AS STRING), 8, '0')) FROM supplier s JOIN t ON s.s_suppkey DIV 2 = t.id AND s.s_suppkey > 1) SELECT id, row_number() OVER (ORDER BY depth, path) AS breadth, row_number() OVER (ORDER BY path) AS deep FROM t", "WITH RECURSIVE t(id, depth, path) AS (SELECT s_suppkey, 0, lpad(s_suppkey::VARCHAR, 8, '0') FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s.s_suppkey, t.depth + 1, t.path || '/' || lpad(s.s_suppkey::VARCHAR, 8, '0') FROM supplier s JOIN t ON s.s_suppkey // 2 = t.id AND s.s_suppkey > 1) SELECT id, row_number() OVER (ORDER BY depth, path) AS breadth, row_number() OVER (ORDER BY path) AS deep FROM t")
sql_query("cycle_check", "WITH RECURSIVE t(node, path, cycle) AS (SELECT 0, array(0), false UNION ALL SELECT (t.node * 3 + 1) % 7, concat(t.path, array((t.node * 3 + 1) % 7)), array_contains(t.path, (t.node * 3 + 1) % 7) FROM t WHERE NOT t.cycle) SELECT node, size(path) AS n, cycle FROM t", "WITH RECURSIVE t(node, path, cycle) AS (SELECT 0, [0], false UNION ALL SELECT (t.node * 3 + 1) % 7, list_append(t.path, (t.node * 3 + 1) % 7), list_contains(t.path, (t.node * 3 + 1) % 7) FROM t WHERE NOT t.cycle) SELECT node, len(path)::INT AS n, cycle FROM t")
sql_query("chained_pivot", "SELECT y, f_n AS f, o_n AS o FROM (SELECT year(o_orderdate) AS y, o_orderstatus, o_orderkey, o_custkey FROM orders) PIVOT (count(o_orderkey) AS n, max(o_custkey) AS c FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT y, nullif(count(*) FILTER (WHERE s = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE s = 'O'), 0) AS o FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s FROM orders) GROUP BY y")
sql_query("unpivot_multi", "SELECT * FROM (SELECT n_nationkey, n_name AS a1, CAST(n_regionkey AS STRING) AS b1, upper(n_name) AS a2, CAST(n_regionkey + 1 AS STRING) AS b2 FROM nation) UNPIVOT ((a, b) FOR k IN ((a1, b1) AS one, (a2, b2) AS two))", "SELECT n_nationkey, 'one' AS k, n_name AS a, n_regionkey::VARCHAR AS b FROM nation UNION ALL SELECT n_nationkey, 'two', upper(n_name), (n_regionkey + 1)::VARCHAR FROM nation")
sql_query("token_rank", "SELECT doc_id, hits FROM (SELECT doc_id, size(array_intersect(split(lower(text), '[^a-z]+'), array('the', 'and', 'with'))) AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 30", "SELECT doc_id, hits FROM (SELECT doc_id, len(list_intersect(regexp_split_to_array(lower(text), '[^a-z]+'), ['the', 'and', 'with']))::INT AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 30")
sql_query("sessions_by_window", "SELECT user_id, CAST(session_window.start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS t FROM events) GROUP BY user_id, session_window(t, '12 hours')", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12' HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")


@query("bound_parameters", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal > 100.0")
def bound_parameters(spark, sf):
    tables(spark, sf, "nation customer")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 5, "least": 100.0})


@query("sample_repeatable")
def sample_repeatable(spark, sf):
    tables(spark, sf, "orders")
    return spark.sql("SELECT o_orderkey FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (42)")


@query("result_pipe", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def result_pipe(spark, sf):
    """A statement over the result of the one before."""
    table(spark, sf, "orders").where("o_totalprice > 100000").createOrReplaceTempView("previous_result")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM previous_result GROUP BY o_orderstatus")


@query("create_table_as", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def create_table_as(spark, sf):
    tables(spark, sf, "customer")
    path = scratch.folder(spark, "ctas")
    spark.sql("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey").write.parquet(path)
    return spark.read.parquet(path)


@query("insert_overwrite_partition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders")
def insert_overwrite_partition(spark, sf):
    """One partition is replaced, the others stay."""
    path = scratch.folder(spark, "parts")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").parquet(path)
    new = rows.where("o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("insert_rows", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'NEW'), (101, NULL)) AS v(a, b)")
def insert_rows(spark, sf):
    new = spark.createDataFrame([("NEW", 100), (None, 101)], "n_name string, n_nationkey int")
    return T.union_by_name([table(spark, sf, "nation").select("n_nationkey", "n_name"), new])


@query("truncate_rows", "SELECT * FROM region WHERE false")
def truncate_rows(spark, sf):
    return table(spark, sf, "region").limit(0)


@query("document_update", "SELECT n_nationkey, 'X' AS name, n_regionkey AS region, n_regionkey + 1 AS next FROM nation")
def document_update(spark, sf):
    """SET, REMOVE and list_append on a nested document."""
    doc = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(1).alias("gone"), F.array("n_regionkey").alias("list"))
    new = doc.withField("name", F.lit("X")).dropFields("gone")
    new = new.withField("list", F.concat(new["list"], F.array(F.col("n_regionkey") + 1)))
    return table(spark, sf, "nation").select("n_nationkey", new.alias("d")).select("n_nationkey", "d.name", "d.region", F.element_at("d.list", -1).alias("next"))


@query("partitioned_table_function", "SELECT n_regionkey, count(*)::INT AS n, max(n_nationkey) AS last FROM nation GROUP BY 1")
def partitioned_table_function(spark, sf):
    """A table function over a table argument, run once for each partition."""

    @udtf(returnType="n_regionkey: int, n: int, last: int")
    class Summary:
        def __init__(self):
            self.key, self.n, self.last = None, 0, None

        def eval(self, row):
            self.key, self.n, self.last = row["n_regionkey"], self.n + 1, max(row["n_nationkey"], self.last if self.last is not None else row["n_nationkey"])

        def terminate(self):
            if self.n:
                yield self.key, self.n, self.last

    tables(spark, sf, "nation")
    spark.udtf.register("summary", Summary)
    return spark.sql("SELECT * FROM summary(TABLE(nation) PARTITION BY n_regionkey)")


@query("materialised_view", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1")
def materialised_view(spark, sf):
    """A view kept as partial sums: a refresh adds those of new rows, reading merges them."""
    path = scratch.folder(spark, "view")
    orders = table(spark, sf, "orders")
    partial = lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    partial(orders.where("o_orderkey % 2 = 0")).write.parquet(path)
    partial(orders.where("o_orderkey % 2 = 1")).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 0).alias("total"))


@query("column_summary", "SELECT 'p_size' AS name, min(p_size) AS lo, max(p_size) AS hi, count(p_size) AS n FROM part")
def column_summary(spark, sf):
    return table(spark, sf, "part").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count("p_size").alias("n")).select(F.lit("p_size").alias("name"), "lo", "hi", "n")


@query("shortest_paths")
def shortest_paths(spark, sf):
    """All pairs over paths of any length from all suppliers; brute force in the tests stands for an oracle."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"))
    n = suppliers.agg(F.count("*").alias("n"))
    edges = suppliers.join(F.broadcast(n)).select("s", F.explode(F.array((F.col("s") * 5 + 1) % F.col("n"), (F.col("s") + 3) % F.col("n"))).alias("t"))  # one row
    return T.shortest(edges, "s", "t")
