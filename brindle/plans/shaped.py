"""Table operators, hierarchies, row changes, graphs and vectors."""

from pyspark.sql import functions as F

from ..operators import tables
from ..operators.vectors import nearest
from ..registry import query, sql_query
from ..session import table

sql_query("pivot_status", "SELECT * FROM (SELECT year(o_orderdate) AS y, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT y, nullif(count(*) FILTER (WHERE s = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE s = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE s = 'P'), 0) AS p FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s FROM orders) GROUP BY y")
sql_query("pivot_multi", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(*) AS n, round(max(o_totalprice), 2) AS hi FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f_n, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f_hi, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o_n, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o_hi FROM orders GROUP BY 1")
sql_query("unpivot_rows", "SELECT * FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_custkey * 2 AS twice FROM customer) UNPIVOT (v FOR name IN (nation, twice))", "UNPIVOT (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_custkey * 2 AS twice FROM customer) ON nation, twice INTO NAME name VALUE v")
sql_query("unpivot_nulls", "SELECT * FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS a, n_nationkey AS b FROM nation) UNPIVOT INCLUDE NULLS (v FOR name IN (a, b))", "SELECT n_nationkey, 'a' AS name, nullif(n_regionkey, 1) AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey FROM nation")
sql_query("connect_by_path", "WITH RECURSIVE t(id, level, path) AS (SELECT c_custkey, 1, CAST(c_custkey AS STRING) FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.level + 1, concat(t.path, '/', c.c_custkey) FROM customer c JOIN t ON c.c_custkey DIV 3 = t.id AND c.c_custkey > 2) SELECT id, level, path FROM t", "WITH RECURSIVE t(id, level, path) AS (SELECT c_custkey, 1, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.level + 1, t.path || '/' || c.c_custkey FROM customer c JOIN t ON c.c_custkey // 3 = t.id AND c.c_custkey > 2) SELECT id, level, path FROM t")
sql_query("graph_two_hop", "SELECT a.s AS start, b.t AS end, count(*) AS paths FROM (SELECT n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation) a JOIN (SELECT n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation) b ON a.t = b.s GROUP BY 1, 2", 'SELECT a.s AS start, b.t AS "end", count(*) AS paths FROM (SELECT n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation) a JOIN (SELECT n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation) b ON a.t = b.s GROUP BY 1, 2')
sql_query("for_json", "SELECT to_json(array_sort(collect_list(struct(r_regionkey, r_name)))) AS doc FROM region", "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS doc FROM region")
sql_query("ngram_jaccard", "SELECT p_partkey, round(size(array_intersect(a, b)) / size(array_union(a, b)), 6) AS j FROM (SELECT p_partkey, array_distinct(transform(sequence(1, length(p_name) - 2), i -> substring(p_name, i, 3))) AS a, array_distinct(transform(sequence(1, length(p_type) - 2), i -> substring(p_type, i, 3))) AS b FROM part WHERE length(p_name) >= 3 AND length(p_type) >= 3)", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j FROM (SELECT p_partkey, list_distinct(list_transform(generate_series(1, length(p_name) - 2), lambda i: substring(p_name, i, 3))) AS a, list_distinct(list_transform(generate_series(1, length(p_type) - 2), lambda i: substring(p_type, i, 3))) AS b FROM part WHERE length(p_name) >= 3 AND length(p_type) >= 3)")


@query("star_replace", "SELECT * REPLACE (upper(n_name) || '!' AS n_name) FROM nation")
def star_replace(spark, sf):
    return table(spark, sf, "nation").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))


@query("star_rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def star_rename(spark, sf):
    return table(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "name"})


@query("star_ilike", "SELECT c_custkey, c_nationkey FROM customer")
def star_ilike(spark, sf):
    return tables.star_like(table(spark, sf, "customer"), "%KEY")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf):
    return tables.distinct_on(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("fetch_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= (SELECT min(q) FROM (SELECT l_quantity AS q FROM lineitem ORDER BY 1 DESC LIMIT 25))")
def fetch_ties(spark, sf):
    return tables.fetch_with_ties(table(spark, sf, "lineitem"), 25, ["l_quantity"], descending=True).select("l_orderkey", "l_linenumber", "l_quantity")


@query("per_partition_limit", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2")
def per_partition_limit(spark, sf):
    return tables.per_partition_limit(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id")


@query("top_n_percent", "SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= ceil((SELECT count(*) FROM part) * 0.05)")
def top_n_percent(spark, sf):
    return tables.percent(table(spark, sf, "part"), 5, [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey")


@query("pivot_any", "SELECT y, coalesce(count(*) FILTER (WHERE s = 'F'), 0) AS F, coalesce(count(*) FILTER (WHERE s = 'O'), 0) AS O, coalesce(count(*) FILTER (WHERE s = 'P'), 0) AS P FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s FROM orders) GROUP BY y")
def pivot_any(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return tables.pivot_any(orders, ["y"], "o_orderstatus", F.count(F.lit(1)), default=0)


@query("tuple_pivot", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS doc FROM nation GROUP BY 1")
def tuple_pivot(spark, sf):
    return tables.tuple_pivot(table(spark, sf, "nation"), "n_name", "n_nationkey", ["n_regionkey"]).select("n_regionkey", F.to_json("tuple").alias("doc"))


@query("tuple_unpivot", "SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation")
def tuple_unpivot(spark, sf):
    made = F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(made).alias("k", "v"))


@query("union_by_name", "SELECT c_nationkey AS k, c_custkey AS c, NULL::BIGINT AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"))
    return tables.union_by_name([a, b], outer=True)


@query("union_corresponding", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_corresponding(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"))
    return tables.corresponding([a, b])


@query("bfs_depth", "WITH RECURSIVE e(s, t) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation), w(node, depth) AS (SELECT 0, 0 UNION SELECT e.t, w.depth + 1 FROM w JOIN e ON e.s = w.node WHERE w.depth < 24) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def bfs_depth(spark, sf):
    n = table(spark, sf, "nation")
    edges = n.select(F.col("n_nationkey").alias("s"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("t")).union(n.select("n_nationkey", (F.col("n_nationkey") * 3 + 1) % 25))
    return tables.closure(edges, "s", "t", n.where("n_nationkey = 0").select(F.col("n_nationkey").alias("node")))


def _halves(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    target = people.where("c_custkey % 3 <> 0")
    source = people.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 100).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return target, source


_T = "t AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey, c_acctbal + 100 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"


@query("upsert", f"WITH {_T} SELECT * FROM s UNION ALL SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s)")
def upsert(spark, sf):
    return tables.upsert(*_halves(spark, sf), ["c_custkey"])


@query("update_from", f"WITH {_T} SELECT t.c_custkey, coalesce(s.c_acctbal * 2, t.c_acctbal) AS c_acctbal, t.c_mktsegment FROM t LEFT JOIN s USING (c_custkey)")
def update_from(spark, sf):
    return tables.update_from(*_halves(spark, sf), ["c_custkey"], {"c_acctbal": F.col("s.c_acctbal") * 2})


@query("delete_using", f"WITH {_T} SELECT t.* FROM t ANTI JOIN s USING (c_custkey)")
def delete_using(spark, sf):
    return tables.delete_using(*_halves(spark, sf), ["c_custkey"])


@query("delete_unknown_stays", "SELECT n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 2) = 1, false)")
def delete_unknown_stays(spark, sf):
    return tables.delete_where(table(spark, sf, "nation"), F.expr("nullif(n_regionkey, 2) = 1")).select("n_nationkey")


@query(
    "merge_clauses",
    f"""WITH {_T} SELECT c_custkey, c_acctbal, c_mktsegment FROM (
        SELECT t.c_custkey, CASE WHEN t.c_acctbal >= 2000 THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal, CASE WHEN t.c_acctbal >= 2000 THEN 'MERGED' ELSE t.c_mktsegment END AS c_mktsegment FROM t JOIN s USING (c_custkey) WHERE NOT t.c_acctbal < 0
        UNION ALL SELECT s.c_custkey, s.c_acctbal, s.c_mktsegment FROM s ANTI JOIN t USING (c_custkey) WHERE s.c_custkey > 10
        UNION ALL SELECT t.c_custkey, t.c_acctbal, 'ALONE' FROM t ANTI JOIN s USING (c_custkey))""",
)
def merge_clauses(spark, sf):
    made = tables.Merge(*_halves(spark, sf), ["c_custkey"])
    made.when_matched(F.col("t.c_acctbal") < 0)
    made.when_matched(F.col("t.c_acctbal") >= 2000, {"c_acctbal": F.col("s.c_acctbal"), "c_mktsegment": F.lit("MERGED")})
    made.when_not_matched({c: F.col(f"s.{c}") for c in ("c_custkey", "c_acctbal", "c_mktsegment")}, F.col("s.c_custkey") > 10)
    made.when_not_matched_by_source(update={"c_mktsegment": F.lit("ALONE")})
    return made.result()


@query("insert_first", "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS branch, count(*) AS n FROM orders GROUP BY 1")
def insert_first(spark, sf):
    parts = tables.insert_first(table(spark, sf, "orders"), [("large", F.col("o_totalprice") > 200000), ("done", F.col("o_orderstatus") == "F")], "rest")
    made = [df.select(F.lit(name).alias("branch")) for name, df in parts.items()]
    return tables.union_by_name(made).groupBy("branch").agg(F.count("*").alias("n"))


@query("snapshot_diff", f"WITH {_T} (SELECT *, 'insert' AS change FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)) UNION ALL (SELECT *, 'delete' FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s))")
def snapshot_diff(spark, sf):
    return tables.snapshot_diff(*_halves(spark, sf))


@query("returning_rows", f"WITH {_T} SELECT t.c_custkey, t.c_acctbal AS before, s.c_acctbal AS after FROM t JOIN s USING (c_custkey)")
def returning_rows(spark, sf):
    target, source = _halves(spark, sf)
    return target.alias("t").join(source.alias("s"), "c_custkey").select("c_custkey", F.col("t.c_acctbal").alias("before"), F.col("s.c_acctbal").alias("after"))


@query("exact_sample")
def exact_sample(spark, sf):
    return tables.exact_sample(table(spark, sf, "orders"), 50, 42).select("o_orderkey")


@query("weighted_sample")
def weighted_sample(spark, sf):
    return tables.weighted_sample(table(spark, sf, "orders"), 50, "o_totalprice", 42).select("o_orderkey")


@query("stratified_sample")
def stratified_sample(spark, sf):
    return table(spark, sf, "orders").sampleBy("o_orderstatus", {"F": 0.1, "O": 0.2, "P": 0.5}, 42).select("o_orderkey", "o_orderstatus")


def _oracle(expression: str, order: str) -> str:
    return f"SELECT vec_id FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY {expression} {order}, vec_id LIMIT 20"


@query("cosine_topk", _oracle("list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])", "DESC"))
def cosine_topk(spark, sf):
    return nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 7, 20, "cosine").select("vec_id")


@query("l2_topk", _oracle("list_distance(embedding::DOUBLE[], q::DOUBLE[])", "ASC"))
def l2_topk(spark, sf):
    return nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 7, 20, "l2").select("vec_id")


@query("dot_topk", _oracle("list_inner_product(embedding::DOUBLE[], q::DOUBLE[])", "DESC"))
def dot_topk(spark, sf):
    return nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 7, 20, "dot").select("vec_id")
