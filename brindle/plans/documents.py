"""Document queries, row patterns and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..documents import mongo, search
from ..operators.match import match_recognize
from ..registry import query
from ..session import table
from ..sources import files, scratch
from ..streaming import streams


@query("mongo_group", "SELECT o_orderpriority AS _id, count(*) AS n, round(sum(o_totalprice), 0) AS total, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000 GROUP BY 1")
def mongo_group(spark, sf):
    made = mongo.aggregate(table(spark, sf, "orders"), [{"$match": {"o_orderstatus": "F", "o_totalprice": {"$gte": 50000}}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "hi": {"$max": "$o_totalprice"}}}])
    return made.withColumn("total", F.round("total", 0))


@query("mongo_filters", "SELECT c_custkey FROM customer WHERE (c_nationkey IN (1, 2, 3) OR c_acctbal < 0) AND c_mktsegment <> 'BUILDING' AND c_custkey % 3 = 1 AND regexp_matches(c_name, '[0-5]$') AND NOT (c_acctbal > 9000)")
def mongo_filters(spark, sf):
    return mongo.find(table(spark, sf, "customer"), {"$or": [{"c_nationkey": {"$in": [1, 2, 3]}}, {"c_acctbal": {"$lt": 0}}], "c_mktsegment": {"$ne": "BUILDING"}, "c_custkey": {"$mod": [3, 1]}, "c_name": {"$regex": "[0-5]$"}, "$nor": [{"c_acctbal": {"$gt": 9000}}]}, {"c_custkey": 1})


@query("mongo_unwind", "SELECT o_custkey, item, count(*) AS n FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS item FROM orders) GROUP BY 1, 2")
def mongo_unwind(spark, sf):
    return mongo.aggregate(table(spark, sf, "orders"), [{"$project": {"o_custkey": 1, "item": ["$o_orderstatus", "$o_orderpriority"]}}, {"$unwind": "$item"}, {"$group": {"_id": {"c": "$o_custkey", "i": "$item"}, "n": {"$sum": 1}}}, {"$project": {"o_custkey": "$_id.c", "item": "$_id.i", "n": 1}}, {"$unset": "_id"}])


@query("mongo_facet", "SELECT 'status' AS facet, o_orderstatus AS key, count(*) AS count FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def mongo_facet(spark, sf):
    parts = mongo.facet(table(spark, sf, "orders"), {"status": [{"$sortByCount": "$o_orderstatus"}], "priority": [{"$sortByCount": "$o_orderpriority"}]})
    made = [df.select(F.lit(k).alias("facet"), F.col("_id").alias("key"), "count") for k, df in parts.items()]
    return made[0].union(made[1])


@query("mongo_bucket", "SELECT CASE WHEN c_acctbal < 0 THEN -1000 WHEN c_acctbal < 5000 THEN 0 ELSE 5000 END AS _id, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def mongo_bucket(spark, sf):
    return mongo.aggregate(table(spark, sf, "customer"), [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [-1000, 0, 5000, 20000], "output": {"n": {"$sum": 1}, "first": {"$min": "$c_custkey"}}}}])


@query("mongo_lookup", "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def mongo_lookup(spark, sf):
    made = mongo.aggregate(table(spark, sf, "nation"), [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "s"}}, {"$project": {"n_nationkey": 1, "n": {"$size": "$s"}}}], {"supplier": table(spark, sf, "supplier")})
    return made.withColumn("n", F.col("n").cast("long"))


@query("mongo_graph_lookup", "WITH RECURSIVE t(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT s_suppkey, depth + 1 FROM supplier JOIN t ON s_suppkey // 2 = node WHERE s_suppkey > 1) SELECT node, min(depth) AS depth FROM t GROUP BY node")
def mongo_graph_lookup(spark, sf):
    suppliers = table(spark, sf, "supplier")
    edges = suppliers.where("s_suppkey > 1").select(F.expr("s_suppkey DIV 2").alias("parent"), "s_suppkey")
    return mongo.aggregate(suppliers.where("s_suppkey = 1"), [{"$graphLookup": {"from": "edges", "startWith": "$s_suppkey", "connectFromField": "parent", "connectToField": "s_suppkey", "as": "below"}}], {"edges": edges})


@query("mongo_window_fields", "SELECT o_orderkey, row_number() OVER w AS doc, rank() OVER w AS rank, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def mongo_window_fields(spark, sf):
    made = mongo.aggregate(table(spark, sf, "orders"), [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"doc": {"$documentNumber": {}}, "rank": {"$rank": {}}, "n": {"$sum": 1, "window": {"documents": ["unbounded", "current"]}}}}}, {"$project": {"o_orderkey": 1, "doc": 1, "rank": 1, "n": 1}}])
    return made


@query("mongo_fill", "SELECT o_orderkey, last_value(nullif(o_orderstatus, 'O') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders")
def mongo_fill(spark, sf):
    rows = table(spark, sf, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'O')"))
    return mongo.aggregate(rows, [{"$fill": {"partitionByFields": ["o_custkey"], "sortBy": {"o_orderkey": 1}, "output": {"s": {"method": "locf"}}}}, {"$project": {"o_orderkey": 1, "s": 1}}])


@query("mongo_union_with", "SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def mongo_union_with(spark, sf):
    others = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    made = mongo.aggregate(table(spark, sf, "customer").select("c_nationkey"), [{"$unionWith": "supplier"}, {"$group": {"_id": "$c_nationkey", "n": {"$count": {}}}}], {"supplier": others})
    return made.withColumnRenamed("_id", "k")


@query("mongo_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
def mongo_update(spark, sf):
    return mongo.update_many(table(spark, sf, "nation"), {"n_regionkey": 1}, {"$set": {"n_name": "x"}, "$inc": {"n_regionkey": 10}})


@query("es_bool", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND value >= 10 AND value < 60 AND NOT user_id < 20 AND ((event_type LIKE 'v%')::INT + (value > 30)::INT) >= 1")
def es_bool(spark, sf):
    body = {"query": {"bool": {"must": [{"terms": {"event_type": ["view", "click"]}}], "filter": {"range": {"value": {"gte": 10, "lt": 60}}}, "must_not": {"range": {"user_id": {"lt": 20}}}, "should": [{"prefix": {"event_type": "v"}}, {"range": {"value": {"gt": 30}}}], "minimum_should_match": 1}}, "size": 10**9, "_source": ["event_id"]}
    return search.search(table(spark, sf, "events"), body)


@query("es_range_sort", "SELECT event_id, user_id FROM events WHERE value > 50 ORDER BY value DESC, event_id LIMIT 25 OFFSET 5")
def es_range_sort(spark, sf):
    body = {"query": {"range": {"value": {"gt": 50}}}, "sort": [{"value": "desc"}, "event_id"], "from": 5, "size": 25, "_source": {"includes": ["event_id", "user*"]}}
    return search.search(table(spark, sf, "events"), body)


@query("es_match", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), 'with')")
def es_match(spark, sf):
    return search.search(table(spark, sf, "documents"), {"query": {"match": {"text": {"query": "the with", "operator": "and"}}}, "size": 10**9, "_source": ["doc_id"]})


@query("es_terms", "SELECT event_type AS key, count(*) AS doc_count, round(avg(value), 4) AS mean FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def es_terms(spark, sf):
    return search.terms(table(spark, sf, "events"), {"query": {"exists": {"field": "user_id"}}}, "event_type", {"mean": F.round(F.avg("value"), 4)})


@query("es_fuzzy_wildcard", "SELECT p_partkey FROM part WHERE levenshtein(p_type, 'PROMO') <= 2 OR regexp_full_match(p_name, '.*a.e.*')")
def es_fuzzy_wildcard(spark, sf):
    return search.search(table(spark, sf, "part"), {"query": {"bool": {"should": [{"fuzzy": {"p_type": {"value": "PROMO", "fuzziness": 2}}}, {"wildcard": {"p_name": "*a?e*"}}]}}, "size": 10**9, "_source": ["p_partkey"]})


_V = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "match_recognize_v",
    f"""WITH f AS (SELECT *, value < lag(value) OVER w AS down, value > lag(value) OVER w AS up, row_number() OVER w AS n FROM events WINDOW w AS ({_V})),
    d AS (SELECT *, CASE WHEN down THEN n - row_number() OVER (PARTITION BY user_id, down ORDER BY n) END AS run FROM f),
    runs AS (SELECT user_id, min(n) AS a, max(n) AS b FROM d WHERE down GROUP BY user_id, run),
    v AS (SELECT r.user_id, r.a, r.b, (SELECT max(u.n) FROM f u WHERE u.user_id = r.user_id AND u.n > r.b AND NOT EXISTS (SELECT 1 FROM f x WHERE x.user_id = r.user_id AND x.n > r.b AND x.n <= u.n AND coalesce(x.up, false) = false)) AS e FROM runs r)
    SELECT user_id, count(*) AS matches, CAST(sum(e - a + 1) AS BIGINT) AS rows FROM v WHERE e IS NOT NULL GROUP BY user_id""",
)
def match_recognize_v(spark, sf):
    """V shapes: one or more falls, then one or more rises."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(window)
    found = match_recognize(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], [F.col("ts"), F.col("event_id")], "DOWN+ UP+", {"DOWN": F.col("value") < before, "UP": F.col("value") > before})
    return found.groupBy("user_id").agg(F.count_distinct("match_number").alias("matches"), F.count("*").alias("rows"))


@query("match_recognize_seq", "SELECT count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a = 'view' AND b = 'click' AND c IN ('purchase', 'error')")
def match_recognize_seq(spark, sf):
    kind = {"V": F.col("event_type") == "view", "C": F.col("event_type") == "click", "P": F.col("event_type") == "purchase", "E": F.col("event_type") == "error"}
    found = match_recognize(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "V C (P | E)", kind, after="to next row")
    return found.where("match_row = 1").agg(F.count("*").alias("n"))


def _events(spark, sf):
    """The events as a folder of files, which the streams read one by one."""
    path = scratch.folder(spark, "events")
    table(spark, sf, "events").repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    return streams.source(spark, path)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return streams.drained(streams.tumbling(_events(spark, sf), "ts", "1 day", "400 days", ["event_type"]), "complete")


@query("stream_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS s FROM events) GROUP BY 1")
def stream_sliding(spark, sf):
    return streams.drained(streams.sliding(_events(spark, sf), "ts", "2 days", "1 day", "400 days"), "complete")


@query("stream_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '1' DAY THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_session(spark, sf):
    return streams.drained(streams.sessions(_events(spark, sf), "ts", "1 day", "400 days", "user_id"), "complete")


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedup(spark, sf):
    path = scratch.folder(spark, "twice")
    events = table(spark, sf, "events")
    events.union(events).repartition(3).write.parquet(path)
    return streams.drained(streams.deduplicated(streams.source(spark, path), ["event_id"], "ts", "4000 days")).agg(F.count("*").alias("n"))


@query("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark, sf):
    joined = _events(spark, sf).where("event_type = 'purchase'").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
    return streams.drained(joined.select("event_id", "c_name"))


@query("stream_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY")
def stream_interval_join(spark, sf):
    events = _events(spark, sf)
    pairs = streams.interval_join(events.where("event_type = 'view'"), _events(spark, sf).where("event_type = 'purchase'"), "user_id", "ts", "ts", "2 DAYS", "4000 days")
    return streams.drained(pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b")))


@query("copy_roundtrip_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def copy_roundtrip_csv(spark, sf):
    path = scratch.folder(spark, "csv")
    files.copy_to(table(spark, sf, "nation"), path, "CSV", header=True, delimiter="|")
    return files.copy_from(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT", "CSV", "n_regionkey <> 2", header=True, delimiter="|")


@query("copy_roundtrip_json", "SELECT r_regionkey + 1 AS k, r_name AS name FROM region")
def copy_roundtrip_json(spark, sf):
    path = scratch.folder(spark, "json")
    files.copy_to(table(spark, sf, "region"), path, "JSON")
    return files.copy_from(spark, path, "r_regionkey INT, r_name STRING", "JSON", mapping={"k": "r_regionkey + 1", "name": "r_name"})


@query("unload_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def unload_partitioned(spark, sf):
    path = scratch.folder(spark, "unload")
    files.copy_to(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, "PARQUET", partition_by=["o_orderstatus"], most_rows=1000)
    return files.partition_scan(spark.read.parquet(path), F.col("o_orderstatus") == "F")


@query("orc_roundtrip", "SELECT * FROM supplier")
def orc_roundtrip(spark, sf):
    path = scratch.folder(spark, "orc")
    files.copy_to(table(spark, sf, "supplier"), path, "ORC")
    return spark.read.orc(path)


@query("time_travel", "SELECT user_id, event_id FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def time_travel(spark, sf):
    events = table(spark, sf, "events").withColumn("version", F.struct("ts", "event_id"))
    moment = events.agg((F.min("ts") + F.expr("INTERVAL 10 DAYS")).alias("m")).first()["m"]
    return files.as_of(events.where(F.col("ts") <= F.lit(moment)), "version", events["version"], ["user_id"]).select("user_id", "event_id")
