"""Graph patterns, words of other dialects, positions, procedures and stream processors, each with rows that an oracle gives too."""

from pyspark.sql import functions as F

from ..documents import mongo, search
from ..functions import dialect as D
from ..operators import graphs
from ..registry import query
from ..services import catalog, statements
from ..services.procedures import Procedures
from ..session import table, tables
from ..sources import files, scratch
from ..streaming import streams
from .documents import _events

# Graph patterns. Every nation has a directed edge and an undirected one.

_EDGES = """e AS (SELECT n_nationkey * 2 AS id, n_nationkey AS s, (n_nationkey * 7 + 3) % 25 AS t, true AS d FROM nation
    UNION ALL SELECT n_nationkey * 2 + 1, n_nationkey, (n_nationkey * 3 + 1) % 25, false FROM nation)"""


def _graph(spark, sf):
    nation, key = table(spark, sf, "nation"), F.col("n_nationkey")
    edge = lambda k, t, directed, label: nation.select((key * 2 + k).alias("edge"), key.alias("source"), (t % 25).alias("target"), F.lit(directed).alias("directed"), F.lit(label).alias("label"))
    return nation.select(key.alias("node")), edge(0, key * 7 + 3, True, "sells").union(edge(1, key * 3 + 1, False, "borders"))


def _paths(found):
    return found.groupBy("start", F.col("end").alias("finish"), "length").agg(F.count("*").alias("paths"))


def _walks(moves: str, more: str, most: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, m AS ({moves}),
    p AS (SELECT n_nationkey AS start, n_nationkey AS finish, [n_nationkey] AS ns, []::INT[] AS es FROM nation
    UNION ALL SELECT start, b, list_append(ns, b), list_append(es, id) FROM p JOIN m ON finish = a WHERE len(es) < {most} AND {more})"""


_COUNTED = "SELECT start, finish, len(es)::INT AS length, count(*) AS paths FROM p"


@query("graph_trails", _walks("SELECT id, s AS a, t AS b FROM e UNION ALL SELECT id, t, s FROM e WHERE NOT d AND s <> t", "NOT list_contains(es, id)", 3) + f"{_COUNTED} WHERE len(es) > 0 GROUP BY ALL")
def graph_trails(spark, sf):
    return _paths(graphs.match(*_graph(spark, sf), "(a)~>{1,3}(b)", restrictor="trail"))


@query("graph_acyclic", _walks("SELECT id, s AS a, t AS b FROM e UNION ALL SELECT id, t, s FROM e WHERE s <> t", "NOT list_contains(ns, b)", 3) + f"{_COUNTED} GROUP BY ALL")
def graph_acyclic(spark, sf):
    return _paths(graphs.match(*_graph(spark, sf), "(a)-{0,3}(b)", restrictor="acyclic"))


@query(
    "graph_simple",
    _walks("SELECT id, s AS a, t AS b FROM e WHERE d", "(NOT list_contains(ns, b) OR b = start) AND (len(es) = 0 OR finish <> start)", 60) + f"{_COUNTED} WHERE len(es) > 0 GROUP BY ALL",
)
def graph_simple(spark, sf):
    return _paths(graphs.match(*_graph(spark, sf), "(a)->+(b)", restrictor="simple"))


@query(
    "graph_any_shortest",
    f"""WITH RECURSIVE {_EDGES}, m AS (SELECT s AS a, t AS b FROM e WHERE d UNION SELECT t, s FROM e WHERE d UNION SELECT s, t FROM e WHERE NOT d UNION SELECT t, s FROM e WHERE NOT d),
    p AS (SELECT a AS start, b AS finish, 1 AS length FROM m UNION SELECT start, b, length + 1 FROM p JOIN m ON finish = a WHERE length < 25)
    SELECT start, finish, min(length) AS length FROM p GROUP BY ALL""",
)
def graph_any_shortest(spark, sf):
    return graphs.match(*_graph(spark, sf), "(a)-+(b)", selector="any shortest").select("start", F.col("end").alias("finish"), "length")


@query(
    "graph_all_shortest",
    _walks("SELECT id, t AS a, s AS b FROM e WHERE d UNION ALL SELECT id, s, t FROM e WHERE NOT d UNION ALL SELECT id, t, s FROM e WHERE NOT d AND s <> t", "true", 5)
    + f"SELECT * FROM ({_COUNTED} WHERE len(es) > 0 GROUP BY ALL) QUALIFY length = min(length) OVER (PARTITION BY start, finish)",
)
def graph_all_shortest(spark, sf):
    return _paths(graphs.match(*_graph(spark, sf), "(a)<~{1,5}(b)", selector="all shortest"))


@query(
    "graph_match_labels",
    f"""WITH {_EDGES}, u AS (SELECT id, s AS a, t AS b FROM e WHERE NOT d UNION ALL SELECT id, t, s FROM e WHERE NOT d AND s <> t)
    SELECT x.s AS start, y.s AS finish, u.id AS border, count(*) AS paths FROM e x JOIN u ON x.t = u.a JOIN e y ON y.t = u.b WHERE x.d AND y.d GROUP BY ALL""",
)
def graph_match_labels(spark, sf):
    found = graphs.match(*_graph(spark, sf), "(a)-[x:sells]->(m)~[:borders]~(n)<-[y:sells]-(b)")
    return found.groupBy("start", F.col("end").alias("finish"), F.col("edges")[1].alias("border")).agg(F.count("*").alias("paths"))


# Words of other dialects


def _dialect(name: str, text: str, oracle: str) -> None:
    """A query whose text Spark's parser takes only when it is adapted."""

    def run(spark, sf):
        tables(spark, sf, text)
        return statements.run_script(spark, text)

    query(name, oracle)(run)


_dialect(
    "materialized_cte",
    "WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), few AS NOT MATERIALIZED (SELECT c_custkey FROM customer WHERE c_acctbal > 0) SELECT c_custkey, round(total, 2) AS total FROM few JOIN big ON o_custkey = c_custkey",
    "WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), few AS NOT MATERIALIZED (SELECT c_custkey FROM customer WHERE c_acctbal > 0) SELECT c_custkey, round(total, 2) AS total FROM few JOIN big ON o_custkey = c_custkey",
)
_dialect(
    "straight_join",
    "SELECT STRAIGHT_JOIN c_custkey, n_name FROM nation STRAIGHT_JOIN customer ON c_nationkey = n_nationkey INNER DIRECTED JOIN region ON r_regionkey = n_regionkey",
    "SELECT c_custkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey",
)
_dialect("order_by_using", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice USING >, p_partkey USING <) AS place FROM part", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
_dialect("allow_filtering", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'ALLOW FILTERING' OR c_acctbal > 500 ALLOW FILTERING", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 500")
_dialect("token_scan", "SELECT o_orderkey FROM orders WHERE TOKEN(o_orderkey) <= 0 UNION ALL SELECT o_orderkey FROM orders WHERE TOKEN(o_orderkey) > 0", "SELECT o_orderkey FROM orders")
_dialect(
    "set_rowcount",
    "SET ROWCOUNT 7; CREATE OR REPLACE TEMP VIEW seven AS SELECT 1 AS one; SET ROWCOUNT 0; SELECT n_nationkey FROM nation; SET ROWCOUNT 4; SELECT one, r_name IS NOT NULL AS named FROM seven CROSS JOIN region",
    "SELECT 1 AS one, true AS named FROM range(4)",
)


@query("mixed_set_chain", "SELECT * FROM (VALUES (0, false), (1, true), (2, false), (3, false), (4, true)) AS t(n, mixed)")
def mixed_set_chain(spark, sf):
    texts = ("SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3", "SELECT 1 UNION ALL SELECT 2 EXCEPT SELECT 3", "(SELECT 1 UNION ALL SELECT 2) EXCEPT SELECT 3", "SELECT ' UNION ' INTERSECT SELECT 2", "SELECT * FROM (SELECT 1 UNION SELECT 2 UNION ALL SELECT 3)")
    return spark.createDataFrame([(n, statements.mixed_chain(text)) for n, text in enumerate(texts)], "n int, mixed boolean")


# Functions


@query(
    "inet6_functions",
    """SELECT n_nationkey, '20010DB8' || repeat('0', 20) || lpad(upper(to_hex(n_nationkey)), 4, '0') AS six, '0A00' || lpad(upper(to_hex(n_regionkey)), 2, '0') || '07' AS four,
    '2001:db8::' || CASE n_nationkey WHEN 0 THEN '' ELSE lower(to_hex(n_nationkey)) END AS back, NULL::VARCHAR AS none FROM nation""",
)
def inet6_functions(spark, sf):
    six = D.inet6_aton(F.concat(F.lit("2001:DB8:0::0:"), F.hex("n_nationkey")))
    four = D.inet6_aton(F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit(".7")))
    return table(spark, sf, "nation").select("n_nationkey", F.hex(six).alias("six"), F.hex(four).alias("four"), D.inet6_ntoa(six).alias("back"), D.inet6_ntoa(D.inet6_aton(F.col("n_name"))).alias("none"))


@query(
    "get_format_patterns",
    """SELECT event_id, strftime(ts, '%d.%m.%Y') AS eur, strftime(ts, '%m.%d.%Y') AS usa, strftime(ts, '%H%M%S') AS plain, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%I:%M:%S %p') AS clock FROM events""",
)
def get_format_patterns(spark, sf):
    shown = lambda kind, standard, name: D.mysql_date_format(F.col("ts"), D.get_format(kind, standard)).alias(name)
    return table(spark, sf, "events").select("event_id", shown("DATE", "EUR", "eur"), shown("DATE", "USA", "usa"), shown("TIME", "INTERNAL", "plain"), shown("TIMESTAMP", "ISO", "iso"), shown("TIME", "USA", "clock"))


@query("current_times", "SELECT true AS curtime, true AS utc_time, true AS utc_timestamp, count(*) AS uuid_short FROM orders")
def current_times(spark, sf):
    clock = lambda c: c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    many = table(spark, sf, "orders").select(D.uuid_short().alias("u")).agg(F.count_distinct("u").alias("uuid_short"))
    return many.select(clock(D.curtime()).alias("curtime"), clock(D.utc_time()).alias("utc_time"), (D.utc_timestamp() <= F.to_utc_timestamp(F.now(), F.current_timezone())).alias("utc_timestamp"), "uuid_short")


@query(
    "key_value_functions",
    """SELECT event_id, event_type LIKE 'p%' AS begins, contains(event_type, 'i') AS has, length(event_type) AS size, 'S' AS text, 'N' AS number, CASE WHEN event_type = 'view' THEN 'NULL' ELSE 'N' END AS maybe, 'L' AS list, 'BOOL' AS flag FROM events""",
)
def key_value_functions(spark, sf):
    kind, letters = F.col("event_type"), D.attribute_type
    maybe = F.when(kind != "view", F.col("value"))
    return table(spark, sf, "events").select(
        "event_id",
        F.startswith(kind, F.lit("p")).alias("begins"),
        F.contains(kind, F.lit("i")).alias("has"),
        F.length(kind).alias("size"),
        letters(kind).alias("text"),
        letters(F.col("user_id")).alias("number"),
        letters(maybe).alias("maybe"),
        letters(F.array("user_id")).alias("list"),
        letters(kind == "view").alias("flag"),
    )


@query("mongo_expressions", "SELECT event_id, value * 2 * user_id AS product, event_type || '-' || user_id AS tag, year(ts) AS y, month(ts) AS m, 2 AS n FROM events")
def mongo_expressions(spark, sf):
    shape = {"event_id": 1, "product": {"$multiply": ["$value", 2, "$user_id"]}, "tag": {"$concat": ["$event_type", "-", {"$toString": "$user_id"}]}, "y": {"$year": "$ts"}, "m": {"$month": "$ts"}, "n": {"$size": "$pair"}}
    return mongo.aggregate(table(spark, sf, "events").withColumn("pair", F.array("event_id", "user_id")), [{"$project": shape}])


# Positions: longitude and latitude from the keys of suppliers

_PLACES = "p AS (SELECT s_suppkey, s_suppkey * 37 % 360 - 180 AS lon, s_suppkey * 17 % 160 - 80 AS lat FROM supplier)"
_KM = "2 * 6371 * asin(sqrt(power(sin(radians({lat} - lat) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * power(sin(radians({lon} - lon) / 2), 2)))"


def _places(spark, sf):
    lon, lat = F.col("s_suppkey") * 37 % 360 - 180, F.col("s_suppkey") * 17 % 160 - 80
    return table(spark, sf, "supplier").select("s_suppkey", F.array(lon, lat).alias("loc"), F.struct(lon.alias("lon"), lat.alias("lat")).alias("place"))


@query("mongo_geo_within", f"WITH {_PLACES} SELECT s_suppkey FROM p WHERE (lon BETWEEN -50 AND 60 AND lat BETWEEN -10 AND 70) OR {_KM.format(lon=100, lat=20)} / 6371 <= 0.3")
def mongo_geo_within(spark, sf):
    box, circle = {"$geoWithin": {"$box": [[-50, -10], [60, 70]]}}, {"$geoWithin": {"$centerSphere": [[100, 20], 0.3]}}
    return mongo.find(_places(spark, sf), {"$or": [{"loc": box}, {"loc": circle}]}).select("s_suppkey")


@query("mongo_near", f"WITH {_PLACES} SELECT s_suppkey FROM (SELECT *, {_KM.format(lon=10, lat=50)} AS km FROM p) WHERE km BETWEEN 500 AND 6000 ORDER BY km, s_suppkey LIMIT 5")
def mongo_near(spark, sf):
    near = {"$nearSphere": {"$geometry": {"type": "Point", "coordinates": [10, 50]}, "$minDistance": 500_000, "$maxDistance": 6_000_000}}
    return mongo.find(_places(spark, sf), {"loc": near}, limit=5).select("s_suppkey")


@query("es_geo_distance", f"WITH {_PLACES} SELECT s_suppkey FROM p WHERE {_KM.format(lon=-70, lat=40)} <= 2500 * 1.609344 OR (lat BETWEEN -60 AND -20 AND lon BETWEEN 100 AND 170)")
def es_geo_distance(spark, sf):
    near = {"geo_distance": {"distance": "2500mi", "place": {"lat": 40, "lon": -70}}}
    box = {"geo_bounding_box": {"place": {"top_left": {"lat": -20, "lon": 100}, "bottom_right": {"lat": -60, "lon": 170}}}}
    return search.search(_places(spark, sf), {"query": {"bool": {"should": [near, box]}}, "size": 10**9, "_source": ["s_suppkey"]})


# Sources and streams


@query("broker_load", "SELECT o_orderkey AS k, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_totalprice > 1000")
def broker_load(spark, sf):
    path = scratch.folder(spark, "broker")
    files.copy_to(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, "CSV", header=True)
    return files.copy_from(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE", "CSV", where="twice > 2000", mapping={"k": "o_orderkey", "twice": "round(o_totalprice * 2, 2)"}, header=True)


@query("external_stream", "SELECT event_id, event_type FROM events")
def external_stream(spark, sf):
    path = scratch.folder(spark, "stream")
    files.copy_to(table(spark, sf, "events").select("event_id", "event_type"), path, "JSON")
    return streams.drained(streams.external(spark, path, "JSON", "event_id BIGINT, event_type STRING"))


@query("stream_processors", "SELECT event_id, true AS listed, false AS listed_after FROM events WHERE value > 50")
def stream_processors(spark, sf):
    target, marks, name = scratch.folder(spark, "target"), scratch.folder(spark, "marks"), "values_over_50"
    running = streams.routine_load(_events(spark, sf), target, marks, name, lambda df: df.where("value > 50").select("event_id"), processingTime="1 second")
    try:
        listed = name in streams.processors(spark)
        running.processAllAvailable()
    finally:
        streams.stop_processor(spark, name)
    return spark.read.schema("event_id BIGINT").parquet(target).select("event_id", F.lit(listed).alias("listed"), F.lit(name in streams.processors(spark)).alias("listed_after"))


@query("dynamic_table", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def dynamic_table(spark, sf):
    path, marks = scratch.folder(spark, "dynamic"), scratch.folder(spark, "marks")
    running = streams.refreshed(_events(spark, sf), lambda df: df.groupBy("user_id").agg(F.count("*").alias("n")), path, marks, lag="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"))


# Services


@query("call_procedure", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 3")
def call_procedure(spark, sf):
    known = Procedures(spark)
    known.add("richest", lambda n, segment: table(spark, sf, "customer").where(F.col("c_mktsegment") == segment).orderBy(F.desc("c_acctbal"), "c_custkey").limit(n).select("c_custkey", "c_acctbal"))
    return known.call("CALL richest(least(3, 8), segment => upper('building'));")


@query("review_rules", "SELECT * FROM (VALUES (0, 'select-all'), (0, 'leading-wildcard'), (1, 'where-required'), (2, 'cross-join'), (2, 'order-by-rand')) AS t(n, rule)")
def review_rules(spark, sf):
    texts = ("SELECT * FROM t WHERE a LIKE '%x'", "DELETE FROM t -- where", "SELECT a FROM t CROSS JOIN u ORDER BY rand()", "SELECT a FROM t WHERE b = 1")
    return spark.createDataFrame([(n, rule) for n, text in enumerate(texts) for rule, _ in catalog.review(text)], "n int, rule string")


@query("pipeline_analysis", "SELECT * FROM (VALUES ('keeps', 'true'), ('shapes', 'false'), ('field', 'a'), ('field', 'b.c'), ('field', 'b')) AS t(part, value)")
def pipeline_analysis(spark, sf):
    rows = [("keeps", str(mongo.keeps_shape([{"$match": {"a": 1}}, {"$limit": 3}])).lower()), ("shapes", str(mongo.keeps_shape([{"$group": {"_id": "$a"}}])).lower())]
    rows += [("field", x) for x in mongo.predicate_fields({"$or": [{"a": 1}, {"b": {"$elemMatch": {"c": 2}}}]})]
    return spark.createDataFrame(rows, "part string, value string")
