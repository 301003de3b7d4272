"""Further names of the function catalogue, loads, streams and services, each with rows that an oracle gives too."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..documents import search
from ..functions import dialect as D
from ..operators import tables as ops
from ..registry import query, sql_query
from ..services import catalog, statements
from ..session import table, tables
from ..sources import files, scratch
from ..streaming import streams
from .documents import _events

sql_query(
    "agg_deviation_names",
    "SELECT o_orderstatus, round(std(o_totalprice), 4) AS s, round(stddev_samp(o_totalprice), 4) AS ss, round(var_samp(o_totalprice) / 1e6, 4) AS v FROM orders GROUP BY 1",
    "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS s, round(stddev_samp(o_totalprice), 4) AS ss, round(var_samp(o_totalprice) / 1e6, 4) AS v FROM orders GROUP BY 1",
)
sql_query(
    "str_names",
    """SELECT c_custkey, substr(c_name, 3, 5) AS s, char_length(c_name) AS n, character_length(c_mktsegment) AS n2, lcase(c_mktsegment) AS lc, ucase(c_name) AS uc,
    concat('a', space(3), 'b') AS sp, position('#' IN c_name) AS p, find_in_set(c_mktsegment, 'BUILDING,MACHINERY') AS fs, elt(c_nationkey % 3 + 1, 'x', 'y', 'z') AS e,
    initcap(lower(c_mktsegment)) AS ic, overlay(c_name PLACING '__' FROM 2 FOR 3) AS o, bit_length(c_name) AS bl, octet_length(c_name) AS ol FROM customer""",
    """SELECT c_custkey, substring(c_name, 3, 5) AS s, length(c_name) AS n, length(c_mktsegment) AS n2, lower(c_mktsegment) AS lc, upper(c_name) AS uc,
    'a   b' AS sp, strpos(c_name, '#') AS p, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS fs, ['x', 'y', 'z'][c_nationkey % 3 + 1] AS e,
    upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS ic, left(c_name, 1) || '__' || substring(c_name, 5) AS o, bit_length(c_name) AS bl, strlen(c_name) AS ol FROM customer""",
)
sql_query(
    "str_sounds_and_formats",
    "SELECT n_nationkey, soundex(CASE n_regionkey WHEN 0 THEN 'Robert' ELSE 'Rubin' END) AS s, format_number(n_nationkey * 1234.5, 2) AS f, to_varchar(n_nationkey + 1, '999') AS v, crc32('Spark') AS c FROM nation",
    "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'R163' ELSE 'R150' END AS s, format('{:,.2f}', n_nationkey * 1234.5) AS f, lpad((n_nationkey + 1)::VARCHAR, 3, ' ') AS v, 1557323817 AS c FROM nation",
)
sql_query(
    "math_names",
    """SELECT p_partkey, ceiling(p_retailprice) AS c, pow(p_size, 2) AS p, round(log(2, p_size + 1), 6) AS l2, round(log(p_size + 1), 6) AS l, round(cosh(p_size / 50.0), 6) AS ch, round(sinh(p_size / 50.0), 6) AS sh,
    round(tanh(p_size / 50.0), 6) AS th, round(acosh(p_size + 1.0), 6) AS ach, round(asinh(p_size), 6) AS ash, round(atanh(p_size / 100.0), 6) AS ath FROM part""",
    """SELECT p_partkey, ceil(p_retailprice)::BIGINT AS c, pow(p_size, 2) AS p, round(ln(p_size + 1) / ln(2), 6) AS l2, round(ln(p_size + 1), 6) AS l, round(cosh(p_size / 50.0), 6) AS ch, round(sinh(p_size / 50.0), 6) AS sh,
    round(tanh(p_size / 50.0), 6) AS th, round(acosh(p_size + 1.0), 6) AS ach, round(asinh(p_size), 6) AS ash, round(atanh(p_size / 100.0), 6) AS ath FROM part""",
)
sql_query(
    "dt_names",
    """SELECT o_orderkey, date(o_orderdate) AS d, second(o_orderdate) AS s, dayofmonth(o_orderdate) AS dm, timestampadd(HOUR, 5, o_orderdate) AS ta, CAST(dateadd(DAY, 3, CAST(o_orderdate AS DATE)) AS DATE) AS da,
    date_part('YEAR', o_orderdate) AS dp, from_unixtime(o_orderkey * 1000) AS fu, CAST(make_timestamp(2020, 1, 2, 3, 4, CAST(o_orderkey % 60 AS DECIMAL(16, 6))) AS TIMESTAMP_NTZ) AS mt FROM orders""",
    """SELECT o_orderkey, o_orderdate::DATE AS d, second(o_orderdate) AS s, day(o_orderdate) AS dm, o_orderdate + INTERVAL 5 HOUR AS ta, (o_orderdate::DATE + 3) AS da,
    year(o_orderdate) AS dp, strftime(make_timestamp(o_orderkey * 1000000000), '%Y-%m-%d %H:%M:%S') AS fu, make_timestamp(2020, 1, 2, 3, 4, o_orderkey % 60) AS mt FROM orders""",
)
sql_query(
    "niladic_names",
    """SELECT current_schema() = current_database() AS s, user() = current_user() AS u, session_user() = current_user() AS su, length(version()) > 0 AS v, abs(timestampdiff(MINUTE, localtimestamp(), CAST(now() AS TIMESTAMP_NTZ))) < 5 AS lt,
    date_format(current_timestamp(), 'HH:mm:ss') >= '00:00:00' AS ct, to_utc_timestamp(now(), current_timezone()) IS NOT NULL AS ut""",
    "SELECT true AS s, true AS u, true AS su, true AS v, true AS lt, true AS ct, true AS ut",
)
sql_query(
    "crypto_names",
    "SELECT n_nationkey, CAST(aes_decrypt(aes_encrypt(n_name, '0123456789abcdef'), '0123456789abcdef') AS STRING) AS back, aes_encrypt(n_name, '0123456789abcdef') <> CAST(n_name AS BINARY) AS hidden FROM nation",
    "SELECT n_nationkey, n_name AS back, true AS hidden FROM nation",
)
sql_query(
    "convert_names",
    "SELECT n_nationkey, hex(binary(n_name)) AS b, collation(n_name) LIKE '%UTF8_BINARY' AS c, string(n_nationkey) AS s, int('7') AS i, double(n_nationkey) / 2 AS d FROM nation",
    "SELECT n_nationkey, hex(n_name) AS b, true AS c, n_nationkey::VARCHAR AS s, 7 AS i, n_nationkey / 2 AS d FROM nation",
)
sql_query(
    "arr_names",
    "SELECT n_nationkey, cardinality(a) AS c, array_join(array_append(a, 9), ',') AS ap, reduce(a, 0, (s, x) -> s + x) AS r FROM (SELECT n_nationkey, array(n_nationkey, n_regionkey, 3) AS a FROM nation)",
    "SELECT n_nationkey, 3 AS c, concat_ws(',', n_nationkey, n_regionkey, 3, 9) AS ap, n_nationkey + n_regionkey + 3 AS r FROM nation",
)
sql_query(
    "random_names",
    "SELECT min(r) >= 0 AND max(r) < 1 AS r, min(u) >= 10 AND max(u) <= 20 AS u, count(DISTINCT r) > 1 AS many FROM (SELECT random(7) AS r, uniform(10, 20, 3) AS u FROM orders)",
    "SELECT true AS r, true AS u, true AS many",
)
sql_query(
    "named_arguments",
    "SELECT n_nationkey, mask(str => n_name, upperChar => 'Q', digitChar => 'd') AS m FROM nation",
    "SELECT n_nationkey, regexp_replace(regexp_replace(n_name, '[A-Z]', 'Q', 'g'), '[0-9]', 'd', 'g') AS m FROM nation",
)
sql_query("row_star", "SELECT s.* FROM (SELECT struct(n_nationkey AS a, n_name AS b) AS s FROM nation)", "SELECT n_nationkey AS a, n_name AS b FROM nation")


@query("join_order_hints", "SELECT n_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def join_order_hints(spark, sf):
    """The hashed side of a shuffled hash join cannot spill, so orders come to it counted by customer."""
    customer, orders, nation = (table(spark, sf, t) for t in ("customer", "orders", "nation"))
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = customer.join(counted.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).join(nation.hint("merge"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n"))


@query(
    "time_of_day_names",
    """SELECT event_id, strftime(ts, '%H:%M:%S') AS t, strftime(date_trunc('day', ts) + INTERVAL 3723 SECOND, '%H:%M:%S') AS mk, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS secs,
    printf('%02d:%02d:%02d', hour(ts) + 30, minute(ts), second(ts)) AS later, printf('%02d:%02d:%02d', hour(ts), minute(ts), second(ts)) AS same, 14 AS months, strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y')::DATE AS parsed FROM events""",
)
def time_of_day_names(spark, sf):
    t = F.date_format("ts", "HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id",
        t.alias("t"),
        D.maketime(F.lit(1), F.lit(2), F.lit(3)).alias("mk"),
        D.time_to_sec(t).alias("secs"),
        D.addtime(t, F.lit("30:00:00")).alias("later"),
        D.subtime(D.addtime(t, F.lit("01:30:00")), F.lit("01:30:00")).alias("same"),
        D.period_diff(F.lit(202103), F.lit(202001)).alias("months"),
        D.str_to_date(F.date_format("ts", "dd/MM/yyyy"), "%d/%m/%Y").cast("date").alias("parsed"),
    )


@query(
    "json_names",
    """SELECT event_id, true AS has, false AS lacks, '$.a.b,$.c[1]' AS at, '{"k":' || (props->>'$.k') || ',"z":1}' AS ins, '{"k":0}' AS rep, '{"k":[' || (props->>'$.k') || ',1]}' AS both, '{"k":1}' AS patch, 2 AS depth,
    '{
  "k": ' || (props->>'$.k') || '
}' AS pretty FROM events""",
)
def json_names(spark, sf):
    props = F.col("props")
    return table(spark, sf, "events").select(
        "event_id",
        D.json_contains(props, F.concat(F.lit('{"k":'), F.get_json_object(props, "$.k"), F.lit("}"))).alias("has"),
        D.json_contains(props, F.lit('{"none":1}')).alias("lacks"),
        F.array_join(D.json_search(F.lit('{"a":{"b":"x"},"c":["y","x"]}'), "x"), ",").alias("at"),
        D.json_insert(D.json_insert(props, "$.z", "1"), "$.k", "5").alias("ins"),
        D.json_replace(D.json_replace(props, "$.k", "0"), "$.none", "5").alias("rep"),
        D.json_merge(props, F.lit('{"k":1}')).alias("both"),
        D.json_merge(props, F.lit('{"k":1}'), patch=True).alias("patch"),
        D.json_depth(props).alias("depth"),
        D.json_pretty(props).alias("pretty"),
    )


@query("identifier_names", "SELECT n_nationkey, true AS good, false AS bad, 'e' || chr(769) AS apart, 'é' AS composed FROM nation")
def identifier_names(spark, sf):
    uuid = D.bin_to_uuid(F.unhex(F.md5("n_name")))
    return table(spark, sf, "nation").select("n_nationkey", D.is_uuid(uuid).alias("good"), D.is_uuid(F.col("n_name")).alias("bad"), D.normalize(F.lit("é"), "NFD").alias("apart"), D.normalize(F.lit("e\u0301"), "NFC").alias("composed"))


@query("map_reduce", "SELECT event_type AS key, sum(n)::BIGINT AS value FROM (SELECT event_type, 1 AS n FROM events UNION ALL SELECT 'user ' || user_id % 3, 1 FROM events) GROUP BY 1")
def map_reduce(spark, sf):
    pair = lambda key: F.struct(key.alias("key"), F.lit(1).alias("value"))
    emit = F.array(pair(F.col("event_type")), pair(F.concat(F.lit("user "), (F.col("user_id") % 3).cast("string"))))
    return ops.map_reduce(table(spark, sf, "events"), emit, F.sum("value"))


# Search bodies


@query("es_phrase", "SELECT event_id FROM (SELECT *, event_type || '-' || (user_id % 3) || ' of it' AS said FROM events) WHERE said LIKE 'view-1 %' OR said LIKE 'click-2 of i%'")
def es_phrase(spark, sf):
    said = F.concat("event_type", F.lit("-"), (F.col("user_id") % 3).cast("string"), F.lit(" of it"))
    body = {"query": {"bool": {"should": [{"match_phrase": {"said": "View-1"}}, {"match_phrase_prefix": {"said": "click 2 of i"}}, {"match_phrase": {"said": "ick 0"}}]}}, "size": 10**9, "_source": ["event_id"]}
    return search.search(table(spark, sf, "events").withColumn("said", said), body)


@query("es_range_from_to", "SELECT event_id FROM events WHERE value >= 20 AND value < 60 AND user_id >= 5 AND user_id <= 900")
def es_range_from_to(spark, sf):
    body = {"query": {"bool": {"filter": [{"range": {"value": {"from": 20, "lt": 60}}}, {"range": {"user_id": {"from": 5, "to": 900}}}]}}, "size": 10**9, "_source": ["event_id"]}
    return search.search(table(spark, sf, "events"), body)


@query("es_nested", "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND l_returnflag = 'R'")
def es_nested(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))).alias("items"))
    rows = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inner = {"bool": {"must": [{"range": {"items.quantity": {"gt": 45}}}, {"term": {"items.flag": "R"}}]}}
    return search.search(rows, {"query": {"nested": {"path": "items", "query": inner}}, "size": 10**9, "_source": ["o_orderkey"]})


@query("es_has_child", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def es_has_child(spark, sf):
    body = {"query": {"bool": {"filter": [{"range": {"c_acctbal": {"gt": 0}}}, {"has_child": {"type": "order", "query": {"term": {"o_orderstatus": "F"}}}}]}}, "size": 10**9, "_source": ["c_custkey"]}
    return search.search(table(spark, sf, "customer"), body, {"order": (table(spark, sf, "orders"), "o_custkey", "c_custkey")})


@query("es_match_prefix", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type), '(^|\\W)(promo|bur)') OR regexp_matches(lower(p_name), '(^|\\W)zz')")
def es_match_prefix(spark, sf):
    should = [{"match_bool_prefix": {"p_type": "promo"}}, {"match_bool_prefix": {"p_type": {"query": "bur"}}}, {"match_bool_prefix": {"p_name": "zz"}}]
    return search.search(table(spark, sf, "part"), {"query": {"bool": {"should": should}}, "size": 10**9, "_source": ["p_partkey"]})


# Loads and exports


@query("load_with_terminators", "SELECT n_nationkey, n_name FROM nation")
def load_with_terminators(spark, sf):
    path, words = scratch.folder(spark, "load"), {"fields_terminated_by": "|", "enclosed_by": "'", "lines_terminated_by": ";", "null": "none"}
    files.copy_to(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "CSV", **words)
    return files.copy_from(spark, path, "n_nationkey INT, n_name STRING", "CSV", **words)


@query("bulk_insert", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier UNION ALL SELECT -1, 'NEW'")
def bulk_insert(spark, sf):
    path = scratch.folder(spark, "bulk")
    files.copy_to(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, "JSON")
    loaded = files.copy_from(spark, path, "s_suppkey BIGINT, s_name STRING", "JSON", mapping={"s_suppkey": "s_suppkey", "s_name": "upper(s_name)"})
    return loaded.union(spark.createDataFrame([(-1, "NEW")], "s_suppkey long, s_name string"))


@query("xml_roundtrip", "SELECT r_regionkey, r_name FROM region")
def xml_roundtrip(spark, sf):
    path = scratch.folder(spark, "xml")
    files.copy_to(table(spark, sf, "region"), path, "XML", rowTag="row")
    return files.copy_from(spark, path, "r_regionkey INT, r_name STRING", "XML", rowTag="row")


@query("select_into_outfile", "SELECT n_name || ':' || n_regionkey AS value FROM nation")
def select_into_outfile(spark, sf):
    path = scratch.folder(spark, "outfile")
    files.copy_to(table(spark, sf, "nation").select(F.concat_ws(":", "n_name", "n_regionkey").alias("value")), path, "TEXT")
    return files.copy_from(spark, path, "value STRING", "TEXT")


# Streams


@query("stream_routine_load", "SELECT event_id, value * 2 AS value FROM events WHERE event_type = 'purchase'")
def stream_routine_load(spark, sf):
    target, marks = scratch.folder(spark, "target"), scratch.folder(spark, "marks")
    load = streams.routine_load(_events(spark, sf), target, marks, "purchases", lambda df: df.where("event_type = 'purchase'").selectExpr("event_id", "value * 2 AS value"))
    load.awaitTermination()
    return spark.read.parquet(target)


@query("stream_refreshed_view", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_refreshed_view(spark, sf):
    path, marks = scratch.folder(spark, "view"), scratch.folder(spark, "marks")
    streams.refreshed(_events(spark, sf), lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), path, marks).awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("change_stream", "SELECT event_id, 'insert' AS change FROM events WHERE event_type IN ('signup', 'error')")
def change_stream(spark, sf):
    watched = _events(spark, sf).where(F.col("event_type").isin("signup", "error")).select("event_id", F.lit("insert").alias("change"))
    return streams.drained(watched)


# Services


@query("limited_query", "SELECT 3 AS n, count(*) AS whole FROM region")
def limited_query(spark, sf):
    tables(spark, sf, "region")
    text = "SELECT r_regionkey FROM region;"
    return spark.sql(statements.with_limit(text, 3)).agg(F.count("*").cast("int").alias("n")).join(spark.sql(text.rstrip(";")).agg(F.count("*").alias("whole")))


@query("syntax_diagnostics", "SELECT * FROM (VALUES (1, 0, 0), (2, 1, 1), (3, 2, 1)) AS t(n, errors, line)")
def syntax_diagnostics(spark, sf):
    found = [statements.check(spark, text) for text in ("SELECT 1", "SELEC 1")]
    second = statements.check(spark, "SELECT 1\nFORM x y z")
    rows = [(1, len(found[0]), 0), (2, len(found[1]), found[1][0].line), (3, 1 + len(second), 1)]
    return spark.createDataFrame(rows, "n int, errors int, line int")


@query("migration_steps", "SELECT * FROM (VALUES ('add', 1), ('drop', 1), ('type', 1)) AS t(kind, n)")
def migration_steps(spark, sf):
    old, new = T.StructType().add("a", T.IntegerType()).add("b", T.StringType()), T.StructType().add("a", T.LongType()).add("d", T.DoubleType())
    steps = [s.upper() for s in catalog.migration("t", old, new)]
    kind = lambda s: "add" if " ADD " in s else "drop" if " DROP " in s else "type"
    return spark.createDataFrame([(kind(s),) for s in steps], "kind string").groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("dependency_order", "SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) AS t(place, name)")
def dependency_order(spark, sf):
    return spark.createDataFrame(list(enumerate(catalog.ordered({"c": {"b"}, "b": {"a"}, "a": set()}))), "place int, name string")


@query("request_analysis", "SELECT * FROM (VALUES ('blocked', 'aggs'), ('predicate', 'x'), ('predicate', 'y'), ('sort', 'z')) AS t(part, name)")
def request_analysis(spark, sf):
    got = search.analysed({"query": {"bool": {"must": [{"term": {"x": 1}}], "filter": {"exists": {"field": "y"}}}}, "sort": [{"z": "desc"}], "aggs": {}})
    rows = [("blocked", x) for x in got["blocked"]] + [("predicate", x) for x in got["predicates"]] + [("sort", x) for x in got["sort"]]
    return spark.createDataFrame(rows, "part string, name string")


@query("explained", "SELECT true AS scans, true AS pushes, true AS prunes")
def explained(spark, sf):
    tables(spark, sf, "customer")
    plan = spark.sql("EXPLAIN FORMATTED SELECT c_name FROM customer WHERE c_nationkey = 3").first()[0]
    return spark.createDataFrame([("Scan parquet" in plan, "EqualTo(c_nationkey,3)" in plan, "c_acctbal" not in plan.split("ReadSchema")[1])], "scans boolean, pushes boolean, prunes boolean")


@query("session_settings", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def session_settings(spark, sf):
    tables(spark, sf, "nation")
    spark.sql("DECLARE OR REPLACE VARIABLE wanted_region INT DEFAULT 1")
    spark.sql("SET VARIABLE wanted_region = 2")
    return spark.sql("SELECT n_nationkey FROM nation WHERE n_regionkey = session.wanted_region")
