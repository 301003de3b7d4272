"""The scalar function catalogue, a query for each family; names that Spark lacks come from ``brindle.functions``."""

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..registry import query, sql_query
from ..session import table

sql_query("str_case_trim", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim(concat('  ', c_name, ' ')) AS t, ltrim(concat('  ', c_name)) AS lt, rtrim(concat(c_name, '  ')) AS rt, length(c_name) AS n, reverse(c_name) AS r FROM customer")
sql_query("str_parts", "SELECT c_custkey, substring(c_name, 3, 5) AS s, left(c_name, 4) AS l, right(c_name, 4) AS r, split_part(c_name, '#', 2) AS p, locate('#', c_name) AS i, replace(c_name, '0', 'o') AS x, repeat('ab', 3) AS rep, lpad(CAST(c_custkey AS STRING), 8, '*') AS lp, rpad(CAST(c_custkey AS STRING), 8, '-') AS rp FROM customer", "SELECT c_custkey, substring(c_name, 3, 5) AS s, left(c_name, 4) AS l, right(c_name, 4) AS r, split_part(c_name, '#', 2) AS p, instr(c_name, '#')::INT AS i, replace(c_name, '0', 'o') AS x, repeat('ab', 3) AS rep, lpad(c_custkey::VARCHAR, 8, '*') AS lp, rpad(c_custkey::VARCHAR, 8, '-') AS rp FROM customer")
sql_query("str_concat", "SELECT n_nationkey, concat_ws('-', n_name, CAST(n_regionkey AS STRING)) AS c, n_name || '!' AS b, startswith(n_name, 'NATION_1') AS s, endswith(n_name, '2') AS e, contains(n_name, '_2') AS k, translate(n_name, 'AEIOU', 'aeiou') AS t, ascii(n_name) AS a, chr(65 + n_regionkey) AS ch FROM nation", "SELECT n_nationkey, concat_ws('-', n_name, n_regionkey::VARCHAR) AS c, n_name || '!' AS b, starts_with(n_name, 'NATION_1') AS s, ends_with(n_name, '2') AS e, contains(n_name, '_2') AS k, translate(n_name, 'AEIOU', 'aeiou') AS t, ascii(n_name) AS a, chr(65 + n_regionkey) AS ch FROM nation")
sql_query("str_distance", "SELECT p_partkey, levenshtein(p_brand, p_type) AS d, hex(p_brand) AS h, CAST(unhex(hex(p_brand)) AS STRING) AS u, base64(CAST(p_brand AS BINARY)) AS b FROM part", "SELECT p_partkey, levenshtein(p_brand, p_type) AS d, hex(p_brand) AS h, p_brand AS u, base64(p_brand::BLOB) AS b FROM part")
sql_query("regexp_functions", "SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS d, regexp_replace(p_type, '[AEIOU]', '_') AS r, regexp_count(p_name, '[aeiou]') AS n, array_join(regexp_extract_all(p_brand, '([0-9])', 1), '.') AS all FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([0-9])([0-9])', 2) AS d, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS r, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n, array_to_string(regexp_extract_all(p_brand, '([0-9])', 1), '.') AS \"all\" FROM part")
sql_query("math_basic", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal, 1) AS r, sign(c_acctbal) AS s, c_custkey % 7 AS m, mod(c_custkey, 5) AS m5, c_custkey DIV 3 AS d, power(c_custkey % 10, 3) AS p FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, round(c_acctbal, 1) AS r, sign(c_acctbal)::DOUBLE AS s, c_custkey % 7 AS m, c_custkey % 5 AS m5, c_custkey // 3 AS d, power(c_custkey % 10, 3) AS p FROM customer")
sql_query("math_logs_trig", "SELECT p_partkey, round(sqrt(p_size), 6) AS q, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size + 1), 6) AS l, round(log2(p_size + 1), 6) AS l2, round(log10(p_size + 1), 6) AS l10, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t, round(atan(p_size), 6) AS at, round(radians(p_size), 6) AS rd, round(degrees(p_size), 4) AS dg, round(asin(1.0 / (p_size + 1)), 6) AS asn, round(acos(1.0 / (p_size + 1)), 6) AS acs, round(cot(p_size + 1), 6) AS ct, round(pi(), 8) AS pi, round(cbrt(p_size), 6) AS cb FROM part")
sql_query("math_bases", "SELECT n_nationkey, conv(CAST(n_nationkey AS STRING), 10, 8) AS o, bin(n_nationkey) AS b, hex(n_nationkey) AS h, factorial(n_nationkey % 12) AS f, width_bucket(n_nationkey, 0, 25, 5) AS w, greatest(n_nationkey, n_regionkey, 3) AS g, least(n_nationkey, n_regionkey, 3) AS l FROM nation", "SELECT n_nationkey, printf('%o', n_nationkey) AS o, bin(n_nationkey) AS b, hex(n_nationkey) AS h, factorial(n_nationkey % 12)::BIGINT AS f, (n_nationkey // 5 + 1)::BIGINT AS w, greatest(n_nationkey, n_regionkey, 3) AS g, least(n_nationkey, n_regionkey, 3) AS l FROM nation")
sql_query("dt_parts", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, weekday(o_orderdate) AS wd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, dayofweek(o_orderdate) AS dw FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, isodow(o_orderdate) - 1 AS wd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, dayofweek(o_orderdate) + 1 AS dw FROM orders")
sql_query("dt_arithmetic", "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 10) AS a, date_sub(CAST(o_orderdate AS DATE), 10) AS s, add_months(CAST(o_orderdate AS DATE), 2) AS m, last_day(CAST(o_orderdate AS DATE)) AS l, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS d, o_orderdate + INTERVAL 3 HOURS AS h, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS t FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(o_orderdate AS DATE) - 10 AS s, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS l, DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS d, o_orderdate + INTERVAL 3 HOURS AS h, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t FROM orders")
sql_query("dt_format_parse", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS f, CAST(to_date('2020-03-0' || CAST(o_orderkey % 9 + 1 AS STRING), 'yyyy-MM-dd') AS DATE) AS p, make_date(2020, CAST(o_orderkey % 12 + 1 AS INT), 15) AS k, date_format(o_orderdate, 'EEEE') AS dn FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, strptime('2020-03-0' || (o_orderkey % 9 + 1)::VARCHAR, '%Y-%m-%d')::DATE AS p, make_date(2020, (o_orderkey % 12 + 1)::INT, 15) AS k, dayname(o_orderdate) AS dn FROM orders")
sql_query("dt_epoch", "SELECT event_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS e, timestampdiff(DAY, TIMESTAMP_NTZ '2020-01-01 00:00:00', ts) AS d, extract(HOUR FROM ts) AS h, to_days AS td FROM (SELECT *, datediff(CAST(ts AS DATE), DATE '1970-01-01') + 719528 AS to_days FROM events)", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS e, date_sub('day', TIMESTAMP '2020-01-01 00:00:00', ts) AS d, hour(ts) AS h, (ts::DATE - DATE '1970-01-01') + 719528 AS td FROM events")
sql_query("cond_functions", "SELECT c_custkey, if(c_acctbal > 0, 'pos', 'neg') AS i, nvl(nullif(c_mktsegment, 'BUILDING'), 'none') AS n, ifnull(nullif(c_nationkey, 3), -1) AS f, coalesce(nullif(c_nationkey, 3), nullif(c_custkey, 1), 0) AS c, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS k, CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 5000 THEN 'b' END AS s FROM customer", "SELECT c_custkey, if(c_acctbal > 0, 'pos', 'neg') AS i, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS n, ifnull(nullif(c_nationkey, 3), -1) AS f, coalesce(nullif(c_nationkey, 3), nullif(c_custkey, 1), 0) AS c, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS k, CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 5000 THEN 'b' END AS s FROM customer")
sql_query("cast_functions", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS i, CAST(o_orderkey AS STRING) AS s, try_cast(o_orderpriority AS INT) AS t, try_cast(o_orderpriority AS INT) IS NOT NULL AS can, o_orderkey :: double AS d FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, o_orderkey::VARCHAR AS s, try_cast(o_orderpriority AS INT) AS t, try_cast(o_orderpriority AS INT) IS NOT NULL AS can, o_orderkey::DOUBLE AS d FROM orders")
sql_query("hash_functions", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s2  FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2 FROM nation")
sql_query("arr_functions", "SELECT n_nationkey, size(a) AS n, a[0] AS first, element_at(a, -1) AS last, array_join(slice(a, 2, 2), ',') AS s, array_contains(a, 3) AS c, array_position(a, 3) AS p, array_join(array_sort(a), ',') AS so, array_join(array_distinct(a), ',') AS d, array_max(a) AS hi, array_join(filter(a, x -> x > 2), ',') AS f, array_join(transform(a, x -> x * 2), ',') AS t, aggregate(a, 0, (s, x) -> s + x) AS r, array_join(concat(a, array(99)), ',') AS cc FROM (SELECT n_nationkey, array(n_regionkey, 3, n_nationkey % 4, 1) AS a FROM nation)", "SELECT n_nationkey, len(a)::INT AS n, a[1] AS first, a[-1] AS last, array_to_string(a[2:3], ',') AS s, list_contains(a, 3) AS c, list_position(a, 3)::BIGINT AS p, array_to_string(list_sort(a), ',') AS so, (SELECT string_agg(x::VARCHAR, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS i) GROUP BY x)) AS d, list_max(a) AS hi, array_to_string(list_filter(a, lambda x: x > 2), ',') AS f, array_to_string(list_transform(a, lambda x: x * 2), ',') AS t, list_sum(a)::INT AS r, array_to_string(list_concat(a, [99]), ',') AS cc FROM (SELECT n_nationkey, [n_regionkey, 3, n_nationkey % 4, 1] AS a FROM nation)")
sql_query("map_functions", "SELECT n_nationkey, m['k'] AS k, size(m) AS n, array_join(array_sort(map_keys(m)), ',') AS ks, map_contains_key(m, 'z') AS z FROM (SELECT n_nationkey, map('k', n_nationkey, 'r', n_regionkey) AS m FROM nation)", "SELECT n_nationkey, n_nationkey AS k, 2 AS n, 'k,r' AS ks, false AS z FROM nation")
sql_query("json_functions", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS k2, variant_get(parse_json(props), '$.k', 'bigint') AS k3, json_object_keys(props)[0] AS key, props IS NOT NULL AND try_parse_json(props) IS NOT NULL AS ok, get_json_object(props, '$.none') IS NULL AS missing, schema_of_variant(parse_json(props)) = 'OBJECT<k: BIGINT>' AS typed FROM events", "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT AS k2, (props->>'$.k')::BIGINT AS k3, json_keys(props)[1] AS key, json_valid(props) AS ok, (props->>'$.none') IS NULL AS missing, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS typed FROM events")
sql_query("json_table_rows", "SELECT n_nationkey, pos + 1 AS ord, item.a AS a, item.b AS b FROM (SELECT n_nationkey, from_json(concat('[{\"a\":', n_nationkey, ',\"b\":\"x\"},{\"a\":', n_regionkey, '}]'), 'array<struct<a: int, b: string>>') AS doc FROM nation) LATERAL VIEW OUTER posexplode(doc) t AS pos, item", "SELECT n_nationkey, 1 AS ord, n_nationkey AS a, 'x' AS b FROM nation UNION ALL SELECT n_nationkey, 2, n_regionkey, NULL FROM nation")
sql_query("xml_functions", "SELECT n_nationkey, xpath_string(x, 'a/b') AS b, xpath_int(x, 'a/c') AS c, xpath_boolean(x, 'a/b') AS e FROM (SELECT n_nationkey, concat('<a><b>', n_name, '</b><c>', n_regionkey, '</c></a>') AS x FROM nation)", "SELECT n_nationkey, n_name AS b, n_regionkey AS c, true AS e FROM nation")
sql_query("open_json_rows", "SELECT event_id, k FROM (SELECT event_id, inline(array(from_json(props, 'k INT'))) FROM events)", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
sql_query("tz_convert", "SELECT o_orderkey, convert_timezone('UTC', 'Asia/Tokyo', o_orderdate) AS t FROM orders", "SELECT o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS t FROM orders")
sql_query("bind_params", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal > 100.0")


@query("str_dialect", "SELECT c_custkey, 'Cust' || substring(c_name, 9) AS ins, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS field, CASE c_nationkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS elt, trim(CASE WHEN c_nationkey & 1 > 0 THEN 'x' ELSE '' END || CASE WHEN c_nationkey & 3 = 3 THEN ',' ELSE '' END || CASE WHEN c_nationkey & 2 > 0 THEN 'y' ELSE '' END) AS made, '''' || c_name || '''' AS q, printf('%o', c_nationkey) AS oct, instr(c_name, '#')::INT AS ci FROM customer")
def str_dialect(spark, sf):
    c = F.col
    return table(spark, sf, "customer").select("c_custkey", D.insert(c("c_name"), 1, 8, F.lit("Cust")).alias("ins"), D.field(c("c_mktsegment"), "BUILDING", "MACHINERY").alias("field"), F.expr("CASE c_nationkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END").alias("elt"), D.make_set(c("c_nationkey"), "x", "y").alias("made"), D.quote(c("c_name")).alias("q"), D.octal(c("c_nationkey")).alias("oct"), D.charindex("#", c("c_name")).alias("ci"))


@query("math_dialect", "SELECT c_custkey, trunc(c_acctbal * 10) / 10 AS t, gcd(c_custkey, 12) AS g, lcm(c_custkey, 12) AS l, ((c_nationkey % 2 = 1) <> (c_acctbal > 0)) AS x FROM customer")
def math_dialect(spark, sf):
    c = F.col
    return table(spark, sf, "customer").select("c_custkey", D.truncate(c("c_acctbal"), 1).alias("t"), D.gcd(c("c_custkey"), F.lit(12)).alias("g"), D.lcm(c("c_custkey"), F.lit(12)).alias("l"), D.xor(c("c_nationkey") % 2 == 1, c("c_acctbal") > 0).alias("x"))


@query("dt_dialect", "SELECT o_orderkey, year(o_orderdate) * 100 + week(o_orderdate) AS yw, make_date(2020, 1, 1) + (o_orderkey % 300)::INT AS md, 719528 + (o_orderdate::DATE - DATE '1970-01-01') AS td, o_orderdate::DATE AS fd, strftime(o_orderdate, '%d/%m/%Y') AS df, (o_orderkey % 1000 // 60)::VARCHAR || 'm' AS mins, 202003 AS pa FROM orders")
def dt_dialect(spark, sf):
    day = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", D.yearweek(F.col("o_orderdate")).alias("yw"), D.makedate(F.lit(2020), (key % 300 + 1).cast("int")).alias("md"), D.to_days(day).alias("td"), D.from_days(D.to_days(day)).alias("fd"), D.mysql_date_format(F.col("o_orderdate"), "%d/%m/%Y").alias("df"), F.concat(F.expr("o_orderkey % 1000 DIV 60").cast("string"), F.lit("m")).alias("mins"), D.period_add(F.lit(202001), F.lit(2)).alias("pa"))


@query("net_dialect", "SELECT n_nationkey, '10.0.' || n_regionkey || '.' || n_nationkey AS ip, 167772160 + n_regionkey * 256 + n_nationkey AS num, true AS v4, false AS v6 FROM nation")
def net_dialect(spark, sf):
    ip = F.concat(F.lit("10.0."), F.col("n_regionkey"), F.lit("."), F.col("n_nationkey"))
    return table(spark, sf, "nation").select("n_nationkey", D.inet_ntoa(D.inet_aton(ip)).alias("ip"), D.inet_aton(ip).cast("int").alias("num"), D.is_ipv4(ip).alias("v4"), D.is_ipv6(ip).alias("v6"))


@query("json_edit", "SELECT event_id, '{\"k\":1,\"n\":{\"a\":2}}' AS s, '{}' AS r, 1 AS len, '{\"k\":null}' AS p FROM events")
def json_edit(spark, sf):
    return _json_edited(table(spark, sf, "events"))


def _json_edited(events):
    props = F.col("props")
    return events.select("event_id", D.json_set(D.json_set(props, "$.k", F.lit("1")), "$.n.a", F.lit("2")).alias("s"), D.json_remove(props, "$.k").alias("r"), F.size(F.json_object_keys(props)).alias("len"), D.json_set(props, "$.k", F.lit("null")).alias("p"))


@query("uuid_binary", "SELECT n_nationkey, lower(hex(unhex(md5(n_name)))) AS h FROM nation")
def uuid_binary(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_replace(D.bin_to_uuid(F.unhex(F.md5("n_name"))), "-", "").alias("h"))


@query("haversine_km", "SELECT n_nationkey, round(2 * 6371 * asin(sqrt(power(sin(radians(n_nationkey) / 2), 2) + cos(radians(0)) * cos(radians(n_nationkey)) * power(sin(radians(n_regionkey * 10) / 2), 2))), 3) AS km FROM nation")
def haversine_km(spark, sf):
    lat, lon = F.col("n_nationkey"), F.col("n_regionkey") * 10
    return table(spark, sf, "nation").select("n_nationkey", F.round(D.haversine(F.lit(0), F.lit(0), lat, lon), 3).alias("km"))


@query("nondeterministic_now")
def nondeterministic_now(spark, sf):
    return spark.range(1).select(F.current_date().alias("d"), F.current_timestamp().alias("t"), F.expr("uuid()").alias("u"), F.rand(1).alias("r"), F.current_user().alias("who"), F.current_database().alias("db"))
