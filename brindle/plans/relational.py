"""Projection, predicates, sorting, set operations and common table expressions.

One text where Spark and the oracle agree; a pair where the construct has no Spark form and is re-expressed.
"""

from ..registry import sql_query

# Projection

sql_query("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
sql_query("star_except", "SELECT * EXCEPT (o_totalprice, o_orderdate) FROM orders", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
sql_query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("values_inline", "SELECT v.id, v.label, n.n_name FROM (VALUES (1, 'one'), (2, 'two'), (7, 'seven')) AS v(id, label) LEFT JOIN nation n ON n.n_nationkey = v.id")
sql_query("let_bindings", "SELECT c_custkey, half, half * 2 AS whole FROM (SELECT c_custkey, c_acctbal / 2 AS half FROM customer)")
sql_query("select_struct", "SELECT s.k AS k, s.p AS p FROM (SELECT named_struct('k', c_custkey, 'p', c_mktsegment) AS s FROM customer)", "SELECT c_custkey AS k, c_mktsegment AS p FROM customer")
sql_query("select_json", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS doc FROM nation", "SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey) AS VARCHAR) AS doc FROM nation")
sql_query("table_primary", "TABLE region")
sql_query("from_less", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(NULL AS INT) IS NULL AS none")
sql_query("pipe_query", "FROM orders |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority |> WHERE n > 0", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 0")
sql_query("from_first", "FROM nation SELECT n_regionkey, n_name WHERE n_regionkey = 2", "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey = 2")
sql_query("positional_refs", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2 DESC")
sql_query("set_returning_select", "SELECT n_nationkey, explode(sequence(1, 3)) AS k FROM nation", "SELECT n_nationkey, unnest(generate_series(1, 3)) AS k FROM nation")
sql_query("generate_series", "SELECT explode(sequence(CAST(5 AS BIGINT), 50, 5)) AS g", "SELECT unnest(generate_series(5, 50, 5)) AS g")
sql_query("row_generator", "SELECT id FROM range(0, 100, 7)", "SELECT range AS id FROM range(0, 100, 7)")

# Predicates

sql_query("between_in_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND p_name LIKE '%a%'")
sql_query("not_between_like", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 OR p_type NOT LIKE '%E%'")
sql_query("like_escape", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1' OR c_name LIKE '%!_%' ESCAPE '!'")
sql_query("ilike_any", "SELECT p_partkey FROM part WHERE p_type ILIKE ANY ('%steel%', '%BRASS%', 'promo%')", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%' OR p_type ILIKE '%BRASS%' OR p_type ILIKE 'promo%'")
sql_query("like_all", "SELECT p_partkey FROM part WHERE p_name LIKE ALL ('%a%', '%e%')", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%e%'")
sql_query("null_safe_eq", "SELECT c_custkey, nullif(c_nationkey, 3) <=> nullif(c_nationkey, 5) AS same FROM customer", "SELECT c_custkey, nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 5) AS same FROM customer")
sql_query("is_distinct", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 3) IS DISTINCT FROM 4")
sql_query("is_true_unknown", "SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'F') IS TRUE AS t, (nullif(o_orderstatus, 'P') = 'F') IS NOT FALSE AS nf, (nullif(o_orderstatus, 'P') = 'F') IS NULL AS u FROM orders")
sql_query("boolean_xor", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 100000)", "SELECT o_orderkey FROM orders WHERE xor((o_orderstatus = 'F')::INT, (o_totalprice > 100000)::INT) = 1")
sql_query("between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN least(30, 10) AND greatest(30, 10)", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30")
sql_query("row_in", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_nationkey < 5)")
sql_query("in_unnest", "SELECT n_name FROM nation WHERE array_contains(array(1, 3, 5), n_regionkey)", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT unnest([1, 3, 5]))")
sql_query("any_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT coalesce(max(s_acctbal), -1e300) FROM supplier WHERE s_nationkey < 10) * 0.9", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal * 0.9 FROM supplier WHERE s_nationkey < 10)")
sql_query("any_all_array", "SELECT n_nationkey, exists(array(2, 5, 9), x -> n_nationkey > x) AS some, forall(array(2, 5, 9), x -> n_nationkey > x) AS every FROM nation", "SELECT n_nationkey, n_nationkey > 2 AS some, n_nationkey > 9 AS every FROM nation")
sql_query("exists_rows", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql_query("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql_query("not_in_null", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
sql_query("not_in_clean", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey IS NOT NULL)")
sql_query("scalar_subquery", "SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n")
sql_query("similar_to", "SELECT p_partkey FROM part WHERE p_brand RLIKE '^(?:Brand#(1|2)[1-3])$'", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[1-3]'")
sql_query("regexp_rows", "SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*[aeiou]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*[aeiou]$')")
sql_query("period_overlaps", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_orderdate < b.o_orderdate + INTERVAL 30 DAYS AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAYS")
sql_query("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
sql_query("qualify_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
sql_query("bit_operators", "SELECT n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey ^ 5 AS x, shiftleft(n_nationkey, 2) AS l, n_nationkey >> 1 AS r FROM nation", "SELECT n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x, (n_nationkey::BIGINT << 2)::INT AS l, n_nationkey >> 1 AS r FROM nation")
sql_query("contains_tokens", "SELECT doc_id FROM documents WHERE array_contains(split(lower(text), '[ \\\\n.,]+'), 'the') AND array_contains(split(lower(text), '[ \\\\n.,]+'), 'and')", "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[ \\n.,]+'), 'the') AND list_contains(regexp_split_to_array(lower(text), '[ \\n.,]+'), 'and')")

# Sort and limit

sql_query("order_nulls", "SELECT rn, k FROM (SELECT nullif(n_regionkey, 2) AS k, row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS rn FROM nation)")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 15")
sql_query("with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10", "SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10))")
sql_query("top_percent", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 0.03)")
sql_query("topk_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
sql_query("order_siblings", "SELECT path FROM (SELECT concat_ws('/', r_name, n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey) ORDER BY path")
sql_query("order_collate", "SELECT n_name, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS rn FROM nation")

# Set operations and common table expressions

sql_query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql_query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
sql_query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("minus_rows", "SELECT n_nationkey AS k FROM nation MINUS SELECT c_nationkey FROM customer", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer")
sql_query("set_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 10 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 7")
sql_query("cte_multi", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_custkey, per.n FROM customer c JOIN per ON per.o_custkey = c.c_custkey")
sql_query("recursive_series", "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 40) SELECT n, s FROM t")
sql_query("recursive_tree", "WITH RECURSIVE t(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT s.s_suppkey, t.depth + 1 FROM supplier s JOIN t ON s.s_suppkey DIV 2 = t.id AND s.s_suppkey > 1) SELECT id, depth FROM t", "WITH RECURSIVE t(id, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT s.s_suppkey, t.depth + 1 FROM supplier s JOIN t ON s.s_suppkey // 2 = t.id AND s.s_suppkey > 1) SELECT id, depth FROM t")
sql_query("recursion_depth", "WITH RECURSIVE t(n, d) AS (SELECT 1, 0 UNION ALL SELECT n * 2, d + 1 FROM t WHERE d < 6) SELECT n, d FROM t WHERE d BETWEEN 2 AND 5")
