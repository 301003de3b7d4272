"""Services as queries, user-defined functions and procedural statements."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..services import catalog, statements
from ..session import table, tables

_SCRIPT = "SELECT 'a;b' AS x; -- one; two\nINSERT INTO t VALUES (1); CREATE TABLE u (k INT);\nWITH c AS (SELECT 1) SELECT * FROM c; SHOW TABLES"


@query("split_classify", "SELECT * FROM (VALUES (1, 'DQL', 1), (2, 'DML', 2), (3, 'DDL', 2), (4, 'DQL', 3), (5, 'INFO', 3)) AS t(n, kind, line)")
def split_classify(spark, sf):
    parts = statements.split(_SCRIPT)
    return spark.createDataFrame([(k, statements.classify(s.text), s.line) for k, s in enumerate(parts, 1)], "n int, kind string, line int")


@query("lineage_rows", "SELECT * FROM (VALUES ('n_name', 'nation.n_name'), ('total', 'customer.c_acctbal'), ('total', 'customer.c_custkey')) AS t(output, source)")
def lineage_rows(spark, sf):
    tables(spark, sf, "nation customer")
    return catalog.lineage(spark.sql("SELECT n_name, sum(c_acctbal + c_custkey) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"))


@query("schema_changes", "SELECT * FROM (VALUES ('add', 'd', NULL, 'double'), ('drop', 'b', 'string', NULL), ('type', 'a', 'int', 'bigint')) AS t(change, \"column\", before, after)")
def schema_changes(spark, sf):
    return catalog.schema_diff(spark, T.StructType().add("a", T.IntegerType()).add("b", T.StringType()), T.StructType().add("a", T.LongType()).add("d", T.DoubleType()))


@query("duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return catalog.duplicate_keys(table(spark, sf, "orders"), ["o_custkey"])


@query("orphan_rows", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def orphan_rows(spark, sf):
    parents = table(spark, sf, "customer").where("c_custkey % 2 = 0")
    return catalog.orphans(table(spark, sf, "events"), parents, "user_id", "c_custkey").select("event_id", "user_id")


@query("check_failures", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0)")
def check_failures(spark, sf):
    return catalog.check_failures(table(spark, sf, "customer"), F.col("c_acctbal") >= 0).select("c_custkey")


@query("masked_rows", "SELECT c_custkey, '***' || right(c_name, 2) AS c_name, c_nationkey FROM customer WHERE c_nationkey < 10")
def masked_rows(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return catalog.masked(rows, F.col("c_nationkey") < 10, {"c_name": F.concat(F.lit("***"), F.right("c_name", F.lit(2)))})


@query("sql_udf", "SELECT n_nationkey, n_nationkey * n_nationkey + 1 AS v FROM nation")
def sql_udf(spark, sf):
    tables(spark, sf, "nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION square_plus(x INT, y INT) RETURNS INT RETURN x * x + y")
    return spark.sql("SELECT n_nationkey, square_plus(n_nationkey, 1) AS v FROM nation")


@query("sql_table_udf", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def sql_table_udf(spark, sf):
    tables(spark, sf, "nation")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION series(n INT) RETURNS TABLE (k INT) RETURN SELECT explode(sequence(0, n)) AS k")
    return spark.sql("SELECT n_nationkey, n_name FROM nation, series(5) s WHERE s.k = 2 AND n_regionkey = s.k")


@query("pandas_udf", "SELECT c_custkey, round(c_acctbal * 1.1, 4) AS v FROM customer")
def pandas_udf(spark, sf):
    @F.pandas_udf("double")
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.1

    return table(spark, sf, "customer").select("c_custkey", F.round(raised("c_acctbal"), 4).alias("v"))


@query("custom_aggregate", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY 1")
def custom_aggregate(spark, sf):
    """A geometric mean from partial sums: state, combine and final step as built-in aggregates."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.exp(F.sum(F.ln("l_quantity")) / F.count("l_quantity")), 6).alias("g"))


@query("execute_immediate", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def execute_immediate(spark, sf):
    tables(spark, sf, "customer")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT c_custkey FROM customer WHERE c_nationkey = :k' USING (7 AS k)")


@query("scripted_loop", "SELECT 55 AS total")
def scripted_loop(spark, sf):
    """A procedural block: a loop over a variable, run by Spark's SQL scripting."""
    return spark.sql("BEGIN DECLARE total INT DEFAULT 0; DECLARE k INT DEFAULT 1; WHILE k <= 10 DO SET total = total + k; SET k = k + 1; END WHILE; SELECT total; END")


@query("view_expansion", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def view_expansion(spark, sf):
    tables(spark, sf, "customer")
    spark.sql("CREATE OR REPLACE TEMP VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 0")
    return spark.sql("SELECT c_nationkey, count(*) AS n FROM rich GROUP BY c_nationkey")


@query("table_statistics", "SELECT count(*) AS n, count(c_acctbal) AS known, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_nationkey) AS nations FROM customer")
def table_statistics(spark, sf):
    return table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("known"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count_distinct("c_nationkey").alias("nations"))


@query("described_columns", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS t(col_name, data_type)")
def described_columns(spark, sf):
    tables(spark, sf, "region")
    return spark.sql("DESCRIBE region").select("col_name", "data_type")
