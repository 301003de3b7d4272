"""Edge cases of operators: nulls, ties, empty inputs, errors."""

import re

import pytest
from pyspark.sql import functions as F

from brindle.documents import mongo, search
from brindle.functions import dialect as D
from brindle.operators import joins, match, tables
from brindle.services import catalog, statements


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_nulls_ties_and_no_match(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 5, 11), ("a", 9, 12), (None, 1, 13), ("b", None, 14)], "k string, t int, v int")
    assert rows(joins.asof(left, right, ["k"], "t", "t", ["v"]).select("id", "v")) == [(1, 11), (2, None), (3, None), (4, None)]
    assert rows(joins.asof(left, right, ["k"], "t", "t", ["v"], "inner").select("id")) == [(1,)]


def test_range_join_bounds(spark):
    points = spark.createDataFrame([(0.0,), (10.0,), (None,)], "x double")
    spans = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (-5.0, 25.0)], "lo double, hi double")
    assert rows(joins.range_join(points, spans, "x", "lo", "hi", 7.0)) == [(0.0, -5.0, 25.0), (0.0, 0.0, 10.0), (10.0, -5.0, 25.0)]


def test_pairs_of_one_large_group(spark):
    """The pairs of one group come from many tasks; equal and null keys and null groups give none."""
    keys = [("a", k) for k in range(60)] + [("a", 7), ("a", None), (None, 3), (None, 4), ("b", 1), ("c", 2), ("c", -9)]
    made = joins.pairs(spark.createDataFrame(keys, "g string, k int").coalesce(1), ["g"], "k", 8)
    want = [(x, y) for g, x in keys for h, y in keys if g and g == h and None not in (x, y) and x < y]
    assert rows(made) == sorted(want, key=repr)
    assert made.select(F.spark_partition_id()).distinct().count() > 8
    assert rows(joins.pairs(spark.createDataFrame([], "g string, k int"), ["g"], "k")) == []


def test_self_join_is_spread(spark):
    """Groups far from each other in size, from a table of one file."""
    from brindle import registry

    made = registry.queries()["self_join"](spark, "/root/testdata/sf0.001")
    assert made.select(F.spark_partition_id()).distinct().count() > 4


def test_greater_than_all_with_nulls(spark):
    left = spark.createDataFrame([(5,), (1,)], "x int")
    assert rows(joins.greater_than_all(left, spark.createDataFrame([(3,), (None,)], "y int"), "x", "y")) == []
    assert len(rows(joins.greater_than_all(left, spark.createDataFrame([], "y int"), "x", "y"))) == 2


def test_densified_keeps_all_facts(spark):
    facts = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 2, 12)], "k string, q int, v int")
    made = joins.densified(facts, ["k"], spark.createDataFrame([(1,), (2,)], "q int"), ["q"]).select("k", "q", "v")
    assert rows(made) == [("a", 1, 10), ("a", 1, 11), ("a", 2, None), ("b", 1, None), ("b", 2, 12)]


def test_merge_refuses_two_sources(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        tables.Merge(target, source, ["k"]).when_matched(update={"v": F.col("s.v")}).result().collect()


def test_merge_first_clause_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z"), (None, "n")], "k int, v string")
    made = tables.Merge(target, source, ["k"]).when_matched(F.col("t.k") == 1).when_matched(update={"v": F.col("s.v")}).when_not_matched({"k": F.col("s.k"), "v": F.col("s.v")}).result()
    assert rows(made) == rows(spark.createDataFrame([(2, "y"), (3, None), (9, "z"), (None, "n")], "k int, v string"))


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "p int, c int")
    assert rows(tables.closure(edges, "p", "c", spark.createDataFrame([(1,)], "node int"))) == [(1, 0), (2, 1), (3, 2)]


def test_shortest_paths_of_any_length(spark):
    edges = [(k, k + 1) for k in range(11)] + [(11, 0), (3, 7), (20, 21), (21, 21), (None, 1)]
    want = {}
    for a in {s for s, _ in edges if s is not None}:
        front, d = {a}, 0
        while front:
            d += 1
            front = {t for s, t in edges if s in front and (a, t) not in want}
            want |= {(a, t): d for t in front}
    assert max(want.values()) > 9
    made = tables.shortest(spark.createDataFrame(edges, "s int, t int"), "s", "t")
    assert rows(made.select("a", "b", "d")) == sorted(((a, b, d) for (a, b), d in want.items()), key=repr)


@pytest.mark.parametrize("held", [0, 1 << 22])
def test_shortest_paths_store_no_pairs(spark, monkeypatch, held):
    """Of 22500 pairs none is stored where workers hold the edges, and each once at most where they do not; batches cut a source's pairs."""
    from brindle.sources import scratch

    stored, real = [], scratch.checkpointed
    monkeypatch.setattr(scratch, "checkpointed", lambda df: (made := real(df), stored.append(made.count()))[0])
    monkeypatch.setattr(tables, "HELD_EDGES", held, raising=False)
    monkeypatch.setattr(tables, "BATCH", 64, raising=False)
    edges = [(f"n{s}", f"n{t % 150}") for s in range(150) for t in (s * 5 + 1, s + 3)] + [("n7", None), (None, "n7")]
    made = tables.shortest(spark.createDataFrame(edges, "s string, t string"), "s", "t")
    got = rows(made.select("a", "b", "d"))
    assert len({(a, b) for a, b, _ in got}) == len(got) == made.count() and rows(made.where("a = b")) == [r for r in got if r[0] == r[1]]
    near = {(a, b): d for a, b, d in got}
    assert all(near[e] == 1 for e in edges if None not in e) and sum(stored) <= (300 if held else 300 + len(got))
    assert all(d == 1 or any(near.get((a, s)) == d - 1 for s, t in edges if t == b) for (a, b), d in near.items())
    assert all(near[a, t] <= d + 1 for (a, b), d in near.items() for s, t in edges if s == b and t)
    assert rows(tables.shortest(spark.createDataFrame([], "s long, t long"), "s", "t")) == []


def test_closure_of_a_long_chain(spark, monkeypatch):
    from brindle.sources import scratch

    monkeypatch.setattr(scratch, "checkpointed", lambda df: spark.createDataFrame(df.coalesce(1).collect(), df.schema).coalesce(1))
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "p int, c int")
    start = spark.createDataFrame([(0,)], "node int")
    assert rows(tables.closure(edges, "p", "c", start)) == sorted(((k, k) for k in range(67)), key=repr)
    assert rows(tables.closure(edges, "p", "c", start, 2)) == [(0, 0), (1, 1), (2, 2)]


def test_fetch_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    assert rows(tables.fetch_with_ties(df, 1, ["x"])) == [(1,), (1,)]


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [("A+ B", "aab", [(1, "aab")]), ("A+? B?", "aab", [(1, "a"), (2, "ab")]), ("(A | B){2}", "abba", [(1, "ab"), (2, "ba")]), ("^ A", "aa", [(1, "a")]), ("B* A", "bba", [(1, "bba")]), ("(A B)+ $", "ababa", []), ("(A B)+", "ababa", [(1, "abab")])],
)
def test_patterns(spark, pattern, text, found):
    df = spark.createDataFrame([("p", k, c) for k, c in enumerate(text)], "g string, n int, c string")
    made = match.match_recognize(df, ["g"], [F.col("n")], pattern, {"A": F.col("c") == "a", "B": F.col("c") == "b"})
    out = {}
    for r in sorted(made.collect(), key=lambda r: (r.match_number, r.match_row)):
        out[r.match_number] = out.get(r.match_number, "") + r.c
    assert sorted(out.items()) == found


def test_dialect_functions(spark):
    one = spark.range(1).select(D.truncate(F.lit(-1.29), 1).alias("t"), D.gcd(F.lit(-12), F.lit(18)).alias("g"), D.inet_aton(F.lit("1.2.3.300")).alias("i"), D.is_ipv6(F.lit("::1")).alias("v"), D.quote(F.lit("it's")).alias("q"), D.period_diff(F.lit(202003), F.lit(201912)).alias("p"), D.sec_to_time(F.lit(3671)).alias("s"), D.similar_to(F.lit("a.c"), "a.(b|c)").alias("m"), D.json_merge(F.lit('{"a":1,"b":2}'), F.lit('{"b":null}'), True).alias("j"), D.json_depth(F.lit("[1,[2]]")).alias("d")).first()
    assert tuple(one) == (-1.2, 6, None, True, "'it\\'s'", 3, "01:01:11", True, '{"a":1}', 3)


def test_mongo_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert rows(mongo.find(df, {"v": {"$ne": "x"}}, {"k": 1})) == [(1,), (3,)]
    assert rows(mongo.find(df, {"v": {"$exists": False}}, {"k": 1})) == [(1,)]
    assert rows(mongo.find(df, {"v": {"$nin": ["x", None]}}, {"k": 1})) == [(3,)]
    assert mongo.keeps_shape([{"$match": {}}, {"$limit": 1}]) and not mongo.keeps_shape([{"$group": {"_id": None}}])
    with pytest.raises(ValueError):
        mongo.predicate({"$where": "1"})


def test_search_analysis():
    found = search.analysed({"query": {"bool": {"must": {"term": {"a": 1}}, "filter": [{"exists": {"field": "b"}}]}}, "aggs": {}, "sort": ["c"]})
    assert found == {"blocked": ["aggs"], "source": [], "sort": ["c"], "predicates": ["a", "b"]}


def test_statements():
    assert [s.text for s in statements.split("SELECT $$a;b$$; SELECT 2;;")] == ["SELECT $$a;b$$", "SELECT 2"]
    assert [s.text for s in statements.split("SELECT 1\nGO\nSELECT 2\nGO 5", "mssql")] == ["SELECT 1", "SELECT 2"]
    assert [s.text for s in statements.split("DELIMITER //\nSELECT 1; SELECT 2//\nDELIMITER ;\nSELECT 3;", "mysql")] == ["SELECT 1; SELECT 2", "SELECT 3"]
    assert statements.classify("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a") == "DML"
    assert statements.classify("SELECT a INTO b FROM c") == "DDL"
    assert statements.classify("select 'x into y from' from t") == "DQL"


def test_syntax_check(spark):
    assert statements.check(spark, "SELECT 1") == []
    assert statements.check(spark, "SELECT 1 FROM (")[0].line == 1


def test_review_and_order():
    assert [r for r, _ in catalog.review("DELETE FROM t")] == ["where-required"]
    assert catalog.review("DELETE FROM t WHERE k = 1") == []
    assert catalog.ordered({"view": {"table"}, "table": set()}) == ["table", "view"]


def test_repeated_source_keys_fail(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    once = spark.createDataFrame([(1, "x"), (None, "n"), (None, "m")], "k int, v string")
    assert rows(tables.upsert(target, once, ["k"])) == sorted([(1, "x"), (2, "b"), (None, "n"), (None, "m")], key=repr)
    assert rows(tables.update_from(target, once, ["k"], {"v": F.col("s.v")})) == [(1, "x"), (2, "b")]
    for changed in (tables.upsert(target, twice, ["k"]), tables.update_from(target, twice, ["k"], {"v": F.col("s.v")})):
        with pytest.raises(Exception, match="several source rows"):
            changed.collect()


@pytest.mark.parametrize("share", [0, 1, 10, 33.3, 99.9, 100])
def test_percent(spark, share):
    df = spark.createDataFrame([(k * 7 % 50,) for k in range(50)], "x int")
    n = -(-int(50 * share * 1000) // 100_000)
    assert rows(tables.percent(df, share, [F.col("x")])) == sorted(((k,) for k in range(n)), key=repr)


def test_search_clauses(spark):
    df = spark.createDataFrame([(1, "smart works", [(1, "a")]), (2, "Art work!", [(2, "a"), (1, "b")]), (3, "e-mail art works", None), (4, None, [])], "id int, text string, items array<struct<n: int, s: string>>")
    hits = lambda query: [r.id for r in search.search(df, {"query": query, "sort": ["id"]}).collect()]
    assert hits({"match_phrase": {"text": "art work"}}) == [2]
    assert hits({"match_phrase_prefix": {"text": "art work"}}) == [2, 3]
    assert hits({"match": {"text": "e-mail"}}) == [3]
    assert hits({"match_bool_prefix": {"text": {"query": "mail wor", "operator": "and"}}}) == [3]
    assert hits({"multi_match": {"query": "smart", "fields": ["text"]}}) == [1]
    both = {"bool": {"must": [{"term": {"items.n": 2}}, {"term": {"items.s": "b"}}]}}
    assert hits({"nested": {"path": "items", "query": both}}) == [] and hits({"nested": {"path": "items", "query": {"term": {"items.s": "b"}}}}) == [2]
    assert hits({"range": {"id": {"from": 2, "to": 3}}}) == [2, 3] and hits({"range": {"id": {"from": 2, "include_lower": False, "lt": 4}}}) == [3]
    assert hits({"range": {"id": {"from": 2, "lt": 4}}}) == [2, 3]
    with pytest.raises(ValueError):
        hits({"range": {"id": {"above": 2}}})
    with pytest.raises(ValueError):
        search.condition({"has_child": {}})


def test_row_patterns_across_batches(spark):
    """Partitions that span Arrow batches, and many of them in one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(g, n, "ab"[n % 2]) for g in range(5) for n in range(2 * g + 1)], "g int, n int, c string")
        made = match.match_recognize(df, ["g"], [F.col("n")], "A B", {"A": F.col("c") == "a", "B": F.col("c") == "b"})
        assert rows(made.groupBy("g").agg(F.count("*").alias("n"))) == [(g, 2 * g) for g in range(1, 5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_near_ties(spark, tmp_path):
    """Many rows at one place, and places equally far by the SQL's own arithmetic."""
    import compare
    import duckdb

    from brindle import registry

    spark.range(3000, -1, -1, 5).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert compare.differences(spark, "mongo_near", registry.queries()["mongo_near"], registry.oracle_sql()["mongo_near"], str(tmp_path), con) == ""
    near = {"$near": {"$geometry": {"type": "Point", "coordinates": [10, 50]}}}
    places = spark.createDataFrame([(k, [lon, 40]) for lon in (-15, 35) for k in range(40)], "k int, loc array<int>").repartition(8)
    assert [(r.k, r.loc[0]) for r in mongo.find(places, {"loc": near}, limit=5).collect()] == [(0, -15), (0, 35), (1, -15), (1, 35), (2, -15)]


def _plan(spark, name):
    from brindle import registry

    made = registry.queries()[name](spark, "/root/testdata/sf0.001")
    return made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["approx_distinct_band", "hll_sketch"])
def test_one_sketch_for_all_keys(spark, name):
    """No sketch is kept for each key."""
    sketches = [line for line in _plan(spark, name).splitlines() if "approx_count_distinct(" in line or "hll_sketch_agg(" in line]
    assert sketches and not any(re.search(r"key=\[\w|keys=\[\w", line) for line in sketches)


def test_json_names_by_one_worker(spark):
    """A task has one Python process, not one for each kind of function."""
    assert _plan(spark, "json_names").count("EvalPython") == 1


def test_join_order_hints_hash_counted_orders(spark):
    plan = _plan(spark, "join_order_hints")
    assert "SortMergeJoin" in plan and re.search(r"ShuffledHashJoin[^\n]*BuildRight(?s:.*)HashAggregate\(keys=\[o_custkey", plan)
