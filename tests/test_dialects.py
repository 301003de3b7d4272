"""Graph patterns, adapted statements, procedures and positions on small rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from brindle.documents import mongo, search
from brindle.functions import dialect as D
from brindle.operators import graphs
from brindle.services import statements
from brindle.services.procedures import Procedures, arguments

EDGES = [(0, 1, 2, True, "x"), (1, 2, 3, True, "x"), (2, 3, 1, True, "y"), (3, 3, 4, False, "x"), (4, 4, 4, False, "y"), (5, 2, 2, True, "x"), (6, None, 1, True, "x"), (7, 2, 3, None, "y")]
NODES = [1, 2, 3, 4, 5]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n,) for n in [*NODES, None]], "node int")
    return nodes, spark.createDataFrame(EDGES, "edge int, source int, target int, directed boolean, label string")


def walked(pattern, restrictor=None, selector=None, longest=6):
    """All paths of a pattern, one after the other."""
    paths = [([n], []) for n in NODES]
    for step in graphs.parse(pattern):
        moves = set()
        for e, s, t, directed, label in EDGES:
            if s is None or (step.label and label != step.label):
                continue
            kinds = graphs.DIRECTIONS[step.direction]
            moves |= {(e, s, t)} if ("u" if directed is False else "r") in kinds else set()
            moves |= {(e, t, s)} if ("u" if directed is False else "l") in kinds else set()
        most, found, front = longest if step.most is None else step.most, [], paths
        for k in range(most + 1):
            found += front if k >= step.least else []
            front = [(ns + [b], es + [e]) for ns, es in front for e, a, b in moves if a == ns[-1]]
            if restrictor == "trail":
                front = [p for p in front if len(set(p[1])) == len(p[1])]
            elif restrictor == "acyclic":
                front = [p for p in front if len(set(p[0])) == len(p[0])]
            elif restrictor == "simple":
                front = [p for p in front if len(set(p[0][:-1])) == len(p[0]) - 1 and p[0][-1] not in p[0][1:-1]]
        paths = found
    if selector:
        groups = itertools.groupby(sorted(paths, key=lambda p: (p[0][0], p[0][-1], len(p[1]), p)), key=lambda p: (p[0][0], p[0][-1]))
        paths = [p for _, g in groups for every in [list(g)] for p in (every[:1] if selector != "all shortest" else [x for x in every if len(x[1]) == len(every[0][1])])]
    return sorted(paths)


@pytest.mark.parametrize(
    ("pattern", "restrictor", "selector"),
    [(f"(a){d}(b)", None, None) for d in graphs.DIRECTIONS]
    + [("(a)-{2}(b)", "trail", None), ("(a)~>*(b)", "acyclic", None), ("(a)<->+(b)", "simple", None), ("(a)-[:x]->{1,3}(b)~[:x]~?(c)", None, None), ("(a)->+(b)~(c)", None, "all shortest"), ("(a)-*(b)", None, "any shortest"), ("(a)->{2,4}(b)", None, "all shortest"), ("(a)-{2,}(b)", "trail", "any")],
)
def test_graph_patterns(graph, pattern, restrictor, selector):
    got = sorted((r.nodes, r.edges) for r in graphs.match(*graph, pattern, restrictor, selector).collect())
    assert got == walked(pattern, restrictor, selector, 8)


def test_graph_errors_and_empty(spark, graph):
    nodes, edges = graph
    with pytest.raises(ValueError):
        graphs.match(nodes, edges, "(a)->+(b)")
    for bad in ("->(b)", "(a)->", "(a)=>(b)", "(a)<-[x]~(b)"):
        with pytest.raises(ValueError):
            graphs.parse(bad)
    assert graphs.match(nodes.limit(0), edges, "(a)-+(b)", "trail").count() == 0
    assert graphs.match(nodes, edges.limit(0), "(a)-*(b)", "trail").count() == len(NODES)
    assert graphs.match(nodes, edges.limit(0), "(a)->(b)").count() == 0


def test_adapted_leaves_quotes_and_comments():
    text = "SELECT 'a STRAIGHT_JOIN b', `ALLOW FILTERING` -- AS MATERIALIZED (\nFROM t /* TOKEN( */"
    assert statements.adapted(text) == text
    assert statements.adapted("SELECT a FROM t JOIN u USING (k) ORDER BY a USING <") == "SELECT a FROM t JOIN u USING (k) ORDER BY a ASC"
    assert statements.adapted("SELECT a FROM t WHERE a >= 1 ORDER BY a USING >= ") == "SELECT a FROM t WHERE a >= 1 ORDER BY a USING >= "


def test_procedures(spark):
    assert arguments("1, f(2, 3), 'a, ''b', x => array(1, 2)") == ["1", "f(2, 3)", "'a, ''b'", "x => array(1, 2)"]
    known = Procedures(spark)
    known.add("Twice", lambda n=1, times=2: spark.range(n * times))
    assert [known.call(s).count() for s in ("call twice", "CALL twice()", "CALL TWICE(3)", "CALL twice(n => 1 + 1, times => 5);")] == [2, 2, 6, 10]
    for bad in ("CALL other()", "SELECT 1"):
        with pytest.raises(ValueError):
            known.call(bad)


def test_addresses_and_positions(spark):
    rows = spark.createDataFrame([("::1",), ("1.2.3.4",), ("x",), (None,), ("",)], "ip string").select(D.inet6_aton(F.col("ip")).alias("b")).select(F.hex("b").alias("h"), D.inet6_ntoa(F.col("b")).alias("ip"))
    assert [tuple(r) for r in rows.collect()] == [("0" * 31 + "1", "::1"), ("01020304", "1.2.3.4"), (None, None), (None, None), (None, None)]
    places = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None)], "id int, loc array<double>")
    near = {"loc": {"$near": {"$geometry": {"type": "Point", "coordinates": [0.9, 0]}}}}
    assert [r.id for r in mongo.find(places, near).collect()] == [2, 1, 3]
    assert [r.id for r in mongo.find(places, near, sort={"id": -1}).collect()] == [3, 2, 1]
    for bad in ("5 leagues", "far"):
        with pytest.raises(ValueError):
            search.condition({"geo_distance": {"distance": bad, "p": {"lat": 1, "lon": 2}}})
