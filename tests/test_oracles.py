"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import compare
from brindle import registry, session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    made = compare.connect(SF)
    yield made
    made.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare.differences(spark, name, QUERIES[name], ORACLES[name], SF, con) == ""
    else:
        WITHOUT[name](spark, QUERIES[name])


def paths(spark, query):
    """Breadth-first search from every supplier."""
    n = session.table(spark, SF, "supplier").count()
    keys = [r.s_suppkey for r in session.table(spark, SF, "supplier").collect()]
    edges = {s: {(s * 5 + 1) % n, (s + 3) % n} for s in keys}
    want = set()
    for start in keys:
        front, seen, d = {start}, set(), 0
        while front:
            d += 1
            front = {t for s in front for t in edges.get(s, ())} - seen
            want |= {(start, t, d) for t in front}
            seen |= front
    assert {tuple(r) for r in query(spark, SF).select("a", "b", "d").collect()} == want


def sampled(most, key):
    """A sample has rows of the table, no row twice, and is the same again."""

    def check(spark, query):
        got = sorted(r[key] for r in query(spark, SF).collect())
        every = {r.o_orderkey for r in session.table(spark, SF, "orders").select("o_orderkey").collect()}
        assert 0 < len(got) <= most(len(every)) and len(set(got)) == len(got) and set(got) <= every
        assert got == sorted(r[key] for r in query(spark, SF).collect())

    return check


def now(spark, query):
    (row,) = query(spark, SF).collect()
    assert all(x is not None for x in row) and 0 <= row.r < 1 and len(row.u) == 36


#: Of the queries without an oracle.
WITHOUT = {
    "nondeterministic_now": now,
    "shortest_paths": paths,
    "exact_sample": sampled(lambda n: 50, "o_orderkey"),
    "weighted_sample": sampled(lambda n: 50, "o_orderkey"),
    "sample_repeatable": sampled(lambda n: n // 2, "o_orderkey"),
    "stratified_sample": sampled(lambda n: n // 2, "o_orderkey"),
}
