"""Graph queries on a small graph."""

from collections import Counter

import pytest

from tessera.catalog.graph import EdgeTable, NodeTable, PropertyGraph
from tessera.frontend.lexer import QueryError
from tessera.plans.bench_queries import QUERIES
from tessera.session import Session


@pytest.fixture()
def session(spark):
    people = spark.createDataFrame([(1, ["Person"], "Ann", 30), (2, ["Person", "Boss"], "Bea", 40), (3, ["Person"], "Cy", 20)], "_id bigint, _labels array<string>, name string, age bigint")
    knows = spark.createDataFrame([(11, 1, 2, 5), (12, 2, 3, 7), (13, 3, 1, 9)], "_id bigint, _src bigint, _dst bigint, since bigint")
    return Session(spark, PropertyGraph((NodeTable(frozenset(["Person"]), people, True),), (EdgeTable("KNOWS", knows),)))


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b ORDER BY a", [("Ann", "Bea"), ("Bea", "Cy"), ("Cy", "Ann")]),
        ("MATCH (n:Boss) RETURN n.name AS x", [("Bea",)]),
        ("MATCH (a)-[:KNOWS]-(b) RETURN count(*) AS n", [(6,)]),
        ("MATCH (a {name: 'Ann'})-[:KNOWS]->{1,3}(b) RETURN b.name AS b ORDER BY b", [("Ann",), ("Bea",), ("Cy",)]),
        ("MATCH p = ANY SHORTEST (a {name: 'Ann'})-[:KNOWS]->+(b {name: 'Cy'}) RETURN path_length(p) AS n", [(2,)]),
        ("MATCH (a) OPTIONAL MATCH (a)-[k:KNOWS WHERE k.since > 6]->() RETURN a.name AS a, count(k) AS n ORDER BY a", [("Ann", 0), ("Bea", 1), ("Cy", 1)]),
        ("MATCH (a) WHERE NOT EXISTS { (a)-[:KNOWS]->(:Boss) } RETURN a.name AS a ORDER BY a", [("Bea",), ("Cy",)]),
        ("RETURN 7 / 2 AS a, [x IN [1, 2, 3] WHERE x > 1 | x * 2] AS b", [(3, [4, 6])]),
        ("UNWIND [3, 1, 2] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN sum(x) AS s", [(5,)]),
        ("INSERT (:Person {name: 'Di', age: 1}); MATCH (n:Person) RETURN count(*) AS n", [(4,)]),
        ("MATCH (n {name: 'Cy'}) SET n.age = 21 RETURN n.age AS a", [(21,)]),
        ("MATCH (n {name: 'Cy'}) DETACH DELETE n; MATCH ()-[k]->() RETURN count(k) AS n", [(1,)]),
        ("MERGE (n:Person {name: 'Ann'}) RETURN n.age AS a", [(30,)]),
    ],
)
def test_query(session, text, rows):
    assert [tuple(r) for r in session.run(text).collect()] == rows


#: Branches that only a count sees, in one match and as one chain, against the same pattern with every row made (a path variable keeps it whole).
@pytest.mark.parametrize(
    ("counted", "whole"),
    [
        ("MATCH (a)-[:KNOWS]->(b), (a)<-[:LIKES]-(c) RETURN a.name AS a, count(*) AS n", "MATCH p = (b)<-[:KNOWS]-(a), (a)<-[:LIKES]-(c) RETURN a.name AS a, count(*) AS n"),
        ("MATCH (b)<-[:KNOWS]-(a)<-[:LIKES]-(c) WHERE b.age > 20 RETURN a.name AS a, sum(a.age) AS s, avg(a.age) AS v, count(c) AS n, min(a.age) AS m", "MATCH p = (b)<-[:KNOWS]-(a)<-[:LIKES]-(c) WHERE b.age > 20 RETURN a.name AS a, sum(a.age) AS s, avg(a.age) AS v, count(c) AS n, min(a.age) AS m"),
        ("MATCH (x)-[:KNOWS]->(a), (a)-[:KNOWS]->(y), (a)<-[:LIKES]-(z), (w) RETURN count(*) AS n", "MATCH p = (x)-[:KNOWS]->(a), q = (a)-[:KNOWS]->(y), r = (a)<-[:LIKES]-(z), (w) RETURN count(*) AS n"),
        ("MATCH (a:Nobody)-[:KNOWS]->(b), (a)<-[:LIKES]-(c) RETURN count(*) AS n", "RETURN 0 AS n"),
    ],
)
def test_counted_branches(spark, counted, whole):
    people = spark.createDataFrame([(k, ["Person"], f"p{k}", 10 * k) for k in range(1, 7)], "_id bigint, _labels array<string>, name string, age bigint")
    edge = lambda rows: spark.createDataFrame([(100 + i, *r) for i, r in enumerate(rows)], "_id bigint, _src bigint, _dst bigint")
    tables = EdgeTable("KNOWS", edge([(1, 2), (1, 3), (1, 3), (2, 4), (4, 1), (5, 5)])), EdgeTable("LIKES", edge([(3, 1), (4, 1), (6, 1), (6, 2), (1, 5), (2, 5)]))
    s = Session(spark, PropertyGraph((NodeTable(frozenset(["Person"]), people, True),), tables))
    rows = lambda text: sorted(tuple(r) for r in s.run(text).collect())
    assert rows(counted) == rows(whole) != []


def test_undefined_variable(session):
    with pytest.raises(QueryError):
        session.run("MATCH (a) RETURN b.name AS x")


def test_different_edges_of_all_orders(spark):
    items = Counter(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").collect())
    got = {r.k: r.n for r in QUERIES["different_edges_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: n * (n - 1) for k, n in items.items() if n > 1} and max(got) >= 200


@pytest.mark.parametrize(("text", "n"), [("MATCH (a {k: 0})-[:NEXT]->*(b) RETURN count(*) AS n", 71), ("MATCH p = ANY SHORTEST (a {k: 0})-[:NEXT]->+(b {k: 70}) RETURN path_length(p) AS n", 70)])
def test_more_hops_than_a_walk_may_take(spark, text, n):
    nodes = spark.createDataFrame([(k, ["T"], k) for k in range(71)], "_id bigint, _labels array<string>, k bigint")
    edges = spark.createDataFrame([(k, k, k + 1) for k in range(70)], "_id bigint, _src bigint, _dst bigint")
    got = Session(spark, PropertyGraph((NodeTable(frozenset(["T"]), nodes, True),), (EdgeTable("NEXT", edges),))).run(text).collect()
    assert [r.n for r in got] == [n]
