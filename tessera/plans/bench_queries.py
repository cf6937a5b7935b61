"""The registered graph queries over the star-schema graph, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from ..sources.tables import star_graph
from . import language_queries

_LIST: list[tuple[str, str, str]] = []


def _q(name: str, text: str, sql: str) -> None:
    _LIST.append((name, text, sql))


_CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"

# -- scans, filters, projections
_q("node_scan_filter", "MATCH (c:Customer) WHERE c.acctbal > 5000 RETURN c.custkey AS k, c.name AS name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal > 5000")
_q("label_union", "MATCH (x:Nation|Region) RETURN x.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
_q("label_negation", "MATCH (x:!Customer&!Order&!Part&!Supplier&!Turn) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT 'Nation' AS l, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
_q("element_where", "MATCH (o:Order WHERE o.orderstatus = 'F' AND o.totalprice > 100000) RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
_q("property_spec", "MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'")
_q("string_predicates", "MATCH (p:Part) WHERE p.type STARTS WITH 'P' OR p.type CONTAINS 'ROM' OR p.name ENDS WITH '7' RETURN p.partkey AS k, upper(p.name) AS u, size(p.type) AS n, substring(p.name, 1, 3) AS s", "SELECT p_partkey AS k, upper(p_name) AS u, CAST(length(p_type) AS BIGINT) AS n, substring(p_name, 2, 3) AS s FROM part WHERE starts_with(p_type, 'P') OR contains(p_type, 'ROM') OR ends_with(p_name, '7')")
_q("regex_and_in", "MATCH (n:Nation) WHERE n.name =~ '.*A.*' OR n.regionkey IN [1, 3] RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, '.*A.*') OR n_regionkey IN (1, 3)")
_q("case_coalesce", "MATCH (o:Order) RETURN o.orderkey AS k, CASE WHEN o.totalprice > 200000 THEN 'high' WHEN o.totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o.orderstatus, 'O'), 'open') AS s", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s FROM orders")
_q("integer_arithmetic", "MATCH (o:Order) RETURN o.orderkey AS k, o.orderkey / 7 AS d, o.orderkey % 7 AS m, -o.orderkey AS neg, abs(3 - o.orderkey) AS a", "SELECT o_orderkey AS k, o_orderkey // 7 AS d, o_orderkey % 7 AS m, -o_orderkey AS neg, abs(3 - o_orderkey) AS a FROM orders")
_q("date_parts", "MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.month AS m, count(*) AS n", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL")
_q("conversions", "MATCH (c:Customer) RETURN c.custkey AS k, toString(c.custkey) AS s, toInteger('12') AS i, toFloat('1.5') AS f, toBoolean('true') AS b", "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s, CAST(12 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, true AS b FROM customer")

# -- expansion
_q("placed_by_segment", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN c.mktsegment AS seg, count(*) AS n, sum(toInteger(round(o.totalprice * 100))) AS total ORDER BY seg", f"SELECT c_mktsegment AS seg, count(*) AS n, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
_q("two_hops", "MATCH (c:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part) RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
_q("region_path", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer) RETURN r.name AS region, count(DISTINCT n) AS nations, count(c) AS customers", "SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_q("different_edges_all", "MATCH (p:Part)<-[a:CONTAINS]-(o:Order)-[b:CONTAINS]->(q:Part) RETURN o.orderkey AS k, count(*) AS n", "WITH e AS (SELECT *, row_number() OVER () AS id FROM lineitem) SELECT o_orderkey AS k, count(*) AS n FROM orders JOIN e a ON a.l_orderkey = o_orderkey JOIN e b ON b.l_orderkey = o_orderkey AND a.id <> b.id GROUP BY 1")
_q("undirected", "MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.name AS a, r.name AS b", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
_q("edge_properties", "MATCH (o:Order)-[l:CONTAINS WHERE l.returnflag = 'R']->(p:Part {size: 10}) RETURN o.orderkey AS o, p.partkey AS p, l.linenumber AS l, type(l) AS t", "SELECT l_orderkey AS o, p_partkey AS p, l_linenumber AS l, 'CONTAINS' AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size = 10")
_q("comma_patterns", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
_q("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
_q("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 150000 RETURN c.custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000 GROUP BY 1")
_q("path_union", "MATCH (n:Nation)<-[:IN_NATION]-(x) | (n:Nation)<-[:BASED_IN]-(x) RETURN n.name AS name, count(*) AS k", "SELECT n_name AS name, count(*) AS k FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1")

# -- subqueries
_q("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'P' } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_q("not_exists", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->() RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_q("count_subquery", "MATCH (n:Nation) RETURN n.name AS name, COUNT { (n)<-[:BASED_IN]-(:Supplier) } AS suppliers", "SELECT n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
_q("value_subquery", "MATCH (n:Nation) RETURN n.name AS name, VALUE { MATCH (n)-[:IN_REGION]->(r) RETURN r.name AS x } AS region", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("call_topk_per_row", "MATCH (n:Nation) CALL (n) { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c ORDER BY c.acctbal DESC, c.custkey LIMIT 2 } RETURN n.name AS name, c.custkey AS k", "SELECT n_name AS name, k FROM (SELECT n_name, c_custkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE r <= 2")
_q("pattern_comprehension", "MATCH (r:Region) RETURN r.name AS name, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.name > 'F' | n.name]) AS n", "SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_name > 'F') AS n FROM region")

# -- aggregation, order, sets
_q("aggregates", "MATCH (o:Order) RETURN o.orderpriority AS p, count(*) AS n, min(o.totalprice) AS lo, max(o.totalprice) AS hi, count(DISTINCT o.custkey) AS customers", "SELECT o_orderpriority AS p, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
_q("percentiles", "MATCH (o:Order) RETURN o.orderstatus AS s, percentile_disc(o.totalprice, 0.5) AS d, percentile_cont(o.totalprice, 0.25) AS c", "SELECT o_orderstatus AS s, quantile_disc(o_totalprice, 0.5) AS d, quantile_cont(o_totalprice, 0.25) AS c FROM orders GROUP BY 1")
_q("with_having", "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 12 RETURN c.custkey AS k, n", "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12")
_q("select_form", "SELECT o.orderstatus AS s, count(*) AS n FROM CURRENT_GRAPH MATCH (o:Order) WHERE o.totalprice > 50000 GROUP BY s HAVING count(*) > 3 ORDER BY s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) > 3")
_q("next_pipeline", "MATCH (o:Order) RETURN o.custkey AS k, count(*) AS n NEXT FILTER n > 10 RETURN n, count(*) AS customers", "SELECT n, count(*) AS customers FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 10 GROUP BY 1")
_q("top_k", "MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS t ORDER BY o.totalprice DESC, o.orderkey LIMIT 25", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_q("order_offset", "MATCH (c:Customer) RETURN c.custkey AS k ORDER BY k OFFSET 20 LIMIT 30", "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 30 OFFSET 20")
_q("distinct", "MATCH (o:Order) RETURN DISTINCT o.orderstatus AS s, o.orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
_q("union_all", "MATCH (c:Customer) RETURN c.name AS name UNION ALL MATCH (s:Supplier) RETURN s.name AS name", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
_q("except_all", "MATCH (c:Customer) RETURN c.nationkey AS k EXCEPT ALL MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_q("intersect", "MATCH (c:Customer) WHERE c.acctbal < 0 RETURN c.nationkey AS k INTERSECT MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
_q("otherwise", "MATCH (c:Customer) WHERE c.acctbal > 1e9 RETURN c.name AS name OTHERWISE MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region")
_q("for_ordinality", "MATCH (r:Region) FOR x IN [10, 20, 30] WITH ORDINALITY i RETURN r.name AS name, x, i", "SELECT r_name AS name, CAST(i * 10 AS BIGINT) AS x, CAST(i AS BIGINT) AS i FROM region, range(1, 4) t(i)")
_q("let_and_lists", "MATCH (n:Nation) LET xs = [x IN range(1, 5) WHERE x % 2 = 1 | x * n.nationkey] RETURN n.nationkey AS k, reduce(s = 0, x IN xs | s + x) AS total, size(xs) AS size, any(x IN xs WHERE x > 50) AS big", "SELECT n_nationkey AS k, CAST(9 * n_nationkey AS BIGINT) AS total, CAST(3 AS BIGINT) AS size, 5 * n_nationkey > 50 AS big FROM nation")

# -- quantified paths
_q("bounded_repetition", "MATCH (a:Turn)-[:NEXT]->{1,4}(b:Turn) RETURN a.conv_id AS c, a.turn AS a, b.turn AS b", "SELECT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 4")
_q("unbounded_repetition", "MATCH (a:Turn {turn: 0})-[:NEXT]->*(b:Turn) RETURN a.conv_id AS c, count(*) AS n", "SELECT conv_id AS c, count(*) AS n FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1")
_q("any_shortest", "MATCH p = ANY SHORTEST (a:Turn {turn: 0})-[:NEXT]->+(b:Turn) RETURN a.conv_id AS c, b.turn AS b, path_length(p) AS n", "SELECT conv_id AS c, turn AS b, turn AS n FROM conversations WHERE turn > 0")
_q("cypher_variable_length", "MATCH (a:Turn)-[r:NEXT*2..3]->(b:Turn) WHERE a.role = 'user' RETURN a.conv_id AS c, a.turn AS t, size(r) AS n", "SELECT a.conv_id AS c, a.turn AS t, b.turn - a.turn AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 2 AND 3 WHERE a.role = 'user'")
_q("parenthesized_repetition", "MATCH (a:Turn)((x)-[:NEXT]->(y) WHERE x.role <> y.role){2}(b:Turn) RETURN a.conv_id AS c, a.turn AS t, size(x) AS n", "SELECT a.conv_id AS c, a.turn AS t, CAST(2 AS BIGINT) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations d ON a.conv_id = d.conv_id AND d.turn = a.turn + 2 WHERE a.role <> b.role AND b.role <> d.role")


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(spark, star_graph(spark, sf_dir)).run(text)


_LIST += language_queries.LIST
TEXTS: dict[str, str] = {n: t for n, t, _ in _LIST}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _run(t) for n, t, _ in _LIST}
ORACLES: dict[str, str] = {n: s for n, _, s in _LIST}
