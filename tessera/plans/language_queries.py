"""Registered queries for the operators of the language, each over whole tables with the same query in SQL."""

from __future__ import annotations

LIST: list[tuple[str, str, str]] = []


def _q(name: str, text: str, sql: str) -> None:
    LIST.append((name, text, sql))


# -- subqueries that aggregate, for outer rows with and without matches
_q("call_count_zero", "MATCH (c:Customer) CALL (c) { MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN count(o) AS n, sum(o.totalprice) AS t, max(o.orderkey) AS m } RETURN c.custkey AS k, n, m", "SELECT c_custkey AS k, count(o_orderkey) AS n, max(o_orderkey) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
_q("value_count_zero", "MATCH (c:Customer) RETURN c.custkey AS k, VALUE { MATCH (c)-[:PLACED]->(o:Order {orderstatus: 'P'}) RETURN count(*) AS n } AS n", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer")
_q("exists_of_aggregate", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order {orderstatus: 'P'}) RETURN count(*) AS n } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer")
_q("count_distinct_correlated", "MATCH (c:Customer) RETURN c.custkey AS k, COUNT { MATCH (c)-[:PLACED]->(o:Order) RETURN DISTINCT o.orderstatus } AS n", "SELECT c_custkey AS k, count(DISTINCT o_orderstatus) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_q("collect_subquery", "MATCH (c:Customer) RETURN c.custkey AS k, size(COLLECT { MATCH (c)-[:PLACED]->(o:Order) RETURN DISTINCT o.orderpriority }) AS n", "SELECT c_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_q("call_otherwise", "MATCH (c:Customer) CALL (c) { MATCH (c)-[:PLACED]->(o:Order {orderstatus: 'P'}) RETURN o.orderkey AS o OTHERWISE RETURN -1 AS o } RETURN c.custkey AS k, o", "SELECT c_custkey AS k, coalesce(o_orderkey, -1) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
_q("optional_call", "MATCH (n:Nation) OPTIONAL CALL (n) { MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.acctbal > 9000 RETURN s.suppkey AS s } RETURN n.name AS n, s", "SELECT n_name AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000")
_q("unnamed_pattern_list", "MATCH (c:Customer) RETURN c.custkey AS k, size([(c)-[:PLACED]->() | 1]) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")

# -- sources, graphs, sessions and the catalog
_q("use_graph", "USE CURRENT_GRAPH MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region")
_q("home_graph", "USE HOME_GRAPH MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation")
_q("table_variable", "TABLE t = { MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS n } FOR x IN TABLE t RETURN x.s AS s, x.n AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
_q("for_in_table", "MATCH (r:Region) FOR x IN TABLE { MATCH (n:Nation) RETURN n.name AS name } RETURN r.name AS r, x.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_q("session_parameter", "SESSION SET VALUE $least = 300000; MATCH (o:Order) WHERE o.totalprice > $least RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000")
_q("session_reset", "SESSION SET VALUE $x = 1; SESSION RESET; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region")
_q("session_graph", "CREATE GRAPH other AS COPY OF HOME_GRAPH; SESSION SET GRAPH other; MATCH (p:Part) RETURN p.brand AS b, count(*) AS n", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1")
_q("schema_ddl", "CREATE SCHEMA s; CREATE SCHEMA IF NOT EXISTS s; DROP SCHEMA s; DROP SCHEMA IF EXISTS s; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region")
_q("graph_ddl", "CREATE GRAPH g AS COPY OF HOME_GRAPH; CREATE OR REPLACE GRAPH g ANY; DROP GRAPH g; DROP GRAPH IF EXISTS g; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region")
_q("graph_type_ddl", "CREATE GRAPH TYPE t AS { (:Region {name STRING}) }; DROP GRAPH TYPE t; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region")
_q("constraint_ddl", "CREATE CONSTRAINT c FOR (n:Order) REQUIRE n.orderkey IS UNIQUE; CREATE INDEX i FOR (n:Order) ON (n.orderkey); DROP INDEX i; DROP CONSTRAINT c; MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders")
_q("transaction_rollback", "START TRANSACTION; MATCH (r:Region) DETACH DELETE r; ROLLBACK; MATCH (r:Region) RETURN r.name AS name", "SELECT r_name AS name FROM region")
_q("transaction_commit", "START TRANSACTION; INSERT (:Tag {k: 5}); COMMIT; MATCH (t:Tag) RETURN t.k AS k", "SELECT 5 AS k")

# -- patterns
_q("pattern_yield", "MATCH (c:Customer)-[:PLACED]->(o:Order) YIELD o RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey")
_q("abbreviated_edge", "MATCH (n:Nation)-->(r:Region) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("abbreviated_left", "MATCH (r:Region)<--(n:Nation) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("any_direction", "MATCH (r:Region)-[:IN_REGION]-(n) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("left_or_right", "MATCH (n:Nation)<-[:IN_REGION]->(r) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("simplified_path", "MATCH (c:Customer) -/IN_NATION IN_REGION/-> (r:Region) RETURN r.name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
_q("simplified_union", "MATCH (n:Nation) <-/IN_NATION|BASED_IN/- (x) RETURN n.name AS n, count(*) AS k", "SELECT n_name AS n, count(*) AS k FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1")
_q("simplified_override", "MATCH (c:Customer) -/IN_NATION <BASED_IN/-> (s) RETURN c.custkey AS c, count(*) AS n", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1")
_q("questioned", "MATCH (a:Turn {role: 'user'})-[:NEXT]->?(b:Turn) RETURN a.conv_id AS c, a.turn AS a, b.turn AS b", "SELECT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 1 WHERE a.role = 'user'")
_q("fixed_quantifier", "MATCH (a:Turn)-[:NEXT]->{3}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT a.conv_id AS c, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 3")
_q("multiset_alternation", "MATCH (n:Nation)-[:IN_REGION]->(x:Region) |+| (n:Nation)-[:IN_REGION]->(x) RETURN n.name AS n, count(*) AS k", "SELECT n_name AS n, CAST(2 AS BIGINT) AS k FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("trail_mode", "MATCH TRAIL (a:Turn {turn: 0})-[:NEXT]->{1,3}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn BETWEEN 1 AND 3")
_q("acyclic_mode", "MATCH ACYCLIC (a:Turn {turn: 0})-[:NEXT]-{1,2}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn BETWEEN 1 AND 2")
_q("simple_mode", "MATCH SIMPLE (a:Turn {turn: 1})-[:NEXT]-{1,2}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT a.conv_id AS c, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn IN (0, 2, 3) WHERE a.turn = 1")
_q("walk_mode", "MATCH WALK (a:Turn {turn: 0})-[:NEXT]-{2}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT a.conv_id AS c, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND (b.turn = 2 OR b.turn = 0) WHERE a.turn = 0 AND EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = a.conv_id AND x.turn = 1)")
_q("repeatable_elements", "MATCH REPEATABLE ELEMENTS (a:Nation)-[e:IN_REGION]->(r:Region)<-[f:IN_REGION]-(b:Nation) RETURN a.name AS a, b.name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_q("keep_clause", "MATCH (a:Turn {turn: 0})-[:NEXT]->{1,4}(b:Turn) KEEP ANY SHORTEST RETURN a.conv_id AS c, b.turn AS t", "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn BETWEEN 1 AND 4")
_q("all_search", "MATCH ALL (a:Turn {turn: 0})-[:NEXT]->{1,4}(b:Turn) RETURN a.conv_id AS c, b.turn AS t", "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn BETWEEN 1 AND 4")
_q("any_k", "MATCH ANY 2 (r:Region)-[:IN_REGION]-(n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey")
_q("all_shortest", "MATCH p = ALL SHORTEST (a:Turn {turn: 0})-[:NEXT]->{1,5}(b:Turn) RETURN a.conv_id AS c, path_length(p) AS n", "SELECT conv_id AS c, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 5")
_q("shortest_k", "MATCH p = SHORTEST 2 PATHS (a:Turn {turn: 0})-[:NEXT]->{1,4}(b:Turn) RETURN a.conv_id AS c, path_length(p) AS n", "SELECT conv_id AS c, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 4")
_q("shortest_groups", "MATCH p = SHORTEST 2 GROUPS (a:Turn {turn: 0})-[:NEXT]->{1,4}(b:Turn) RETURN a.conv_id AS c, path_length(p) AS n", "SELECT conv_id AS c, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 4")
_q("cartesian", "MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation")
_q("label_wildcard", "MATCH (x:%&!Turn&!Order) RETURN labels(x)[0] AS l, count(*) AS n", "SELECT 'Customer' AS l, count(*) AS n FROM customer UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
_q("horizontal_aggregation", "MATCH (a:Turn {turn: 0})-[e:NEXT]->{1,3}(b:Turn) RETURN a.conv_id AS c, b.turn AS t, count(e) AS n", "SELECT conv_id AS c, turn AS t, turn AS n FROM conversations WHERE turn BETWEEN 1 AND 3")
_q("horizontal_sum", "MATCH (o:Order)((x)-[l:CONTAINS]->(p)){1}(q:Part) RETURN o.orderkey AS o, sum(l.linenumber) AS s, max(l.linenumber) AS m", "SELECT l_orderkey AS o, l_linenumber AS s, l_linenumber AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")

# -- results and statements
_q("several_statements", "MATCH (r:Region) RETURN r.name AS x; MATCH (n:Nation) RETURN n.name AS x", "SELECT n_name AS x FROM nation")
_q("return_star", "MATCH (n:Nation) LET k = n.nationkey, m = n.name FILTER k > 3 RETURN k, m", "SELECT n_nationkey AS k, n_name AS m FROM nation WHERE n_nationkey > 3")
_q("let_in", "MATCH (n:Nation) RETURN n.name AS n, LET x = n.nationkey, y = 2 IN x * y + 1 END AS v", "SELECT n_name AS n, CAST(n_nationkey * 2 + 1 AS BIGINT) AS v FROM nation")
_q("value_variable", "VALUE least = 5 MATCH (n:Nation) WHERE n.nationkey > least RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey > 5")
_q("avg_aggregate", "MATCH (o:Order) RETURN o.orderstatus AS s, avg(o.orderkey) AS a", "SELECT o_orderstatus AS s, avg(o_orderkey) AS a FROM orders GROUP BY 1")
_q("collect_list", "MATCH (c:Customer) RETURN c.mktsegment AS s, size(collect_list(c.custkey)) AS n, size(collect(DISTINCT c.nationkey)) AS d", "SELECT c_mktsegment AS s, count(*) AS n, count(DISTINCT c_nationkey) AS d FROM customer GROUP BY 1")
_q("deviations", "MATCH (c:Customer) RETURN c.mktsegment AS s, round(stddev_samp(c.nationkey) * 1e6) AS a, round(stddev_pop(c.nationkey) * 1e6) AS b, round(stDev(c.nationkey) * 1e6) AS c, round(stDevP(c.nationkey) * 1e6) AS d", "SELECT c_mktsegment AS s, floor(stddev_samp(c_nationkey) * 1e6 + 0.5) AS a, floor(stddev_pop(c_nationkey) * 1e6 + 0.5) AS b, floor(stddev_samp(c_nationkey) * 1e6 + 0.5) AS c, floor(stddev_pop(c_nationkey) * 1e6 + 0.5) AS d FROM customer GROUP BY 1")
_q("group_by_nothing", "MATCH (o:Order) RETURN count(*) AS n, max(o.totalprice) AS m GROUP BY ()", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders")
_q("union_distinct", "MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_q("except_distinct", "MATCH (n:Nation) RETURN n.nationkey AS k EXCEPT MATCH (s:Supplier) WHERE s.acctbal > 0 RETURN s.nationkey AS k", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
_q("intersect_all", "MATCH (c:Customer) RETURN c.nationkey AS k INTERSECT ALL MATCH (s:Supplier) RETURN s.nationkey AS k", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_q("order_nulls", "MATCH (n:Nation) RETURN n.name AS n, nullif(n.regionkey, 2) AS r ORDER BY r NULLS FIRST, n LIMIT 12", "SELECT n_name AS n, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS FIRST, n LIMIT 12")

# -- data modification
_q("insert_nodes", "MATCH (r:Region) INSERT (:Copy {name: r.name, size: 1}); MATCH (c:Copy) RETURN c.name AS name, c.size AS size", "SELECT r_name AS name, 1 AS size FROM region")
_q("insert_edges", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) INSERT (r)-[:HAS {w: n.nationkey}]->(n); MATCH (r:Region)-[h:HAS]->(n:Nation) RETURN r.name AS r, n.name AS n, h.w AS w", "SELECT r_name AS r, n_name AS n, n_nationkey AS w FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("create_path", "CREATE (:A {k: 1})-[:TO {w: 2}]->(:B {k: 3}); MATCH (a:A)-[t:TO]->(b:B) RETURN a.k AS a, t.w AS w, b.k AS b", "SELECT 1 AS a, 2 AS w, 3 AS b")
_q("set_property", "MATCH (c:Customer) WHERE c.acctbal < 0 SET c.mktsegment = 'DEBT'; MATCH (c:Customer) RETURN c.mktsegment AS s, count(*) AS n", "SELECT CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS s, count(*) AS n FROM customer GROUP BY 1")
_q("set_all_properties", "MATCH (r:Region) SET r = {name: r.name, rank: r.regionkey + 1}; MATCH (r:Region) RETURN r.name AS n, r.rank AS k, r.regionkey AS gone", "SELECT r_name AS n, CAST(r_regionkey + 1 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS gone FROM region")
_q("set_merge_map", "MATCH (r:Region) SET r += {rank: 7}; MATCH (r:Region) RETURN r.name AS n, r.rank AS k, r.regionkey AS r", "SELECT r_name AS n, 7 AS k, r_regionkey AS r FROM region")
_q("set_parenthesized", "MATCH (r:Region) SET (r).rank = r.regionkey * 2; MATCH (r:Region) RETURN r.name AS n, r.rank AS k", "SELECT r_name AS n, CAST(r_regionkey * 2 AS BIGINT) AS k FROM region")
_q("set_label", "MATCH (n:Nation) WHERE n.regionkey = 1 SET n:Picked; MATCH (n:Picked) RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
_q("remove_property", "MATCH (n:Nation) WHERE n.regionkey = 1 REMOVE n.name; MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name", "SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 1 THEN n_name END AS name FROM nation")
_q("remove_label", "MATCH (n:Nation) WHERE n.regionkey = 1 REMOVE n:Nation; MATCH (n:Nation) RETURN n.nationkey AS k", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1")
_q("delete_edges", "MATCH (:Nation {regionkey: 1})-[e:IN_REGION]->() DELETE e; MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey <> 1")
_q("detach_delete", "MATCH (r:Region {regionkey: 1}) DETACH DELETE r; MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 1")
_q("merge_create_and_match", "MATCH (n:Nation) MERGE (t:Tag {k: n.regionkey}) ON CREATE SET t.made = 1; MATCH (n:Nation) MERGE (t:Tag {k: n.regionkey}) ON MATCH SET t.seen = 2; MATCH (t:Tag) RETURN t.k AS k, t.made AS made, t.seen AS seen", "SELECT DISTINCT n_regionkey AS k, 1 AS made, 2 AS seen FROM nation")

# -- predicates and null logic
_q("null_logic", "MATCH (n:Nation) LET x = nullif(n.regionkey, 1) RETURN n.nationkey AS k, (x > 2) AND TRUE AS a, (x > 2) OR TRUE AS b, (x > 2) XOR FALSE AS c, NOT (x > 2) AS d, x IS NULL AS e, x IS NOT NULL AS f", "SELECT n_nationkey AS k, (x > 2) AND TRUE AS a, (x > 2) OR TRUE AS b, xor(CAST(x > 2 AS INT), 0) = 1 AS c, NOT (x > 2) AS d, x IS NULL AS e, x IS NOT NULL AS f FROM (SELECT *, nullif(n_regionkey, 1) AS x FROM nation)")
_q("truth_tests", "MATCH (n:Nation) LET x = nullif(n.regionkey, 1) > 2 RETURN n.nationkey AS k, x IS TRUE AS a, x IS FALSE AS b, x IS UNKNOWN AS c, x IS NOT TRUE AS d", "SELECT n_nationkey AS k, x IS NOT DISTINCT FROM true AS a, x IS NOT DISTINCT FROM false AS b, x IS NULL AS c, x IS DISTINCT FROM true AS d FROM (SELECT *, nullif(n_regionkey, 1) > 2 AS x FROM nation)")
_q("chained_comparison", "MATCH (o:Order) WHERE 100000 < o.totalprice <= 200000 RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE 100000 < o_totalprice AND o_totalprice <= 200000")
_q("predicate_comparison", "MATCH (n:Nation) RETURN n.nationkey AS k, none(x IN [1, 2, n.regionkey] WHERE x > 3) = true AS a, single(x IN [n.regionkey, 3] WHERE x = 3) AS b", "SELECT n_nationkey AS k, NOT n_regionkey > 3 AS a, n_regionkey <> 3 AS b FROM nation")
_q("all_predicate", "MATCH (n:Nation) RETURN n.nationkey AS k, all(x IN [1, n.regionkey] WHERE x > 0) AS a", "SELECT n_nationkey AS k, n_regionkey > 0 AS a FROM nation")
_q("list_equality", "MATCH (n:Nation) LET x = nullif(n.regionkey, 1) RETURN n.nationkey AS k, [1, x] = [1, x] AS a, [1, x] = [2, x] AS b, [x] <> [2] AS c", "SELECT n_nationkey AS k, CASE WHEN x IS NOT NULL THEN true END AS a, false AS b, x <> 2 AS c FROM (SELECT *, nullif(n_regionkey, 1) AS x FROM nation)")
_q("typed_predicate", "MATCH (n:Nation) RETURN n.nationkey AS k, n.name IS TYPED STRING AS a, n.name IS TYPED INTEGER AS b, n.regionkey IS NOT TYPED STRING AS c", "SELECT n_nationkey AS k, true AS a, false AS b, true AS c FROM nation")
_q("normalized_predicate", "MATCH (n:Nation) RETURN n.name AS n, n.name IS NORMALIZED AS a, normalize(n.name, NFD) IS NFD NORMALIZED AS b", "SELECT n_name AS n, true AS a, true AS b FROM nation")
_q("directed_predicate", "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n.name AS n, e IS DIRECTED AS d, e IS NOT DIRECTED AS u", "SELECT n_name AS n, true AS d, false AS u FROM nation")
_q("labeled_predicate", "MATCH (x:Nation|Region) WHERE x IS LABELED Nation RETURN x.name AS n, x:Region AS r", "SELECT n_name AS n, false AS r FROM nation")
_q("endpoint_predicate", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.name AS n, n IS SOURCE OF e AS a, r IS DESTINATION OF e AS b, r IS NOT SOURCE OF e AS c", "SELECT n_name AS n, true AS a, true AS b, true AS c FROM nation")
_q("different_and_same", "MATCH (a:Nation), (b:Nation) WHERE ALL_DIFFERENT(a, b) RETURN count(*) AS n, count(CASE WHEN SAME(a, b) THEN 1 END) AS s", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS s FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
_q("property_exists", "MATCH (x:Nation|Customer) WHERE PROPERTY_EXISTS(x, acctbal) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer")
_q("case_forms", "MATCH (n:Nation) RETURN n.nationkey AS k, CASE n.regionkey WHEN 0, 1 THEN 'low' WHEN > 3 THEN 'high' ELSE 'mid' END AS c", "SELECT n_nationkey AS k, CASE WHEN n_regionkey IN (0, 1) THEN 'low' WHEN n_regionkey > 3 THEN 'high' ELSE 'mid' END AS c FROM nation")
_q("cast_types", "MATCH (o:Order) RETURN o.orderkey AS k, CAST(o.totalprice AS INTEGER) AS i, CAST(o.orderkey AS STRING) AS s, CAST('2020-02-03' AS DATE) AS d", "SELECT o_orderkey AS k, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, DATE '2020-02-03' AS d FROM orders")

# -- numbers
_q("mod_power_sqrt", "MATCH (o:Order) RETURN o.orderkey AS k, mod(o.orderkey, 7) AS m, round(power(o.orderkey, 2)) AS p, round(sqrt(o.orderkey) * 1e6) AS s, o.orderkey ^ 2 AS q", "SELECT o_orderkey AS k, o_orderkey % 7 AS m, CAST(o_orderkey * o_orderkey AS DOUBLE) AS p, floor(sqrt(o_orderkey) * 1e6 + 0.5) AS s, CAST(o_orderkey * o_orderkey AS DOUBLE) AS q FROM orders")
_q("logarithms", "MATCH (o:Order) RETURN o.orderkey AS k, round(ln(o.totalprice) * 1e6) AS a, round(log10(o.totalprice) * 1e6) AS b, round(log(2, o.totalprice) * 1e6) AS c, round(exp(1) * 1e6) AS d, round(e() * 1e6) AS e", "SELECT o_orderkey AS k, floor(ln(o_totalprice) * 1e6 + 0.5) AS a, floor(log10(o_totalprice) * 1e6 + 0.5) AS b, floor(ln(o_totalprice) / ln(2) * 1e6 + 0.5) AS c, floor(exp(1) * 1e6 + 0.5) AS d, floor(exp(1) * 1e6 + 0.5) AS e FROM orders")
_q("floor_ceiling_sign", "MATCH (c:Customer) RETURN c.custkey AS k, floor(c.acctbal) AS f, ceil(c.acctbal) AS g, sign(c.acctbal) AS s, isNaN(c.acctbal) AS n, abs(c.acctbal) AS a", "SELECT c_custkey AS k, floor(c_acctbal) AS f, ceil(c_acctbal) AS g, CAST(sign(c_acctbal) AS BIGINT) AS s, false AS n, abs(c_acctbal) AS a FROM customer")
_q("trigonometry", "MATCH (n:Nation) LET x = n.nationkey / 100.0 RETURN n.nationkey AS k, round(sin(x) * 1e6) AS a, round(cos(x) * 1e6) AS b, round(tan(x) * 1e6) AS c, round(asin(x) * 1e6) AS d, round(acos(x) * 1e6) AS e, round(atan(x) * 1e6) AS f, round(atan2(x, 2) * 1e6) AS g, round(degrees(x) * 1e6) AS h, round(radians(x) * 1e6) AS i, round(haversin(x) * 1e6) AS j, round(pi() * 1e6) AS l", "SELECT n_nationkey AS k, floor(sin(x) * 1e6 + 0.5) AS a, floor(cos(x) * 1e6 + 0.5) AS b, floor(tan(x) * 1e6 + 0.5) AS c, floor(asin(x) * 1e6 + 0.5) AS d, floor(acos(x) * 1e6 + 0.5) AS e, floor(atan(x) * 1e6 + 0.5) AS f, floor(atan2(x, 2) * 1e6 + 0.5) AS g, floor(degrees(x) * 1e6 + 0.5) AS h, floor(radians(x) * 1e6 + 0.5) AS i, floor((1 - cos(x)) / 2 * 1e6 + 0.5) AS j, floor(pi() * 1e6 + 0.5) AS l FROM (SELECT *, n_nationkey / 100.0::DOUBLE AS x FROM nation)")
_q("hyperbolic", "MATCH (n:Nation) LET x = (n.nationkey + 1) / 100.0 RETURN n.nationkey AS k, round(sinh(x) * 1e6) AS a, round(cosh(x) * 1e6) AS b, round(tanh(x) * 1e6) AS c, round(cot(x) * 1e3) AS d", "SELECT n_nationkey AS k, floor((exp(x) - exp(-x)) / 2 * 1e6 + 0.5) AS a, floor((exp(x) + exp(-x)) / 2 * 1e6 + 0.5) AS b, floor((exp(x) - exp(-x)) / (exp(x) + exp(-x)) * 1e6 + 0.5) AS c, floor(cos(x) / sin(x) * 1e3 + 0.5) AS d FROM (SELECT *, (n_nationkey + 1) / 100.0::DOUBLE AS x FROM nation)")

# -- strings and bytes
_q("concatenation", "MATCH (c:Customer) RETURN c.custkey AS k, c.name || '-' || c.mktsegment AS a, c.name + '!' AS b, [c.custkey] || [1] AS l, size([1, 2] + c.custkey) AS n", "SELECT c_custkey AS k, c_name || '-' || c_mktsegment AS a, c_name || '!' AS b, [c_custkey, 1] AS l, CAST(3 AS BIGINT) AS n FROM customer")
_q("trim_forms", "MATCH (c:Customer) LET s = '  ' || c.name || 'xx' RETURN c.custkey AS k, trim(s) AS a, trim(LEADING ' ' FROM s) AS b, trim(TRAILING 'x' FROM s) AS c, trim(BOTH FROM s) AS d, btrim(s, ' x') AS e, ltrim(s) AS f, rtrim(s, 'x') AS g", "SELECT c_custkey AS k, trim(s) AS a, ltrim(s) AS b, rtrim(s, 'x') AS c, trim(s) AS d, trim(s, ' x') AS e, ltrim(s) AS f, rtrim(s, 'x') AS g FROM (SELECT *, '  ' || c_name || 'xx' AS s FROM customer)")
_q("string_parts", "MATCH (p:Part) RETURN p.partkey AS k, left(p.name, 3) AS a, right(p.name, 2) AS b, lower(p.type) AS c, char_length(p.name) AS d, byte_length(p.name) AS e, octet_length(p.type) AS f, reverse(p.name) AS g, replace(p.name, 'a', 'b') AS h", "SELECT p_partkey AS k, left(p_name, 3) AS a, right(p_name, 2) AS b, lower(p_type) AS c, CAST(length(p_name) AS BIGINT) AS d, CAST(strlen(p_name) AS BIGINT) AS e, CAST(strlen(p_type) AS BIGINT) AS f, reverse(p_name) AS g, replace(p_name, 'a', 'b') AS h FROM part")
_q("split_text", "MATCH (p:Part) RETURN p.partkey AS k, split(p.type, ' ') AS s, size(split(p.type, ' ')) AS n", "SELECT p_partkey AS k, string_split(p_type, ' ') AS s, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n FROM part")
_q("normalize_text", "MATCH (t:Turn) RETURN t.conv_id AS c, t.turn AS t, normalize(t.role) AS r", "SELECT conv_id AS c, turn AS t, role AS r FROM conversations")
_q("byte_strings", "MATCH (r:Region) RETURN r.regionkey AS k, byte_length(trim(BOTH X'00' FROM X'0041420000')) AS n, byte_length(left(X'414243', 2)) AS m, byte_length(X'41' || X'4243') AS o", "SELECT r_regionkey AS k, CAST(2 AS BIGINT) AS n, CAST(2 AS BIGINT) AS m, CAST(3 AS BIGINT) AS o FROM region")

# -- lists, records and conversions
_q("list_parts", "MATCH (n:Nation) LET xs = [n.nationkey, n.regionkey, 7] RETURN n.nationkey AS k, head(xs) AS a, last(xs) AS b, tail(xs) AS c, xs[1..] AS d, xs[-1] AS e, trim(xs, 1) AS f, cardinality(xs) AS g, isEmpty(xs) AS h, reverse(xs) AS i", "SELECT n_nationkey AS k, xs[1] AS a, xs[3] AS b, xs[2:] AS c, xs[2:] AS d, xs[3] AS e, xs[1:2] AS f, CAST(3 AS BIGINT) AS g, false AS h, list_reverse(xs) AS i FROM (SELECT *, [CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(7 AS BIGINT)] AS xs FROM nation)")
_q("list_conversions", "MATCH (n:Nation) RETURN n.nationkey AS k, toIntegerList(['1', 'x']) AS a, toFloatList(['1.5']) AS b, toBooleanList(['true', 'no']) AS c, toStringList([1, n.nationkey]) AS d", "SELECT n_nationkey AS k, [1, NULL] AS a, [CAST(1.5 AS DOUBLE)] AS b, [true, NULL] AS c, ['1', CAST(n_nationkey AS VARCHAR)] AS d FROM nation")
_q("or_null_conversions", "MATCH (p:Part) RETURN p.partkey AS k, toIntegerOrNull(p.name) AS a, toFloatOrNull('2.5') AS b, toBooleanOrNull('maybe') AS c, toStringOrNull(p.partkey) AS d", "SELECT p_partkey AS k, CAST(NULL AS BIGINT) AS a, CAST(2.5 AS DOUBLE) AS b, CAST(NULL AS BOOLEAN) AS c, CAST(p_partkey AS VARCHAR) AS d FROM part")
_q("records", "MATCH (c:Customer) LET r = {name: c.name, inner: {k: c.custkey}} RETURN r.name AS n, r.inner.k AS k, size(keys(r)) AS m", "SELECT c_name AS n, c_custkey AS k, CAST(2 AS BIGINT) AS m FROM customer")
_q("map_projection", "MATCH (c:Customer) LET r = c{.custkey, .name, one: 1} RETURN r.custkey AS k, r.name AS n, r.one AS o", "SELECT c_custkey AS k, c_name AS n, CAST(1 AS BIGINT) AS o FROM customer")

# -- paths and elements
_q("path_constructor", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) LET p = PATH[n, e, r] RETURN n.name AS n, path_length(p) AS l, size(nodes(p)) AS k, size(elements(p)) AS m, size(relationships(p)) AS e", "SELECT n_name AS n, CAST(1 AS BIGINT) AS l, CAST(2 AS BIGINT) AS k, CAST(3 AS BIGINT) AS m, CAST(1 AS BIGINT) AS e FROM nation")
_q("path_concatenation", "MATCH (c:Customer)-[e:IN_NATION]->(n:Nation)-[f:IN_REGION]->(r:Region) LET p = PATH[c, e, n] || PATH[n, f, r] RETURN c.custkey AS c, path_length(p) AS l, nodes(p)[2].name AS r", "SELECT c_custkey AS c, CAST(2 AS BIGINT) AS l, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
_q("element_functions", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.name AS n, elementId(n) <> elementId(r) AS a, startNode(e).name AS s, endNode(e).name AS t, properties(r).name AS p, valueType(n.name) AS v", "SELECT n_name AS n, true AS a, n_name AS s, r_name AS t, r_name AS p, 'STRING' AS v FROM nation JOIN region ON r_regionkey = n_regionkey")
_q("points", "MATCH (n:Nation) LET p = point({x: n.nationkey, y: 0}), q = point({x: 0, y: 0}) RETURN n.nationkey AS k, point.distance(p, q) AS d, point.withinBBox(p, q, point({x: 5, y: 5})) AS b", "SELECT n_nationkey AS k, CAST(n_nationkey AS DOUBLE) AS d, n_nationkey <= 5 AS b FROM nation")
_q("clock_functions", "MATCH (r:Region) RETURN r.name AS n, size(randomUUID()) AS u, timestamp() > 1600000000000 AS t, rand() < 1 AS f", "SELECT r_name AS n, CAST(36 AS BIGINT) AS u, true AS t, true AS f FROM region")

# -- time
_q("dates", "MATCH (o:Order) RETURN o.orderkey AS k, date('2020-02-03') AS a, date({year: 2021, month: 5, day: 6}) AS b, DATE '2019-01-02' AS c, CURRENT_DATE > DATE '2020-01-01' AS d", "SELECT o_orderkey AS k, DATE '2020-02-03' AS a, DATE '2021-05-06' AS b, DATE '2019-01-02' AS c, true AS d FROM orders")
_q("times", "MATCH (n:Nation) LET z = zoned_time('12:30:05+01:00'), l = local_time('07:08:09.5') RETURN n.nationkey AS k, z.hour AS a, z.minute AS b, z.offset AS c, l.second AS d, l.nanosecond AS e, TIME '10:11:12'.hour AS f", "SELECT n_nationkey AS k, CAST(12 AS BIGINT) AS a, CAST(30 AS BIGINT) AS b, CAST(60 AS BIGINT) AS c, CAST(9 AS BIGINT) AS d, CAST(500000000 AS BIGINT) AS e, CAST(10 AS BIGINT) AS f FROM nation")
_q("datetimes", "MATCH (n:Nation) RETURN n.nationkey AS k, local_datetime('2020-02-03T04:05:06') AS a, local_datetime({year: 2020, month: 1, day: 2, hour: 3}) AS b, zoned_datetime('2020-02-03T04:05:06+01:00').hour AS c, CURRENT_TIMESTAMP > zoned_datetime('2020-01-01T00:00:00Z') AS d", "SELECT n_nationkey AS k, TIMESTAMP '2020-02-03 04:05:06' AS a, TIMESTAMP '2020-01-02 03:00:00' AS b, CAST(3 AS BIGINT) AS c, true AS d FROM nation")
_q("durations", "MATCH (n:Nation) LET d = DURATION 'P1Y2M3DT4H5M6S', i = INTERVAL '1-2' YEAR TO MONTH, r = duration({days: 2, hours: 3}) RETURN n.nationkey AS k, d.months AS a, d.days AS b, d.seconds AS c, i.months AS e, r.days AS f, r.hours AS g, (d + r).days AS h, (d * 2).months AS j", "SELECT n_nationkey AS k, CAST(14 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(14706 AS BIGINT) AS c, CAST(14 AS BIGINT) AS e, CAST(2 AS BIGINT) AS f, CAST(3 AS BIGINT) AS g, CAST(5 AS BIGINT) AS h, CAST(28 AS BIGINT) AS j FROM nation")
_q("date_arithmetic", "MATCH (o:Order) LET d = date('2020-01-30') + DURATION 'P1M2D', t = local_datetime('2020-01-01T00:00:00') - DURATION 'PT1H' RETURN o.orderkey AS k, d, t", "SELECT o_orderkey AS k, DATE '2020-03-02' AS d, TIMESTAMP '2019-12-31 23:00:00' AS t FROM orders")
_q("duration_between", "MATCH (n:Nation) LET d = duration_between(date('2020-01-01'), date('2021-03-04')) RETURN n.nationkey AS k, d.months AS m, d.days AS d", "SELECT n_nationkey AS k, CAST(14 AS BIGINT) AS m, CAST(3 AS BIGINT) AS d FROM nation")
_q("time_functions", "MATCH (n:Nation) RETURN n.nationkey AS k, date.truncate('month', date('2020-02-17')) AS a, datetime.fromepochmillis(1000).second AS b, duration.inDays(date('2020-01-01'), date('2020-02-01')).days AS c", "SELECT n_nationkey AS k, DATE '2020-02-01' AS a, CAST(1 AS BIGINT) AS b, CAST(31 AS BIGINT) AS c FROM nation")
_q("literals", "MATCH (n:Nation) RETURN n.nationkey AS k, 0x1F AS a, 0o17 AS b, 0b101 AS c, 1_000 AS d, 1.5e2 AS e, 'it''s' AS f, TRUE AS g, UNKNOWN AS h, null AS i", "SELECT n_nationkey AS k, CAST(31 AS BIGINT) AS a, CAST(15 AS BIGINT) AS b, CAST(5 AS BIGINT) AS c, CAST(1000 AS BIGINT) AS d, CAST(150 AS DOUBLE) AS e, 'it''s' AS f, true AS g, CAST(NULL AS BOOLEAN) AS h, CAST(NULL AS INTEGER) AS i FROM nation")
