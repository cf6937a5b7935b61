"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tessera.plans.bench_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = (
    "comma_patterns", "call_count_zero", "value_count_zero", "exists_of_aggregate", "count_distinct_correlated", "call_otherwise", "unnamed_pattern_list", "table_variable", "simplified_override",
    "horizontal_sum", "path_concatenation", "merge_create_and_match", "list_equality", "times",
)


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    want = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == sorted(got.columns)
    assert sorted([plain(r[c]) for c in sorted(at)] for r in got.collect()) == sorted([plain(r[at[c]]) for c in sorted(at)] for r in want.fetchall())
