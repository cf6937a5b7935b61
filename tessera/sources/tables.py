"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.graph import GraphBuilder, PropertyGraph


def _short(df, prefix: str) -> dict[str, str]:
    return {c.removeprefix(prefix): f"`{c}`" for c in df.columns}


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, orders, parts, suppliers, nations, regions and turns of conversations, with their edges.

    All tables are plain selects, so filters and columns reach the Parquet scan. An edge that joins two
    tables by a key is read from the table that holds the key.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    t = {x: read(x) for x in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "conversations")}
    turn_key = f"conv_id * {1 << 20} + turn"
    turns = t["conversations"]
    b = GraphBuilder()
    b.node("Customer", t["customer"], "c_custkey", props=_short(t["customer"], "c_"))
    b.node("Order", t["orders"], "o_orderkey", props=_short(t["orders"], "o_"))
    b.node("Part", t["part"], "p_partkey", props=_short(t["part"], "p_"))
    b.node("Supplier", t["supplier"], "s_suppkey", props=_short(t["supplier"], "s_"))
    b.node("Nation", t["nation"], "n_nationkey", props=_short(t["nation"], "n_"))
    b.node("Region", t["region"], "r_regionkey", props=_short(t["region"], "r_"))
    b.node("Turn", turns, turn_key, props={c: f"`{c}`" for c in turns.columns})
    b.edge("PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey")
    b.edge("CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), None, _short(t["lineitem"], "l_"))
    b.edge("SHIPPED", t["lineitem"], ("Supplier", "l_suppkey"), ("Order", "l_orderkey"), None, _short(t["lineitem"], "l_"))
    b.edge("IN_NATION", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey")
    b.edge("BASED_IN", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey")
    b.edge("IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey")
    later = turns.select("conv_id", F.col("turn").cast(T.LongType()).alias("turn")).where("turn > 0")
    b.edge("NEXT", later, ("Turn", f"conv_id * {1 << 20} + turn - 1"), ("Turn", turn_key), turn_key)
    return b.build()


def from_mapping(spark: SparkSession, mapping: dict) -> PropertyGraph:
    """A graph from a description: {"nodes": [{name, path, format, key, labels, props}], "edges": [{type, path, format, src, dst, key, props}]}."""
    b = GraphBuilder()
    load = lambda x: spark.read.format(x.get("format", "parquet")).options(**x.get("options", {})).load(x["path"])
    for n in mapping.get("nodes", ()):
        b.node(n["name"], load(n), n["key"], n.get("labels"), n.get("props"))
    for e in mapping.get("edges", ()):
        b.edge(e["type"], load(e), tuple(e["src"]), tuple(e["dst"]), e.get("key"), e.get("props"), e.get("directed", True))
    return b.build()
