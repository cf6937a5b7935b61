"""Sharding by a hierarchical weighted hash tree.

Shards hang in a tree: region, rack, shard. At every level a row draws
``-ln(u) / weight`` for each child, where u is a hash of the row's key and the
child's name, and descends to the child with the least draw, so a child gets
rows in proportion to its weight. Changing the weight of one subtree moves rows
only into or out of it: the draws of the other children stay as they were.

A new shard comes as a region of its own. The weights inside the old regions do
not change, so every row either stays or moves into the new shard, for any
number of added shards (law ``key``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

BASE_SHARDS, RACKS, SHARDS_PER_RACK = 16, 2, 2
#: Chunks in which a shard's slots are numbered; shards x chunks rows are broadcast.
SLOT_CHUNKS = 256
_LEVELS = 3


@dataclass
class Node:
    name: str
    weight: float
    children: list["Node"] = field(default_factory=list)
    shard: int = -1


def topology(shards: int, base: int = BASE_SHARDS, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> Node:
    """The tree of ``shards`` shards: the first ``base`` fill regions, each later one is a region.

    Filling the base itself shard by shard is not part of the law; it holds from
    ``base`` shards on. With fewer than ``base`` each shard is its own region, so it holds there too.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    leaf = lambda i: Node(f"shard-{i}", 1.0, shard=i)
    alone = lambda i: Node(f"region-of-{i}", 1.0, [Node(f"rack-of-{i}", 1.0, [leaf(i)])])
    if shards < base:
        return Node("root", float(shards), [alone(i) for i in range(shards)])
    regions, size = [], racks * per_rack
    for r in range(0, base, size):
        held = list(range(r, min(base, r + size)))
        in_racks = [held[i : i + per_rack] for i in range(0, len(held), per_rack)]
        nodes = [Node(f"rack-{x[0] // per_rack}", float(len(x)), [leaf(i) for i in x]) for x in in_racks]
        regions.append(Node(f"region-{r // size}", float(len(held)), nodes))
    regions += [alone(i) for i in range(base, shards)]
    return Node("root", float(shards), regions)


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 52 bits of an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def place(key: Column, tree: Node) -> Column:
    """The shard of ``key``: one weighted draw among the children at each level."""
    table: dict[str, list[Node]] = {}

    def collect(node: Node) -> None:
        if node.children:
            table[node.name] = node.children
            for c in node.children:
                collect(c)

    collect(tree)
    rows = F.create_map(*[x for name, kids in table.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(c.weight).alias("weight"), F.lit(c.shard).alias("shard")) for c in kids]))])
    at: Column = F.lit(tree.name)
    for level in range(_LEVELS):
        drawn = F.transform(rows[at], lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"), c["shard"].alias("shard")))
        best = F.array_min(drawn)
        at = best["shard"] if level == _LEVELS - 1 else best["name"]
    return at


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = BASE_SHARDS, chunks: int = SLOT_CHUNKS) -> DataFrame:
    """One row per input row: its shard, its slot there, and its shard once one more is added.

    Null ids draw as the empty string. A null text has no bytes (size 1). Repeated
    rows share a shard and get slots of their own; equal ids with other texts share a
    shard too. An empty table gives an empty result. Other columns are ignored.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, topology(shards)).cast("int").alias("shard"),
        place(key, topology(shards + 1)).cast("int").alias("grown_shard"),
    )
    chunk = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 25, 8), 16, 10).cast("long") % chunks
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = gapless_rank(rows, "shard", order, chunk.cast("int"), chunks, "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

