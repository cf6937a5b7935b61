"""Property graphs over DataFrames: node tables by label set, edge tables by type."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frontend.lexer import QueryError
from ..frontend.tree import Node

#: Ids of a table are shifted by so many bits; the low bits hold the table's number, so ids of tables never meet.
TAG_BITS = 8


@dataclass(frozen=True)
class NodeTable:
    """``df`` has _id, _labels and property columns. ``labels`` are those of every row; with ``open`` rows may have more."""

    labels: frozenset[str]
    df: DataFrame
    open: bool = False

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]


@dataclass(frozen=True)
class EdgeTable:
    """``df`` has _id, _src, _dst and property columns. ``unique_src``: a node is the source of one edge of the table at most."""

    type: str
    df: DataFrame
    directed: bool = True
    unique_src: bool = False
    unique_dst: bool = False

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("_")]


def _fixed(n: Node | None, labels: frozenset[str], open_: bool) -> bool | None:
    """What a label expression says of a label set; None if rows decide."""
    if n is None:
        return True
    if n.kind == "label":
        if n.name == "%":
            return True if labels else (None if open_ else False)
        return True if n.name in labels else (None if open_ else False)
    args = [_fixed(a, labels, open_) for a in n.args]
    if n.op == "!":
        return None if args[0] is None else not args[0]
    if n.op == "&":
        return False if False in args else (None if None in args else True)
    return True if True in args else (None if None in args else False)


def label_test(n: Node, labels: F.Column) -> F.Column:
    """A label expression as a test of a label array."""
    if n.kind == "label":
        return F.size(labels) > 0 if n.name == "%" else F.array_contains(labels, n.name)
    args = [label_test(a, labels) for a in n.args]
    if n.op == "!":
        return ~args[0]
    return args[0] & args[1] if n.op == "&" else args[0] | args[1]


def _common(tables: list) -> dict[str, T.DataType]:
    """The properties of tables and the type each has in their union."""
    out: dict[str, T.DataType] = {}
    number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    for t in tables:
        for f in t.df.schema:
            if f.name.startswith("_"):
                continue
            old = out.get(f.name)
            if old is None or isinstance(old, T.NullType):
                out[f.name] = f.dataType
            elif old != f.dataType and not isinstance(f.dataType, T.NullType):
                out[f.name] = T.DoubleType() if isinstance(old, number) and isinstance(f.dataType, number) else T.StringType()
    return out


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable graph; changes make a new one."""

    nodes: tuple[NodeTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    types: tuple | None = field(default=None, compare=False)

    def node_props(self) -> dict[str, T.DataType]:
        return _common(list(self.nodes))

    def edge_props(self) -> dict[str, T.DataType]:
        return _common(list(self.edges))

    def node_scan(self, labels: Node | None) -> tuple[DataFrame | None, dict[str, T.DataType]]:
        """Rows (_id, _labels, properties) that satisfy a label expression; only tables that can are read."""
        parts, tables = [], []
        for t in self.nodes:
            fits = _fixed(labels, t.labels, t.open)
            if fits is False:
                continue
            tables.append(t)
            parts.append(t.df if fits else t.df.where(label_test(labels, F.col("_labels"))))
        return _union(parts, _common(tables), ["_id", "_labels"]), _common(tables)

    def edge_tables(self, labels: Node | None) -> list[EdgeTable]:
        """The edge tables that a label expression admits."""
        return [t for t in self.edges if _fixed(labels, frozenset([t.type]), False)]

    def edge_scan(self, labels: Node | None) -> tuple[DataFrame | None, dict[str, T.DataType], frozenset[str]]:
        """Rows (_id, _type, _src, _dst, _directed, properties) of the edge types of a label expression."""
        tables = self.edge_tables(labels)
        parts = [t.df.withColumns({"_type": F.lit(t.type), "_directed": F.lit(t.directed)}) for t in tables]
        return _union(parts, _common(tables), ["_id", "_type", "_src", "_dst", "_directed"]), _common(tables), frozenset(t.type for t in tables)


def _union(parts: list[DataFrame], props: dict[str, T.DataType], fixed: list[str]) -> DataFrame | None:
    out = None
    for p in parts:
        have = set(p.columns)
        own = p.select(*fixed, *[(F.col(f"`{k}`") if k in have else F.lit(None)).cast(t).alias(k) for k, t in props.items()])
        out = own if out is None else out.unionByName(own)
    return out


class GraphBuilder:
    """Builds a graph from tables. Keys may be integers or strings; tables may use the same key values."""

    def __init__(self) -> None:
        self.kinds: dict[str, tuple[int, bool]] = {}
        self.made_nodes: list[NodeTable] = []
        self.made_edges: list[EdgeTable] = []
        self.tags = 0

    def _tagged(self, key: F.Column, integral: bool, tag: int) -> F.Column:
        if integral:
            return F.shiftleft(key.cast("long"), TAG_BITS).bitwiseOR(F.lit(tag))
        return F.shiftleft(F.xxhash64(key), TAG_BITS).bitwiseOR(F.lit(tag))

    def node(self, name: str, df: DataFrame, key: str, labels: list[str] | None = None, props: dict[str, str] | None = None) -> "GraphBuilder":
        """Nodes of ``df`` by the column or expression ``key``; ``props`` maps property names to columns or expressions.

        String keys are hashed to 64 bits, of which the tag takes eight.
        """
        self.tags += 1
        keyed = df.withColumn("_key", F.expr(key))
        integral = not isinstance(keyed.schema["_key"].dataType, T.StringType)
        self.kinds[name] = (self.tags, integral)
        own = labels or [name]
        given = props if props is not None else {c: f"`{c}`" for c in df.columns}
        cols = [F.expr(e).alias(p) for p, e in given.items()]
        out = keyed.select(self._tagged(F.col("_key"), integral, self.tags).alias("_id"), F.array(*[F.lit(x) for x in own]).alias("_labels"), *cols)
        self.made_nodes.append(NodeTable(frozenset(own), out))
        return self

    def edge(self, kind: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], key: str | None = None, props: dict[str, str] | None = None, directed: bool = True) -> "GraphBuilder":
        """Edges of type ``kind``; src and dst are (node table, key expression). Without ``key`` the whole row is hashed.

        ``key`` is unique in ``df``, so an end with the same expression has one edge at most.
        """
        self.tags += 1
        ends = [self._tagged(F.expr(e), self.kinds[n][1], self.kinds[n][0]) for n, e in (src, dst)]
        ident = self._tagged(F.expr(key) if key else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), True, self.tags)
        cols = [F.expr(e).alias(p) for p, e in (props or {}).items()]
        out = df.select(ident.alias("_id"), ends[0].alias("_src"), ends[1].alias("_dst"), *cols)
        self.made_edges.append(EdgeTable(kind, out, directed, key == src[1], key == dst[1]))
        return self

    def build(self) -> PropertyGraph:
        return PropertyGraph(tuple(self.made_nodes), tuple(self.made_edges))


def check_type(graph: PropertyGraph, types: list[Node]) -> PropertyGraph:
    """A graph whose tables all fit a closed graph type."""
    allowed = {_names(t.node.labels or (t.node.name and Node("label", name=t.node.name))) for t in types if t.kind == "node_type"}
    for t in graph.nodes:
        if allowed and t.labels not in allowed:
            raise QueryError(f"the graph type has no node type for labels {sorted(t.labels)}", code="type")
    return replace(graph, types=tuple(types))


def _names(n: Node | None) -> frozenset[str]:
    return frozenset(x.name for x in n.walk() if x.kind == "label") if n else frozenset()
