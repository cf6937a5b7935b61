"""Sessions: named graphs, parameters, procedures, and running program text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog.graph import PropertyGraph, check_type
from .frontend.lexer import QueryError
from .frontend.parser import parse
from .frontend.tree import Node
from .operators.lower import Lower


class Session:
    """Runs GQL and Cypher text over graphs. Graphs are immutable; an update makes a new version."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, name: str = "home"):
        self.spark, self.graphs, self.current = spark, {name: graph or PropertyGraph()}, name
        self.home = name
        self.params: dict[str, Any] = {}
        self.macros: dict[str, Any] = {}
        self.procedures: dict[str, Callable[..., DataFrame]] = {}
        self.functions: dict[str, Callable] = {}
        self.tables: dict[str, Any] = {}
        self.schemas: set[str] = set()
        self.types: dict[str, Any] = {}
        self.indexes: dict[str, str] = {}
        self.constraints: dict[str, Node] = {}
        self.saved: dict[str, PropertyGraph] | None = None
        self.read_only = False

    def graph(self, name: str) -> PropertyGraph:
        key = {"CURRENT_GRAPH": self.current, "HOME_GRAPH": self.home}.get(name.upper(), name)
        if key not in self.graphs:
            raise QueryError(f"no graph {name}", code="catalog")
        return self.graphs[key]

    def run(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The result of a program's last statement. Statements without a result give an empty table."""
        out: DataFrame | None = None
        for s in parse(text, self.params | (params or {}), self.macros):
            out = self.statement(s, self.params | (params or {}))  # a statement may have set some
        return out

    def _empty(self) -> DataFrame:
        return self.spark.range(0).select()

    def statement(self, s: Node, params: dict[str, Any]) -> DataFrame:
        if s.kind in ("explain", "profile"):
            got = self.statement(s.query, params)
            plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            rows = [(plan, got.count() if s.kind == "profile" else None)]
            return self.spark.createDataFrame(rows, "plan string, rows bigint")
        if s.kind in ("session", "transaction", "ddl"):
            getattr(self, f"_{s.kind}")(s)
            return self._empty()
        if s.kind == "at_schema":
            return self.statement(s.body, params)
        if any(n.kind in ("insert", "merge", "set_items", "remove", "delete") for n in s.walk()):
            if self.read_only:
                raise QueryError("the transaction is read only", code="transaction")
            from .operators.update import Updater

            low = Updater(self.spark, self.graph(self.current), params, self)
            low.query(s)
            self.graphs[self.current] = low.graph
        else:
            low = Lower(self.spark, self.graph(self.current), params, self)
            low.query(s)
        if not _returns(s):
            return self._empty()
        return low.result() if low.scope else low.frame().select()

    def _session(self, s: Node) -> None:
        if s.op == "zone":
            self.spark.conf.set("spark.sql.session.timeZone", str(s.value.value))
        elif s.op == "graph":
            self.graph(s.name)
            self.current = s.name
        elif s.op == "param":
            self.params[s.name] = s.value.value if s.value.kind == "lit" else Lower(self.spark, PropertyGraph(), self.params, self).frame().select(Lower(self.spark, PropertyGraph(), self.params, self).ex(s.value).col).head()[0]
        elif s.op in ("reset", "close"):
            self.params, self.current, self.read_only = {}, self.home, False

    def _transaction(self, s: Node) -> None:
        if s.op == "start":
            self.saved, self.read_only = dict(self.graphs), s.mode == "only"
        elif self.saved is None:
            raise QueryError("no transaction is open", code="transaction")
        else:
            if s.op == "rollback":
                self.graphs = self.saved
            self.saved, self.read_only = None, False

    def _ddl(self, s: Node) -> None:
        store = {"schema": self.schemas, "graph": self.graphs, "graph_type": self.types, "index": self.indexes, "constraint": self.constraints}[s.what]
        name = s.name or f"{s.what}_{len(store)}"
        if s.drop:
            if name not in store:
                if s.quiet:
                    return
                raise QueryError(f"no {s.what} {name}", code="catalog")
            store.discard(name) if isinstance(store, set) else store.pop(name)
            return
        if name in store and not s.replace:
            if s.quiet:
                return
            raise QueryError(f"{s.what} {name} is there already", code="catalog")
        if s.what == "schema":
            self.schemas.add(name)
        elif s.what == "graph_type":
            self.types[name] = s.types
        elif s.what == "graph":
            graph = self.graph(s.copy) if s.copy else PropertyGraph()
            types = self.types.get(s.types) if isinstance(s.types, str) else s.types
            if s.like:
                types = self.graph(s.like).types
            self.graphs[name] = check_type(graph, list(types)) if types else graph
        elif s.what == "index":
            self.indexes[name] = s.get("text", "")  # Spark has no index: kept as a hint for the layout of tables
        else:
            self._check_constraint(s)
            self.constraints[name] = s

    def _check_constraint(self, s: Node) -> None:
        """Refuses a constraint that the current graph breaks."""
        element, on = s.on
        var = next(n.var for n in element.walk() if n.kind in ("node", "edge") and n.named)
        low = Lower(self.spark, self.graph(self.current), {}, self)
        low.match(Node("match", optional=False, mode="different", parts=[element], keep=None, where=None, shown=None))
        cols = [low.ex(e).col for e in on]
        rows = low.frame().select(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
        names = rows.columns
        bad = None
        if "NULL" in (s.rule or "") or "KEY" in (s.rule or ""):
            bad = rows.where(" or ".join(f"{n} is null" for n in names)).limit(1)
            if bad.head(1):
                raise QueryError("the graph breaks the constraint: a property is missing", code="constraint")
        if "UNIQUE" in (s.rule or "") or "KEY" in (s.rule or ""):
            bad = rows.dropna().groupBy(*names).count().where("count > 1").limit(1)
            if bad.head(1):
                raise QueryError("the graph breaks the constraint: a value repeats", code="constraint")


def _returns(s: Node) -> bool:
    """Whether a query ends with a result."""
    if s.kind == "next":
        return _returns(s.then)
    if s.kind == "set":
        return _returns(s.left)
    last = s.clauses[-1]
    return last.kind in ("project", "select", "page", "procedure", "call")
