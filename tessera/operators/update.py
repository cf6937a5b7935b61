"""Graph updates: each makes a new version of the graph's tables."""

from __future__ import annotations

from dataclasses import replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.graph import EdgeTable, NodeTable
from ..frontend.lexer import QueryError
from ..frontend.tree import Node
from .lower import Lower, fresh
from .paths import _cut
from .values import EdgeVar, NodeVar, name_of

_serial = count(1)


def _new_id() -> Column:
    """An id for a new element: negative, so that it meets none of a loaded table."""
    nonce = F.lit(f"{next(_serial)}")
    return -F.pmod(F.xxhash64(F.monotonically_increasing_id(), nonce), F.lit(2**62)) - 1


def _labels(n: Node | None) -> list[str]:
    if n is None:
        return []
    if n.kind == "label":
        return [n.name]
    if n.op != "&":
        raise QueryError("a new element needs plain labels", code="insert")
    return [x for a in n.args for x in _labels(a)]


class Updater(Lower):
    """A working table that may change its graph."""

    def fork(self) -> "Updater":
        out = Updater(self.spark, self.graph, self.params, self.session)
        out.df, out.scope = self.df, dict(self.scope)
        return out

    def pin(self) -> None:
        """Fixes the working table, so that ids given to its rows stay the same in every later job."""
        self.df = _cut(self.frame())

    # ------------------------------------------------------------ insert

    def _do_insert(self, c: Node) -> None:
        for part in c.parts:
            self.insert(part)

    def insert(self, part: Node) -> None:
        chain = part.alternatives[0]
        made: list[tuple[str, object, list[str]]] = []
        for p in chain[::2]:
            if p.var in self.scope:
                if p.labels is not None or p.props:
                    raise QueryError(f"{p.var} is bound already", code="variable-already-bound")
                continue
            labels = sorted(_labels(p.labels))
            props = self.props(p)
            v = NodeVar(fresh(p.var), fresh("labels"), {k: fresh(k) for k, _ in props})
            self.keep(lambda d, v=v, labels=labels, props=props: d.withColumns({v.id: _new_id(), v.labels: F.array(*[F.lit(x) for x in labels]).cast("array<string>")} | {v.props[k]: e for k, e in props}))
            self.scope[p.var] = v
            made.append(("node", v, labels))
        for i in range(1, len(chain), 2):
            p = chain[i]
            kinds = _labels(p.labels)
            if len(kinds) != 1:
                raise QueryError("a new edge needs one type", code="insert")
            a, b = self.scope[chain[i - 1].var], self.scope[chain[i + 1].var]
            if p.direction == "left":
                a, b = b, a
            props = self.props(p)
            e = EdgeVar(*(fresh(x) for x in ("id", "type", "src", "dst", "directed")), {k: fresh(k) for k, _ in props})
            cols = {e.id: _new_id(), e.type: F.lit(kinds[0]), e.src: name_of(a.id), e.dst: name_of(b.id), e.directed: F.lit(not p.undirected)} | {e.props[k]: x for k, x in props}
            self.keep(lambda d, cols=cols: d.withColumns(cols))
            self.scope[p.var] = e
            made.append(("edge", e, kinds))
        self.pin()
        for kind, v, names in made:
            own = [name_of(v.props[k]).alias(k) for k in v.props]
            if kind == "node":
                table = NodeTable(frozenset(names), self.df.select(name_of(v.id).alias("_id"), name_of(v.labels).alias("_labels"), *own))
                self.graph = replace(self.graph, nodes=(*self.graph.nodes, table))
            else:
                rows = self.df.select(name_of(v.id).alias("_id"), name_of(v.src).alias("_src"), name_of(v.dst).alias("_dst"), *own)
                self.graph = replace(self.graph, edges=(*self.graph.edges, EdgeTable(names[0], rows)))

    def props(self, p: Node) -> list[tuple[str, Column]]:
        if p.props and p.props[0][0] is None:
            return [(k, self.lit(v).col) for k, v in self.params[p.props[0][1].name].items()]
        return [(k, self.ex(e).col) for k, e in p.props]

    # ------------------------------------------------------------ set and remove

    def _do_set_items(self, c: Node) -> None:
        self.assign(c.items, None)

    def assign(self, items: list[Node], mask: str | None) -> None:
        """SET items, for the rows of ``mask`` only if that is given."""
        for s in items:
            if s.kind == "set_label":
                names = _labels(s.label)
                self.relabel(self.var(s.var.name), lambda old, names=names: F.array_union(old, F.array(*[F.lit(x) for x in names])), mask, frozenset())
            elif s.target.kind == "prop":
                self.write(s.target.value, {s.target.name: s.value}, False, mask)
            elif s.value.kind == "record":
                self.write(s.target, dict(s.value.fields), s.op == "=", mask)
            elif s.value.kind == "param":
                self.write(s.target, {k: Node("lit", value=v) for k, v in self.params[s.value.name].items()}, s.op == "=", mask)
            else:
                other = self.var(s.value.name)
                self.write(s.target, {k: Node("prop", value=s.value, name=k) for k in other.props}, s.op == "=", mask)

    def _do_remove(self, c: Node) -> None:
        for r in c.items:
            if r.kind == "remove_property":
                self.write(r.target.value, {r.target.name: Node("lit", value=None)}, False, None)
            else:
                names = _labels(r.label)
                self.relabel(self.var(r.var.name), lambda old, names=names: F.array_except(old, F.array(*[F.lit(x) for x in names])), None, frozenset(names))

    def write(self, target: Node, values: dict[str, Node], all_: bool, mask: str | None) -> None:
        v = self.var(target.name) if target.kind == "var" else None
        if not isinstance(v, (NodeVar, EdgeVar)):
            raise QueryError("only properties of nodes and edges can be set", code="set")
        new = {k: self.ex(e).col for k, e in values.items()}
        if all_:
            new = {k: F.lit(None) for k in v.props if k not in new} | new
        kinds = {f.name: f.dataType for f in self.frame().schema}
        cols: dict[str, str] = {}
        for k, col in new.items():
            c = fresh(k)
            old = name_of(v.props[k]) if k in v.props else F.lit(None)
            if values.get(k) is not None and values[k].kind == "lit" and values[k].value is None and k in v.props:
                col = F.lit(None).cast(kinds[v.props[k]])
            self.keep(lambda d, c=c, col=col, old=old: d.withColumn(c, col if mask is None else F.when(name_of(mask), col).otherwise(old)))
            cols[k] = c
        self.pin()
        v.props = v.props | cols
        changes = self.df.where(name_of(v.id).isNotNull() if mask is None else name_of(mask) & name_of(v.id).isNotNull())
        rows = changes.select(name_of(v.id).alias("_cid"), *[name_of(c).alias(f"_c_{k}") for k, c in cols.items()]).dropDuplicates(["_cid"])
        self.patch(rows, isinstance(v, NodeVar), lambda d, have: {k: F.when(F.col("_cid").isNotNull(), name_of(f"_c_{k}")).otherwise(name_of(k) if k in have else F.lit(None)) for k in cols})

    def relabel(self, v: NodeVar, change, mask: str | None, gone: frozenset[str]) -> None:
        c = fresh("labels")
        self.keep(lambda d: d.withColumn(c, change(name_of(v.labels)) if mask is None else F.when(name_of(mask), change(name_of(v.labels))).otherwise(name_of(v.labels))))
        self.pin()
        v.labels = c
        rows = self.df.where(name_of(v.id).isNotNull()).select(name_of(v.id).alias("_cid"), name_of(c).alias("_c_l")).dropDuplicates(["_cid"])
        self.patch(rows, True, lambda d, have: {"_labels": F.coalesce("_c_l", "_labels")})
        self.graph = replace(self.graph, nodes=tuple(replace(t, labels=t.labels - gone, open=True) for t in self.graph.nodes))

    def patch(self, rows: DataFrame, nodes: bool, change) -> None:
        """Joins changes (_cid, ...) to every node or edge table."""

        def one(t):
            have = set(t.df.columns)
            return replace(t, df=t.df.join(rows, t.df["_id"] == rows["_cid"], "left").withColumns(change(t.df, have)).drop(*[c for c in rows.columns if c not in have]))

        if nodes:
            self.graph = replace(self.graph, nodes=tuple(map(one, self.graph.nodes)))
        else:
            self.graph = replace(self.graph, edges=tuple(map(one, self.graph.edges)))

    # ------------------------------------------------------------ delete

    def _do_delete(self, c: Node) -> None:
        self.pin()
        nodes, edges = [], []
        for e in c.items:
            v = self.var(e.name) if e.kind == "var" else None
            if not isinstance(v, (NodeVar, EdgeVar)):
                raise QueryError("only nodes and edges can be deleted", code="delete")
            (nodes if isinstance(v, NodeVar) else edges).append(self.df.select(name_of(v.id).alias("_gone")).where("_gone is not null"))
        drop = lambda d, key, gone: d.join(gone, d[key] == gone["_gone"], "left_anti")
        g = self.graph
        for gone in edges:
            g = replace(g, edges=tuple(replace(t, df=drop(t.df, "_id", gone)) for t in g.edges))
        for gone in nodes:
            if not c.detach:
                for t in g.edges:
                    for end in ("_src", "_dst"):
                        if t.df.join(gone, t.df[end] == gone["_gone"], "left_semi").head(1):
                            raise QueryError("a node still has edges; DETACH DELETE takes them too", code="delete")
            g = replace(g, nodes=tuple(replace(t, df=drop(t.df, "_id", gone)) for t in g.nodes), edges=tuple(replace(t, df=drop(drop(t.df, "_src", gone), "_dst", gone)) for t in g.edges))
        self.graph = g

    # ------------------------------------------------------------ merge

    def _do_merge(self, c: Node) -> None:
        """Makes what no row finds, once for equal values, then matches again on the new graph."""
        match = Node("match", optional=False, mode="different", parts=[c.part], keep=None, where=None, shown=None)
        elements = [n for n in c.part.alternatives[0]]
        values = [(p, k, e) for p in elements for k, e in p.props]
        wanted = [self.add(self.ex(e), "merge") for _, _, e in values]
        self.pin()
        bound = [self.scope[p.var].id for p in elements if p.var in self.scope]
        keys = [*dict.fromkeys(bound + wanted)]
        found = self.fork()
        found.match(match)
        have = found.frame().select(*keys).distinct() if keys else found.frame().limit(1).select()
        missing = self.fork()
        if keys:
            named = {k: fresh("key") for k in keys}
            right = have.withColumnsRenamed(named)
            test = None
            for k in keys:
                one = name_of(k).eqNullSafe(name_of(named[k]))
                test = one if test is None else test & one
            missing.df = missing.frame().join(right, test, "left_anti").dropDuplicates(keys)
        else:
            one = have.withColumn(fresh("one"), F.lit(1))
            missing.df = missing.frame().join(one, F.lit(True), "left_anti").limit(1)
        made_vars = [p.var for p in elements if p.var not in self.scope]
        missing.insert(c.part)
        self.graph = missing.graph
        old = set(self.scope)
        self.match(match)
        new = next((self.scope[v] for v in made_vars if v in self.scope and v not in old), None)
        if new is not None and (c.on_create or c.on_match):
            ids = missing.df.select(name_of(missing.scope[next(v for v in made_vars if v not in old)].id).alias("_made"))
            flag, other = fresh("made"), fresh("found")
            self.df = self.frame().join(ids.withColumn(flag, F.lit(True)), name_of(new.id) == F.col("_made"), "left").drop("_made")
            self.df = self.df.withColumn(flag, F.coalesce(name_of(flag), F.lit(False))).withColumn(other, ~name_of(flag))
            self.assign(c.on_create, flag)
            self.assign(c.on_match, other)
