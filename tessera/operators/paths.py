"""Graph patterns as joins: scans, expansions, quantified parts and path search."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frontend.lexer import QueryError
from ..frontend.tree import Node
from .lower import Lower, fresh
from .values import EdgeVar, NodeVar, Value, name_of


@dataclass
class _Step:
    """One repetition of a quantified part: from _s to _t with its edges and the lists it binds."""

    df: DataFrame
    types: frozenset[str]
    lists: dict[str, str] = field(default_factory=dict)  # variable -> array column of one repetition


class Matcher:
    """Joins the patterns of one MATCH onto the working table of ``low``."""

    def __init__(self, low: Lower, match: Node):
        self.low, self.match = low, match
        self.used: list[tuple[str, frozenset[str], bool]] = []  # edge id columns: (column, types, whether a list)

    @property
    def graph(self):
        return self.low.graph

    def run(self) -> None:
        for part in self.ordered(self.match.parts):
            if self.match.keep and not part.search:
                part = part.replace(search=self.match.keep["search"], count=self.match.keep["count"], mode=self.match.keep["mode"] or part.mode)
            self.path(part)

    def ordered(self, parts: list[Node]) -> list[Node]:
        """Parts that share variables with what is bound come first, then the more selective ones."""
        left, out, bound = list(parts), [], set(self.low.scope)
        names = lambda p: {x.var for x in p.walk() if x.kind in ("node", "edge")}
        while left:
            best = max(left, key=lambda p: (bool(names(p) & bound), sum(bool(x.props or x.where) for x in p.walk() if x.kind == "node"), -left.index(p)))
            left.remove(best)
            out.append(best)
            bound |= names(best)
        return out

    # ------------------------------------------------------------ one path

    def path(self, part: Node) -> None:
        if len(part.alternatives) > 1:
            self.alternatives(part)
            return
        chain = part.alternatives[0]
        long_ = [p for p in chain if p.kind == "group" or (p.kind == "edge" and p.low is not None)]
        prune = None
        if part.search in ("shortest", "all_shortest") and part.count == 1 and len(long_) == 1 and len(chain) == 3:
            prune = "any" if part.search == "shortest" else "all"
        elements = self.chain(chain, part.mode, prune, part.var is not None)
        needs_path = part.var is not None or part.search
        if needs_path:
            nodes, edges = self.path_columns(elements)
            if part.search:
                self.search(part, elements, edges)
            if part.var is not None:
                c = fresh(part.var)
                self.low.keep(lambda d: d.withColumn(c, F.struct(nodes.alias("nodes"), edges.alias("edges"))))
                self.low.scope[part.var] = Value(c, "path")

    def alternatives(self, part: Node) -> None:
        """Union of the alternatives over the variables that all of them bind."""
        before, sides = dict(self.low.scope), []
        for a in part.alternatives:
            inner = self.low.fork()
            Matcher(inner, self.match).path(part.replace(alternatives=[a]))
            sides.append(inner)
        common = [k for k in sides[0].scope if k not in before and not k.startswith("_anon") and all(k in s.scope for s in sides)]
        old = [c for v in before.values() for c in v.columns()]
        kinds = self.graph.node_props(), self.graph.edge_props()
        made: dict = {}
        for k in common:
            v = sides[0].scope[k]
            if isinstance(v, NodeVar):
                made[k] = NodeVar(fresh(k), fresh("labels"), {p: fresh(p) for p in kinds[0]})
            elif isinstance(v, EdgeVar):
                made[k] = EdgeVar(*(fresh(x) for x in ("id", "type", "src", "dst", "directed")), {p: fresh(p) for p in kinds[1]})
            else:
                made[k] = Value(fresh(k), v.role)
        out = None
        for s in sides:
            cols: list[Column] = []
            for k in common:
                v, w = s.scope[k], made[k]
                if isinstance(w, Value):
                    cols.append(name_of(v.col).alias(w.col))
                    continue
                fixed = ("id", "labels") if isinstance(w, NodeVar) else ("id", "type", "src", "dst", "directed")
                for a in fixed:
                    src = getattr(v, a)
                    cols.append((name_of(src) if src else F.lit(None).cast("array<string>")).alias(getattr(w, a)))
                for p, t in kinds[0 if isinstance(w, NodeVar) else 1].items():
                    cols.append((name_of(v.props[p]) if p in v.props else F.lit(None)).cast(t).alias(w.props[p]))
            own = s.frame().select(*dict.fromkeys(old), *cols) if old or cols else s.frame().select(F.lit(0).alias("_unit"))
            out = own if out is None else out.unionByName(own)
        keys = [c for v in [*before.values(), *made.values()] for c in [v.id]]
        self.low.df = out if part.bag or not keys else out.dropDuplicates(keys)
        self.low.scope = before | made

    def chain(self, chain: list[Node], mode: str | None, prune: str | None, full: bool) -> list[tuple[str, object]]:
        """Joins a chain's elements; returns what each stands for, in the order of the pattern."""
        at = self.start(chain)
        placed: dict[int, object] = {at: self.node(chain[at])}
        for i in range(at + 1, len(chain) - 1, 2):  # rightwards
            placed[i + 1], placed[i] = self.hop(placed[i - 1], chain[i], chain[i + 1], False, mode, prune, full)
        for i in range(at - 1, 0, -2):  # leftwards
            placed[i - 1], placed[i] = self.hop(placed[i + 1], chain[i], chain[i - 1], True, mode, prune, full)
        return [placed[i] for i in range(len(chain))]

    def start(self, chain: list[Node]) -> int:
        """The node to begin with: one that is bound, else one with a property test, else one with a label."""

        def weight(i: int) -> tuple:
            p = chain[i]
            return p.var in self.low.scope, bool(p.props) * 2 + bool(p.where), p.labels is not None, -i

        return max(range(0, len(chain), 2), key=weight)

    def node(self, p: Node) -> NodeVar:
        """Binds a node by scan, or takes it from the scope."""
        v = self.low.scope.get(p.var)
        if v is None:
            v = self.scan(p)
            self.low.scope[p.var] = v
        elif isinstance(v, Value) and v.role == "value":
            raise QueryError(f"{p.var} is no node", code="variable-type-conflict")
        elif not isinstance(v, NodeVar):
            raise QueryError(f"{p.var} is no node", code="variable-type-conflict")
        elif p.labels is not None:
            self.low.where(Node("labeled", value=Node("var", name=p.var), labels=p.labels))
        self.tests(p)
        return v

    def fields(self, p: Node) -> tuple[DataFrame, NodeVar]:
        scan, props = self.graph.node_scan(p.labels)
        v = NodeVar(fresh(p.var), fresh("labels"), {k: fresh(k) for k in props})
        if scan is None:
            empty = self.low.spark.createDataFrame([], "_id bigint, _labels array<string>")
            return empty.select(F.col("_id").alias(v.id), F.col("_labels").alias(v.labels)), v
        cols = [F.col("_id").alias(v.id), F.col("_labels").alias(v.labels), *[name_of(k).alias(c) for k, c in v.props.items()]]
        return scan.select(*cols), v

    def scan(self, p: Node) -> NodeVar:
        rows, v = self.fields(p)
        self.low.df = rows if self.low.df is None else self.low.df.crossJoin(rows)
        return v

    def tests(self, p: Node) -> None:
        """Property specifications and the WHERE inside an element."""
        for k, value in p.props:
            if k is None:  # a parameter with a map
                for name, one in self.low.params[value.name].items():
                    self.low.where(Node("binary", op="=", left=Node("prop", value=Node("var", name=p.var), name=name), right=Node("lit", value=one)))
            else:
                self.low.where(Node("binary", op="=", left=Node("prop", value=Node("var", name=p.var), name=k), right=value))
        if p.where is not None:
            self.low.where(p.where)

    # ------------------------------------------------------------ hops

    def hop(self, here: NodeVar, edge: Node, to: Node, backwards: bool, mode: str | None, prune: str | None, full: bool) -> tuple[NodeVar, object]:
        if edge.kind == "group" and edge.low is None:
            edge = edge.replace(low=1, high=1, once=True)
        if edge.kind == "group" or edge.low is not None:
            return self.repeat(here, edge, to, backwards, mode, prune, full)
        bound = self.low.scope.get(edge.var)
        if isinstance(bound, EdgeVar):
            e, types = bound, frozenset(t.type for t in self.graph.edges)
            flip = edge.direction == "any"
            go_src, go_dst = (e.dst, e.src) if (edge.direction == "left") != backwards else (e.src, e.dst)
            test = name_of(here.id) == name_of(go_src)
            end = name_of(go_dst)
            if flip:
                test = test | (name_of(here.id) == name_of(go_dst))
                end = F.when(name_of(here.id) == name_of(e.src), name_of(e.dst)).otherwise(name_of(e.src))
            self.low.keep(lambda d: d.where(test))
        else:
            rows, e, ends, types = self.edges(edge, backwards)
            self.low.df = self.low.frame().join(rows, name_of(here.id) == name_of(ends[0]))
            self.low.scope[edge.var] = e
            end = name_of(ends[1])
            self.tests(edge)
            if self.match.mode == "different" and mode not in ("walk",):
                self.distinct(e.id, types, False)
        return self.arrive(end, to), e

    def edges(self, edge: Node, backwards: bool) -> tuple[DataFrame, EdgeVar, tuple[str, str], frozenset[str]]:
        """Edges as seen from one end: (_from, _to) and the edge's own columns."""
        scan, props, types = self.graph.edge_scan(edge.labels)
        e = EdgeVar(*(fresh(x) for x in ("id", "type", "src", "dst", "directed")), {k: fresh(k) for k in props})
        ends = fresh("from"), fresh("to")
        if scan is None:
            empty = self.low.spark.createDataFrame([], "_id bigint, _type string, _src bigint, _dst bigint, _directed boolean")
            scan = empty
        own = [F.col(a).alias(b) for a, b in (("_id", e.id), ("_type", e.type), ("_src", e.src), ("_dst", e.dst), ("_directed", e.directed))] + [name_of(k).alias(c) for k, c in e.props.items()]
        if edge.undirected and edge.direction == "any":
            scan = scan.where(~F.col("_directed"))
        out = lambda d: d.select(F.col("_src").alias(ends[0]), F.col("_dst").alias(ends[1]), *own)
        into = lambda d: d.select(F.col("_dst").alias(ends[0]), F.col("_src").alias(ends[1]), *own)
        direction = edge.direction
        if backwards and direction in ("left", "right"):
            direction = "left" if direction == "right" else "right"
        if direction == "right":
            rows = out(scan)
        elif direction == "left":
            rows = into(scan)
        else:  # a loop is seen once
            rows = out(scan).unionByName(into(scan.where("_src != _dst")))
        return rows, e, ends, types

    def distinct(self, c: str, types: frozenset[str], many: bool) -> None:
        """No edge twice in one match; edges of types that never meet need no test."""
        for other, kinds, listed in self.used:
            if not types & kinds:
                continue
            if many and listed:
                test = ~F.arrays_overlap(name_of(c), name_of(other))
            elif many or listed:
                test = ~F.array_contains(name_of(c if many else other), name_of(other if many else c))
            else:
                test = name_of(c) != name_of(other)
            self.low.keep(lambda d, test=test: d.where(test))
        self.used.append((c, types, many))

    def arrive(self, end: Column, to: Node) -> NodeVar:
        """The node at the other end. A node that nothing asks about is not joined: its id is enough."""
        v = self.low.scope.get(to.var)
        if v is not None:
            if not isinstance(v, NodeVar):
                raise QueryError(f"{to.var} is no node", code="variable-type-conflict")
            self.low.keep(lambda d: d.where(end == name_of(v.id)))
            if to.labels is not None:
                self.low.where(Node("labeled", value=Node("var", name=to.var), labels=to.labels))
            self.tests(to)
            return v
        if not to.named and to.labels is None and not to.props and to.where is None:
            v = NodeVar(fresh("end"), None)
            self.low.keep(lambda d: d.withColumn(v.id, end))
            if to.get("bare"):  # counted by its id
                self.low.scope[to.var] = v
            return v
        rows, v = self.fields(to)
        self.low.df = self.low.frame().join(rows, end == name_of(v.id))
        self.low.scope[to.var] = v
        self.tests(to)
        return v

    # ------------------------------------------------------------ repetition

    def step(self, part: Node, backwards: bool, full: bool) -> _Step:
        """One repetition as a table of its own."""
        inner = Lower(self.low.spark, self.graph, self.low.params, self.low.session)
        once = Node("match", optional=False, mode="different", parts=[], keep=None, where=None, shown=None)
        if part.kind == "edge":
            m = Matcher(inner, once)
            edge = part.replace(low=None, high=None)
            rows, e, ends, types = m.edges(edge, backwards)
            inner.df, inner.scope = rows, {part.var: e}
            m.tests(edge)
            shown = inner.edge_value(e, True).col
            df = inner.frame().select(name_of(ends[0]).alias("_s"), name_of(ends[1]).alias("_t"), F.array(name_of(e.id)).alias("_ids"), F.array(shown).alias("_es"))
            out = _Step(df, types)
            if part.named:
                out.lists[part.var] = "_es"
            return out if not full else self.with_nodes(out)
        parts = []
        for a in part.alternatives:
            own = Lower(self.low.spark, self.graph, self.low.params, self.low.session)
            m = Matcher(own, once)
            elements = m.chain(a, None, None, False)
            if part.where is not None:
                own.where(part.where)
            edges = [x for x in elements if isinstance(x, EdgeVar)]
            first, last = (elements[-1], elements[0]) if backwards else (elements[0], elements[-1])
            listed = {}
            for name, v in own.scope.items():
                if not name.startswith(("_anon", "_")) and isinstance(v, (NodeVar, EdgeVar)):
                    listed[name] = (own.node_value(v, True) if isinstance(v, NodeVar) else own.edge_value(v, True)).col
            cols = {n: f"_g_{n}" for n in listed}
            df = own.frame().select(
                name_of(first.id).alias("_s"), name_of(last.id).alias("_t"),
                F.array(*[name_of(e.id) for e in edges]).alias("_ids"), F.array(*[own.edge_value(e, True).col for e in edges]).alias("_es"),
                *[F.array(c).alias(cols[n]) for n, c in listed.items()],
            )
            parts.append(_Step(df, frozenset(t.type for t in self.graph.edges), cols))
        names = [n for n in parts[0].lists if all(n in p.lists for p in parts)]
        keep = ["_s", "_t", "_ids", "_es", *[parts[0].lists[n] for n in names]]
        df = parts[0].df.select(*keep)
        for p in parts[1:]:
            df = df.unionByName(p.df.select(*keep))
        out = _Step(df if part.bag or len(parts) == 1 else df.dropDuplicates(["_s", "_t", "_ids"]), parts[0].types, {n: parts[0].lists[n] for n in names})
        return out if not full else self.with_nodes(out)

    def with_nodes(self, step: _Step) -> _Step:
        """Adds _n, the node that a repetition ends at, for path values."""
        blank = Node("node", var="n", named=True, labels=None, props=[], where=None)
        rows, v = self.fields(blank)
        shown = Lower(self.low.spark, self.graph).node_value(v, True).col
        ends = rows.select(name_of(v.id).alias("_nid"), shown.alias("_n"))
        step.df = step.df.join(ends, F.col("_t") == F.col("_nid")).drop("_nid")
        return step

    def repeat(self, here: NodeVar, part: Node, to: Node, backwards: bool, mode: str | None, prune: str | None, full: bool) -> tuple[NodeVar, object]:
        step = self.step(part, backwards, full)
        low, high = part.low, part.high
        once = bool(part.get("once"))
        starts = self.low.frame().select(name_of(here.id).alias("_s")).distinct()
        found = self.walk(starts, step, low, high, part.get("mode") or mode, prune, full, backwards)
        start, end, ids, hops = fresh("start"), fresh("end"), fresh("ids"), fresh("hops")
        named = {"_s": start, "_t": end, "_ids": ids, "_es": hops} | {c: fresh(n) for n, c in step.lists.items() if c != "_es"}
        if full:
            named["_ns"] = fresh("nodes")
        rows = found.select(*[F.col(a).alias(b) for a, b in named.items()])
        self.low.df = self.low.frame().join(rows, name_of(here.id) == name_of(start)).drop(start)
        for n, c in step.lists.items():
            if once:  # a parenthesized part without a quantifier binds its variables singly
                one = fresh(n)
                self.low.keep(lambda d, c=c, one=one: d.withColumn(one, F.try_element_at(name_of(named[c]), F.lit(1))))
                self.low.scope[n] = Value(one, "element")
            else:
                self.low.scope[n] = Value(named[c], "group")
        if self.match.mode == "different" and mode != "walk":
            self.distinct(ids, step.types, True)
        out = self.arrive(name_of(end), to)
        return out, Value(hops, f"hops:{named.get('_ns', '')}:{int(backwards)}")

    def walk(self, starts: DataFrame, step: _Step, low: int, high: int | None, mode: str | None, prune: str | None, full: bool, backwards: bool) -> DataFrame:
        """Paths of low to high repetitions from the starts, a join a level.

        Bounded levels are one plan. Unbounded ones run level by level until nothing new is
        reached, and each level is cut off in the shared checkpoint folder.
        """
        lists = [c for c in step.lists.values() if c != "_es"]
        kinds = {f.name: f.dataType for f in step.df.schema}
        empty = lambda c: F.array().cast(kinds[c]).alias(c)
        seed = starts.select("_s", F.col("_s").alias("_t"), empty("_ids"), empty("_es"), *[empty(c) for c in lists], *([F.array().cast(f"array<{kinds['_n'].simpleString()}>").alias("_ns")] if full else []), F.array("_s").alias("_seen"))
        move = step.df.select(F.col("_s").alias("_f"), F.col("_t").alias("_to"), F.col("_ids").alias("_i2"), F.col("_es").alias("_e2"), *[F.col(c).alias(f"{c}2") for c in lists], *([F.col("_n").alias("_n2")] if full else []))
        join = (lambda a, b: F.concat(F.col(b), F.col(a))) if backwards else (lambda a, b: F.concat(F.col(a), F.col(b)))
        levels, now, hop = ([seed] if low == 0 else []), seed, 0
        visited = starts.select("_s", F.col("_s").alias("_t")) if prune and low == 0 else None
        endless = high is None and mode == "walk" and prune is None  # on a cycle; other walks run out of edges or of new ends
        stop = Lower.MOST_HOPS if endless else high
        unbounded = high is None or high > 12 or prune is not None
        while stop is None or hop < stop:
            hop += 1
            grown = now.join(move, F.col("_t") == F.col("_f"))
            if mode != "walk" and prune is None:
                grown = grown.where(~F.arrays_overlap("_ids", "_i2"))
            if mode == "acyclic":
                grown = grown.where(~F.array_contains("_seen", F.col("_to")))
            elif mode == "simple":
                inner = F.slice("_seen", 2, F.greatest(F.size("_seen") - 1, F.lit(0)))
                closed = (F.size("_seen") > 1) & (F.col("_t") == F.col("_s"))
                grown = grown.where(~F.array_contains(inner, F.col("_to")) & ~closed)
            now = grown.select(
                "_s", F.col("_to").alias("_t"), join("_ids", "_i2").alias("_ids"), join("_es", "_e2").alias("_es"), *[join(c, f"{c}2").alias(c) for c in lists],
                *([(F.concat(F.array("_n2"), "_ns") if backwards else F.concat("_ns", F.array("_n2"))).alias("_ns")] if full else []), F.concat("_seen", F.array("_to")).alias("_seen"),
            )
            if prune is not None:
                if visited is not None:
                    now = now.join(visited, ["_s", "_t"], "left_anti")
                if prune == "any":
                    now = now.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_t").orderBy("_ids"))).where("_k = 1").drop("_k")
            if unbounded:
                now = _cut(now)
                if not now.head(1):
                    break
                if hop == stop and endless:
                    raise QueryError(f"an unbounded quantifier goes beyond {Lower.MOST_HOPS} repetitions", code="limit")
            if prune is not None:
                reached = now.select("_s", "_t").distinct()
                visited = _cut(reached if visited is None else visited.union(reached)) if hop >= low else visited
            if hop >= low:
                levels.append(now)
        out = levels[0] if levels else seed.limit(0)
        for x in levels[1:]:
            out = out.unionByName(x)
        return out

    # ------------------------------------------------------------ paths

    def path_columns(self, elements: list) -> tuple[Column, Column]:
        """The arrays of nodes and of edges of a matched chain."""
        nodes, edges = [], []
        for i, x in enumerate(elements):
            if isinstance(x, NodeVar):
                before = elements[i - 1] if i else None
                if isinstance(before, Value) and before.role.endswith(":0") and before.role.split(":")[1]:
                    continue  # the repetition ends at this node and lists it
                after = elements[i + 1] if i + 1 < len(elements) else None
                if isinstance(after, Value) and after.role.endswith(":1") and after.role.split(":")[1]:
                    continue
                nodes.append(F.array(self.low.node_value(self.whole(x), True).col))
            elif isinstance(x, EdgeVar):
                edges.append(F.array(self.low.edge_value(x, True).col))
            else:
                edges.append(name_of(x.col))
                listed = x.role.split(":")[1]
                if listed:
                    nodes.append(name_of(listed))
        none = F.array().cast("array<string>")
        return (F.concat(*nodes) if nodes else none), (F.concat(*edges) if edges else none)

    def whole(self, v: NodeVar) -> NodeVar:
        """A node whose columns are there; one known by its id alone is joined now."""
        if v.labels is not None:
            return v
        rows, own = self.fields(Node("node", var="n", named=True, labels=None, props=[], where=None))
        self.low.df = self.low.frame().join(rows, name_of(v.id) == name_of(own.id))
        return own

    def search(self, part: Node, elements: list, edges: Column) -> None:
        """Keeps the wanted paths of each pair of ends; ties are settled by the edges' ids."""
        size, key, at = fresh("size"), fresh("key"), fresh("at")
        ends = [elements[0].id, elements[-1].id]
        keys = ends + [v.id for v in self.low.scope.values() if isinstance(v, Value) and v.role == "value"]
        self.low.keep(lambda d: d.withColumns({size: F.size(edges), key: F.transform(edges, lambda e: e["id"])}))
        w = Window.partitionBy(*keys)
        if part.search == "all_shortest":
            f, most = F.rank().over(w.orderBy(size)), 1
        elif part.search == "groups":
            f, most = F.dense_rank().over(w.orderBy(size)), part.count
        else:
            f, most = F.row_number().over(w.orderBy(size, key)), part.count
        self.low.keep(lambda d: d.withColumn(at, f).where(name_of(at) <= most).drop(at, size, key))


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)
