"""Lowering of clauses and expressions to DataFrames.

The working table is a DataFrame in which a variable is a bundle of columns: a node is
its id, labels and properties, so that Catalyst prunes what a query does not read.
Joins come from shared variables. Subqueries are not run per row: the outer variables
they use are carried through them once, distinct, and the result is joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.graph import PropertyGraph, label_test
from ..frontend.lexer import QueryError
from ..frontend.parser import AGGREGATES
from ..frontend.tree import Node
from ..functions import registry
from . import factor
from .values import Bound, EdgeVar, Expr, NodeVar, Value, Var, name_of

_serial = count()


def fresh(hint: str) -> str:
    return f"_{next(_serial)}_{''.join(c if c.isalnum() else '_' for c in hint)}"


def cast_name(text: str) -> str:
    """The Spark type of a GQL type name."""
    base = text.replace(" NOT NULL", "").strip()
    if base.startswith(("LIST<", "ARRAY<")):
        return f"array<{cast_name(base[base.index('<') + 1 : -1])}>"
    head, _, args = base.partition("(")
    args = f"({args}" if args else ""
    #: Fixed value: type names of the language and Spark's.
    names = {
        "BOOL": "boolean", "BOOLEAN": "boolean", "STRING": "string", "CHAR": "string", "VARCHAR": "string", "BYTES": "binary", "BINARY": "binary", "VARBINARY": "binary",
        "INT8": "tinyint", "INT16": "smallint", "SMALLINT": "smallint", "INT32": "int", "INT": "bigint", "INTEGER": "bigint", "INT64": "bigint", "BIGINT": "bigint", "SIGNED INTEGER": "bigint",
        "UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "UINT": "decimal(20,0)", "FLOAT16": "float", "FLOAT32": "float", "REAL": "float", "FLOAT": "double", "FLOAT64": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double",
        "DECIMAL": "decimal", "DEC": "decimal", "DATE": "date", "LOCAL DATETIME": "timestamp_ntz", "TIMESTAMP WITHOUT TIME ZONE": "timestamp_ntz", "ZONED DATETIME": "timestamp", "TIMESTAMP": "timestamp", "DATETIME": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp",
    }
    if head.strip() not in names:
        raise QueryError(f"type {text} has no counterpart here", code="type")
    return names[head.strip()] + (args if head.strip() in ("DECIMAL", "DEC") else "")


class Lower:
    """One working table and its scope."""

    #: How far an unbounded quantifier is followed before it is refused, where walks may repeat edges and no search ends them.
    MOST_HOPS = 64

    def __init__(self, spark: SparkSession, graph: PropertyGraph, params: dict[str, Any] | None = None, session: Any = None):
        self.spark, self.graph, self.params, self.session = spark, graph, params or {}, session
        self.df: DataFrame | None = None  # None: one row without columns
        self.scope: dict[str, Var] = {}
        self.known: dict[Node, Expr] = {}  # expressions that are columns already (grouping keys, aggregates)
        self.outer_rows: DataFrame | None = None  # in a subquery: the distinct outer rows it runs for
        self.weights: list[str] = []  # how many rows a row stands for, as columns to multiply

    # ------------------------------------------------------------ working table

    def frame(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1).select(F.lit(0).alias("_unit"))
        return self.df

    def fork(self) -> "Lower":
        out = Lower(self.spark, self.graph, self.params, self.session)
        out.df, out.scope, out.imported, out.partition, out.outer_rows = self.df, dict(self.scope), self.imported, self.partition, self.outer_rows
        return out

    def keep(self, f: Callable[[DataFrame], DataFrame]) -> None:
        self.df = f(self.frame())

    def add(self, e: Expr, hint: str) -> str:
        c = fresh(hint)
        self.df = self.frame().withColumn(c, e.col)
        return c

    # ------------------------------------------------------------ expressions

    def expr(self, col: Column, kind: T.DataType | None = None) -> Expr:
        return Expr(col, col, self.frame, kind)

    def lit(self, v: Any) -> Expr:
        if isinstance(v, (list, tuple)):
            return self.array([self.lit(x) for x in v])
        if isinstance(v, dict):
            return self.struct([(k, self.lit(x)) for k, x in v.items()])
        if isinstance(v, bool) or v is None:
            return self.expr(F.lit(v))
        if isinstance(v, int):
            return self.expr(F.lit(v).cast("bigint"), T.LongType())
        return self.expr(F.lit(v))

    def array(self, items: list[Expr]) -> Expr:
        if not items:
            return self.expr(F.array().cast("array<string>"))
        kinds = {type(e.type) for e in items}
        scalar = (T.StringType, T.BooleanType, T.LongType, T.IntegerType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType)
        if len({_family(e) for e in items} - {"null"}) > 1 and all(issubclass(k, (*scalar, T.NullType)) for k in kinds):
            items = [e.make(lambda c: c.cast("variant")) for e in items]
        return items[0].make(lambda *c: F.array(*c), *items[1:])

    def struct(self, fields: list[tuple[str, Expr]]) -> Expr:
        if not fields:
            return self.expr(F.create_map().cast("map<string,string>"))
        names = [n for n, _ in fields]
        return fields[0][1].make(lambda *c: F.struct(*[x.alias(n) for n, x in zip(names, c, strict=True)]), *[e for _, e in fields[1:]])

    def node_value(self, v: NodeVar, canonical: bool = False) -> Expr:
        kinds = self.graph.node_props() if canonical else None
        props = [(name_of(v.props[k]) if k in v.props else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()] if kinds is not None else [name_of(c).alias(k) for k, c in v.props.items()]
        inner = F.struct(*props) if props else F.lit(None).cast("string")
        labels = name_of(v.labels) if v.labels else F.lit(None).cast("array<string>")
        return self.expr(F.when(name_of(v.id).isNotNull(), F.struct(name_of(v.id).alias("id"), labels.alias("labels"), inner.alias("properties"))))

    def edge_value(self, v: EdgeVar, canonical: bool = False) -> Expr:
        kinds = self.graph.edge_props() if canonical else None
        props = [(name_of(v.props[k]) if k in v.props else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()] if kinds is not None else [name_of(c).alias(k) for k, c in v.props.items()]
        inner = F.struct(*props) if props else F.lit(None).cast("string")
        cols = [name_of(c).alias(a) for c, a in ((v.id, "id"), (v.type, "type"), (v.src, "src"), (v.dst, "dst"))]
        return self.expr(F.when(name_of(v.id).isNotNull(), F.struct(*cols, inner.alias("properties"))))

    def ex(self, n: Node) -> Expr:
        """An expression as a column of the working table (which subqueries may widen)."""
        if self.known and n in self.known:
            return self.known[n]
        return getattr(self, f"_ex_{n.kind}", self._no)(n)

    def _no(self, n: Node) -> Expr:
        raise QueryError(f"{n.kind} cannot be used as a value here", code="unsupported")

    def _ex_lit(self, n: Node) -> Expr:
        return self.lit(n.value)

    def _ex_param(self, n: Node) -> Expr:
        if n.name not in self.params:
            raise QueryError(f"no value for parameter ${n.name}", code="parameter")
        return self.lit(self.params[n.name])

    def var(self, name: str) -> Var:
        if name not in self.scope:
            raise QueryError(f"undefined variable {name}", code="undefined-variable")
        return self.scope[name]

    def _ex_var(self, n: Node) -> Expr:
        v = self.var(n.name)
        if isinstance(v, Bound):
            return v.expr
        if isinstance(v, NodeVar):
            return self.node_value(v)
        if isinstance(v, EdgeVar):
            return self.edge_value(v)
        return self.expr(name_of(v.col))

    def _ex_prop(self, n: Node) -> Expr:
        if n.value.kind == "var":
            v = self.scope.get(n.value.name)
            if isinstance(v, (NodeVar, EdgeVar)):
                return self.expr(name_of(v.props[n.name])) if n.name in v.props else self.lit(None)
        return self.field(self.ex(n.value), n.name)

    def field(self, e: Expr, name: str) -> Expr:
        p = registry.part(e, name)
        if p is not None:
            return p
        if e.is_(T.StructType):
            names = e.type.names
            if "properties" in names and "id" in names:
                inner = e.type["properties"].dataType
                return e.make(lambda c: c["properties"][name]) if isinstance(inner, T.StructType) and name in inner.names else self.lit(None)
            return e.make(lambda c: c[name]) if name in names else self.lit(None)
        if e.is_(T.MapType):
            return e.make(lambda c: F.try_element_at(c, F.lit(name)))
        if e.is_(T.NullType):
            return self.lit(None)
        if e.is_(T.VariantType):
            return e.make(lambda c: F.try_variant_get(c, f"$.{name}", "string"))
        raise QueryError(f"{e.type.simpleString()} has no property {name}", code="type")

    def _ex_list(self, n: Node) -> Expr:
        return self.array([self.ex(x) for x in n.items])

    def _ex_record(self, n: Node) -> Expr:
        return self.struct([(k, self.ex(v)) for k, v in n.fields])

    def _ex_map_projection(self, n: Node) -> Expr:
        fields: list[tuple[str, Expr]] = []
        for k, v in n.fields:
            if k == "*":
                own = self.var(n.value.name)
                fields += [(p, self.expr(name_of(c))) for p, c in own.props.items()] if isinstance(own, (NodeVar, EdgeVar)) else [(p, self.field(self.ex(n.value), p)) for p in self.ex(n.value).type.names]
            else:
                fields.append((k, self.ex(v)))
        return self.struct(list(dict(fields).items()))

    def _ex_is_null(self, n: Node) -> Expr:
        return self._ident(n.value).make(lambda c: c.isNull(), kind=T.BooleanType())

    def _ident(self, n: Node) -> Expr:
        """The id of a graph element, any other expression as it is."""
        if n.kind == "var":
            v = self.var(n.name)
            if isinstance(v, (NodeVar, EdgeVar)):
                return self.expr(name_of(v.id))
        e = self.ex(n)
        if e.is_(T.StructType) and "id" in e.type.names and "properties" in e.type.names:
            return e.make(lambda c: c["id"])
        return e

    def _ex_is_truth(self, n: Node) -> Expr:
        e = self.ex(n.value)
        if n.truth == "UNKNOWN":
            return e.make(lambda c: c.cast("boolean").isNull())
        return e.make(lambda c: c.cast("boolean").eqNullSafe(F.lit(n.truth == "TRUE")))

    def _ex_is_typed(self, n: Node) -> Expr:
        e, want = self.ex(n.value), T._parse_datatype_string(cast_name(n.type))
        number = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        same = type(e.type) is type(want) or (isinstance(e.type, number) and isinstance(want, number))
        return e.make((lambda c: c.isNotNull()) if "NOT NULL" in n.type and same else (lambda c: F.lit(same)) if not e.is_(T.NullType) else (lambda c: F.lit("NOT NULL" not in n.type)))

    def _ex_is_directed(self, n: Node) -> Expr:
        v = self.var(n.value.name)
        return self.expr(name_of(v.directed)) if isinstance(v, EdgeVar) else self._no(n)

    def _ex_labeled(self, n: Node) -> Expr:
        v = self.var(n.value.name) if n.value.kind == "var" else None
        if isinstance(v, NodeVar):
            return self.expr(label_test(n.labels, name_of(v.labels)) if v.labels else F.lit(False))
        if isinstance(v, EdgeVar):
            return self.expr(label_test(n.labels, F.array(name_of(v.type))))
        return self.ex(n.value).make(lambda c: label_test(n.labels, c["labels"]))

    def _ex_endpoint(self, n: Node) -> Expr:
        a, e = self.var(n.node.name), self.var(n.edge.name)
        return self.expr(name_of(a.id) == name_of(e.src if n.end == "source" else e.dst))

    def _ex_unary(self, n: Node) -> Expr:
        e = self.ex(n.value)
        return e.make((lambda c: ~c.cast("boolean")) if n.op == "NOT" else (lambda c: -c))

    def _ex_binary(self, n: Node) -> Expr:
        op = n.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.ex(n.left), self.ex(n.right)
            return a.make({"AND": lambda x, y: x & y, "OR": lambda x, y: x | y, "XOR": lambda x, y: x != y}[op], b, kind=T.BooleanType())
        if op in ("=", "<>"):
            a, b = self._ident(n.left), self._ident(n.right)
            if _family(a) != _family(b) and "null" not in (_family(a), _family(b)):
                return a.make(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "<>")), b)
            if a.is_(T.ArrayType) and b.is_(T.ArrayType):
                same = lambda x, y: _same_lists(x, y, max(_depth(a.type), _depth(b.type)))
                return a.make(same if op == "=" else (lambda x, y: ~same(x, y)), b, kind=T.BooleanType())
            return a.make((lambda x, y: x == y) if op == "=" else (lambda x, y: x != y), b, kind=T.BooleanType())
        a, b = self.ex(n.left), self.ex(n.right)
        if op in ("<", "<=", ">", ">="):
            if _family(a) != _family(b):
                return self.expr(F.lit(None).cast("boolean"))
            return a.make({"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op], b, kind=T.BooleanType())
        return self.arithmetic(op, a, b)

    def arithmetic(self, op: str, a: Expr, b: Expr) -> Expr:
        time = (T.DateType, T.TimestampType, T.TimestampNTZType)
        if op in ("+", "||"):
            if a.is_(T.StructType) and b.is_(T.StructType) and a.type.names == b.type.names == ["nodes", "edges"]:
                meet = lambda x, y: F.try_element_at(x["nodes"], F.lit(-1))["id"] == F.try_element_at(y["nodes"], F.lit(1))["id"]
                rest = lambda y: F.slice(y["nodes"], 2, F.greatest(F.size(y["nodes"]) - 1, F.lit(0)))
                return a.make(lambda x, y: F.when(meet(x, y), F.struct(F.concat(x["nodes"], rest(y)).alias("nodes"), F.concat(x["edges"], y["edges"]).alias("edges"))), b)
            if a.is_(T.ArrayType) or b.is_(T.ArrayType):
                if not a.is_(T.ArrayType):
                    return a.make(lambda x, y: F.concat(F.array(x), y), b)
                return a.make((lambda x, y: F.concat(x, y)) if b.is_(T.ArrayType) else (lambda x, y: F.concat(x, F.array(y))), b)
            if op == "||" or a.is_(T.StringType) or b.is_(T.StringType):
                return a.make((lambda x, y: F.concat(x, y)) if a.is_(T.BinaryType) else (lambda x, y: F.concat(x.cast("string"), y.cast("string"))), b)
        da, db = registry.is_duration(a.type), registry.is_duration(b.type)
        if op in "+-" and db and a.is_(*time):
            return registry.shift(a, b, 1 if op == "+" else -1)
        if op == "+" and da and b.is_(*time):
            return registry.shift(b, a, 1)
        if da and db and op in "+-":
            s = 1 if op == "+" else -1
            return a.make(lambda x, y: F.struct(*[(x[k] + y[k] * s).alias(k) for k in ("months", "days", "seconds", "nanos")]), b)
        if (da or db) and op in "*/":
            d, k = (a, b) if da else (b, a)
            f = (lambda x, y: x * y) if op == "*" else (lambda x, y: x / y)
            return d.make(lambda x, y: F.struct(*[f(x[p], y).cast("bigint").alias(p) for p in ("months", "days", "seconds", "nanos")]), k)
        if op == "/":
            if a.integral and b.integral:
                return a.make(_int_div, b, kind=T.LongType())
            zero = lambda x: F.when(x.isNull(), None).when(x == 0, F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            if a.is_(T.DecimalType) or b.is_(T.DecimalType):
                return a.make(lambda x, y: x / y, b)
            return a.make(lambda x, y: F.when(y == 0, zero(x.cast("double"))).otherwise(F.try_divide(x.cast("double"), y.cast("double"))), b)
        if op == "^":
            return a.make(lambda x, y: F.pow(x.cast("double"), y.cast("double")), b)
        return a.make({"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "%": lambda x, y: x % y}[op], b)

    def _ex_in(self, n: Node) -> Expr:
        if n.list.kind == "list" and n.list.items and all(x.kind == "lit" and x.value is not None for x in n.list.items) and len({type(x.value) for x in n.list.items}) == 1:
            return self.ex(n.value).make(lambda v: v.isin([x.value for x in n.list.items]), kind=T.BooleanType())
        v, items = self._ident(n.value), self.ex(n.list)
        if n.list.kind == "list" and not n.list.items:
            return self.lit(False)
        if v.is_(T.NullType):
            return items.make(lambda y: F.when(F.size(y) == 0, False))
        if items.is_(T.ArrayType) and isinstance(items.type.elementType, T.StructType) and "id" in items.type.elementType.names and not v.is_(T.StructType):
            items = items.make(lambda y: F.transform(y, lambda z: z["id"]))
        return v.make(lambda x, y: F.when(F.size(y) == 0, False).otherwise(F.array_contains(y, x)), items, kind=T.BooleanType())

    def _ex_index(self, n: Node) -> Expr:
        if n.at.kind == "lit" and isinstance(n.at.value, str):
            return self._ex_prop(Node("prop", value=n.value, name=n.at.value))
        e, i = self.ex(n.value), self.ex(n.at)
        if e.is_(T.MapType):
            return e.make(lambda m, k: F.try_element_at(m, k), i)
        return e.make(lambda a, k: F.when(k >= 0, F.try_element_at(a, (k + 1).cast("int"))).otherwise(F.try_element_at(a, F.when(k < 0, k).otherwise(F.lit(-1)).cast("int"))), i)

    def _ex_slice(self, n: Node) -> Expr:
        e = self.ex(n.value)
        lo = self.ex(n.low) if n.low is not None else self.lit(0)
        hi = self.ex(n.high) if n.high is not None else e.make(lambda a: F.size(a).cast("bigint"))

        def f(a: Column, x: Column, y: Column) -> Column:
            size = F.size(a)
            place = lambda k: F.least(F.greatest(F.when(k < 0, k + size).otherwise(k), F.lit(0)), size)
            return F.when(x.isNotNull() & y.isNotNull(), F.slice(a, (place(x) + 1).cast("int"), F.greatest(place(y) - place(x), F.lit(0)).cast("int")))

        return e.make(f, lo, hi)

    def lam(self, var: str, source: Expr, body: Node, extra: dict[str, Bound] | None = None) -> tuple[Callable[[Column], Column], Expr]:
        """A function of an element of ``source``, and the body's expression with the element unknown."""
        kind = source.type.elementType if isinstance(source.type, T.ArrayType) else T.NullType()

        def at(c: Column) -> Expr:
            old = dict(self.scope)
            self.scope[var] = Bound(Expr(c, F.lit(None).cast(kind), self.frame, kind))
            if extra:
                self.scope.update(extra)
            try:
                return self.ex(body)
            finally:
                self.scope = old

        return (lambda c: at(c).col), at(F.lit(None).cast(kind))

    def _ex_comprehension(self, n: Node) -> Expr:
        source = self.ex(n.list)
        out = source
        if n.where is not None:
            test, _ = self.lam(n.var, source, n.where)
            out = Expr(F.filter(out.col, test), source.probe, self.frame, source.type)
        if n.out is not None:
            f, shape = self.lam(n.var, source, n.out)
            out = Expr(F.transform(out.col, f), F.array(shape.probe), self.frame)
        return out

    def _ex_quantified(self, n: Node) -> Expr:
        source = self.ex(n.list)
        test, _ = self.lam(n.var, source, n.where)
        s = source.col
        if n.how == "all":
            col = F.forall(s, test)
        elif n.how == "any":
            col = F.exists(s, test)
        elif n.how == "none":
            col = ~F.exists(s, test)
        else:
            yes = F.size(F.filter(s, test))
            unknown = F.size(F.filter(s, lambda c: test(c).isNull()))
            col = F.when(s.isNull(), None).when(yes > 1, False).when(unknown > 0, None).otherwise(yes == 1)
        return Expr(col, F.lit(None).cast("boolean"), self.frame, T.BooleanType())

    def _ex_reduce(self, n: Node) -> Expr:
        source, start = self.ex(n.list), self.ex(n.start)
        kind = source.type.elementType

        def step(acc: Column, x: Column) -> Column:
            old = dict(self.scope)
            self.scope |= {n.acc: Bound(Expr(acc, start.probe, self.frame, start.type)), n.var: Bound(Expr(x, F.lit(None).cast(kind), self.frame, kind))}
            try:
                return self.ex(n.out).col.cast(start.type)
            finally:
                self.scope = old

        return Expr(F.aggregate(source.col, start.col, step), start.probe, self.frame, start.type)

    def _ex_case(self, n: Node) -> Expr:
        parts = [e for t, v in n.whens for e in (self.ex(t), self.ex(v))]
        other = self.ex(n.other) if n.other is not None else self.lit(None)

        def f(*c: Column) -> Column:
            out = F.when(c[0].cast("boolean"), c[1])
            for i in range(2, len(c) - 1, 2):
                out = out.when(c[i].cast("boolean"), c[i + 1])
            return out.otherwise(c[-1])

        return parts[0].make(f, *parts[1:], other)

    def _ex_cast(self, n: Node) -> Expr:
        want = cast_name(n.type)
        return self.ex(n.value).make(lambda c: c.cast(want))

    def _ex_let_in(self, n: Node) -> Expr:
        body = n.out
        for name, v in reversed(n.items):
            body = body.map(lambda x, name=name, v=v: v if x.kind == "var" and x.name == name else x)
        return self.ex(body)

    def _ex_call_fn(self, n: Node) -> Expr:
        name, args = n.name, n.args
        if name in AGGREGATES:
            raise QueryError(f"{name} cannot be used here", code="aggregation-in-non-return-context")
        special = getattr(self, f"_fn_{name.replace('.', '_')}", None)
        if special is not None:
            return special(args)
        if name in ("normalize", "is_normalized"):
            form = args[1].value if len(args) > 1 and args[1].kind == "lit" else args[1].name.upper() if len(args) > 1 else "NFC"
            return registry.call(f"{name}_{form.lower()}", [self.ex(args[0])])
        if self.session is not None and name in self.session.functions:
            f = self.session.functions[name]
            own = [self.ex(a) for a in args]
            return own[0].make(lambda *c: f(*c), *own[1:]) if own else self.expr(f())
        return registry.call(name, [self.ex(a) for a in args])

    # functions that look at variables rather than values

    def _fn_elementid(self, args: list[Node]) -> Expr:
        return self._ident(args[0]).make(lambda c: c.cast("string"), kind=T.StringType())

    _fn_element_id = _fn_elementid

    def _fn_id(self, args: list[Node]) -> Expr:
        return self._ident(args[0])

    def _fn_labels(self, args: list[Node]) -> Expr:
        v = self.scope.get(args[0].name) if args[0].kind == "var" else None
        return self.expr(name_of(v.labels)) if isinstance(v, NodeVar) and v.labels else self.ex(args[0]).make(lambda c: c["labels"])

    def _fn_type(self, args: list[Node]) -> Expr:
        v = self.scope.get(args[0].name) if args[0].kind == "var" else None
        return self.expr(name_of(v.type)) if isinstance(v, EdgeVar) else self.ex(args[0]).make(lambda c: c["type"])

    def _fn_properties(self, args: list[Node]) -> Expr:
        e = self.ex(args[0])
        return e.make(lambda c: c["properties"]) if e.is_(T.StructType) and "properties" in e.type.names else e

    def _fn_keys(self, args: list[Node]) -> Expr:
        e = self._fn_properties(args)
        if e.is_(T.MapType):
            return e.make(F.map_keys)
        names = e.type.names if e.is_(T.StructType) else []
        return e.make(lambda c: F.filter(F.array(*[F.when(c[k].isNotNull(), F.lit(k)) for k in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>"))

    def _fn_property_exists(self, args: list[Node]) -> Expr:
        return self._ex_prop(Node("prop", value=args[0], name=args[1].name)).make(lambda c: c.isNotNull())

    def _ends(self, args: list[Node], end: str) -> Expr:
        v = self.var(args[0].name)
        scan, props = self.graph.node_scan(None)
        own = NodeVar(fresh("id"), fresh("labels"), {p: fresh(p) for p in props})
        cols = [F.col("_id").alias(own.id), F.col("_labels").alias(own.labels), *[name_of(p).alias(c) for p, c in own.props.items()]]
        self.df = self.frame().join(scan.select(*cols), name_of(getattr(v, end)) == name_of(own.id), "left")
        return self.node_value(own)

    def _fn_startnode(self, args: list[Node]) -> Expr:
        return self._ends(args, "src")

    def _fn_endnode(self, args: list[Node]) -> Expr:
        return self._ends(args, "dst")

    def _fn_all_different(self, args: list[Node]) -> Expr:
        ids = [self._ident(a) for a in args]
        return ids[0].make(lambda *c: F.size(F.array_distinct(F.array(*c))) == len(c), *ids[1:], kind=T.BooleanType())

    def _fn_same(self, args: list[Node]) -> Expr:
        ids = [self._ident(a) for a in args]
        return ids[0].make(lambda *c: F.size(F.array_distinct(F.array(*c))) == 1, *ids[1:], kind=T.BooleanType())

    def _fn_pi(self, args: list[Node]) -> Expr:
        return self.expr(F.pi())

    def _fn_e(self, args: list[Node]) -> Expr:
        return self.expr(F.e())

    def _fn_rand(self, args: list[Node]) -> Expr:
        return self.expr(F.rand())

    def _fn_randomuuid(self, args: list[Node]) -> Expr:
        return self.expr(F.expr("uuid()"))

    def _fn_timestamp(self, args: list[Node]) -> Expr:
        return self.expr(F.unix_millis(F.current_timestamp()))

    def _fn_current_date(self, args: list[Node]) -> Expr:
        return self.expr(F.current_date())

    def _fn_current_timestamp(self, args: list[Node]) -> Expr:
        return self.expr(F.current_timestamp())

    def _fn_local_timestamp(self, args: list[Node]) -> Expr:
        return self.expr(F.localtimestamp())

    def _now(self, args: list[Node]) -> Expr:
        return self.expr(F.current_timestamp())

    _fn_datetime_realtime = _fn_datetime_transaction = _fn_datetime_statement = _now

    def _today(self, args: list[Node]) -> Expr:
        return self.expr(F.current_date())

    _fn_date_realtime = _fn_date_transaction = _fn_date_statement = _today

    def _fn_valuetype(self, args: list[Node]) -> Expr:
        return self.lit(self.ex(args[0]).type.simpleString().upper())

    def _time_record(self, args: list[Node], make: Callable[[dict[str, Column]], Column]) -> Expr | None:
        if args and args[0].kind == "record":
            fields = {k: self.ex(v) for k, v in args[0].fields}
            return self.expr(make({k: e.col for k, e in fields.items()}))
        return None

    def _fn_date(self, args: list[Node]) -> Expr:
        if not args:
            return self.expr(F.current_date())
        one = F.lit(1)
        got = self._time_record(args, lambda f: F.make_date(f["year"].cast("int"), f.get("month", one).cast("int"), f.get("day", one).cast("int")))
        return got or registry.call("date", [self.ex(args[0])])

    def _stamp(self, args: list[Node], name: str, make: Callable[..., Column], now: Column) -> Expr:
        if not args:
            return self.expr(now)
        zero, one = F.lit(0), F.lit(1)
        got = self._time_record(args, lambda f: make(*[f.get(k, d).cast("int") for k, d in (("year", one), ("month", one), ("day", one), ("hour", zero), ("minute", zero))], f.get("second", zero).cast("decimal(16,6)")))
        return got or registry.call(name, [self.ex(args[0])])

    def _fn_datetime(self, args: list[Node]) -> Expr:
        return self._stamp(args, "datetime", F.make_timestamp, F.current_timestamp())

    _fn_zoned_datetime = _fn_datetime

    def _fn_localdatetime(self, args: list[Node]) -> Expr:
        return self._stamp(args, "localdatetime", F.make_timestamp_ntz, F.localtimestamp())

    _fn_local_datetime = _fn_localdatetime

    def _fn_duration(self, args: list[Node]) -> Expr:
        if args[0].kind == "lit":
            months, days, seconds = registry.parse_duration(args[0].value)
            return self.expr(registry.duration_struct(F.lit(int(months)), F.lit(int(days)), F.lit(float(seconds))))
        zero = F.lit(0)

        def make(f: dict[str, Column]) -> Column:
            get = lambda k: f.get(k, zero)
            return registry.duration_struct(get("years") * 12 + get("months"), get("weeks") * 7 + get("days"), (get("hours") * 3600 + get("minutes") * 60 + get("seconds")).cast("double"))

        got = self._time_record(args, make)
        return got or self._no(args[0])

    def _fn_point(self, args: list[Node]) -> Expr:
        f = {k: self.ex(v).col for k, v in args[0].fields}
        null = F.lit(None)
        x, y, z = (f.get(a, f.get(b, null)).cast("double") for a, b in (("x", "longitude"), ("y", "latitude"), ("z", "height")))
        geo = "longitude" in f
        srid = {(True, False): 4326, (True, True): 4979, (False, False): 7203, (False, True): 9157}[geo, "z" in f or "height" in f]
        return self.expr(F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(srid).alias("srid")))

    _fn_distance = lambda self, args: registry.call("point.distance", [self.ex(a) for a in args])

    # ------------------------------------------------------------ subqueries

    def outer(self, n: Node) -> dict[str, Var]:
        """The variables of the scope that a subquery mentions."""
        names = {x.name for x in n.walk() if x.kind == "var"} | {x.var for x in n.walk() if x.kind in ("node", "edge")}
        return {k: v for k, v in self.scope.items() if k in names and not isinstance(v, Bound)}

    def correlated(self, used: dict[str, Var]) -> tuple["Lower", list[str]]:
        """A working table of the distinct values of the outer variables, and their identifying columns."""
        inner = Lower(self.spark, self.graph, self.params, self.session)
        keys = [v.id for v in used.values()]
        if keys:
            inner.df = self.frame().select(*[c for v in used.values() for c in v.columns()]).dropDuplicates(keys)
            inner.outer_rows = inner.df
        inner.scope, inner.imported = dict(used), dict(used)
        return inner, keys

    def back(self, result: DataFrame, keys: list[str], how: str) -> None:
        """Joins a subquery's result on the outer variables' identifying columns."""
        if not keys:
            self.df = self.frame().join(result, F.lit(True), how) if how != "cross" else self.frame().crossJoin(result)
            return
        named = {k: fresh("key") for k in keys}
        right = result.withColumnsRenamed(named)
        test = reduce(lambda a, b: a & b, [name_of(k).eqNullSafe(name_of(named[k])) for k in keys])
        self.df = self.frame().join(right, test, how).drop(*named.values())

    def run_sub(self, n: Node, inner: "Lower") -> None:
        if n.query is not None:
            inner.query(n.query, final=False)
        else:
            inner.match(Node("match", optional=False, mode="different", parts=n.pattern, keep=None, where=n.where, shown=None))

    def _ex_exists(self, n: Node) -> Expr:
        inner, keys = self.correlated(self.outer(n))
        body = n
        if n.query is not None and n.query.kind == "linear" and n.query.clauses[-1].kind == "project" and not any(c.kind_of == "with" for c in n.query.clauses if c.kind == "project") and n.query.clauses[-1].limit is None and not _aggregates(n.query.clauses[-1]):
            body = n.replace(query=Node("linear", clauses=n.query.clauses[:-1])) if len(n.query.clauses) > 1 else n
        self.run_sub(body, inner)
        flag = fresh("exists")
        result = inner.frame().select(*keys).distinct() if keys else inner.frame().limit(1).select()
        self.back(result.withColumn(flag, F.lit(True)), keys, "left")
        return self.expr(F.coalesce(name_of(flag), F.lit(False)), T.BooleanType())

    def semi(self, n: Node, anti: bool) -> None:
        """WHERE [NOT] EXISTS as a semi or anti join."""
        inner, keys = self.correlated(self.outer(n))
        self.run_sub(n, inner)
        if not keys:
            result = inner.frame().limit(1).select(F.lit(1).alias(fresh("one")))
            self.df = self.frame().join(result, F.lit(True), "left_anti" if anti else "left_semi")
            return
        named = {k: fresh("key") for k in keys}
        right = inner.frame().select(*[name_of(k).alias(named[k]) for k in keys])
        test = reduce(lambda a, b: a & b, [name_of(k).eqNullSafe(name_of(named[k])) for k in keys])
        self.df = self.frame().join(right, test, "left_anti" if anti else "left_semi")

    def _aggregated(self, n: Node, value: Callable[["Lower"], Column], empty: Column) -> Expr:
        inner, keys = self.correlated(self.outer(n))
        self.run_sub(n, inner)
        out = fresh("sub")
        self.back(inner.frame().groupBy(*keys).agg(value(inner).alias(out)), keys, "left")
        return self.expr(F.coalesce(name_of(out), empty) if empty is not None else name_of(out))

    def _ex_count_query(self, n: Node) -> Expr:
        return self._aggregated(n, lambda i: F.count(F.lit(1)), F.lit(0).cast("bigint"))

    def _only(self, inner: "Lower") -> Column:
        names = list(inner.scope)
        return inner.ex(Node("var", name=names[-1])).col

    def _ex_value_query(self, n: Node) -> Expr:
        def one(i: Lower) -> Column:
            v = self._only(i)
            return F.when(F.count(F.lit(1)) <= 1, F.first(v)).otherwise(F.raise_error(F.lit("VALUE has more than one row")).cast(i.frame().select(v.alias("v")).schema[0].dataType))

        return self._aggregated(n, one, None)

    def _ex_collect_query(self, n: Node) -> Expr:
        inner, keys = self.correlated(self.outer(n))
        self.run_sub(n, inner)
        out = fresh("list")
        self.back(inner.frame().groupBy(*keys).agg(F.collect_list(self._only(inner)).alias(out)), keys, "left")
        kind = self.frame().schema[out].dataType
        return self.expr(F.coalesce(name_of(out), F.array().cast(kind)))

    def _ex_pattern_list(self, n: Node) -> Expr:
        inner, keys = self.correlated(self.outer(n))
        inner.match(Node("match", optional=False, mode="different", parts=[n.part], keep=None, where=n.where, shown=None))
        c, out = inner.add(inner.ex(n.out), "item"), fresh("list")
        self.back(inner.frame().groupBy(*keys).agg(F.collect_list(name_of(c)).alias(out)), keys, "left")
        kind = self.frame().schema[out].dataType
        return self.expr(F.coalesce(name_of(out), F.array().cast(kind)))

    # ------------------------------------------------------------ clauses

    def query(self, n: Node, final: bool = True) -> None:
        if n.kind == "linear":
            self.clauses(n.clauses)
        elif n.kind == "next":
            self.query(n.first)
            if n.keep is not None:
                self.scope = {new: self.scope[old] for old, new in n.keep}
            self.query(n.then)
        elif n.kind == "set":
            self.set_query(n)
        else:
            raise QueryError(f"{n.kind} is no query", code="unsupported")

    def clauses(self, cs: list[Node]) -> None:
        """Runs clauses in turn. Before an aggregation, branches of a match that it does not read are only counted."""
        for i, c in enumerate(cs):
            if c.kind == "match" and i + 1 < len(cs) and cs[i + 1].kind == "project":
                counted = factor.plan(self, c, cs[i + 1])
                if counted is not None:
                    counted.run(self)
                    continue
            self.clause(c)

    def weight(self) -> Column:
        """How many rows of the pattern a row stands for."""
        return reduce(lambda a, b: a * b, [name_of(w) for w in self.weights])

    def clause(self, c: Node) -> None:
        f = getattr(self, f"_do_{c.kind}", None)
        if f is None:
            raise QueryError(f"{c.kind} cannot run here", code="unsupported")
        f(c)

    def _do_use(self, c: Node) -> None:
        self.graph = self.session.graph(c.name)

    def _do_finish(self, c: Node) -> None:
        self.df, self.scope = self.frame().limit(0).select(), {}

    def _do_filter(self, c: Node) -> None:
        self.where(c.where)

    def where(self, n: Node) -> None:
        """Keeps rows for which n is true. EXISTS at the top becomes a semi join."""
        if n.kind == "binary" and n.op == "AND":
            self.where(n.left)
            self.where(n.right)
        elif n.kind == "exists":
            self.semi(n, False)
        elif n.kind == "unary" and n.op == "NOT" and n.value.kind == "exists":
            self.semi(n.value, True)
        else:
            e = self.ex(n)
            self.df = self.frame().where(e.col.cast("boolean"))

    def _do_let(self, c: Node) -> None:
        for name, v in c.items:
            e = self.ex(v)
            self.scope[name] = Value(self.add(e, name))

    def _do_local_table(self, c: Node) -> None:
        self.session.tables[c.name] = c.query

    def _do_for(self, c: Node) -> None:
        out, at = fresh(c.var), fresh("at")
        if c.list.kind == "table":
            query = c.list.query
            if not isinstance(query, Node):
                if query not in self.session.tables:
                    raise QueryError(f"no table {query}", code="undefined-variable")
                query = self.session.tables[query]
            inner = Lower(self.spark, self.graph, self.params, self.session)
            inner.query(query)
            row = inner.struct([(k, inner.ex(Node("var", name=k))) for k in inner.scope])
            rows = inner.frame().select(row.col.alias(out))
            if c.counter:
                rows = _numbered(rows, at)
            self.df = rows if self.df is None else self.df.crossJoin(rows)
        else:
            e = self.ex(c.list)
            if not e.is_(T.ArrayType):
                e = e.make(lambda x: F.when(x.isNotNull(), F.array(x)))
            self.df = self.frame().select("*", F.posexplode(e.col).alias(at, out))
        self.scope[c.var] = Value(out)
        if c.counter:
            k = fresh(c.counter)
            self.df = self.df.withColumn(k, (name_of(at) + c.base).cast("bigint"))
            self.scope[c.counter] = Value(k)

    def _do_call(self, c: Node) -> None:
        used = self.outer(c.query) if c.scope is None else {k: self.var(k) for k in c.scope}
        inner, keys = self.correlated(used)
        inner.partition = keys  # ORDER BY and LIMIT inside hold for each outer row
        inner.query(c.query)
        new = {k: v for k, v in inner.scope.items() if k not in used or v is not used[k]}
        if not any(x.kind == "project" for x in c.query.walk()):  # no result: run for its rows only
            new = {}
        result = inner.frame().select(*keys, *[x for v in new.values() for x in v.columns()])
        self.back(result, keys, "left" if c.optional else "inner" if keys else ("cross"))
        self.scope |= new

    def _do_procedure(self, c: Node) -> None:
        f = self.session.procedures.get(c.name.lower()) if self.session is not None else None
        if f is None:
            raise QueryError(f"unknown procedure {c.name}", code="procedure")
        args = [a.value if a.kind == "lit" else self.params.get(a.name) if a.kind == "param" else self.graph for a in c.args]
        got: DataFrame = f(self.spark, self.graph, *args)
        keep = c.keep if c.keep is not None else [(x, x) for x in got.columns]
        named = {new: fresh(new) for _, new in keep}
        rows = got.select(*[name_of(old).alias(named[new]) for old, new in keep])
        if self.df is None:
            self.df = rows
        else:
            self.df = self.df.join(rows, F.lit(True), "left" if c.optional else "inner")
        self.scope |= {k: Value(v) for k, v in named.items()}
        if c.where is not None:
            self.where(c.where)

    def _do_select(self, c: Node) -> None:
        self.clauses([*c.source, c.project])

    def set_query(self, n: Node) -> None:
        left, right = self.fork(), self.fork()
        left.query(n.left)
        right.query(n.right)
        if list(left.scope) != list(right.scope) and set(left.scope) != set(right.scope):
            raise QueryError("the sides of a set operation have different columns", code="union-column-mismatch")
        names = list(left.scope)
        shown = {k: fresh(k) for k in names}
        carried = [c for v in self.imported.values() for c in v.columns()]
        cols = lambda side: side.frame().select(*carried, *[side.ex(Node("var", name=k)).col.alias(shown[k]) for k in names])
        a, b = cols(left), cols(right)
        if n.op == "union":
            out = a.unionByName(b) if n.all else a.unionByName(b).distinct()
        elif n.op == "except":
            out = a.exceptAll(b) if n.all else a.subtract(b)
        elif n.op == "intersect":
            out = a.intersectAll(b) if n.all else a.intersect(b)
        else:
            ids = {v.id: fresh("key") for v in self.imported.values()}
            if ids:  # for each outer row
                some = a.select(*[name_of(k).alias(x) for k, x in ids.items()])
                test = reduce(lambda x, y: x & y, [name_of(k).eqNullSafe(name_of(x)) for k, x in ids.items()])
            else:
                some, test = a.limit(1).select(F.lit(1).alias(fresh("some"))), F.lit(True)
            out = a.unionByName(b.join(some, test, "left_anti"))
        self.df, self.scope = out, {k: Value(v) for k, v in shown.items()}

    # ------------------------------------------------------------ projection

    partition: list[str] = []
    imported: dict[str, Var] = {}

    def _do_page(self, c: Node) -> None:
        self.order(c.order, c.skip, c.limit)

    def constant(self, n: Node) -> int:
        if n.kind == "lit":
            return int(n.value)
        if n.kind == "param":
            return int(self.params[n.name])
        return int(self.spark.range(1).select(Lower(self.spark, self.graph, self.params, self.session).ex(n).col).head()[0])

    def order(self, order: list[Node], skip: Node | None, limit: Node | None) -> None:
        cols = []
        for s in order:
            c = self._ident(s.by).col
            nulls_first = s.nulls == "first" if s.nulls else s.down  # nulls count as largest
            cols.append((c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if s.down else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()))
        if self.partition and (skip is not None or limit is not None):
            at = fresh("row")
            w = Window.partitionBy(*self.partition).orderBy(*(cols or [F.lit(0)]))
            lo = self.constant(skip) if skip is not None else 0
            self.df = self.frame().withColumn(at, F.row_number().over(w)).where(name_of(at) > lo)
            if limit is not None:
                self.df = self.df.where(name_of(at) <= lo + self.constant(limit))
            return
        if cols:
            self.df = self.frame().orderBy(*cols)
        if skip is not None:
            self.df = self.frame().offset(self.constant(skip))
        if limit is not None:
            self.df = self.frame().limit(self.constant(limit))

    def folded(self, n: Node) -> Node:
        """The expression with aggregates over group variables as folds of their lists."""

        def change(x: Node) -> Node:
            if x.kind == "call_fn" and x.name in AGGREGATES and x.args and x.args[0].kind != "star":
                over = [y.name for y in x.args[0].walk() if y.kind == "var" and getattr(self.scope.get(y.name), "role", "") == "group"]
                if over and x.name not in ("collect", "percentile_cont", "percentile_disc", "percentilecont", "percentiledisc"):
                    return Node("fold", name=x.name, var=over[0], body=x.args[0], distinct=x.distinct)
            return x

        return n.map(change)

    def _ex_fold(self, n: Node) -> Expr:
        """An aggregate over the elements that a group variable is bound to in one row."""
        source = self.ex(Node("var", name=n.var))
        f, shape = self.lam(n.var, source, n.body)
        items = F.filter(F.transform(source.col, f), lambda x: x.isNotNull())
        if n.distinct:
            items = F.array_distinct(items)
        total = lambda a: F.aggregate(a, F.lit(0).cast("double" if not shape.integral else "bigint"), lambda x, y: x + y)
        size = F.size(items)
        mean = F.when(size > 0, total(items) / size)
        spread = F.aggregate(items, F.lit(0.0), lambda x, y: x + F.pow(y.cast("double") - mean, 2))
        col = {
            "count": lambda: size.cast("bigint"), "sum": lambda: total(items), "avg": lambda: mean, "min": lambda: F.array_min(items), "max": lambda: F.array_max(items), "collect_list": lambda: items,
            "stddev_pop": lambda: F.when(size > 0, F.sqrt(spread / size)), "stdevp": lambda: F.when(size > 0, F.sqrt(spread / size)),
            "stddev_samp": lambda: F.when(size > 1, F.sqrt(spread / (size - 1))), "stdev": lambda: F.when(size > 1, F.sqrt(spread / (size - 1))).otherwise(F.when(size > 0, 0.0)),
        }[n.name]()
        return self.expr(col)

    def _fn_make_path(self, args: list[Node]) -> Expr:
        """PATH[node, edge, node, ...]: null where an edge does not join its neighbours."""
        found = [self.var(a.name) if a.kind == "var" else None for a in args]
        if len(found) % 2 == 0 or not all(isinstance(v, EdgeVar if i % 2 else NodeVar) for i, v in enumerate(found)):
            raise QueryError("a path is made of nodes with edges between them", code="type")
        nodes = F.array(*[self.node_value(v, True).col for v in found[::2]])
        edges = [self.edge_value(v, True).col for v in found[1::2]]
        joined = F.lit(True)
        for i in range(1, len(found), 2):
            a, e, b = (found[i + k] for k in (-1, 0, 1))
            ends = lambda x, y, e=e: (name_of(e.src) == name_of(x.id)) & (name_of(e.dst) == name_of(y.id))
            joined = joined & (ends(a, b) | ends(b, a))
        kinds = ", ".join(f"`{k}`:{t.simpleString()}" for k, t in self.graph.edge_props().items())
        none = F.array().cast(f"array<struct<id:bigint,type:string,src:bigint,dst:bigint,properties:{f'struct<{kinds}>' if kinds else 'string'}>>")
        return self.expr(F.when(joined, F.struct(nodes.alias("nodes"), (F.array(*edges) if edges else none).alias("edges"))))

    def _do_project(self, c: Node) -> None:
        c = c.replace(items=[(self.folded(e), k, x) for e, k, x in c.items], order=[self.folded(o) for o in c.order])
        items = list(c.items)
        if c.star:
            items = [(Node("var", name=k), k, False) for k in self.scope if not k.startswith("_anon")] + items
        names = [x[1] for x in items]
        if len(set(names)) < len(names):
            raise QueryError("two result columns have the same name", code="duplicate-alias")
        aggregated = c.group is not None or any(_aggregates(e) for e, _, _ in items) or (c.having is not None)
        before = dict(self.scope)
        aliases = {k: e for e, k, _ in items}
        order = [s.replace(by=s.by) for s in c.order]
        if aggregated:
            self.group(items, c.group, [s.by for s in order] + ([c.having] if c.having is not None else []), aliases)
        out: dict[str, Var] = {}
        for e, k, _ in items:
            v = self.scope.get(e.name) if e.kind == "var" and e not in self.known else None
            out[k] = v if isinstance(v, (NodeVar, EdgeVar, Value)) and v is not None else Value(self.add(self.ex(e), k))
        if c.having is not None:
            self.scope = before | out
            self.where(c.having)
        if c.distinct:
            keys = [v.id for v in out.values()] + self.partition + [v.id for v in self.imported.values()]
            self.scope = out
            self.df = self.frame().dropDuplicates(list(dict.fromkeys(keys)))
            self.known = {e: self.ex(Node("var", name=k)) for e, k, _ in items if e.kind != "var"}
        self.scope = (out if c.distinct else before | out) if not aggregated else (self.scope | out)
        self.order(order, c.skip, c.limit)
        if c.where is not None:
            self.where(c.where)
        self.known = {}
        kept = [x for v in (self.imported | out).values() for x in v.columns()] + self.partition
        self.df = self.frame().select(*dict.fromkeys(kept)) if kept else self.frame().select(F.lit(0).alias("_unit"))
        self.scope = out

    def group(self, items: list, by: list[Node] | None, others: list[Node], aliases: dict[str, Node]) -> None:
        """Groups by the items without aggregates (or by ``by``) and makes the aggregates columns."""
        keys = [e for e, _, _ in items if not _aggregates(e)] if by is None else [aliases.get(e.name, e) if e.kind == "var" and e.name not in self.scope else e for e in by]
        calls: dict[Node, None] = {}
        for e in [x for x, _, _ in items] + others:
            for n in e.walk():
                if n.kind == "call_fn" and n.name in AGGREGATES:
                    if any(_aggregates(a) for a in n.args):
                        raise QueryError("aggregates cannot be nested", code="nested-aggregation")
                    calls[n] = None
        cols, kept, bundles = list(self.partition), {}, {}
        cols += [v.id for v in self.imported.values() if v.id not in cols]
        carried = [x for v in self.imported.values() for x in v.columns() if x not in cols]
        for k in keys:
            v = self.scope.get(k.name) if k.kind == "var" else None
            if isinstance(v, (NodeVar, EdgeVar)):
                bundles[k.name] = v
                cols.append(v.id)
            else:
                kept[k] = self.add(self.ex(k), "key")
                cols.append(kept[k])
        made, after = {}, []
        for n in calls:
            made[n] = fresh(n.name)
            col, empty = self.aggregate(n)
            after.append((made[n], empty))
            calls[n] = col
        rest = [F.first(name_of(x)).alias(x) for v in bundles.values() for x in v.columns() if x not in cols]
        aggs = [col.alias(made[n]) for n, col in calls.items()] + rest
        if not keys and self.outer_rows is not None:  # an aggregate without keys has a row for each outer row, whether or not it matched
            self.ungrouped(aggs, after)
        else:
            self.grouped(cols, aggs + [F.first(name_of(x)).alias(x) for x in carried])
        self.weights = []
        self.scope = dict(self.imported) | bundles | {k.name: Value(c) for k, c in kept.items() if k.kind == "var"}
        self.known = {k: self.expr(name_of(c)) for k, c in kept.items()} | {n: self.expr(name_of(c)) for n, c in made.items()}

    def grouped(self, cols: list[str], aggs: list[Column]) -> None:
        by = self.frame().groupBy(*dict.fromkeys(cols))
        self.df = by.agg(*aggs) if aggs else by.agg(F.count(F.lit(1)).alias(fresh("n")))

    def ungrouped(self, aggs: list[Column], after: list[tuple[str, Column | None]]) -> None:
        """Aggregates of each outer row; a row without matches gets those of an empty table."""
        ids = list(dict.fromkeys([*self.partition, *(v.id for v in self.imported.values())]))
        outer = self.outer_rows.dropDuplicates(ids)
        self.grouped(ids, aggs)
        named = {k: fresh("key") for k in ids}
        right = self.df.withColumnsRenamed(named)
        test = reduce(lambda a, b: a & b, [name_of(k).eqNullSafe(name_of(named[k])) for k in ids])
        self.df = outer.join(right, test, "left").drop(*named.values())
        for name, empty in after:
            if empty is not None:
                self.df = self.df.withColumn(name, F.coalesce(name_of(name), empty.cast(self.df.schema[name].dataType)))

    def aggregate(self, n: Node) -> tuple[Column, Column | None]:
        """The aggregate, and its value over no rows where that is not null."""
        name, zero = n.name, F.lit(0)
        if n.args and n.args[0].kind == "star":
            return (F.coalesce(F.sum(self.weight()), F.lit(0)) if self.weights else F.count(F.lit(1))), zero
        e = self._ident(n.args[0]) if name == "count" else self.ex(n.args[0])
        c = e.col
        if self.weights and not n.distinct and name in ("count", "sum", "avg"):
            rows = F.sum(F.when(c.isNotNull(), self.weight()))
            if name == "count":
                return F.coalesce(rows, zero), zero
            total = F.sum(c * self.weight())
            return (F.coalesce(total, zero), zero) if name == "sum" else (total.cast("double") / rows, None)
        if name == "count":
            return (F.count_distinct(c) if n.distinct else F.count(c)), zero
        if name in ("collect", "collect_list"):
            sets = F.collect_set(c) if e.is_(T.MapType) else F.sort_array(F.collect_set(c))
            return (sets if n.distinct else F.collect_list(c)), F.array()
        if name == "sum":
            col = F.sum_distinct(c) if n.distinct else F.sum(c)
            return F.coalesce(col, zero), zero
        if name == "avg":
            return (F.call_function("avg", c) if not n.distinct else F.sum_distinct(c.cast("double")) / F.count_distinct(c)), None
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(c), None
        if name in ("stdev", "stddev_samp"):
            return F.coalesce(F.stddev_samp(c), F.when(F.count(c) > 0, 0.0)) if name == "stdev" else F.stddev_samp(c), None
        if name in ("stdevp", "stddev_pop"):
            return F.stddev_pop(c), None
        p = self.params[n.args[1].name] if n.args[1].kind == "param" else n.args[1].value
        value = self.add(e, "value")
        how = "percentile_cont" if "cont" in name else "percentile_disc"
        return F.expr(f"{how}({float(p)}) WITHIN GROUP (ORDER BY `{value}`)"), None

    # ------------------------------------------------------------ matching

    def _do_match(self, c: Node) -> None:
        self.match(c)

    def _do_optional_block(self, c: Node) -> None:
        self.optional(list(c.clauses))

    def match(self, c: Node) -> None:
        if c.optional:
            self.optional([c.replace(optional=False)])
            return
        from .paths import Matcher

        Matcher(self, c).run()
        if c.where is not None:
            self.where(c.where)
        if c.shown is not None:
            shown = dict(c.shown)
            own = {p.var for p in Node("x", parts=c.parts).walk() if p.kind in ("node", "edge")}
            self.scope = {shown.get(k, k): v for k, v in self.scope.items() if k in shown or k not in own}

    def optional(self, clauses: list[Node]) -> None:
        body = Node("x", clauses=clauses)
        used = self.outer(body)
        inner, keys = self.correlated(used)
        for c in clauses:
            inner.clause(c)
        new = {k: v for k, v in inner.scope.items() if k not in used}
        result = inner.frame().select(*keys, *[x for v in new.values() for x in v.columns()])
        self.back(result, keys, "left")
        self.scope |= new

    # ------------------------------------------------------------ results

    def result(self) -> DataFrame:
        """The working table with the scope's names; nodes and edges become structs."""
        return self.frame().select(*[self.ex(Node("var", name=k)).col.alias(k) for k in self.scope])


def _numbered(rows: DataFrame, at: str) -> DataFrame:
    """Rows with their number from 0: those of a partition are counted first, so no task holds them all."""
    part, nth = fresh("part"), fresh("nth")
    marked = rows.withColumns({part: F.spark_partition_id(), nth: F.monotonically_increasing_id()})
    counts = marked.groupBy(part).agg(F.count(F.lit(1)).alias(nth))  # a row for each partition
    before = counts.select(name_of(part).alias("_p"), F.coalesce(F.sum(name_of(nth)).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    low = F.lit((1 << 33) - 1)
    return marked.join(F.broadcast(before), name_of(part) == F.col("_p")).withColumn(at, F.col("_before") + name_of(nth).bitwiseAND(low)).drop(part, nth, "_p", "_before")


def _depth(t: T.DataType) -> int:
    return 1 + _depth(t.elementType) if isinstance(t, T.ArrayType) else 0


def _same_lists(x: Column, y: Column, depth: int) -> Column:
    """Equality of lists: false if any elements differ, else null if any comparison is null."""
    one = (lambda a, b: a == b) if depth <= 1 else (lambda a, b: _same_lists(a, b, depth - 1))
    tests = F.zip_with(x, y, one)
    told = F.when(F.exists(tests, lambda t: ~t), False).when(F.exists(tests, lambda t: t.isNull()), None).otherwise(True)
    return F.when(x.isNull() | y.isNull(), None).when(F.size(x) != F.size(y), False).otherwise(told)


def _int_div(x: Column, y: Column) -> Column:
    """Whole division towards zero; division by zero is an error, as everywhere."""
    return F.call_function("div", x, y)


def _aggregates(n: Node) -> bool:
    """Whether an expression aggregates, subqueries and lists aside."""
    if n.kind == "call_fn" and n.name in AGGREGATES:
        return True
    if n.kind in ("exists", "count_query", "value_query", "collect_query", "pattern_list"):
        return False
    if n.kind == "project":
        return n.group is not None or any(_aggregates(e) for e, _, _ in n.items)
    return any(_aggregates(c) for c in n.children())


def _family(e: Expr) -> str:
    if e.is_(T.NullType):
        return "null"
    if e.number:
        return "number"
    if e.is_(T.StringType, T.CharType, T.VarcharType):
        return "string"
    if e.is_(T.DateType, T.TimestampType, T.TimestampNTZType):
        return "time"
    return type(e.type).__name__

