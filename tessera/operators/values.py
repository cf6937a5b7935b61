"""Typed expressions and what variables stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expr:
    """A column, and a probe of it: the same with lambda variables put as typed nulls, to ask Spark for its type."""

    __slots__ = ("col", "probe", "frame", "_type")

    def __init__(self, col: Column, probe: Column, frame: Callable[[], DataFrame], kind: T.DataType | None = None):
        self.col, self.probe, self.frame, self._type = col, probe, frame, kind

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.frame().select(self.probe.alias("x")).schema[0].dataType
        return self._type

    def make(self, f: Callable[..., Column], *more: "Expr", kind: T.DataType | None = None) -> "Expr":
        """f applied to this and more."""
        return Expr(f(self.col, *(m.col for m in more)), f(self.probe, *(m.probe for m in more)), self.frame, kind)

    def is_(self, *kinds: type) -> bool:
        return isinstance(self.type, kinds)

    @property
    def integral(self) -> bool:
        return self.is_(T.ByteType, T.ShortType, T.IntegerType, T.LongType)

    @property
    def number(self) -> bool:
        return self.integral or self.is_(T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class NodeVar:
    """A node: its id, labels and property columns."""

    id: str
    labels: str | None
    props: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if self.labels else []), *self.props.values()]


@dataclass
class EdgeVar:
    id: str
    type: str
    src: str
    dst: str
    directed: str
    props: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.id, self.type, self.src, self.dst, self.directed, *self.props.values()]


@dataclass
class Value:
    """Any other value: a column. ``role`` tells paths and lists of graph elements from other values."""

    col: str
    role: str = "value"

    def columns(self) -> list[str]:
        return [self.col]

    @property
    def id(self) -> str:
        return self.col


@dataclass
class Bound:
    """A variable inside a lambda."""

    expr: Expr


Var = NodeVar | EdgeVar | Value | Bound


def name_of(c: str) -> Column:
    return F.col(f"`{c}`")
