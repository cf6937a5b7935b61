"""Scalar functions by name: argument expressions to an expression."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frontend.lexer import QueryError
from ..operators.values import Expr

FUNCTIONS: dict[str, tuple[int, int, Callable[..., Expr]]] = {}
_LONG, _DOUBLE, _STRING, _BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _simple(names: str, least: int, most: int, f: Callable[..., Column], kind: T.DataType | None = None) -> None:
    for n in names.split():
        FUNCTIONS[n] = (least, most, lambda *a: a[0].make(f, *a[1:], kind=kind))


def _typed(names: str, least: int, most: int):
    def keep(f: Callable[..., Expr]) -> Callable[..., Expr]:
        for n in names.split():
            FUNCTIONS[n] = (least, most, f)
        return f

    return keep


def call(name: str, args: list[Expr]) -> Expr:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name}", code="GG:FN01")
    least, most, f = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least} to {most} arguments, not {len(args)}", code="arity")
    return f(*args)


# ---------------------------------------------------------------- numbers

_d = lambda c: c.cast("double")
_simple("abs", 1, 1, F.abs)
for _n, _f in {
    "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "degrees": F.degrees, "radians": F.radians,
}.items():
    _simple(_n, 1, 1, lambda a, g=_f: g(_d(a)), _DOUBLE)
FUNCTIONS["log"] = (1, 2, lambda *a: a[0].make(lambda x: F.ln(_d(x)), kind=_DOUBLE) if len(a) == 1 else a[0].make(lambda b, x: F.ln(_d(x)) / F.ln(_d(b)), a[1], kind=_DOUBLE))
_simple("floor", 1, 1, lambda a: F.floor(_d(a)).cast("double"), _DOUBLE)
_simple("ceil ceiling", 1, 1, lambda a: F.ceil(_d(a)).cast("double"), _DOUBLE)
_simple("sign", 1, 1, lambda a: F.signum(_d(a)).cast("long"), _LONG)
_simple("power", 2, 2, lambda a, b: F.pow(_d(a), _d(b)), _DOUBLE)
_simple("atan2", 2, 2, lambda a, b: F.atan2(_d(a), _d(b)), _DOUBLE)
_simple("haversin", 1, 1, lambda a: (1 - F.cos(_d(a))) / 2, _DOUBLE)
_simple("mod", 2, 2, lambda a, b: a % b)
_simple("isnan", 1, 1, lambda a: F.isnan(_d(a)), _BOOL)


@_typed("round", 1, 2)
def _round(x: Expr, places: Expr | None = None) -> Expr:
    if places is None:  # halves go up
        return x.make(lambda a: F.floor(_d(a) + 0.5).cast("double"), kind=_DOUBLE)
    return x.make(lambda a, p: F.round(_d(a) * F.pow(F.lit(10.0), p)) / F.pow(F.lit(10.0), p), places, kind=_DOUBLE)


# ---------------------------------------------------------------- strings and bytes

_simple("upper toupper", 1, 1, F.upper, _STRING)
_simple("lower tolower", 1, 1, F.lower, _STRING)
_simple("starts_with", 2, 2, lambda a, b: a.startswith(b), _BOOL)
_simple("ends_with", 2, 2, lambda a, b: a.endswith(b), _BOOL)
_simple("contains", 2, 2, lambda a, b: a.contains(b), _BOOL)
_simple("regex_match", 2, 2, lambda a, b: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), _BOOL)
_simple("left", 2, 2, lambda a, n: F.substring(a, F.lit(1), n))
_simple("replace", 3, 3, lambda a, b, c: F.replace(a, b, c), _STRING)
_simple("split", 2, 2, lambda a, b: F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E")), -1), T.ArrayType(_STRING))
_simple("byte_length octet_length", 1, 1, lambda a: F.octet_length(a).cast("long"), _LONG)
_simple("right", 2, 2, lambda a, n: F.when(n <= 0, F.substring(a, 1, 0)).otherwise(F.substring(a, F.greatest(F.lit(1), F.length(a) - n + 1), n)))
FUNCTIONS["substring"] = (2, 3, lambda s, a, n=None: s.make(lambda x, y: F.substring(x, y + 1, F.lit(2**31 - 1)), a) if n is None else s.make(lambda x, y, z: F.substring(x, y + 1, z), a, n))


def _trim_bytes(s: Expr, c: Expr | None, ends: str) -> Expr:
    """Bytes without leading or trailing ones, by their hexadecimal digits."""

    def f(x: Column, *given: Column) -> Column:
        cut = F.concat(F.lit("("), F.hex(given[0]) if given else F.lit("20"), F.lit(")+"))
        front, back = F.concat(F.lit("^"), cut), F.concat(cut, F.lit("$"))
        out = F.hex(x)
        out = F.regexp_replace(out, front, F.lit("")) if "l" in ends else out
        return F.unhex(F.regexp_replace(out, back, F.lit("")) if "r" in ends else out)

    return s.make(f, *([c] if c is not None else []), kind=T.BinaryType())


def _trimmer(one: Callable[..., Column], ends: str) -> Callable[..., Expr]:
    return lambda s, c=None: _trim_bytes(s, c, ends) if s.is_(T.BinaryType) else s.make(lambda x: one(x), kind=_STRING) if c is None else s.make(lambda x, y: one(x, y), c, kind=_STRING)


for _n, _f in {"btrim": F.btrim, "trim": F.btrim, "ltrim": F.ltrim, "rtrim": F.rtrim}.items():
    FUNCTIONS[_n] = (1, 2, _trimmer(_f, {"ltrim": "l", "rtrim": "r"}.get(_n, "lr")))


def _normalized(form: str, text: Column, test: bool) -> Column:
    import unicodedata

    import pandas as pd

    def change(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    change.__annotations__ = {"s": pd.Series, "return": pd.Series}
    got = F.pandas_udf(change, "string")(text)
    return got == text if test else got


_FORMS = ("NFC", "NFD", "NFKC", "NFKD")
for _form in _FORMS:
    _simple(f"normalize_{_form.lower()}", 1, 1, lambda a, g=_form: _normalized(g, a, False), _STRING)
    _simple(f"is_normalized_{_form.lower()}", 1, 1, lambda a, g=_form: _normalized(g, a, True), _BOOL)


# ---------------------------------------------------------------- conversions


def _convert(kind: str) -> Callable[[Column], Column]:
    if kind == "boolean":
        return lambda a: F.when(F.lower(F.trim(a.cast("string"))).isin("true", "false"), F.lower(F.trim(a.cast("string"))) == "true")
    if kind == "long":
        return lambda a: F.coalesce(a.try_cast("long"), a.try_cast("double").try_cast("long"))
    return lambda a: a.try_cast(kind)


for _n, _kind, _out in (("integer", "long", _LONG), ("float", "double", _DOUBLE), ("boolean", "boolean", _BOOL), ("string", "string", _STRING)):
    _simple(f"to{_n} to{_n}ornull", 1, 1, _convert(_kind), _out)
    _simple(f"to{_n}list", 1, 1, lambda a, g=_convert(_kind): F.transform(a, lambda x: g(x)), T.ArrayType(_out))


@_typed("tostring tostringornull", 1, 1)
def _to_string(x: Expr) -> Expr:
    return x.make(lambda a: a.cast("string"), kind=_STRING)


# ---------------------------------------------------------------- lists and maps


@_typed("size cardinality", 1, 1)
def _size(x: Expr) -> Expr:
    if x.is_(T.StringType):
        return x.make(lambda a: F.char_length(a).cast("long"), kind=_LONG)
    if x.is_(T.StructType) and {"nodes", "edges"} <= set(x.type.names):
        return x.make(lambda a: (2 * F.size(a["edges"]) + 1).cast("long"), kind=_LONG)
    if x.is_(T.StructType):
        return x.make(lambda a, n=len(x.type.names): F.when(a.isNotNull(), F.lit(n)).cast("long"), kind=_LONG)
    return x.make(lambda a: F.when(a.isNotNull(), F.size(a)).cast("long"), kind=_LONG)


_simple("char_length character_length", 1, 1, lambda a: F.char_length(a).cast("long"), _LONG)
_simple("head", 1, 1, lambda a: F.try_element_at(a, F.lit(1)))
_simple("last", 1, 1, lambda a: F.try_element_at(a, F.lit(-1)))
_simple("tail", 1, 1, lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))
_simple("trim_list", 2, 2, lambda a, n: F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)).cast("int")))


@_typed("reverse", 1, 1)
def _reverse(x: Expr) -> Expr:
    return x.make(F.reverse)


@_typed("isempty", 1, 1)
def _is_empty(x: Expr) -> Expr:
    return x.make((lambda a: F.char_length(a) == 0) if x.is_(T.StringType) else (lambda a: F.when(a.isNotNull(), F.size(a) == 0)), kind=_BOOL)


@_typed("range", 2, 3)
def _range(a: Expr, b: Expr, step: Expr | None = None) -> Expr:
    if step is None:
        return a.make(lambda x, y: F.when(x <= y, F.sequence(x.cast("long"), y.cast("long"))).otherwise(F.array().cast("array<bigint>")), b)
    ok = lambda x, y, s: ((s > 0) & (x <= y)) | ((s < 0) & (x >= y))
    return a.make(lambda x, y, s: F.when(ok(x, y, s), F.sequence(x.cast("long"), F.when(ok(x, y, s), y).otherwise(x).cast("long"), F.when(ok(x, y, s), s).otherwise(F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>")), b, step)


@_typed("coalesce", 1, 99)
def _coalesce(*a: Expr) -> Expr:
    return a[0].make(lambda *x: F.coalesce(*x), *a[1:])


_simple("nullif", 2, 2, F.nullif)

# ---------------------------------------------------------------- paths


def _path(names: str, f: Callable[[Column], Column], kind: T.DataType | None = None) -> None:
    _simple(names, 1, 1, f, kind)


_path("nodes", lambda p: p["nodes"])


def _elements(p: Column) -> Column:
    """Nodes and edges in turn, each as its id with its labels or its type."""

    def one(i: Column) -> Column:
        node, edge = F.try_element_at(p["nodes"], (i / 2 + 1).cast("int")), F.try_element_at(p["edges"], (i / 2 + 1).cast("int"))
        even = i % 2 == 0
        return F.struct(F.when(even, node["id"]).otherwise(edge["id"]).alias("id"), F.when(even, node["labels"]).alias("labels"), F.when(~even, edge["type"]).alias("type"))

    return F.transform(F.sequence(F.lit(0), 2 * F.size(p["edges"])), one)


_path("elements", _elements)
_path("relationships edges", lambda p: p["edges"])


@_typed("length path_length", 1, 1)
def _length(x: Expr) -> Expr:
    if x.is_(T.StructType):
        return x.make(lambda p: F.size(p["edges"]).cast("long"), kind=_LONG)
    return _size(x)


# ---------------------------------------------------------------- time

#: Fixed value: the parts of a duration.
DURATION = "months bigint, days bigint, seconds bigint, nanos bigint"
_ISO = re.compile(r"(-)?P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?$", re.I)


def duration_struct(months: Column, days: Column, seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), whole.cast("long").alias("seconds"), F.round((seconds - whole) * 1e9).cast("long").alias("nanos"))


def parse_duration(text: str) -> tuple[float, float, float]:
    m = _ISO.match(text.strip())
    if m is None:
        raise QueryError(f"not a duration: {text!r}", code="value")
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi, s = (float(x or 0) * sign for x in m.groups()[1:])
    return y * 12 + mo, w * 7 + d, h * 3600 + mi * 60 + s


def is_duration(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["months", "days", "seconds", "nanos"]


def shift(x: Expr, d: Expr, sign: int) -> Expr:
    """A date or time plus or minus a duration."""
    if x.is_(T.DateType):
        return x.make(lambda a, b: F.date_add(F.add_months(a, (b["months"] * sign).cast("int")), (b["days"] * sign).cast("int")), d)
    step = lambda b: F.make_interval(months=(b["months"] * sign).cast("int"), days=(b["days"] * sign).cast("int"), secs=((b["seconds"] + b["nanos"] / 1e9) * sign).cast("decimal(18,6)"))
    return x.make(lambda a, b: a + step(b), d)


_simple("date", 1, 1, lambda a: a.cast("date"), T.DateType())
_simple("datetime zoned_datetime", 1, 1, lambda a: a.cast("timestamp"), T.TimestampType())
_simple("localdatetime local_datetime", 1, 1, lambda a: a.cast("timestamp_ntz"), T.TimestampNTZType())


@_typed("duration_between duration.between", 2, 2)
def _between(a: Expr, b: Expr) -> Expr:
    def f(x: Column, y: Column) -> Column:
        x, y = x.cast("timestamp"), y.cast("timestamp")
        months = F.months_between(y, x, False).cast("long")
        rest = F.unix_micros(y) - F.unix_micros(x + F.make_interval(months=months.cast("int")))
        days = (rest / 86_400_000_000).cast("long")
        return duration_struct(months, days, (rest - days * 86_400_000_000) / 1e6)

    return a.make(f, b)


_simple("duration.indays", 2, 2, lambda a, b: duration_struct(F.lit(0), F.date_diff(b, a), F.lit(0.0)))
_simple("date.truncate", 2, 2, lambda u, d: F.call_function("trunc", d, u), T.DateType())
_simple("datetime.truncate", 2, 2, lambda u, d: F.call_function("date_trunc", u, d), T.TimestampType())


def _clock(zoned: bool) -> Callable[[Column], Column]:
    """A time of day as its parts; offset is minutes east of UTC, null for a local time, 0 where a zoned one names none."""

    def f(a: Column) -> Column:
        text = F.when(F.typeof(a) == "timestamp", F.date_format(a.try_cast("timestamp"), "HH:mm:ss.SSSSSS")).otherwise(a.cast("string"))
        got = lambda k: F.regexp_extract(text, r"(\d\d):?(\d\d)(?::?(\d\d)(?:[.,](\d{1,9}))?)?(?:([+-])(\d\d):?(\d\d))?Z?\]?$", k)
        number = lambda k: F.when(got(k) == "", 0).otherwise(got(k).try_cast("long"))
        east = number(6) * 60 + number(7)
        offset = F.when(got(5) == "-", -east).otherwise(east) if zoned else F.lit(None).cast("long")
        nanos = F.rpad(got(4), 9, "0").try_cast("long")
        parts = F.struct(number(1).alias("hour"), number(2).alias("minute"), number(3).alias("second"), F.when(got(4) == "", 0).otherwise(nanos).alias("nanosecond"), offset.alias("offset"))
        return F.when(got(1) != "", parts)

    return f


_simple("time zoned_time", 1, 1, _clock(True))
_simple("localtime local_time", 1, 1, _clock(False))
_simple("datetime.fromepoch", 2, 2, lambda s, n: F.timestamp_micros(s * 1_000_000 + (n / 1000).cast("long")))
_simple("datetime.fromepochmillis", 1, 1, F.timestamp_millis)

_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.day, "quarter": F.quarter, "week": F.weekofyear, "dayofweek": lambda c: F.weekday(c) + 1, "ordinalday": F.dayofyear,
    "hour": F.hour, "minute": F.minute, "second": F.second, "epochseconds": F.unix_seconds, "epochmillis": F.unix_millis,
    "millisecond": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)), "microsecond": lambda c: F.pmod(F.unix_micros(c), F.lit(1_000_000)),
}


def part(x: Expr, name: str) -> Expr | None:
    """A component of a date, time or duration."""
    if is_duration(x.type):
        f = {"months": lambda d: d["months"], "days": lambda d: d["days"], "seconds": lambda d: d["seconds"], "years": lambda d: (d["months"] / 12).cast("long"), "minutes": lambda d: (d["seconds"] / 60).cast("long"), "hours": lambda d: (d["seconds"] / 3600).cast("long"), "weeks": lambda d: (d["days"] / 7).cast("long"), "nanoseconds": lambda d: d["seconds"] * 1_000_000_000 + d["nanos"]}.get(name.lower())
    elif x.is_(T.DateType, T.TimestampType, T.TimestampNTZType):
        f = _PARTS.get(name.lower())
    else:
        return None
    return None if f is None else x.make(lambda a: f(a).cast("long"), kind=_LONG)


# ---------------------------------------------------------------- space


@_typed("point.distance", 2, 2)
def _distance(a: Expr, b: Expr) -> Expr:
    def f(p: Column, q: Column) -> Column:
        lat1, lat2 = F.radians(p["y"]), F.radians(q["y"])
        h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(q["x"] - p["x"]) / 2), 2)
        flat = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2) + F.pow(F.coalesce(p["z"], F.lit(0.0)) - F.coalesce(q["z"], F.lit(0.0)), 2))
        return F.when(p["srid"] == q["srid"], F.when(p["srid"].isin(4326, 4979), 2 * 6378140.0 * F.asin(F.sqrt(h))).otherwise(flat))

    return a.make(f, b, kind=_DOUBLE)


_simple("point.withinbbox", 3, 3, lambda p, a, b: (p["x"] >= a["x"]) & (p["x"] <= b["x"]) & (p["y"] >= a["y"]) & (p["y"] <= b["y"]), _BOOL)
