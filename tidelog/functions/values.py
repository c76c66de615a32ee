"""Columns with the kind of their values, and the language's loose rules for combining them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class Value(NamedTuple):
    """kind: int, float, str, bool, time, span, list, null."""

    col: Column
    kind: str
    #: the constant behind a literal
    literal: object = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "float")


def null() -> Value:
    return Value(F.lit(None), "null")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return "list"
    if isinstance(t, T.NullType):
        return "null"
    return "str"


def of_column(col: Column, t: T.DataType) -> Value:
    kind = kind_of(t)
    if isinstance(t, T.TimestampNTZType | T.DateType):
        col = col.cast("timestamp")
    elif isinstance(t, T.DecimalType | T.FloatType):
        col = col.cast("double")
    elif kind == "int" and not isinstance(t, T.LongType):
        col = col.cast("long")
    elif kind == "str" and not isinstance(t, T.StringType):
        col = F.to_json(col) if isinstance(t, T.StructType | T.MapType | T.ArrayType) else col.cast("string")
    return Value(col, kind)


def literal(value: object) -> Value:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Value(F.lit(value), "bool", value)
    if isinstance(value, int):
        return Value(F.lit(value).cast("long"), "int", value)
    if isinstance(value, float):
        return Value(F.lit(value), "float", value)
    return Value(F.lit(str(value)), "str", str(value))


def unquoted(v: Value) -> Value:
    """A quoted literal that is a number is a number."""
    if v.kind == "str" and isinstance(v.literal, str):
        for kind in (int, float):
            try:
                number = kind(v.literal)
            except ValueError:
                continue
            if number == number and abs(number) != float("inf"):
                return literal(number)
    return v


def number(v: Value) -> Column:
    """As a double; null where the text is no number."""
    if v.kind in ("int", "float", "span"):
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    if v.kind == "time":
        return F.unix_micros(v.col) / F.lit(1e6)
    if v.kind == "null":
        return F.lit(None).cast("double")
    # the guard keeps out what only Spark's cast takes: spaces, "1d", "inf"
    return F.when(text(v).rlike(NUMBER), text(v).try_cast("double"))


def text(v: Value) -> Column:
    if v.kind == "list":
        return F.array_join(v.col, "|||")
    if v.kind == "time":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return v.col.cast("string") if v.kind != "str" else v.col


def instant(v: Value) -> Column:
    if v.kind == "time":
        return v.col
    if v.kind in ("int", "float"):
        return F.timestamp_micros((v.col.cast("double") * 1_000_000).cast("long"))
    return text(v).try_cast("timestamp")


def truth(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.numeric or v.kind == "span":
        return v.col != 0
    if v.kind == "null":
        return F.lit(None).cast("boolean")
    return text(v) != "" if v.kind in ("str", "list") else v.col.isNotNull()


def glob_pattern(glob: str, anchored: bool = True) -> str:
    """A regular expression for * and ?; everything else is literal."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c not in "_-/ " else c for c in glob)
    return f"(?s)^{body}$" if anchored else f"(?s){body}"


def compare(op: str, a: Value, b: Value) -> Column:
    """=, !=, <, <=, >, >= between any kinds, with SQL's nulls."""
    if op in ("=", "!="):
        for x, y in ((a, b), (b, a)):
            if isinstance(y.literal, str) and y.kind == "str" and any(c in y.literal for c in "*?"):
                same = text(x).rlike(glob_pattern(y.literal))
                return same if op == "=" else ~same
    a, b = unquoted(a), unquoted(b)
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if "time" in (a.kind, b.kind):
        return apply(op, instant(a), instant(b))
    kinds = {a.kind, b.kind}
    if kinds <= {"int", "float", "span"}:
        return apply(op, a.col, b.col)
    if kinds == {"bool"}:
        return apply(op, a.col, b.col)
    x, y = text(a), text(b)
    if op in ("=", "!=") and kinds <= {"str", "list", "bool"}:
        return apply(op, x, y)
    both = number(a).isNotNull() & number(b).isNotNull()
    return F.when(both, apply(op, number(a), number(b))).otherwise(apply(op, x, y))


def apply(op: str, x: Column, y: Column) -> Column:
    match op:
        case "=":
            return x == y
        case "!=":
            return x != y
        case "<":
            return x < y
        case "<=":
            return x <= y
        case ">":
            return x > y
    return x >= y


def same_value(a: Value, b: Value) -> Column:
    return compare("=", a, b)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if "time" in (a.kind, b.kind):
        if b.kind == "span" and op in "+-":
            micros = (b.col.cast("double") * 1_000_000).cast("long")
            return Value(F.timestamp_micros(F.unix_micros(a.col) + (micros if op == "+" else -micros)), "time")
        if a.kind == "span" and op == "+":
            return arithmetic("+", b, a)
    if op == ".":
        return Value(F.concat(text(a), text(b)), "str")
    if op == "+" and a.kind in ("str", "list") and b.kind in ("str", "list"):
        return Value(F.concat(text(a), text(b)), "str")
    if {a.kind, b.kind} == {"int"}:
        match op:
            case "+":
                return Value(F.try_add(a.col, b.col), "int")
            case "-":
                return Value(F.try_subtract(a.col, b.col), "int")
            case "*":
                return Value(F.try_multiply(a.col, b.col), "int")
            case "/":
                return Value(F.when(b.col != 0, F.call_function("div", a.col, F.when(b.col != 0, b.col))), "int")
            case "%":
                return Value(F.try_mod(a.col, b.col), "int")
    if op == "%":
        # of whole numbers only
        x, y = (F.when(n == F.floor(n), n.cast("long")) for n in (number(a), number(b)))
        return Value(F.try_mod(x, y), "int")
    x, y = number(a), number(b)
    match op:
        case "+":
            return Value(x + y, "float")
        case "-":
            return Value(x - y, "float")
        case "*":
            return Value(x * y, "float")
    return Value(F.try_divide(x, y), "float")


def bucket(t: Column, seconds: float) -> Column:
    """The beginning of a timestamp's bucket, counted from the epoch."""
    size = F.lit(int(seconds * 1_000_000))
    return F.timestamp_micros(F.unix_micros(t) - F.pmod(F.unix_micros(t), size))


def sql_type(kind: str) -> str:
    return {"int": "long", "float": "double", "str": "string", "bool": "boolean", "time": "timestamp", "span": "double", "list": "array<string>", "null": "string"}[kind]
