"""The scalar functions of the language, as builders of columns."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import jsontext
from tidelog.functions.values import NUMBER, Value, compare, glob_pattern, instant, number, sql_type, text, truth
from tidelog.lang.tokens import QueryError

Builder = Callable[[list[Value]], Value]
FUNCTIONS: dict[str, tuple[int, int | None, Builder]] = {}


def function(name: str, least: int, most: int | None = -1):
    """Register a builder under one or more names; `most` None: any number of arguments."""

    def register(f: Builder) -> Builder:
        for n in name.split():
            FUNCTIONS[n] = (least, least if most == -1 else most, f)
        return f

    return register


def call(name: str, args: list[Value]) -> Value:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name}")
    least, most, build = FUNCTIONS[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise QueryError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(args)}")
    return build(args)


def common(values: list[Value]) -> tuple[str, list[Column]]:
    """One kind for all values, and the values in it."""
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) == 1:
        kind = kinds.pop()
        return kind, [v.col.cast(sql_type(kind)) if v.kind == "null" else v.col for v in values]
    if not kinds:
        return "null", [v.col.cast("string") for v in values]
    if kinds <= {"int", "float"}:
        return "float", [v.col.cast("double") for v in values]
    return "str", [text(v) for v in values]


def constant(v: Value, what: str) -> str:
    if not isinstance(v.literal, str):
        raise QueryError(f"{what} must be a quoted constant")
    return v.literal


# ---- choice and nulls


@function("if", 3)
def _if(a):
    kind, (x, y) = common(a[1:])
    return Value(F.when(truth(a[0]), x).otherwise(y), kind)


@function("case", 2, None)
def _case(a):
    pairs, rest = a[: len(a) // 2 * 2], a[len(a) // 2 * 2 :]
    kind, columns = common([*pairs[1::2], *rest])
    out = F
    for condition, value in zip(pairs[::2], columns):
        out = out.when(truth(condition), value)
    return Value(out.otherwise(columns[-1]) if rest else out, kind)


@function("coalesce", 1, None)
def _coalesce(a):
    kind, columns = common(a)
    return Value(F.coalesce(*columns), kind)


@function("null", 0)
def _null(a):
    return Value(F.lit(None), "null")


@function("isnull", 1)
def _isnull(a):
    return Value(a[0].col.isNull(), "bool")


@function("isnotnull", 1)
def _isnotnull(a):
    return Value(a[0].col.isNotNull(), "bool")


# ---- numbers


@function("tonumber", 1)
def _tonumber(a):
    return Value(number(a[0]), "float")


@function("toint", 1)
def _toint(a):
    return Value(number(a[0]).try_cast("long"), "int")


@function("tostring", 1)
def _tostring(a):
    return Value(text(a[0]), "str")


@function("round", 1, 2)
def _round(a):
    x = number(a[0])
    digits = number(a[1]).cast("int") if len(a) > 1 else F.lit(0)
    scale = F.pow(F.lit(10.0), digits)
    # half away from zero on the scaled value
    return Value(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale, "float")


@function("ln", 1)
def _ln(a):
    return Value(F.when(number(a[0]) > 0, F.ln(F.greatest(number(a[0]), F.lit(1e-320)))), "float")


@function("sqrt", 1)
def _sqrt(a):
    return Value(F.when(number(a[0]) >= 0, F.sqrt(F.greatest(number(a[0]), F.lit(0.0)))), "float")


@function("abs", 1)
def _abs(a):
    return Value(F.abs(a[0].col), "int") if a[0].kind == "int" else Value(F.abs(number(a[0])), "float")


@function("ceil ceiling", 1)
def _ceil(a):
    return Value(F.ceil(number(a[0])).cast("double"), "float")


@function("floor", 1)
def _floor(a):
    return Value(F.floor(number(a[0])).cast("double"), "float")


def pick(a: list[Value], op: str) -> Value:
    kind, (x, y) = common(a)
    if kind in ("int", "float", "time"):
        return Value(F.greatest(x, y) if op == ">" else F.least(x, y), kind)
    first = compare(op, Value(x, kind), Value(y, kind))
    return Value(F.when(y.isNull() | first, x).when(x.isNull() | ~first, y), kind)


@function("max", 2)
def _max(a):
    return pick(a, ">")


@function("min", 2)
def _min(a):
    return pick(a, "<")


@function("isnum isnumeric", 1)
def _isnum(a):
    return Value(F.lit(True) & a[0].col.isNotNull() if a[0].numeric else F.coalesce(text(a[0]).rlike(NUMBER), F.lit(False)), "bool")


@function("isint", 1)
def _isint(a):
    return Value(F.coalesce(text(a[0]).rlike(r"^[+-]?\d+$"), F.lit(False)), "bool")


@function("isstr", 1)
def _isstr(a):
    return Value(a[0].col.isNotNull(), "bool")


# ---- text


@function("len", 1)
def _len(a):
    return Value(F.octet_length(text(a[0])).cast("long"), "int")


@function("lower", 1)
def _lower(a):
    return Value(F.lower(text(a[0])), "str")


@function("upper", 1)
def _upper(a):
    return Value(F.upper(text(a[0])), "str")


@function("trim", 1)
def _trim(a):
    return Value(F.trim(text(a[0])), "str")


@function("substr", 2, 3)
def _substr(a):
    start = F.greatest(number(a[1]).cast("int"), F.lit(1))
    length = number(a[2]).cast("int") if len(a) > 2 else F.lit(2**31 - 1)
    return Value(F.substring(text(a[0]), start, length), "str")


@function("match", 2)
def _match(a):
    return Value(F.coalesce(text(a[0]).rlike(java_regex(constant(a[1], "a pattern"))), F.lit(False)), "bool")


@function("replace", 3)
def _replace(a):
    replacement = re.sub(r"\$\{(\d+)\}", r"$\1", constant(a[2], "a replacement"))
    return Value(F.regexp_replace(text(a[0]), java_regex(constant(a[1], "a pattern")), replacement), "str")


@function("split", 2)
def _split(a):
    return Value(F.split(text(a[0]), "\\Q" + constant(a[1], "a delimiter") + "\\E"), "list")


@function("startswith", 2)
def _startswith(a):
    return Value(F.coalesce(text(a[0]).startswith(text(a[1])), F.lit(False)), "bool")


@function("endswith", 2)
def _endswith(a):
    return Value(F.coalesce(text(a[0]).endswith(text(a[1])), F.lit(False)), "bool")


@function("contains", 2)
def _contains(a):
    return Value(F.coalesce(text(a[0]).contains(text(a[1])), F.lit(False)), "bool")


@function("ilike", 2)
def _ilike(a):
    return Value(text(a[0]).ilike(constant(a[1], "a pattern")), "bool")


@function("glob", 2)
def _glob(a):
    return Value(text(a[0]).rlike(glob_pattern(constant(a[1], "a pattern"))), "bool")


def java_regex(pattern: str) -> str:
    """Named groups `(?P<name>` become plain ones: Java's names are narrower."""
    return re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern)


# ---- time

#: Tokens of strftime: a fixed table of the language.
TIME_TOKENS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "p": "a", "I": "hh", "Z": "z", "z": "xx", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "y": "yy", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}


def time_format(pattern: str) -> str:
    out, plain = "", ""

    def flush() -> str:
        return "'" + plain.replace("'", "''") + "'" if plain else ""

    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "%" and at + 1 < len(pattern):
            at += 1
            if pattern[at] == "%":
                plain += "%"
            elif pattern[at] in TIME_TOKENS:
                out += flush() + TIME_TOKENS[pattern[at]]
                plain = ""
            else:
                raise QueryError(f"strftime: unknown %{pattern[at]}")
        else:
            plain += c
        at += 1
    return out + flush()


@function("strftime", 2)
def _strftime(a):
    return Value(F.date_format(instant(a[0]), time_format(constant(a[1], "a time format"))), "str")


@function("now", 0)
def _now(a):
    return Value(F.current_timestamp(), "time")


# ---- networks


@F.pandas_udf(T.BooleanType())
def _in_network6(network: pd.Series, address: pd.Series) -> pd.Series:
    def one(n, x):
        try:
            return ipaddress.ip_address(x) in ipaddress.ip_network(n, strict=False)
        except (ValueError, TypeError):
            return False

    return pd.Series([one(*p) for p in zip(network, address)])


IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


@function("cidrmatch", 2)
def _cidrmatch(a):
    network = ipaddress.ip_network(constant(a[0], "a network"), strict=False)
    address = text(a[1])
    if network.version == 6:
        return Value(_in_network6(F.lit(str(network)), address), "bool")
    octets = F.split(address, r"\.")
    value = sum((F.get(octets, i).cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    low, high = int(network.network_address), int(network.broadcast_address)
    return Value(F.coalesce(F.when(address.rlike(IPV4), value.between(low, high)), F.lit(False)), "bool")


# ---- lists


def as_list(v: Value) -> Column:
    return v.col if v.kind == "list" else F.when(text(v).isNull(), F.array().cast("array<string>")).otherwise(F.split(text(v), r"\|\|\|"))


@function("mvappend", 1, None)
def _mvappend(a):
    return Value(F.filter(F.concat(*map(as_list, a)), lambda x: x.isNotNull()), "list")


@function("mvjoin", 2)
def _mvjoin(a):
    return Value(F.array_join(as_list(a[0]), constant(a[1], "a delimiter")), "str")


@function("mvdedup", 1)
def _mvdedup(a):
    return Value(F.array_distinct(as_list(a[0])), "list")


@function("mvcount", 1)
def _mvcount(a):
    return Value(F.coalesce(F.size(as_list(a[0])), F.lit(0)).cast("long"), "int")


# ---- JSON


@function("json_extract", 2)
def _json_extract(a):
    return Value(jsontext.at_path(a), "str")


@function("json_valid", 1)
def _json_valid(a):
    return Value(jsontext.valid(text(a[0])), "bool")


@function("json_keys", 1, 2)
def _json_keys(a):
    return Value(F.to_json(F.json_object_keys(jsontext.at_path(a))), "str")


@function("json_array_length", 1, 2)
def _json_array_length(a):
    return Value(F.json_array_length(jsontext.at_path(a)).cast("long"), "int")


@function("json_object", 0, None)
def _json_object(a):
    if len(a) % 2:
        raise QueryError("json_object takes names and values in pairs")
    return Value(jsontext.build_object(a), "str")


@function("json_array", 0, None)
def _json_array(a):
    return Value(jsontext.build_array(a), "str")


@function("json_type", 1, 2)
def _json_type(a):
    return Value(jsontext.scalar_type(text(a[0]), constant(a[1], "a path")) if len(a) > 1 else jsontext.type_name(text(a[0])), "str")


@function("json_set", 3)
def _json_set(a):
    return Value(jsontext.json_set(text(a[0]), text(a[1]), jsontext.as_json(a[2])), "str")


@function("json_remove", 2)
def _json_remove(a):
    return Value(jsontext.json_remove(text(a[0]), text(a[1])), "str")


@function("json_merge", 2)
def _json_merge(a):
    return Value(jsontext.json_merge(text(a[0]), text(a[1])), "str")
