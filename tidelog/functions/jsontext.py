"""Functions over JSON text. Reading is built-in; set, remove and merge are Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.values import Value, text


def steps(path: str) -> list[str | int]:
    """`a.b[0].c`, `items[*].p`, `$.a` as names, places and "*"."""
    out: list[str | int] = []
    for name, place in re.findall(r"([^.\[\]]+)|\[(\*|-?\d+)\]", path.removeprefix("$").lstrip(".")):
        out.append(name if name else place if place == "*" else int(place))
    return out


def json_path(parts: list[str | int]) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) or p == "*" else f"['{p}']" if re.search(r"\W", p) else f".{p}" for p in parts)


def extract(source: Column, path: str) -> Column:
    """The value as text; objects and arrays as JSON. Negative places count from the end."""
    parts = steps(path)
    for at, p in enumerate(parts):
        if isinstance(p, int) and p < 0:
            items = F.from_json(F.get_json_object(source, json_path(parts[:at])) if at else source, "array<string>")
            item = F.when(F.size(items) >= -p, F.element_at(items, p))
            rest = parts[at + 1 :]
            return extract(item, json_path(rest)) if rest else item
    if "*" in parts:
        # one match comes without brackets
        found = F.get_json_object(source, json_path(parts))
        return F.when(found.startswith("["), found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]")))
    return F.get_json_object(source, json_path(parts)) if parts else source


def at_path(args: list[Value]) -> Column:
    source = text(args[0])
    if len(args) > 1:
        if not isinstance(args[1].literal, str):
            raise ValueError("a JSON path must be a constant")
        return extract(source, args[1].literal)
    return source


def valid(source: Column) -> Column:
    return F.coalesce(F.try_parse_json(source).isNotNull(), F.lit(False))


def type_name(source: Column) -> Column:
    return type_name_of_variant(F.try_parse_json(source))


def scalar_type(source: Column, path: str) -> Column:
    """Type of the value at a path: text values keep their quotes in a variant."""
    parts = steps(path)
    return type_name_of_variant(F.try_variant_get(F.try_parse_json(source), json_path(parts), "variant"))


def type_name_of_variant(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")


def as_json(v: Value) -> Column:
    """One value as JSON text."""
    if v.kind == "null":
        return F.lit("null")
    if v.kind in ("int", "float", "bool"):
        return F.coalesce(v.col.cast("string"), F.lit("null"))
    quoted = F.to_json(F.struct(text(v).alias("v")))
    return F.when(text(v).isNull(), "null").otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))


def build_object(args: list[Value]) -> Column:
    fields = [F.concat(as_json(Value(text(k), "str")), F.lit(":"), as_json(v)) for k, v in zip(args[::2], args[1::2])]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def build_array(args: list[Value]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *map(as_json, args)), F.lit("]"))


def _loaded(s):
    try:
        return json.loads(s) if s is not None else None
    except ValueError:
        return None


def _dumped(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def json_set(source: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    def one(s, p, v):
        root = _loaded(s)
        names = [x for x in steps(p or "") if isinstance(x, str)]
        if not isinstance(root, dict) or not names:
            return None
        at = root
        for n in names[:-1]:
            if not isinstance(at.get(n), dict):
                at[n] = {}
            at = at[n]
        at[names[-1]] = _loaded(v)
        return _dumped(root)

    return pd.Series([one(*x) for x in zip(source, path, value)], dtype=object)


@F.pandas_udf(T.StringType())
def json_remove(source: pd.Series, path: pd.Series) -> pd.Series:
    def one(s, p):
        root = _loaded(s)
        names = [x for x in steps(p or "") if isinstance(x, str)]
        if not isinstance(root, dict):
            return None
        at = root
        for n in names[:-1]:
            at = at.get(n)
            if not isinstance(at, dict):
                return _dumped(root)
        if names:
            at.pop(names[-1], None)
        return _dumped(root)

    return pd.Series([one(*x) for x in zip(source, path)], dtype=object)


@F.pandas_udf(T.StringType())
def json_merge(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        x, y = _loaded(x), _loaded(y)
        return _dumped(x | y) if isinstance(x, dict) and isinstance(y, dict) else None

    return pd.Series([one(*x) for x in zip(a, b)], dtype=object)
