"""Projection, renaming, null filling, packing, sorting, limiting: DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.values import number, of_column, text
from tidelog.lang.tree import SortKey
from tidelog.plans.scope import BUILTIN, quoted


def matching(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns in the order of the names; globs in the order of the columns; unknown names are skipped."""
    out: list[str] = []
    for n in names:
        out += [c for c in df.columns if c not in out and (c == n or ("*" in n or "?" in n) and fnmatchcase(c, n))]
    return out


def keep(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in matching(df, names)])


def omit(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = set(matching(df, names))
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def rename(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """All at once; a renamed column replaces one that has its new name."""
    new = {a: b for a, b in pairs if a in df.columns}
    taken = set(new.values())
    return df.select(*[quoted(c).alias(new.get(c, c)) for c in df.columns if c in new or c not in taken])


def fill_null(df: DataFrame, value: object, names: Sequence[str]) -> DataFrame:
    """The value in the column's type where it can be, else the column becomes text."""
    columns = {}
    for n in names or df.columns:
        if n not in df.columns:
            columns[n] = F.lit(str(value))
            continue
        kind = df.schema[n].dataType
        fits = isinstance(kind, T.StringType) or isinstance(kind, T.NumericType) and _is_number(value)
        columns[n] = F.coalesce(quoted(n), F.lit(value if not isinstance(kind, T.StringType) else str(value)).cast(kind)) if fits else F.coalesce(text(of_column(quoted(n), kind)), F.lit(str(value)))
    return df.withColumns(columns)


def _is_number(value: object) -> bool:
    try:
        float(str(value))
    except ValueError:
        return False
    return True


def pack(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """A JSON object of the fields, keys sorted, nulls left out; without names all but built-in and hidden ones."""
    chosen = sorted(n for n in (names or [c for c in df.columns if c not in BUILTIN and not c.startswith("_")]) if n in df.columns)
    packed = F.to_json(F.struct(*[quoted(n).alias(n) for n in chosen])) if chosen else F.lit("{}")
    return df.withColumn(target, packed)


def sort_columns(df: DataFrame, keys: Sequence[SortKey], ties: bool = True) -> list[Column]:
    """Nulls first ascending, last descending; numbers in text sort as numbers; ties by all other columns."""
    out: list[Column] = []
    for k in keys:
        if k.name not in df.columns:
            continue
        v = of_column(quoted(k.name), df.schema[k.name].dataType)
        parts = [F.when(v.col.isNotNull(), number(v).isNull()), number(v), text(v)] if v.kind == "str" else [quoted(k.name)]
        out += [p.desc() if k.descending else p.asc() for p in parts]
    if ties:
        named = {k.name for k in keys}
        rest = sorted(c for c in df.columns if c not in named and isinstance(df.schema[c].dataType, T.AtomicType) and not isinstance(df.schema[c].dataType, T.VariantType))
        out += [quoted(c).asc() for c in rest]
    return out


def dedup(df: DataFrame, names: Sequence[str], n: int, order: Sequence[Column], key: Column | None) -> DataFrame:
    """The first n rows of each key; a null is a key of its own."""
    keys = [quoted(c) if c in df.columns else F.lit(None).cast("string") for c in names]
    if n == 1 and key is not None:
        # one row a key and task travels, so a hot key is no burden
        row = F.struct(*[quoted(c).alias(c) for c in df.columns])
        best = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, key).alias("__row"))
        return best.select("__row.*")
    if n == 1 and not order:
        return df.dropDuplicates([c for c in names if c in df.columns])
    window = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")
