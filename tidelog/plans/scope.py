"""What a name means at one place of a pipeline, and the order its rows are in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import jsontext
from tidelog.functions.values import Value, null, number, of_column, text
from tidelog.lang.tree import SortKey

#: Names that mean the same field.
ALIASES = {"source": "_source", "sourcetype": "_sourcetype"}
BUILTIN = ("_time", "_raw", "_source", "source", "_sourcetype", "sourcetype", "host", "index")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Frame:
    """Rows, and the keys that their order follows (none: no order is promised)."""

    df: DataFrame
    order: tuple[SortKey, ...] = ()

    def having(self, df: DataFrame, order: Sequence[SortKey] | None = None) -> Frame:
        kept = self.order if order is None else tuple(order)
        return replace(self, df=df, order=kept if all(k.name in df.columns for k in kept) else ())

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def value(self, name: str) -> Value:
        """A column; else a path into a JSON column; else into the raw line; else null."""
        for known in (name, ALIASES.get(name)):
            if known in self.columns:
                return of_column(quoted(known), self.type_of(known))
        root, dot, rest = name.partition(".")
        if dot and root in self.columns:
            kind = self.type_of(root)
            if isinstance(kind, T.StringType):
                return Value(jsontext.extract(quoted(root), rest), "str")
            if isinstance(kind, T.StructType):
                found, at = quoted(root), kind
                for step in rest.split("."):
                    if not isinstance(at, T.StructType) or step not in at.names:
                        return null()
                    found, at = found.getField(step), at[step].dataType
                return of_column(found, at)
        if "_raw" in self.columns and isinstance(self.type_of("_raw"), T.StringType) and name != "_raw":
            return Value(jsontext.extract(quoted("_raw"), name), "str")
        return null()

    def sortable(self) -> list[str]:
        return sorted(c for c in self.columns if not isinstance(self.type_of(c), T.MapType | T.VariantType))

    def order_key(self) -> Column | None:
        """One comparable value for min_by and max_by; None where an order cannot be one ascending key."""
        if not self.order or any(k.descending for k in self.order):
            return None
        parts: list[Column] = []
        for k in self.order:
            v = of_column(quoted(k.name), self.type_of(k.name))
            # numbers in text sort as numbers, before other text
            parts += [number(v).isNull(), number(v), text(v)] if v.kind == "str" else [quoted(k.name)]
        return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
