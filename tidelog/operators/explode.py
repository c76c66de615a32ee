"""JSON arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import jsontext
from tidelog.functions.values import Value, text
from tidelog.plans.scope import quoted


def items_of(v: Value) -> Column:
    """The elements as JSON text (texts without quotes); null unless a JSON array that has some."""
    if v.kind == "list":
        return F.when(F.size(v.col) > 0, v.col)
    source = F.when(F.trim(text(v)).startswith("["), text(v))
    items = F.from_json(source, "array<string>")
    return F.when(F.json_array_length(source) > 0, items)


def explode(df: DataFrame, values: Sequence[tuple[str, Value]], names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A row an element; several fields in step, when they are equally long.

    Rows without such arrays stay as they are. With one field the members `keys` of object
    elements become columns `field.key`.
    """
    arrays = [items_of(v) for _, v in values]
    equal = arrays[0].isNotNull()
    for a in arrays[1:]:
        equal = equal & (F.size(a) == F.size(arrays[0]))
    kept = [text(v) for _, v in values]
    single = F.array(F.struct(*[k.alias(n) for k, n in zip(kept, names)]))
    zipped = F.transform(F.arrays_zip(*[a.alias(f"v{i}") for i, a in enumerate(arrays)]), lambda x: F.struct(*[x[f"v{i}"].alias(n) for i, n in enumerate(names)]))
    rows = df.withColumn("__item", F.explode(F.when(equal, zipped).otherwise(single)))
    rows = rows.withColumns({n: F.col("__item").getField(n) for n in names}).drop("__item")
    if len(names) == 1 and keys:
        rows = rows.withColumns({f"{names[0]}.{k}": jsontext.extract(quoted(names[0]), k) for k in keys})
    return rows
