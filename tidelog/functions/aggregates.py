"""The aggregate functions, for groups and for windows."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidelog.functions.values import Value, number, text, truth
from tidelog.lang.tokens import QueryError


def aggregate(func: str, value: Value | None, *, condition: bool = False, order: Column | None = None, over: WindowSpec | None = None, approximate: bool = False) -> Value:
    """`order` says what comes first; `over` makes a window aggregate; `approximate` allows sketches."""

    def done(c: Column, kind: str, finish=lambda x: x) -> Value:
        return Value(finish(c.over(over) if over is not None else c), kind)

    if condition and value is not None:
        # false counts as missing
        value = Value(F.when(truth(value), F.lit(1).cast("long")), "int")
    if func == "count":
        return done(F.count(F.lit(1) if value is None else value.col), "int")
    if value is None:
        raise QueryError(f"{func} needs a field")
    if func == "sum":
        return done(F.sum(number(value)), "float", lambda x: F.coalesce(x, F.lit(0.0)))
    if func == "avg":
        return done(F.avg(number(value)), "float")
    if func in ("min", "max"):
        f = F.min if func == "min" else F.max
        if value.kind in ("int", "float", "time", "bool"):
            return done(f(value.col), value.kind)
        # numbers sort as numbers, before other text; a missing text takes no part
        key = F.when(text(value).isNotNull(), F.struct(number(value).isNull().alias("t"), number(value).alias("n"), text(value).alias("s")))
        return done(f(key), "str", lambda x: x["s"])
    if func == "dc":
        if over is not None:
            return done(F.collect_set(text(value)), "int", lambda x: F.size(x).cast("long"))
        return Value(F.approx_count_distinct(value.col, 0.008) if approximate else F.count_distinct(value.col), "int")
    if func == "values":
        return done(F.collect_set(text(value)), "str", lambda x: F.array_join(F.array_sort(x), "|||"))
    if func in ("first", "earliest", "last", "latest"):
        early = func in ("first", "earliest")
        if order is None:
            return done((F.first if early else F.last)(value.col, ignorenulls=True), value.kind)
        return done((F.min_by if early else F.max_by)(value.col, F.when(value.col.isNotNull(), order)), value.kind)
    if func == "stdev":
        return done(F.stddev_samp(number(value)), "float")
    if func.startswith("perc"):
        p = float(func[4:]) / 100
        if not 0 <= p <= 1:
            raise QueryError(f"{func}: a percentile lies between 0 and 100")
        return done(F.percentile_approx(number(value), p, 10_000) if approximate else F.percentile(number(value), p), "float")
    raise QueryError(f"unknown aggregate {func}")
