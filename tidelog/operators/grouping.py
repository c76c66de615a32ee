"""Aggregations: top and rare values, pivots, roll-ups over several resolutions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import bucket
from tidelog.plans.scope import quoted

#: Distinct values of a pivot's second field.
MOST_SERIES = 10_000


def top(df: DataFrame, field: str, by: Sequence[str], n: int, *, ascending: bool = False) -> DataFrame:
    """The n most (or least) frequent values over all groups, with count and percent of all rows."""
    keys = [*by, field]
    counted = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("__all"))  # one row
    ordered = counted.orderBy(F.asc("count") if ascending else F.desc("count"), quoted(field), *[quoted(b) for b in by]).limit(n)
    out = ordered.crossJoin(F.broadcast(total)).withColumn("percent", F.lit(100.0) * F.col("count") / F.col("__all")).drop("__all")
    return out.orderBy(F.asc("count") if ascending else F.desc("count"), quoted(field), *[quoted(b) for b in by])


def xyseries(df: DataFrame, x: str, y: str, value: str, order: Column | None) -> DataFrame:
    """One row for each x, one column for each y, the last value in each cell."""
    series = sorted(r[0] for r in df.select(quoted(y).cast("string")).where(quoted(y).isNotNull()).distinct().limit(MOST_SERIES + 1).collect())
    if len(series) > MOST_SERIES:
        raise ValueError(f"xyseries: {y} has more than {MOST_SERIES} values")
    last = F.max_by(quoted(value), order) if order is not None else F.last(quoted(value), ignorenulls=True)
    return df.withColumn("__y", quoted(y).cast("string")).groupBy(quoted(x)).pivot("__y", series).agg(last).orderBy(quoted(x))


def span_name(seconds: float) -> str:
    for unit, size in (("w", 604800), ("d", 86400), ("h", 3600), ("m", 60)):
        if seconds >= size and seconds % size == 0:
            return f"{int(seconds // size)}{unit}"
    return f"{seconds:g}s"


def rollup(df: DataFrame, spans: Sequence[float], by: Sequence[str], time: str = "_time") -> DataFrame:
    """Counts per bucket for several resolutions: the finest is counted first, the rows of the others derive from it where they nest."""
    keys = [quoted(b) for b in by]
    finest = min(spans)
    base = df.groupBy(bucket(quoted(time), finest).alias("__b"), *keys).agg(F.count(F.lit(1)).alias("__n"))
    if all((s / finest) == int(s / finest) for s in spans):
        # one row in a bucket of the finest span stands for all of its events
        counted = base
    else:
        counted = df.select(quoted(time).alias("__b"), *keys, F.lit(1).cast("long").alias("__n"))
    choices = F.array(*[F.struct(F.lit(span_name(s)).alias("name"), bucket(F.col("__b"), s).alias("bucket")) for s in spans])
    rows = counted.select(F.explode(choices).alias("__c"), *keys, "__n")
    out = rows.groupBy(F.col("__c.name").alias("_resolution"), F.col("__c.bucket").alias("_bucket"), *keys).agg(F.sum("__n").alias("count"))
    return out.orderBy("_resolution", "_bucket", *keys)
