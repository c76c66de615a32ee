"""Row enrichment: running and whole-set aggregates, sessions, transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.scope import quoted


def joined_back(df: DataFrame, by: Sequence[str], aggregates: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Whole-set aggregates on every row. Joining them back keeps a hot group splittable, unlike a window."""
    df = df.drop(*names)
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # one row
    sums = df.groupBy(*[quoted(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(*aggregates)
    same = quoted(by[0]).eqNullSafe(F.col("__by0"))
    for i, b in enumerate(by[1:], 1):
        same = same & quoted(b).eqNullSafe(F.col(f"__by{i}"))
    return df.join(sums, same).drop(*[f"__by{i}" for i in range(len(by))])


def frame(by: Sequence[str], order: Sequence[Column], window: int, current: bool):
    """The rows of a running aggregate: `window` rows (0: all so far), with or without the current one."""
    spec = Window.partitionBy(*[quoted(b) for b in by]).orderBy(*order)
    if current:
        return spec.rowsBetween(-(window - 1) if window else Window.unboundedPreceding, 0)
    return spec.rowsBetween(-window if window else Window.unboundedPreceding, -1)


def sessionize(df: DataFrame, by: Sequence[str], gap: float, order: Sequence[Column], time: str = "_time") -> DataFrame:
    """_session_id (dense from 1 over groups and time), _session_start, _session_end; a new session after a pause over `gap`."""
    keys = [quoted(b) for b in by]
    group = Window.partitionBy(*keys).orderBy(quoted(time), *order)
    pause = F.unix_micros(quoted(time)) - F.unix_micros(F.lag(quoted(time)).over(group))
    fresh = F.when(pause.isNull() | (pause > int(gap * 1_000_000)), 1).otherwise(0)
    rows = df.withColumn("__fresh", fresh).withColumn("__s", F.sum("__fresh").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy(*keys, F.col("__s"))
    rows = rows.withColumns({"_session_start": F.min(quoted(time)).over(session), "_session_end": F.max(quoted(time)).over(session)})
    if not by:
        return rows.withColumn("_session_id", F.col("__s").cast("long")).drop("__fresh", "__s")
    # how many sessions the groups before this one have: one row a group
    counts = rows.groupBy(*[k.alias(f"__by{i}") for i, k in enumerate(keys)]).agg(F.max("__s").alias("__count"))
    before = Window.orderBy(*[F.col(f"__by{i}") for i in range(len(keys))]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0))).drop("__count")
    same = keys[0].eqNullSafe(F.col("__by0"))
    for i, k in enumerate(keys[1:], 1):
        same = same & k.eqNullSafe(F.col(f"__by{i}"))
    rows = rows.join(counts, same).withColumn("_session_id", (F.col("__before") + F.col("__s")).cast("long"))
    return rows.drop("__fresh", "__s", "__before", *[f"__by{i}" for i in range(len(keys))])


def transaction(df: DataFrame, names: Sequence[str], order: Column, *, maxspan: float | None = None, starts: Column | None = None, ends: Column | None = None, time: str = "_time") -> DataFrame:
    """One row a group: its first event's fields, eventcount, duration in seconds, the raw lines in order.

    Groups longer than `maxspan` are dropped. With start or end conditions a group splits before
    or after the events that meet them.
    """
    keys = [quoted(n) for n in names]
    rows = df
    parts: list[Column] = []
    if starts is not None or ends is not None:
        spec = Window.partitionBy(*keys).orderBy(quoted(time), order)
        first = F.coalesce(starts, F.lit(False)).cast("int") if starts is not None else F.lit(0)
        rows = rows.withColumn("__open", first)
        rows = rows.withColumn("__close", F.coalesce(ends, F.lit(False)).cast("int") if ends is not None else F.lit(0))
        opened = F.sum("__open").over(spec.rowsBetween(Window.unboundedPreceding, 0))
        closed = F.coalesce(F.sum("__close").over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("__part", opened + closed).drop("__open", "__close")
        parts = [F.col("__part")]
    rest = [c for c in df.columns if c not in (*names, "_raw")]
    key = F.struct(quoted(time).alias("t"), order.alias("o"))
    aggregates = [F.min_by(F.struct(*[quoted(c).alias(c) for c in rest]), key).alias("__first"), F.count(F.lit(1)).alias("eventcount"), ((F.max(F.unix_micros(quoted(time))) - F.min(F.unix_micros(quoted(time)))) / 1e6).alias("duration")]
    if "_raw" in df.columns:
        lines = F.array_sort(F.collect_list(F.struct(key.alias("k"), quoted("_raw").alias("r"))))
        aggregates.append(F.array_join(F.transform(lines, lambda x: x["r"]), "\n").alias("_raw"))
    out = rows.groupBy(*keys, *parts).agg(*aggregates).drop("__part")
    if maxspan is not None:
        out = out.where(F.col("duration") <= maxspan)
    return out.select(*keys, "__first.*", *(["_raw"] if "_raw" in df.columns else []), "eventcount", "duration")
