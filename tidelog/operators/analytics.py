"""Outliers, correlation, log patterns, traces, topology, profiles: DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.values import Value, number, of_column, text
from tidelog.plans.scope import quoted

# ---- outliers

DEFAULT_THRESHOLD = {"iqr": 1.5, "zscore": 3.0, "mad": 1.5}


def outliers(df: DataFrame, value: Column, *, method: str = "iqr", threshold: float | None = None, approximate: bool = False) -> DataFrame:
    """Adds _outlier and _score; too few rows or no spread: no outliers."""
    if method not in DEFAULT_THRESHOLD:
        raise ValueError(f"outliers: unknown method {method}")
    t = DEFAULT_THRESHOLD[method] if threshold is None else float(threshold)
    percentile = (lambda c, p: F.percentile_approx(c, p, 10_000)) if approximate else F.percentile
    rows = df.drop("_outlier", "_score").withColumn("__v", value)

    def beside(aggregates: Sequence[Column], to: DataFrame) -> DataFrame:
        return to.crossJoin(F.broadcast(rows.agg(*aggregates)))  # one row

    v = F.col("__v")
    if method == "iqr":
        rows = beside([percentile(v, 0.25).alias("__a"), percentile(v, 0.75).alias("__b"), F.count("__v").alias("__n")], rows)
        iqr = F.col("__b") - F.col("__a")
        low, high = F.col("__a") - t * iqr, F.col("__b") + t * iqr
        score = F.try_divide(F.when(v < low, low - v).when(v > high, v - high).otherwise(F.lit(0.0)), iqr)
        usable, out = (F.col("__n") >= 4) & (iqr > 0), (v < low) | (v > high)
    elif method == "zscore":
        rows = beside([F.avg("__v").alias("__a"), F.stddev_samp("__v").alias("__b"), F.count("__v").alias("__n")], rows)
        score = F.try_divide(F.abs(v - F.col("__a")), F.col("__b"))
        usable, out = (F.col("__n") >= 2) & (F.col("__b") > 0), score > t
    else:
        rows = beside([percentile(v, 0.5).alias("__a"), F.count("__v").alias("__n")], rows)
        spread = rows.agg(percentile(F.abs(v - F.col("__a")), 0.5).alias("__b"))
        rows = rows.crossJoin(F.broadcast(spread))  # one row
        score = F.try_divide(F.lit(0.6745) * F.abs(v - F.col("__a")), F.col("__b"))
        usable, out = (F.col("__n") >= 3) & (F.col("__b") > 0), score > t
    rows = rows.withColumn("_outlier", F.coalesce(usable & out, F.lit(False)))
    rows = rows.withColumn("_score", F.when(usable & v.isNotNull(), F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)))
    return rows.drop("__v", "__a", "__b", "__n")


# ---- correlation


def correlate(df: DataFrame, a: Column, b: Column, names: tuple[str, str], *, method: str = "pearson") -> DataFrame:
    """One row: _correlation, _method, _n, _field1, _field2. No spread: 0; fewer than two rows: null."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"correlate: unknown method {method}")
    rows = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    if method == "spearman":
        for c in ("a", "b"):
            # average ranks: rows before a value, and half of those that share it
            counts = rows.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            rows = rows.join(ranked(counts).select("v", "rank"), F.col(c) == F.col("v")).withColumn(c, F.col("rank")).drop("v", "rank")
    sums = rows.agg(F.count(F.lit(1)).alias("_n"), F.covar_samp("a", "b").alias("c"), F.stddev_samp("a").alias("x"), F.stddev_samp("b").alias("y"))
    value = F.when(F.col("_n") >= 2, F.coalesce(F.try_divide("c", F.col("x") * F.col("y")), F.lit(0.0)))
    return sums.select(value.alias("_correlation"), F.lit(method).alias("_method"), "_n", F.lit(names[0]).alias("_field1"), F.lit(names[1]).alias("_field2"))


def ranked(counts: DataFrame) -> DataFrame:
    """v, rank from v, n: the running sum is over distinct values."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("rank", before + (F.col("n") + 1) / 2)


# ---- patterns

#: Tokens that become <*> before templates are merged: numbers, hexadecimal, UUIDs, IPv4 addresses.
VARIABLE = r"^[\W_]*(?:[+-]?\d[\d.,:/-]*(?:ms|s|m|h|d|kb|mb|gb|b|%)?|0x[0-9a-fA-F]+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?)[\W_]*$"
WILDCARD = "<*>"


def merge_templates(templates: list[tuple[list[str], int, str]], similarity: float) -> list[tuple[list[str], int, str]]:
    """Templates of one length and first token, the most frequent first: each joins the first group it resembles enough."""
    groups: list[list] = []
    for tokens, n, example in sorted(templates, key=lambda t: (-t[1], t[0])):
        for g in groups:
            same = sum(x == y for x, y in zip(g[0], tokens))
            if same >= similarity * len(tokens):
                g[0] = [x if x == y else WILDCARD for x, y in zip(g[0], tokens)]
                g[1] += n
                break
        else:
            groups.append([list(tokens), n, example])
    return [tuple(g) for g in groups]


def patterns(df: DataFrame, source: Column, *, max_templates: int = 50, similarity: float = 0.4) -> DataFrame:
    """pattern, count, percent, example of the most frequent line templates.

    Lines are masked and counted first, in SQL; only distinct masks reach the merge, split by
    their number of tokens and first token.
    """
    lines = df.select(source.alias("line")).where("line is not null and trim(line) <> ''")
    tokens = F.split(F.trim("line"), r"\s+")
    masked = F.transform(tokens, lambda t: F.when(t.rlike(VARIABLE), WILDCARD).otherwise(t))
    counted = lines.select("line", F.array_join(masked, " ").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("example"))
    counted = counted.withColumn("size", F.size(F.split("mask", " "))).withColumn("head", F.element_at(F.split("mask", " "), 1))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge_templates([(m.split(" "), int(n), e) for m, n, e in zip(pdf["mask"], pdf["n"], pdf["example"])], similarity)
        return pd.DataFrame([(" ".join(t), n, e) for t, n, e in merged], columns=["pattern", "count", "example"])

    merged = counted.groupBy("size", "head").applyInPandas(merge, "pattern string, count long, example string")
    merged = merged.groupBy("pattern").agg(F.sum("count").alias("count"), F.min("example").alias("example"))
    total = lines.agg(F.count(F.lit(1)).alias("__all"))  # one row
    best = merged.orderBy(F.desc("count"), "pattern").limit(max_templates).crossJoin(F.broadcast(total))
    return best.select("pattern", "count", (F.lit(100.0) * F.col("count") / F.col("__all")).alias("percent"), "example").orderBy(F.desc("count"), "pattern")


# ---- traces


def span_tree(spans: list[dict]) -> list[tuple[int, int, str]]:
    """(place in `spans`, depth, box-drawing prefix) depth first; spans without a known parent are roots."""
    ids = {s["id"]: k for k, s in enumerate(spans)}
    below: dict[int | None, list[int]] = {}
    for k, s in enumerate(spans):
        parent = ids.get(s["parent"]) if s["parent"] else None
        below.setdefault(None if parent == k else parent, []).append(k)
    for own in below.values():
        own.sort(key=lambda k: (spans[k]["time"], k))
    out: list[tuple[int, int, str]] = []
    seen: set[int] = set()

    def walk(first: list[int]) -> None:
        stack = [(k, 0, "", n == len(first) - 1) for n, k in reversed(list(enumerate(first)))]
        while stack:
            k, depth, lead, last = stack.pop()
            if k in seen:
                continue
            seen.add(k)
            out.append((k, depth, lead + ("" if depth == 0 else "└── " if last else "├── ")))
            own = below.get(k, [])
            further = lead + ("" if depth == 0 else "    " if last else "│   ")
            stack += [(c, depth + 1, further, n == len(own) - 1) for n, c in reversed(list(enumerate(own)))]

    walk(below.get(None, []))
    for k in range(len(spans)):  # cycles have no root
        if k not in seen:
            walk([k])
    return out


def trace(df: DataFrame, trace_id: Value, span_id: Value, parent_id: Value, service: Value, operation: Value, duration: Value, time: Column) -> DataFrame:
    """The spans of each trace as a tree: trace, span, service, operation, duration, _span_depth, _span_tree."""
    rows = df.select(
        text(trace_id).alias("trace_id"), text(span_id).alias("span_id"), text(parent_id).alias("parent"), text(service).alias("service"), text(operation).alias("operation"), number(duration).alias("duration_ms"), F.unix_micros(time).alias("t")
    ).where("trace_id is not null and span_id is not null")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "span_id"], kind="stable").reset_index(drop=True)
        walked = span_tree([{"id": i, "parent": p or None, "time": t} for i, p, t in zip(pdf["span_id"], pdf["parent"], pdf["t"])])
        out = pdf.iloc[[k for k, _, _ in walked]][["trace_id", "span_id", "service", "operation", "duration_ms"]].reset_index(drop=True)
        out["_span_depth"] = [d for _, d, _ in walked]
        out["_span_tree"] = [lead + str(o or i) for (_, _, lead), o, i in zip(walked, out["operation"], out["span_id"])]
        return out

    return rows.groupBy("trace_id").applyInPandas(tree, "trace_id string, span_id string, service string, operation string, duration_ms double, _span_depth int, _span_tree string")


# ---- topology


def topology(df: DataFrame, source: Column, dest: Column, weight: Column | None, *, max_nodes: int = 100) -> DataFrame:
    """Edges with counts, event degrees and weights, among the nodes with the most events."""
    events = df.select(source.alias("_source_node"), dest.alias("_dest_node"), (weight if weight is not None else F.lit(None).cast("double")).alias("w"))
    events = events.where("_source_node is not null and _source_node <> '' and _dest_node is not null and _dest_node <> ''")
    edges = events.groupBy("_source_node", "_dest_node").agg(F.count(F.lit(1)).alias("_edge_count"), F.sum("w").alias("_edge_weight"))
    ends = edges.select(F.explode(F.array("_source_node", "_dest_node")).alias("node"), "_edge_count")
    best = ends.groupBy("node").agg(F.sum("_edge_count").alias("n")).orderBy(F.desc("n"), "node").limit(max_nodes).select("node")  # at most max_nodes rows
    edges = edges.join(F.broadcast(best), F.col("_source_node") == F.col("node"), "left_semi").join(F.broadcast(best), F.col("_dest_node") == F.col("node"), "left_semi")
    out_degree = edges.groupBy(F.col("_source_node").alias("s")).agg(F.sum("_edge_count").alias("_source_out_degree"))
    in_degree = edges.groupBy(F.col("_dest_node").alias("d")).agg(F.sum("_edge_count").alias("_dest_in_degree"))
    joined = edges.join(out_degree, F.col("_source_node") == F.col("s")).join(in_degree, F.col("_dest_node") == F.col("d"))
    return joined.select("_source_node", "_dest_node", "_edge_count", "_source_out_degree", "_dest_in_degree", "_edge_weight").orderBy(F.desc("_edge_count"), "_source_node", "_dest_node")


# ---- profile

CARDINALITY = 50
TOP_VALUES = 5
PERCENTILES = {"p50": 0.5, "p99": 0.99}
NEAR = 0.001


def glimpse(df: DataFrame, rows: int | None = 10_000) -> DataFrame:
    """One row a field over a sample of `rows` rows (None: over all rows): type, coverage, null_pct, cardinality (50: or more), top values, min, p50, p99, max."""
    from pyspark.sql import Window

    sample = df if rows is None else df.limit(rows)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, type string, rows long, coverage double, null_pct double, cardinality long, top string, min double, p50 double, p99 double, max double")
    cells = []
    for f in fields:
        v = of_column(quoted(f.name), f.dataType)
        cells.append(F.struct(F.lit(f.name).alias("field"), F.lit({"str": "string", "time": "timestamp", "null": "null"}.get(v.kind, v.kind)).alias("type"), text(v).alias("v"), (number(v) if v.kind in ("int", "float", "str") else F.lit(None).cast("double")).alias("n")))
    long = sample.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    counts = long.groupBy("field", "type", "v", "n").agg(F.count(F.lit(1)).alias("c"))
    # a map of all values is only held where a sample bounds it
    held = [] if rows is None else [F.percentile("n", p, F.col("c")).alias(name) for name, p in PERCENTILES.items()]
    sums = counts.groupBy("field", "type").agg(F.sum("c").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("__full"), F.count("v").alias("__d"), F.min("n").alias("min"), F.max("n").alias("max"), *held)
    joined = sums if rows is not None else sums.join(percentiles(long, PERCENTILES), "field", "left")
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("v").isNull(), F.desc("c"), "v"))
    best = counts.withColumn("place", place).where(F.col("place") <= TOP_VALUES).where("v is not null").groupBy(F.col("field").alias("f"))
    best = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "v", "c"))), lambda x: F.concat(x["v"], F.lit(" ("), x["c"].cast("string"), F.lit(")"))), ", ").alias("top"))
    joined = joined.join(best, F.col("field") == F.col("f"), "left")
    full = F.col("__full") / F.col("rows")
    return joined.select("field", "type", "rows", (100 * full).alias("coverage"), (100 - 100 * full).alias("null_pct"), F.least(F.col("__d"), F.lit(CARDINALITY)).cast("long").alias("cardinality"), "top", "min", "p50", "p99", "max").orderBy("field")


def percentiles(rows: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """field and a column for each share from field, n: exact, as F.percentile gives them.

    Sketches only say where to cut. The rows counted between the cuts tell in which part a wanted
    rank lies, and only the values of that part are put in order.
    """
    from pyspark.sql import Window

    rows = rows.where("n is not null")
    counts = rows.groupBy("field", "n").agg(F.count(F.lit(1)).alias("c"))
    near = sorted(min(max(p + d, 0.0), 1.0) for p in shares.values() for d in (-NEAR, NEAR))
    cuts = rows.groupBy(F.col("field").alias("f")).agg(F.percentile_approx("n", near, 10_000).alias("cuts"))  # one row a field
    # a value at a cut is a part of its own, as it may be most of the rows
    part = sum(((F.col("n") > F.col("cuts")[i]).cast("int") + (F.col("n") >= F.col("cuts")[i]).cast("int") for i in range(len(near))), F.lit(0))
    parts = counts.join(F.broadcast(cuts), F.col("field") == F.col("f")).groupBy("f", part.alias("part")).agg(F.sum("c").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    w = Window.partitionBy("f")
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = {name: p * (F.sum("k").over(w) - 1) for name, p in shares.items()}
    ranks = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), x.alias("at"), rank(x).alias("rank")) for name, x in at.items() for side, rank in (("low", F.floor), ("high", F.ceil))]
    parts = parts.select("f", "low", "high", "k", before.alias("before"), F.array(*ranks).alias("ranks")).select("f", "low", "high", "k", "before", F.inline("ranks"))
    parts = parts.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k"))).drop("k")  # two rows a field and share
    inside = counts.join(F.broadcast(parts), (F.col("field") == F.col("f")) & F.col("n").between(F.col("low"), F.col("high")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("field", "name", "side").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = inside.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))

    def between(name: str) -> Column:
        a, b, x = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(c))) for side, c in (("low", "n"), ("high", "n"), ("low", "at")))
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(name)

    return found.groupBy("field").agg(*map(between, shares))


def histogram(df: DataFrame, seconds: float, by: str | None = None, time: str = "_time") -> DataFrame:
    """Counts per time bucket."""
    from tidelog.functions.values import bucket

    keys = [bucket(quoted(time), seconds).alias("bucket")] + ([quoted(by)] if by else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy("bucket", *([quoted(by)] if by else []))


def field_values(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """The most frequent values of a field, with their share of the rows that have it."""
    from tidelog.operators.grouping import top

    return top(df.where(quoted(field).isNotNull()), field, [], n)


def field_catalog(df: DataFrame) -> DataFrame:
    """One row a field: how many rows have it, and its share of all rows."""
    fields = [f.name for f in df.schema.fields]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("count"), F.try_divide(F.lit(100.0) * F.col(f"c{i}"), F.col("n")).alias("coverage")) for i, f in enumerate(fields)])
    return sums.select(F.explode(cells).alias("c")).select("c.*").orderBy("field")
