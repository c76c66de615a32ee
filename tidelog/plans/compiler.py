"""Programs to DataFrames: one handler for each command, everything else is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.aggregates import aggregate
from tidelog.functions.values import bucket, kind_of, number, text
from tidelog.lang.timeexpr import point
from tidelog.lang.tokens import QueryError
from tidelog.lang.tree import Agg, Command, Program, Query, SortKey, Source
from tidelog.operators import analytics, explode, extraction, grouping, shaping, windows
from tidelog.plans.expressions import Expressions
from tidelog.plans.scope import Frame, quoted


class Catalog(Protocol):
    """What a compiler asks of its engine."""

    now: datetime
    approximate: bool
    default_source: str

    def frames(self, names: Sequence[str]) -> list[Frame]: ...
    def view(self, name: str) -> DataFrame: ...
    def materialize(self, name: str, frame: Frame, commands: list[Command], source: Source | None, options: dict) -> DataFrame: ...
    def views(self, name: str | None, options: dict) -> DataFrame: ...
    def drop_view(self, name: str) -> DataFrame: ...
    def tee(self, df: DataFrame, path: str) -> DataFrame: ...
    def describe(self, df: DataFrame) -> None: ...
    def answered_by_view(self, query: Query) -> Query | None: ...


def union(frames: Sequence[Frame]) -> Frame:
    """All rows of several frames; a column of differing types becomes text."""
    first, rest = frames[0], frames[1:]
    if not rest:
        return first
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c in f.df.schema.fields:
            kinds.setdefault(c.name, set()).add(c.dataType.simpleString())

    def aligned(f: Frame) -> DataFrame:
        casts = {}
        for c in f.df.schema.fields:
            if len(kinds[c.name]) > 1:
                numeric = all(k in ("int", "bigint", "double", "float", "smallint", "tinyint") for k in kinds[c.name])
                casts[c.name] = quoted(c.name).cast("double") if numeric else text(f.value(c.name))
        return f.df.withColumns(casts) if casts else f.df

    df = aligned(first)
    for f in rest:
        df = df.unionByName(aligned(f), allowMissingColumns=True)
    order = first.order if all(f.order == first.order for f in rest) else ()
    return Frame(df, order)


class Compiler:
    def __init__(self, catalog: Catalog, shift: timedelta | None = None):
        self.catalog, self.shift = catalog, shift
        self.datasets: dict[str, Frame] = {}

    # ---- programs and sources

    def program(self, p: Program) -> Frame:
        self.resolve(p.datasets)
        return self.query(p.main)

    def resolve(self, datasets: dict[str, Query]) -> None:
        done: dict[str, Frame] = {}
        active: list[str] = []

        def build(name: str) -> None:
            if name in done:
                return
            if name in active:
                raise QueryError(f"datasets refer to each other: {' -> '.join([*active, name])}")
            active.append(name)
            for other in references(datasets[name]):
                if other in datasets:
                    build(other)
            done[name] = self.datasets[name] = self.query(datasets[name])
            active.pop()

        for name in datasets:
            build(name)

    def query(self, q: Query, inherited: Frame | None = None) -> Frame:
        rewritten = self.catalog.answered_by_view(q) if self.shift is None else None
        q = rewritten or q
        frame = self.source(q.source, inherited)
        return self.commands(frame, q.commands, q.source, inherited)

    def source(self, s: Source | None, inherited: Frame | None) -> Frame:
        if s is None:
            if inherited is not None:
                return inherited
            s = Source([self.catalog.default_source])
        frames: list[Frame] = []
        for name in s.names:
            if name.startswith("$"):
                if name not in self.datasets:
                    raise QueryError(f"no dataset is named {name}")
                frames.append(self.datasets[name])
            else:
                frames += self.catalog.frames([name])
        if not frames:
            raise QueryError(f"no source matches {', '.join(s.names)}")
        frame = union(frames)
        if "_time" in frame.columns:
            df = frame.df
            back = self.shift or timedelta(0)
            for bound, keep in ((s.low, lambda t: quoted("_time") >= F.lit(t)), (s.high, lambda t: quoted("_time") <= F.lit(t))):
                if bound is not None:
                    df = df.where(keep(point(bound, self.catalog.now) - back))
            if self.shift:
                df = df.withColumn("_time", F.timestamp_micros(F.unix_micros("_time") + int(back.total_seconds() * 1_000_000)))
            frame = frame.having(df)
        return frame

    def commands(self, frame: Frame, commands: Sequence[Command], source: Source | None, inherited: Frame | None = None) -> Frame:
        for at, c in enumerate(commands):
            handler: Callable[..., Frame] | None = getattr(self, f"do_{c.kind}", None)
            if handler is None:
                raise QueryError(f"unknown command {c.kind}")
            if c.kind in ("compare", "materialize", "multisearch"):
                frame = handler(frame, c, list(commands[:at]), source, inherited)
            else:
                frame = handler(frame, c)
        return frame

    def ex(self, frame: Frame) -> Expressions:
        return Expressions(frame, self.catalog.now)

    # ---- filters

    def do_chain(self, f: Frame, c: Command) -> Frame:
        return self.commands(f, c["commands"], None)

    def do_where(self, f: Frame, c: Command) -> Frame:
        return f.having(f.df.where(self.ex(f).condition(c["condition"])))

    def do_search(self, f: Frame, c: Command) -> Frame:
        if c.get("index") and c["index"] != "*":
            f = self.source(Source([c["index"]]), None)
        return f.having(f.df.where(self.ex(f).search(c["term"]))) if "term" in c.args else f

    def do_errors_only(self, f: Frame, c: Command) -> Frame:
        return f.having(f.df.where(F.lower(text(f.value("level"))).isin("error", "fatal")))

    # ---- aggregation

    def aggregates(self, f: Frame, aggs: Sequence[Agg], over=None) -> list:
        ex = self.ex(f)
        order = f.order_key()
        if order is None and "_time" in f.columns and not f.order:
            order = quoted("_time")
        out = []
        for a in aggs:
            value = ex.value(a.args[0]) if a.args else None
            # earliest and latest go by time whatever the order
            key = F.struct(quoted("_time"), order) if a.func in ("earliest", "latest") and "_time" in f.columns and order is not None else quoted("_time") if a.func in ("earliest", "latest") and "_time" in f.columns else order
            out.append(aggregate(a.func, value, condition=a.condition, order=key, over=over, approximate=self.catalog.approximate).col.alias(a.name))
        return out

    def keys(self, f: Frame, names: Sequence[str]) -> list:
        return [self.key(f, n).alias(n) for n in names]

    def key(self, f: Frame, name: str):
        v = f.value(name)
        return v.col.cast("string") if v.kind == "null" else v.col

    def do_stats(self, f: Frame, c: Command) -> Frame:
        aggs, by = c["aggs"], c["by"]
        if not aggs:
            return Frame(f.df.select(*self.keys(f, by)).distinct(), tuple(map(SortKey, by)))
        df = f.df.groupBy(*self.keys(f, by)).agg(*self.aggregates(f, aggs)) if by else f.df.agg(*self.aggregates(f, aggs))
        return Frame(df)

    def do_timechart(self, f: Frame, c: Command) -> Frame:
        if "_time" not in f.columns:
            raise QueryError("timechart needs _time")
        by = c["by"]
        time = bucket(quoted("_time"), c["span"]).alias("_time")
        df = f.df.groupBy(time, *self.keys(f, by)).agg(*self.aggregates(f, c["aggs"]))
        keys = [SortKey("_time"), *map(SortKey, by)]
        return Frame(df.orderBy(*shaping.sort_columns(df, keys, ties=False)), tuple(keys))

    def do_bin(self, f: Frame, c: Command) -> Frame:
        v = f.value(c["field"])
        span = c["span"]
        if v.kind == "time":
            out = bucket(v.col, span)
        elif v.kind == "int":
            out = v.col - F.pmod(v.col, F.lit(int(span)).cast("long")) if span == int(span) else F.floor(v.col / span) * span
        elif v.kind == "float":
            out = F.floor(v.col / span) * span
        else:
            out = F.when(number(v).isNotNull(), (F.floor(number(v) / span) * span).cast("string")).otherwise(text(v))
        return f.having(f.df.withColumn(c["name"], out))

    def do_top(self, f: Frame, c: Command) -> Frame:
        keys = [*c["by"], c["field"]]
        df = f.df.select(*self.keys(f, keys))
        count = SortKey("count", not c["ascending"])
        return Frame(grouping.top(df, c["field"], c["by"], c["n"], ascending=c["ascending"]), (count, SortKey(c["field"]), *map(SortKey, c["by"])))

    def do_topby(self, f: Frame, c: Command) -> Frame:
        agg = c["agg"]
        f = self.do_stats(f, Command("stats", {"aggs": [agg, *c["more"]], "by": [c["field"]]}))
        return self.do_head(self.do_sort(f, Command("sort", {"keys": [SortKey(agg.name, not c["ascending"])]})), Command("head", {"n": c["n"]}))

    def do_xyseries(self, f: Frame, c: Command) -> Frame:
        df = f.df.select(*self.keys(f, dict.fromkeys([c["x"], c["y"], c["value"], *(k.name for k in f.order)])))
        narrow = f.having(df)
        return Frame(grouping.xyseries(df, c["x"], c["y"], c["value"], narrow.order_key()), (SortKey(c["x"]),))

    def do_rollup(self, f: Frame, c: Command) -> Frame:
        df = f.df.select(quoted("_time"), *self.keys(f, c["by"]))
        return Frame(grouping.rollup(df, c["spans"], c["by"]), (SortKey("_resolution"), SortKey("_bucket"), *map(SortKey, c["by"])))

    # ---- windows

    def with_keys(self, f: Frame, names: Sequence[str]) -> Frame:
        """Fields that are read from inside a text become columns."""
        missing = [n for n in names if n not in f.columns]
        return f.having(f.df.withColumns({n: self.key(f, n) for n in missing})) if missing else f

    def in_order(self, f: Frame, reverse: bool = False) -> list:
        """Sort columns for the rows' order."""
        keys = [SortKey(k.name, k.descending != reverse) for k in f.order]
        return shaping.sort_columns(f.df, keys, ties=False)

    def ordered(self, f: Frame) -> list:
        if f.order:
            return self.in_order(f)
        return [quoted("_time").asc()] if "_time" in f.columns else [F.lit(1)]

    def do_eventstats(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, c["by"])
        df = windows.joined_back(g.df, c["by"], self.aggregates(g, c["aggs"]), [a.name for a in c["aggs"]])
        return f.having(df)

    def do_streamstats(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, c["by"])
        over = windows.frame(c["by"], self.ordered(g), c["window"], c["current"])
        added = dict(zip([a.name for a in c["aggs"]], self.aggregates(g, c["aggs"], over)))
        return f.having(g.df.withColumns(added))

    def do_sessionize(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, c["by"])
        ties = [quoted(k.name).asc() for k in f.order if k.name != "_time"]
        df = windows.sessionize(g.df, c["by"], c["gap"], ties)
        return Frame(df, (*map(SortKey, c["by"]), SortKey("_time"), *(SortKey(k.name) for k in f.order if k.name not in ("_time", *c["by"]))))

    def do_transaction(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, c["names"])
        order = g.order_key()
        mark = {k: Expressions(g, self.catalog.now).raw().contains(str(c[k])) for k in ("startswith", "endswith") if k in c.args}
        df = windows.transaction(g.df, c["names"], order if order is not None else quoted("_time"), maxspan=c.get("maxspan"), starts=mark.get("startswith"), ends=mark.get("endswith"))
        return Frame(df, (SortKey("_time"), *map(SortKey, c["names"])))

    # ---- shaping

    def do_let(self, f: Frame, c: Command) -> Frame:
        for name, e in c["assignments"]:
            v = self.ex(f).value(e)
            col = v.col.cast("string") if v.kind == "null" else F.make_dt_interval(secs=v.col) if v.kind == "span" else v.col
            f = f.having(f.df.withColumn(name, col))
        return f

    def do_fields(self, f: Frame, c: Command) -> Frame:
        if c["remove"]:
            return f.having(shaping.omit(f.df, c["names"]))
        known = {n: f.value(n) for n in c["names"] if "*" not in n and n not in f.columns}
        df = f.df.withColumns({n: v.col for n, v in known.items() if v.kind != "null"}) if known else f.df
        return f.having(shaping.keep(df, c["names"]))

    def do_select(self, f: Frame, c: Command) -> Frame:
        return f.having(f.df.select(*[self.key(f, a).alias(b) for a, b in c["pairs"]]))

    def do_rename(self, f: Frame, c: Command) -> Frame:
        new = dict(c["pairs"])
        order = [replace(k, name=new.get(k.name, k.name)) for k in f.order]
        return f.having(shaping.rename(f.df, c["pairs"]), order)

    def do_fillnull(self, f: Frame, c: Command) -> Frame:
        return f.having(shaping.fill_null(f.df, c["value"], c["names"]))

    def do_pack(self, f: Frame, c: Command) -> Frame:
        return f.having(shaping.pack(self.with_keys(f, c["names"]).df, c["names"], c["target"]))

    def do_describe(self, f: Frame, c: Command) -> Frame:
        self.catalog.describe(f.df)
        return f

    # ---- order

    def do_sort(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, [k.name for k in c["keys"]])
        added = [n for n in g.columns if n not in f.columns]
        columns = shaping.sort_columns(g.df, c["keys"])
        df = g.df.orderBy(*columns).drop(*added)
        keys = [k for k in c["keys"] if k.name in df.columns]
        rest = [SortKey(n) for n in sorted(df.columns) if n not in {k.name for k in keys} and isinstance(df.schema[n].dataType, T.AtomicType)]
        return Frame(df, (*keys, *rest))

    def do_head(self, f: Frame, c: Command) -> Frame:
        # without a sort before it the promised order decides which rows are first
        df = f.df if not f.order or f.df.isStreaming else f.df.orderBy(*self.in_order(f))
        return f.having(df.limit(c["n"]))

    def do_tail(self, f: Frame, c: Command) -> Frame:
        if not f.order:
            raise QueryError("tail needs rows in an order: sort them first")
        last = f.df.orderBy(*self.in_order(f, reverse=True)).limit(c["n"])
        return f.having(last.orderBy(*self.in_order(f.having(last))))

    def do_dedup(self, f: Frame, c: Command) -> Frame:
        g = self.with_keys(f, c["names"])
        df = shaping.dedup(g.df, c["names"], c["n"], self.in_order(g), g.order_key())
        return f.having(df.select(*[quoted(n) for n in f.columns]))

    # ---- several inputs

    def do_join(self, f: Frame, c: Command) -> Frame:
        right = self.query(c["query"], f)
        hows = {"inner": "inner", "left": "left", "outer": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
        names = c["names"]
        left, right = self.with_keys(f, names), self.with_keys(right, names)
        same = None
        for n in names:
            a, b = F.col(f"__left.`{n}`"), F.col(f"__right.`__r_{n}`")
            e = a == b if kind_of(left.type_of(n)) == kind_of(right.type_of(n)) else a.cast("string") == b.cast("string")
            same = e if same is None else same & e
        more = [n for n in right.columns if n not in names and n not in left.columns]
        r = right.df.select(*[quoted(n).alias(f"__r_{n}") for n in names], *[quoted(n) for n in more]).alias("__right")
        df = left.df.alias("__left").join(r, same, hows.get(c["how"], "inner")).drop(*[f"__r_{n}" for n in names])
        return f.having(df)

    def do_append(self, f: Frame, c: Command) -> Frame:
        return Frame(union([f, self.query(c["query"], self.origin(f))]).df)

    def origin(self, f: Frame) -> Frame | None:
        """What a subsearch without a source reads: the default source."""
        try:
            return self.source(None, None)
        except QueryError:
            return f

    def do_multisearch(self, f: Frame, c: Command, before: list[Command], source: Source | None, inherited: Frame | None) -> Frame:
        base = self.source(source, inherited)
        return Frame(union([self.query(q, base) for q in c["queries"]]).df)

    # ---- views, outputs

    def do_materialize(self, f: Frame, c: Command, before: list[Command], source: Source | None, inherited: Frame | None) -> Frame:
        return Frame(self.catalog.materialize(c["name"], f, before, source, c.args))

    def do_from_view(self, f: Frame, c: Command) -> Frame:
        if c["name"].startswith("$"):
            return self.source(Source([c["name"]]), None)
        try:
            return Frame(self.catalog.view(c["name"]))
        except KeyError:
            return self.source(Source([c["name"]]), None)

    def do_views(self, f: Frame, c: Command) -> Frame:
        return Frame(self.catalog.views(c["name"], c.args))

    def do_dropview(self, f: Frame, c: Command) -> Frame:
        return Frame(self.catalog.drop_view(c["name"]))

    def do_tee(self, f: Frame, c: Command) -> Frame:
        return f.having(self.catalog.tee(f.df, c["path"]))

    # ---- extraction

    def do_unpack(self, f: Frame, c: Command) -> Frame:
        df = extraction.unpack(f.df, c["format"], text(f.value(c["field"])), only=c["only"], prefix=c["prefix"], if_missing=c["if_missing"], pattern=c.get("pattern"), options=c["options"])
        return f.having(df)

    def do_rex(self, f: Frame, c: Command) -> Frame:
        return f.having(extraction.rex(f.df, text(f.value(c["field"])), c["pattern"]))

    def do_json(self, f: Frame, c: Command) -> Frame:
        return f.having(extraction.json_paths(f.df, text(f.value(c["field"])), c["pairs"]))

    def do_explode(self, f: Frame, c: Command) -> Frame:
        names = c["names"]
        values = [(n, f.value(n)) for n in names]
        targets = [c["name"]] if c["name"] and len(names) == 1 else names
        keys: list[str] = []
        if len(names) == 1 and not f.df.isStreaming and values[0][1].kind == "str":
            items = f.df.select(F.explode(explode.items_of(values[0][1])).alias("x")).where("x like '{%'")
            found = items.select(F.explode(F.json_object_keys("x")).alias("k")).distinct().orderBy("k").limit(extraction.MOST_KEYS + 1).collect()
            if len(found) > extraction.MOST_KEYS:
                raise QueryError(f"the objects of {names[0]} have over {extraction.MOST_KEYS} different keys")
            keys = [r[0] for r in found]
        return f.having(explode.explode(f.df, values, targets, keys))

    # ---- analytics

    def do_outliers(self, f: Frame, c: Command) -> Frame:
        v = f.value(c["field"])
        return f.having(analytics.outliers(f.df, number(v), method=c.get("method", "iqr"), threshold=c.get("threshold"), approximate=self.catalog.approximate))

    def do_correlate(self, f: Frame, c: Command) -> Frame:
        return Frame(analytics.correlate(f.df, number(f.value(c["a"])), number(f.value(c["b"])), (c["a"], c["b"]), method=c["method"]))

    def do_compare(self, f: Frame, c: Command, before: list[Command], source: Source | None, inherited: Frame | None) -> Frame:
        earlier = Compiler(self.catalog, timedelta(seconds=c["shift"]))
        earlier.datasets = self.datasets
        past = earlier.commands(earlier.source(source, inherited), before, source, inherited)
        numbers = [n for n in f.columns if f.value(n).numeric]
        keys = [n for n in f.columns if n not in numbers and n in past.columns]
        renamed = past.df.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[quoted(n).cast("double").alias(f"previous_{n}") for n in numbers if n in past.columns])
        if keys:
            same = quoted(keys[0]).eqNullSafe(F.col("__k0"))
            for i, k in enumerate(keys[1:], 1):
                same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
            df = f.df.join(renamed, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        elif before and before[-1].kind == "stats" and not before[-1]["by"]:
            df = f.df.join(renamed, F.lit(True), "left")  # one row of totals on each side
        else:
            raise QueryError("compare needs a field that is not a number to match the periods by, or totals")
        change = {f"change_{n}": F.try_divide(F.lit(100.0) * (quoted(n).cast("double") - quoted(f"previous_{n}")), F.abs(quoted(f"previous_{n}"))) for n in numbers if n in past.columns}
        return f.having(df.withColumns(change) if change else df)

    def do_patterns(self, f: Frame, c: Command) -> Frame:
        df = analytics.patterns(f.df, text(f.value(c.get("field", "_raw"))), max_templates=c.get("max_templates", 50), similarity=c.get("similarity", 0.4))
        return Frame(df, (SortKey("count", True), SortKey("pattern")))

    def do_trace(self, f: Frame, c: Command) -> Frame:
        ids = [f.value(c.get(k, d)) for k, d in (("trace_id", "trace_id"), ("span_id", "span_id"), ("parent_id", "parent_span_id"))]
        time = quoted("_time") if "_time" in f.columns else F.lit(None).cast("timestamp")
        return Frame(analytics.trace(f.df, *ids, f.value("service"), f.value("operation"), f.value("duration_ms"), time))

    def do_topology(self, f: Frame, c: Command) -> Frame:
        weight = number(f.value(c["weight_field"])) if "weight_field" in c.args else None
        df = analytics.topology(f.df, text(f.value(c.get("source_field", "source"))), text(f.value(c.get("dest_field", "dest"))), weight, max_nodes=c.get("max_nodes", 100))
        return Frame(df, (SortKey("_edge_count", True), SortKey("_source_node"), SortKey("_dest_node")))

    def do_glimpse(self, f: Frame, c: Command) -> Frame:
        return Frame(analytics.glimpse(f.df, c["n"]), (SortKey("field"),))


def references(q: Query) -> set[str]:
    """Datasets that a query reads."""
    out = {n for n in (q.source.names if q.source else []) if n.startswith("$")}
    for c in q.commands:
        for sub in [c.get("query"), *c.get("queries", [])]:
            if sub is not None:
                out |= references(sub)
        if c.kind == "from_view" and c["name"].startswith("$"):
            out.add(c["name"])
    return out
