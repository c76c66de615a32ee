"""Live tail, continuous views and alerts on Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.engine import Engine
from tidelog.functions.values import bucket
from tidelog.lang.tokens import QueryError
from tidelog.lang.tree import Agg, Field, Query
from tidelog.plans.compiler import Compiler
from tidelog.plans.scope import quoted
from tidelog.plans.views import remove

#: Commands that work row by row, and so on a stream.
TAIL_COMMANDS = frozenset({"search", "where", "let", "fields", "rename", "rex", "fillnull", "head", "bin", "select", "json", "unpack", "pack", "chain", "errors_only"})
#: Aggregates whose states can be merged batch by batch.
MERGED = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def check_tail(query: Query) -> None:
    for c in query.commands:
        if c.kind not in TAIL_COMMANDS:
            raise QueryError(f"{c.kind} needs all rows and cannot run on a live stream; these can: {', '.join(sorted(TAIL_COMMANDS))}")


def tail(engine: Engine, stream: DataFrame, text: str, *, time: str | None = None) -> DataFrame:
    """A streaming DataFrame: row-wise commands over a stream."""
    program = engine.program(text)
    if program.datasets:
        raise QueryError("datasets cannot be used on a live stream")
    check_tail(program.main)
    live = Engine(engine.spark, now=engine._now)
    live.fragments = engine.fragments
    name = program.main.source.names[0] if program.main.source else live.default_source
    live.register(name, stream, time=time)
    return Compiler(live).program(program).df


def catch_up(engine: Engine, history: DataFrame, stream: DataFrame, text: str, n: int = 100, *, time: str = "_time") -> tuple[DataFrame, DataFrame]:
    """The last n matching rows of the history, and the stream of rows after them."""
    past = engine.run_on(history, text.strip() if text.strip().startswith("|") else f"| {text}", time=time).orderBy(F.desc("_time")).limit(n)
    newest = history.agg(F.max(quoted(time).cast("timestamp"))).first()[0]
    rows = stream if newest is None else stream.where(quoted(time).cast("timestamp") > F.lit(newest))
    return past, tail(engine, rows, text, time=time)


@dataclass
class ContinuousView:
    """Counts, sums, minima, maxima and averages of a stream by keys and time buckets, kept up to date.

    Each batch is aggregated and merged with the rows of its keys; a version of the table is
    written for each batch, so a repeated batch changes nothing. The one before it stays for
    readers, older ones are removed. Each checkpoint has versions of its own under the path, and
    a marker says which of them is read: another checkpoint builds the view anew beside it.

    pause() stops the stream, so that its checkpoint keeps the place; resume() goes on from there.
    """

    engine: Engine
    name: str
    path: str
    aggs: Sequence[Agg]
    by: Sequence[str] = ()
    span: float | None = None
    filter: str | None = None
    paused: bool = field(default=False)
    running: StreamingQuery | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        bad = [a.func for a in self.aggs if a.func not in (*MERGED, "avg") or a.condition or any(not isinstance(x, Field) for x in a.args)]
        if bad:
            raise QueryError(f"a continuous view cannot hold {', '.join(bad)}: it merges count, sum, min, max and avg of fields")

    def states(self) -> list[Agg]:
        out: dict[str, Agg] = {}
        for a in self.aggs:
            parts = [a] if a.func != "avg" else [Agg("sum", a.args, f"sum({a.args[0].name})"), Agg("count", a.args, f"count({a.args[0].name})")]
            for p in parts:
                name = "count" if p.func == "count" and not p.args else f"{p.func}({p.args[0].name})"
                out[name] = Agg(p.func, p.args, name)
        return list(out.values())

    def partial(self, rows: DataFrame) -> DataFrame:
        if self.filter:
            rows = self.engine.run_on(rows, f"| where {self.filter}")
        keys = ([bucket(quoted("_time"), self.span).alias("_time")] if self.span else []) + [quoted(b) for b in self.by]
        f = {"count": lambda a: F.count(F.lit(1) if not a.args else quoted(a.args[0].name)), "sum": lambda a: F.sum(quoted(a.args[0].name).cast("double")), "min": lambda a: F.min(quoted(a.args[0].name)), "max": lambda a: F.max(quoted(a.args[0].name))}
        return rows.groupBy(*keys).agg(*[f[a.func](a).alias(a.name) for a in self.states()])

    def keys(self) -> list[str]:
        return (["_time"] if self.span else []) + list(self.by)

    def merge(self, batch: DataFrame, batch_id: int, build: str) -> None:
        fresh = self.partial(batch)
        done = self.versions(build)
        earlier = [v for v in done if v < batch_id]
        both = fresh if not earlier else self.engine.spark.read.parquet(f"{self.path}/{build}/v{max(earlier)}").unionByName(fresh)
        f = {"sum": F.sum, "min": F.min, "max": F.max}
        merged = both.groupBy(*[quoted(k) for k in self.keys()]).agg(*[f[MERGED[a.func]](quoted(a.name)).alias(a.name) for a in self.states()])
        merged.write.mode("overwrite").parquet(f"{self.path}/{build}/v{batch_id}")
        for v in sorted(earlier)[:-1]:
            remove(self.engine.spark, f"{self.path}/{build}/v{v}")

    def listed(self, path: str) -> list[str]:
        spark = self.engine.spark
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self, build: str) -> list[int]:
        """The finished versions of a build."""
        names = [n for n in self.listed(f"{self.path}/{build}") if n[:1] == "v" and n[1:].isdigit()]
        return [int(n[1:]) for n in names if "_SUCCESS" in self.listed(f"{self.path}/{build}/{n}")]

    def current(self) -> str | None:
        """The build that is read: that of the latest marker."""
        marks = [n.split("-") for n in self.listed(self.path) if n.startswith("current-")]
        return max((int(n), build) for _, n, build in marks)[1] if marks else None

    def switch(self, build: str) -> None:
        """Read this build from now on; an empty folder is the marker."""
        if self.current() != build:
            marks = [int(n.split("-")[1]) for n in self.listed(self.path) if n.startswith("current-")]
            spark = self.engine.spark
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current-{max(marks, default=0) + 1}-{build}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def version(self) -> DataFrame | None:
        """The newest version of the build that is read."""
        build = self.current()
        done = self.versions(build) if build else []
        return self.engine.spark.read.parquet(f"{self.path}/{build}/v{max(done)}") if done else None

    def read(self) -> DataFrame:
        """The finished aggregates."""
        rows = self.version()
        if rows is None:
            raise KeyError(self.name)
        out = [quoted(k) for k in self.keys()]
        for a in self.aggs:
            if a.func == "avg":
                out.append(F.try_divide(quoted(f"sum({a.args[0].name})"), quoted(f"count({a.args[0].name})")).alias(a.name))
            else:
                own = "count" if not a.args else f"{a.func}({a.args[0].name})"
                out.append(quoted(own).alias(a.name))
        return rows.select(*out)

    def start(self, stream: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        """Follow a stream; `once` takes what there is and ends. The first batch of a new checkpoint makes its build the one that is read."""
        return self.follow(stream, checkpoint, once, True)

    def follow(self, stream: DataFrame, checkpoint: str, once: bool, at_once: bool) -> StreamingQuery:
        if self.paused:
            raise QueryError(f"the view {self.name} is paused: resume it")
        build = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

        def run(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, batch_id, build)
            if at_once:
                self.switch(build)

        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        self.running = (writer.trigger(availableNow=True) if once else writer).start()
        return self.running

    def pause(self) -> None:
        """Stop after the batches that are done; rows that come meanwhile wait at the checkpoint."""
        self.paused = True
        if self.running is not None:
            self.running.stop()
            self.running = None

    def resume(self, stream: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        """Go on from the checkpoint."""
        self.paused = False
        return self.start(stream, checkpoint, once=once)

    def rebuild(self, stream: DataFrame, checkpoint: str) -> None:
        """Build the view anew from all that a stream has, under a new checkpoint; readers see the build before until it is complete."""
        before = self.current()
        self.follow(stream, checkpoint, True, False).awaitTermination()
        self.switch(hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16])
        if before is not None and before != self.current():
            remove(self.engine.spark, f"{self.path}/{before}")


def projection_view(engine: Engine, stream: DataFrame, text: str, path: str, checkpoint: str, *, time: str | None = None, once: bool = False) -> StreamingQuery:
    """A view without aggregates: the filtered and evaluated rows of a stream, appended to a table."""
    rows = tail(engine, stream, text, time=time)
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, span: str, *, late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Tumbling counts with a watermark: rows later than `late` are dropped, windows are final."""
    return stream.withWatermark("_time", late).groupBy(F.window("_time", span), *[quoted(b) for b in by]).agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("_time"), *[quoted(b) for b in by], "count")


@dataclass
class Alert:
    """A query that triggers its channels when it has rows.

    Channels are told the first `limit` rows; `total` is how many the last trigger had. With
    `table` all rows of each batch of a stream are written there first.
    """

    name: str
    query: str
    channels: Sequence[Callable[[str, list[dict]], None]]
    limit: int = 100
    table: str | None = None
    total: int = field(default=0, init=False)

    def tell(self, found: DataFrame) -> bool:
        rows = [r.asDict() for r in found.limit(self.limit).collect()]
        if rows:
            self.total = len(rows) if len(rows) < self.limit else found.count()
            for notify in self.channels:
                notify(self.name, rows)
        return bool(rows)

    def check(self, engine: Engine) -> bool:
        return self.tell(engine.query(self.query))

    def follow(self, engine: Engine, stream: DataFrame, checkpoint: str, *, time: str | None = None, once: bool = False) -> StreamingQuery:
        """Check each batch of a stream."""

        def run(batch: DataFrame, batch_id: int) -> None:
            found = engine.run_on(batch, self.query, time=time)
            if self.table:
                # a batch that runs again replaces its rows
                found.write.mode("overwrite").parquet(f"{self.table}/v{batch_id}")
                found = engine.spark.read.schema(found.schema).parquet(f"{self.table}/v{batch_id}")
            self.tell(found)

        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def log_channel(sink: list) -> Callable[[str, list[dict]], None]:
    """A channel that keeps what it is told."""
    return lambda name, rows: sink.append((name, rows))
