"""The engine: named sources, views and fragments, and queries in the pipeline language."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.lang.fragments import expand_program, with_params
from tidelog.lang.parser import parse
from tidelog.lang.timeexpr import point
from tidelog.lang.tokens import QueryError
from tidelog.lang.tree import Command, Program, Query, SortKey, Source
from tidelog.plans.compiler import Compiler
from tidelog.plans.scope import BUILTIN, Frame, quoted
from tidelog.plans.views import ViewCatalog, answered_by


@dataclass(frozen=True)
class Registered:
    df: DataFrame
    order: tuple[SortKey, ...]


class Engine:
    """Sources are DataFrames with, where there is one, a timestamp `_time`.

    `approximate` lets percentiles and distinct counts use sketches of bounded size, for groups
    whose values do not fit an executor. `now` fixes relative times, for tests.
    """

    def __init__(self, spark: SparkSession, *, warehouse: str | None = None, now: datetime | None = None, approximate: bool = False, default_source: str = "main"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self._now, self.approximate, self.default_source = spark, now, approximate, default_source
        self.sources: dict[str, Registered] = {}
        self.fragments: dict[str, str] = {}
        self.catalog = ViewCatalog(spark, warehouse, lambda: self.now)

    @property
    def now(self) -> datetime:
        return self._now or datetime.now(UTC)

    # ---- sources

    def register(self, name: str, df: DataFrame, *, time: str | None = None, order: Sequence[str] = ()) -> Engine:
        """Name a DataFrame. `time` becomes `_time`; `order` names the columns that break ties of time."""
        if time is not None and time != "_time":
            df = df.withColumn("_time", quoted(time).cast("timestamp"))
        keys = ["_time"] if "_time" in df.columns else []
        self.sources[name] = Registered(df, tuple(SortKey(k) for k in [*keys, *order]))
        return self

    def frames(self, names: Sequence[str]) -> list[Frame]:
        out = []
        for name in names:
            if name.startswith("system."):
                out.append(Frame(self.system(name)))
                continue
            globbed = any(c in name for c in "*?")
            found = [k for k in sorted(self.sources) if k == name or globbed and fnmatchcase(k, name)]
            if not found and not globbed:
                if name in self.catalog:
                    out.append(Frame(self.catalog.read(name)))
                    continue
                raise QueryError(f"no source is named {name}; there are {', '.join(sorted(self.sources)) or 'none'}")
            for k in found:
                s = self.sources[k]
                df = s.df if "index" in s.df.columns else s.df.withColumn("index", F.lit(k))
                df = df if "_source" in df.columns else df.withColumn("_source", F.lit(k))
                out.append(Frame(df, s.order))
        return out

    def system(self, name: str) -> DataFrame:
        """system.sources, system.columns, system.parts, system.views."""
        table = name.removeprefix("system.")
        if table == "columns":
            rows = [(n, f.name, f.dataType.simpleString()) for n, s in sorted(self.sources.items()) for f in s.df.schema.fields]
            return self.spark.createDataFrame(rows, "source string, column string, type string")
        if table == "parts":
            rows = [(n, f) for n, s in sorted(self.sources.items()) if not s.df.isStreaming for f in sorted(s.df.inputFiles())]
            return self.spark.createDataFrame(rows, "source string, path string")
        if table == "sources":
            return self.spark.createDataFrame([(n, len(s.df.columns), s.df.isStreaming) for n, s in sorted(self.sources.items())], "source string, columns int, streaming boolean")
        if table == "views":
            return self.catalog.listing()
        raise QueryError(f"no system table is named {name}")

    # ---- queries

    def program(self, text: str, params: Mapping[str, object] | None = None) -> Program:
        return expand_program(parse(with_params(text, params or {})), self.fragments)

    def query(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """The result of a query as a lazy DataFrame; views are made when the query is compiled."""
        return self.visible(Compiler(self).program(self.program(text, params)))

    def visible(self, frame: Frame) -> DataFrame:
        return frame.df

    def run_on(self, df: DataFrame, commands: str, *, time: str | None = None, order: Sequence[str] = ()) -> DataFrame:
        """Commands over one DataFrame: `engine.run_on(df, "| where x > 1 | stats count")`."""
        other = Engine(self.spark, now=self._now, approximate=self.approximate, default_source="main")
        other.catalog, other.fragments = self.catalog, self.fragments
        other.register("main", df, time=time, order=order)
        return other.query(commands)

    def explain(self, text: str) -> str:
        """The physical plan of a query."""
        df = self.query(text)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # ---- what compilers ask for

    def view(self, name: str) -> DataFrame:
        return self.catalog.read(name)

    def materialize(self, name: str, frame: Frame, commands: list[Command], source: Source | None, options: dict) -> DataFrame:
        return self.catalog.create(name, frame.df, commands, source, options, self.source_state(source or Source([self.default_source])))

    def views(self, name: str | None, options: dict) -> DataFrame:
        if name is not None and "retention" in options:
            self.catalog.alter(name, str(options["retention"]))
        listing = self.catalog.listing()
        return listing.where(F.col("name") == name) if name is not None else listing

    def drop_view(self, name: str) -> DataFrame:
        self.catalog.drop(name)
        return self.catalog.listing()

    def tee(self, df: DataFrame, path: str) -> DataFrame:
        from tidelog.sources.sinks import write_json_lines

        if df.isStreaming:
            raise QueryError("tee writes batches; on a stream use foreachBatch")
        write_json_lines(df, path)
        return df

    def describe(self, df: DataFrame) -> None:
        print("\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields), file=sys.stderr)

    def answered_by_view(self, query: Query) -> Query | None:
        return answered_by(self.catalog, query, self.default_source, self.source_state)

    def source_state(self, source: Source) -> str | None:
        """What a source holds now: plans, files with their sizes and times, and the points its bounds stand for. None where that is not known."""
        parts: list[str] = [str(point(b, self.now)) if b is not None else "" for b in (source.low, source.high)]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in source.names:
            globbed = any(c in name for c in "*?")
            found = [k for k in sorted(self.sources) if k == name or globbed and fnmatchcase(k, name)]
            if not found:
                return None
            for k in found:
                df = self.sources[k].df
                if df.isStreaming:
                    return None
                parts.append(f"{k}:{df.semanticHash()}")
                for f in sorted(df.inputFiles()):
                    path = hadoop(self.spark._jvm.java.net.URI(f))
                    at = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
                    parts.append(f"{f}:{at.getLen()}:{at.getModificationTime()}")
        return "\n".join(parts)

    def expire(self, name: str) -> int:
        """Delete the rows of a view beyond its retention; how many there were."""
        return self.catalog.expire(name)


def ordered_columns(df: DataFrame) -> DataFrame:
    """Built-in columns first, then the others by name: the order in which results are shown."""
    first = [c for c in BUILTIN if c in df.columns]
    return df.select(*[quoted(c) for c in first], *[quoted(c) for c in sorted(df.columns) if c not in first])
