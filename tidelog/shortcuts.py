"""Short forms of common questions: counts, samples, the last rows, this period next to the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.engine import Engine
from tidelog.lang.tokens import span_seconds
from tidelog.operators.grouping import top as top_values
from tidelog.plans.scope import quoted


def piped(source: str, commands: str) -> str:
    """A query over a source; commands may begin with a pipe or be a search."""
    commands = commands.strip()
    if not commands:
        return f"from {source}"
    return f"from {source} {commands if commands.startswith('|') else f'| search {commands}'}"


def count(engine: Engine, source: str, predicate: str = "") -> int:
    return engine.query(f"{piped(source, predicate)} | stats count").first()[0]


def sample(engine: Engine, source: str, n: int = 5, predicate: str = "", seed: int = 0) -> DataFrame:
    """n rows by a hash of their content: the same rows each time, wherever they are stored."""
    rows = engine.query(piped(source, predicate))
    key = F.xxhash64(F.lit(seed), F.to_json(F.struct(*[quoted(c) for c in rows.columns])))
    return rows.withColumn("__key", key).orderBy("__key").limit(n).drop("__key")


def last(engine: Engine, source: str, n: int = 10, predicate: str = "") -> DataFrame:
    return engine.query(f"{piped(source, predicate)} | tail {n}")


def top(engine: Engine, source: str, field: str, n: int = 10, predicate: str = "") -> DataFrame:
    return top_values(engine.query(piped(source, predicate)), field, [], n)


def diff(engine: Engine, source: str, period: str, commands: str = "| stats count") -> DataFrame:
    """The last period next to the one before it."""
    span_seconds(period)
    body = commands.strip()
    return engine.query(f"from {source}[-{period}..now] {body if body.startswith('|') else '| ' + body} | compare previous {period}")


def watch(engine: Engine, query: str, every: float, sleep: Callable[[float], None], rounds: int) -> Iterator[DataFrame]:
    """A query again and again; its relative times move on."""
    for k in range(rounds):
        if k:
            sleep(every)
            if engine._now is not None:
                engine._now += timedelta(seconds=every)
        yield engine.query(query)
