"""Files and payloads to events: lines, JSON lines, CSV, and the ingest formats."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields that may hold an event's time, in the order they are tried: fixed by the data model.
TIME_FIELDS = ("_timestamp", "timestamp", "@timestamp", "time", "ts", "datetime")
#: Layouts tried on raw lines: a pattern and Spark's format.
LINE_TIMES = (
    (r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d))", None),
    (r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?)", None),
    (r"(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d)", "yyyy/MM/dd HH:mm:ss"),
    (r"(\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})", "dd/MMM/yyyy:HH:mm:ss xx"),
    (r"[A-Z][a-z]{2}, (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4})", "dd MMM yyyy HH:mm:ss xx"),
)
META = ("_time", "_raw", "_source", "_sourcetype", "host", "index")


def parsed_time(text: Column) -> Column:
    """ISO text, or epoch seconds, milliseconds, microseconds or nanoseconds by magnitude."""
    number = F.when(text.rlike(r"^\d{9,19}(\.\d+)?$"), text.try_cast("double"))
    seconds = F.when(number < 1e11, number).when(number < 1e14, number / 1e3).when(number < 1e17, number / 1e6).otherwise(number / 1e9)
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.when(number.isNull(), text.try_cast("timestamp")))


def line_time(line: Column) -> Column:
    tries = []
    for pattern, layout in LINE_TIMES:
        found = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
        tries.append(found.try_cast("timestamp") if layout is None else F.try_to_timestamp(found, F.lit(layout)))
    return F.coalesce(*tries)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """_raw, _source, _time of the lines of files; blank ones are left out."""
    rows = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "\r$", "")).alias("_raw"), F.col("_metadata.file_path").alias("_source"))
    rows = rows.where(F.trim("_raw") != "")
    return rows.withColumn("_time", line_time(F.col("_raw")))


def with_time(df: DataFrame, raw: str | None = "_raw") -> DataFrame:
    """_time from the first time field that has a value, else from the raw line."""
    tries = [parsed_time(F.col(f"`{c}`").cast("string")) for c in TIME_FIELDS if c in df.columns]
    if raw is not None and raw in df.columns:
        tries.append(line_time(F.col(raw)))
    return df.withColumn("_time", F.coalesce(*tries)) if tries else df.withColumn("_time", F.lit(None).cast("timestamp"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Fields of JSON lines next to the raw line; nested objects become dotted names, arrays JSON text."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        schema = spark.read.json(path).drop("_corrupt_record").schema  # type: ignore[assignment]
    rows = raw.select(F.col("value").alias("_raw"), F.from_json("value", schema).alias("j"))
    return with_time(flatten(rows.select("_raw", "j.*")))


def flatten(df: DataFrame) -> DataFrame:
    """Structs to dotted columns, arrays and maps to JSON text."""
    from pyspark.sql import types as T

    def leaves(col: Column, name: str, kind) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(col.getField(f.name), f"{name}.{f.name}", f.dataType)]
        return [(F.to_json(col) if isinstance(kind, T.ArrayType | T.MapType) else col).alias(name)]

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col("`" + f.name + "`"), f.name, f.dataType)])


def csv_files(spark: SparkSession, path: str, *, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header; all texts unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep)
    return with_time(reader.schema(schema).csv(path) if schema else reader.csv(path), None)


def from_lines(spark: SparkSession, text: str | Iterable[str]) -> DataFrame:
    """Piped input: a text or an iterable of lines."""
    found = text.splitlines() if isinstance(text, str) else text
    rows = [(x.rstrip("\r\n"),) for x in found if x.strip()]
    return spark.createDataFrame(rows, "_raw string").withColumn("_time", line_time(F.col("_raw")))


# ---- detection

SCORES = {
    "json": lambda x: _is_object(x),
    "logfmt": lambda x: len(re.findall(r'(?:^| )[\w.]+=(?:"[^"]*"|\S*)', x)) >= 2 and not x.startswith("{"),
    "combined": lambda x: bool(re.match(r'\S+ \S+ \S+ \[[^\]]+\] "[^"]*" \d{3} (\d+|-)', x)),
    "syslog": lambda x: bool(re.match(r"<\d{1,3}>", x)) or bool(re.match(r"[A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d \S+ \S+:", x)),
    "docker": lambda x: _is_object(x) and {"log", "stream", "time"} <= set(json.loads(x)),
}


def _is_object(x: str) -> bool:
    try:
        return isinstance(json.loads(x), dict)
    except ValueError:
        return False


def detect(sample: Sequence[str], least: float = 0.7) -> str:
    """json, logfmt, combined, syslog, docker, csv, tsv, or plain where no format fits enough lines."""
    found = [x for x in sample if x.strip()]
    if not found:
        return "plain"
    scores = {name: sum(map(test, found)) / len(found) for name, test in SCORES.items()}
    for name, sep in (("csv", ","), ("tsv", "\t")):
        widths = [len(r) for r in csv.reader(io.StringIO("\n".join(found)), delimiter=sep)]
        scores[name] = widths.count(widths[0]) / len(found) if widths and widths[0] >= 2 and len(found) > 1 else 0.0
    order = ["docker", "json", "combined", "syslog", "logfmt", "tsv", "csv"]
    best = max(order, key=lambda n: (scores[n], -order.index(n)))
    return best if scores[best] >= least else "plain"


def file_source(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A file in its own or the detected format."""
    if format is None:
        format = detect([r[0] for r in spark.read.text(path).limit(50).collect()])
    if format in ("json", "docker"):
        return json_lines(spark, path)
    if format in ("csv", "tsv"):
        return csv_files(spark, path, sep="," if format == "csv" else "\t")
    rows = lines(spark, path)
    if format == "plain":
        return rows
    from tidelog.operators.extraction import unpack

    return unpack(rows, format, F.col("_raw"), if_missing=True)


# ---- ingest payloads

EVENT = "time double, event string, source string, sourcetype string, host string, index string, fields map<string,string>"


def hec_events(df: DataFrame, column: str = "value") -> DataFrame:
    """Collector events, one JSON object a row: event may be a text or any JSON."""
    e = F.from_json(F.col(column), EVENT)
    rows = df.select(e.alias("e")).where("e.event is not null")
    return rows.select(
        F.timestamp_micros((F.col("e.time") * 1_000_000).cast("long")).alias("_time"), F.col("e.event").alias("_raw"), F.col("e.source").alias("_source"), F.col("e.sourcetype").alias("_sourcetype"), F.col("e.host").alias("host"),
        F.coalesce("e.index", F.lit("main")).alias("index"), F.to_json("e.fields").alias("fields"),
    )


def json_events(spark: SparkSession, events: Sequence[dict]) -> DataFrame:
    """A list of event objects, as an HTTP body gives them."""
    rows = [(json.dumps(e),) for e in events]
    return hec_events(spark.createDataFrame(rows, "value string"))


def bulk_events(df: DataFrame, order: str, column: str = "value", request: str | None = None) -> DataFrame:
    """Action lines, each followed by its document but for deletes, which have none; `order` is the order of a request's lines.

    After a delete, or what looks like one in a document's place, an action follows; from there
    actions and documents take turns. A request is one task: name its column if there are several.
    """
    whole = [F.col(request)] if request else [F.lit(0)]
    rows = df.where(F.trim(column) != "").select(F.col(column).alias("line"), F.col(order).alias("at"), F.struct(*whole).alias("request"))
    rows = rows.withColumn("deletes", F.col("line").rlike(r'^\s*\{\s*"delete"\s*:').cast("int"))
    inside = Window.partitionBy("request").orderBy("at")
    rows = rows.withColumns({"run": F.coalesce(F.sum("deletes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "doc": F.lead("line").over(inside)})
    place = F.row_number().over(Window.partitionBy("request", "run").orderBy("at"))
    lines = rows.withColumn("place", place).where("place % 2 = 1 and deletes = 0 and doc is not null").select(F.col("line").alias("action"), "doc")
    action = F.from_json("action", "map<string,struct<_index:string,_id:string>>")
    kind = F.get(F.map_keys(action), F.lit(0))
    rows = lines.select(kind.alias("op"), F.get(F.map_values(action), F.lit(0)).alias("a"), F.col("doc").alias("_raw")).where(F.col("op").isin("index", "create"))
    time = F.coalesce(*[F.get_json_object("_raw", f"$['{n}']") for n in ("@timestamp", *[t for t in TIME_FIELDS if t != "@timestamp"])])
    return rows.select(parsed_time(time).alias("_time"), "_raw", F.coalesce("a._index", F.lit("main")).alias("index"), F.col("a._id").alias("_id"), F.coalesce(F.get_json_object("_raw", "$.message"), F.col("_raw")).alias("message"))


OTLP = (
    "resourceLogs array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>,"
    "scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string>,"
    "attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>,traceId:string,spanId:string,flags:int>>>>>>"
)
#: Severity numbers in groups of four.
SEVERITY = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def attributes(a: Column) -> Column:
    value = lambda x: F.coalesce(x["value"]["stringValue"], x["value"]["intValue"], x["value"]["doubleValue"].cast("string"), x["value"]["boolValue"].cast("string"))
    from tidelog.operators.extraction import unique_map

    return unique_map(F.transform(F.coalesce(a, F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>")), lambda x: F.struct(x["key"].alias("key"), value(x).alias("value"))))


def otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """OTLP log exports in JSON: one row a record."""
    rows = df.select(F.explode(F.from_json(column, OTLP)["resourceLogs"]).alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    number = F.col("l.severityNumber")
    level = F.coalesce(F.nullif("l.severityText", F.lit("")), F.get(F.array(*map(F.lit, SEVERITY)), F.floor((number - 1) / 4).cast("int")))
    resource = attributes(F.col("resource.attributes"))
    return rows.select(
        F.timestamp_micros(F.floor(F.col("l.timeUnixNano").cast("decimal(20,0)") / 1000).cast("long")).alias("_time"), F.col("l.body.stringValue").alias("_raw"), level.alias("level"), F.col("l.traceId").alias("trace_id"),
        F.col("l.spanId").alias("span_id"), F.col("scope.name").alias("scope"), F.try_element_at(resource, F.lit("service.name")).alias("service"), F.try_element_at(resource, F.lit("host.name")).alias("host"),
        F.to_json(attributes(F.col("l.attributes"))).alias("attributes"),
    )


def without_repeats(df: DataFrame) -> DataFrame:
    """Ingest dedup: one row for each raw line. On a stream, within the watermark of _time."""
    return df.dropDuplicatesWithinWatermark(["_raw"]) if df.isStreaming else df.dropDuplicates(["_raw"])
