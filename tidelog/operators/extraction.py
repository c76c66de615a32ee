"""Fields out of raw lines: eighteen log formats, patterns, regular expressions, JSON paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import jsontext
from tidelog.functions.values import NUMBER
from tidelog.lang.tokens import QueryError
from tidelog.plans.scope import quoted

SEPARATOR = "\x01"
#: Keys of a format with keys of its own, found by a pass over the lines.
MOST_KEYS = 500
#: field -> (column, cast or None)
Fields = dict[str, Column]


def groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern over the whole line as an array, null without a match: one replacement, not n extractions."""
    whole = f"(?s)^{pattern}$"
    parts = F.split(F.regexp_replace(line, whole, SEPARATOR.join(f"${i}" for i in range(1, n + 1))), SEPARATOR)
    return F.when(line.rlike(whole), parts)


def named(line: Column, pattern: str, names: Sequence[str], numbers: Sequence[str] = ()) -> Fields:
    found = groups(line, pattern, len(names))
    return {n: _value(F.get(found, i), n in numbers) for i, n in enumerate(names)}


def _value(c: Column, numeric: bool) -> Column:
    c = F.when(~c.isin("", "-"), c)
    return F.when(c.rlike(NUMBER), c.try_cast("double" if numeric == "float" else "long")) if numeric else c


def either(*choices: Fields) -> Fields:
    """The first format that gives a field a value."""
    names = dict.fromkeys(n for c in choices for n in c)
    return {n: F.coalesce(*[c[n] for c in choices if n in c]) for n in names}


# ---- formats with fixed fields

FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
ACCESS = r'(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\d+|-)'
REDIS_ROLES = {"M": "master", "S": "slave", "C": "child", "X": "sentinel"}
REDIS_LEVELS = {".": "debug", "-": "verbose", "*": "notice", "#": "warning"}


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def syslog(line: Column, options: dict) -> Fields:
    old = groups(line, r"<(\d{1,3})>([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) (\S+) ([^\s\[:]+)(?:\[(\d+)\])?: ?(.*)", 6)
    new = groups(line, r"<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[.*?\])+)(?: (.*))?", 9)
    priority = F.coalesce(F.get(new, 0), F.get(old, 0)).cast("long")

    def both(n: int, o: int | None) -> Column:
        return _value(F.coalesce(F.get(new, n), F.get(old, o)) if o is not None else F.get(new, n), False)

    return {
        "priority": priority,
        "facility": F.floor(priority / 8),
        "severity": priority % 8,
        "facility_name": F.get(F.array(*map(F.lit, FACILITIES)), F.floor(priority / 8).cast("int")),
        "severity_name": F.get(F.array(*map(F.lit, SEVERITIES)), (priority % 8).cast("int")),
        "format": F.when(new.isNotNull(), "rfc5424").when(old.isNotNull(), "rfc3164"),
        "timestamp": both(2, 1),
        "hostname": both(3, 2),
        "appname": both(4, 3),
        "procid": both(5, 4),
        "msgid": both(6, None),
        "version": _value(F.get(new, 1), True),
        "structured_data": both(7, None),
        "message": F.coalesce(F.get(new, 8), F.get(old, 5)),
    }


def access(line: Column, options: dict, agent: bool) -> Fields:
    names = ["client_ip", "ident", "user", "timestamp", "request", "status", "bytes"] + (["referer", "user_agent"] if agent else [])
    out = named(line, ACCESS + (r' "([^"]*)" "([^"]*)".*' if agent else ".*"), names, ("status", "bytes"))
    request = F.split(out["request"], " ")
    whole = F.size(request) == 3
    return out | {"method": F.when(whole, F.get(request, 0)), "uri": F.when(whole, F.get(request, 1)), "protocol": F.when(whole, F.get(request, 2))}


def pairs_of_tail(line: Column, keys: dict[str, str]) -> Fields:
    """`, key: value` settings at the end of a line."""
    return {name: F.when(line.rlike(rf"[,;] {key}: "), F.regexp_extract(line, rf'[,;] {key}: "?([^",;]*)"?', 1)) for name, key in keys.items()}


def nginx_error(line: Column, options: dict) -> Fields:
    out = named(line, r"(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?(.*?)(?:, client: .*)?", ["timestamp", "severity", "pid", "tid", "cid", "message"], ("pid", "tid", "cid"))
    out |= pairs_of_tail(line, {k: k for k in ("client", "server", "request", "upstream", "host", "referrer")})
    request = F.split(out["request"], " ")
    return out | {"method": F.get(request, 0), "uri": F.get(request, 1)}


def apache_error(line: Column, options: dict) -> Fields:
    new = named(
        line,
        r"\[([^\]]+)\] \[([\w.-]*):(\w+)\] \[pid (\d+)(?::tid (\d+))?\](?: \[client ([^\]:]+|\[[^\]]+\])(?::(\d+))?\])?(?: (AH\d+):)? ?(.*)",
        ["timestamp", "module", "severity", "pid", "tid", "client_ip", "client_port", "error_code", "message"],
        ("pid", "tid", "client_port"),
    )
    old = named(line, r"\[([A-Z][a-z]{2} [^\]]+)\] \[(\w+)\](?: \[client ([^\]]+)\])? (.*)", ["timestamp", "severity", "client_ip", "message"])
    return either(new, old)


def docker(line: Column, options: dict) -> Fields:
    row = F.from_json(line, "log string, stream string, time string")
    return {n: row.getField(n) for n in ("log", "stream", "time")}


def redis(line: Column, options: dict) -> Fields:
    out = named(line, r"(\d+):([A-Z]) (\d{1,2} \w{3} \d{4} \d\d:\d\d:\d\d\.\d+) ([.*#-]) (.*)", ["pid", "role_char", "timestamp", "level_char", "message"], ("pid",))
    # a level sign may be a hyphen, which other formats use for nothing
    sign = F.when(out["message"].isNotNull(), F.regexp_extract(line, r"\.\d+ ([.*#-]) ", 1))
    return out | {"level_char": sign, "role": lookup(out["role_char"], REDIS_ROLES), "level": lookup(sign, REDIS_LEVELS)}


def postgres(line: Column, options: dict) -> Fields:
    out = named(
        line,
        r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?(?: \w+)?) \[(\d+)\](?:(?:: \[[^\]]*\])? (?:user=)?(\w+)(?:@|,db=)(\w+)\S*)? ?([A-Z]+\d?): +(.*)",
        ["timestamp", "pid", "user", "database", "severity", "message"],
        ("pid",),
    )
    timed = out["message"].rlike(r"^duration: [\d.]+ ms")
    return out | {
        "duration_ms": F.when(timed, F.regexp_extract(out["message"], r"^duration: ([\d.]+) ms", 1).try_cast("double")),
        "statement": F.when(out["message"].rlike(r"(?s)(?:statement|execute [^:]*): "), F.regexp_extract(out["message"], r"(?s)(?:statement|execute [^:]*): (.*)$", 1)),
    }


def mysql_slow(line: Column, options: dict) -> Fields:
    def part(pattern: str, kind: str | None = None) -> Column:
        c = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
        c = F.when(c != "", c)
        return c.try_cast(kind) if kind else c

    return {
        "timestamp": part(r"# Time: (\S+(?: +\d+:\d\d:\d\d)?)"),
        "user": part(r"# User@Host: ([^\[\s]*)\["),
        "host": part(r"# User@Host: \S+ @ +(\S*) *\["),
        "client_ip": part(r"# User@Host: [^\n]*@[^\n\[]*\[([^\]]*)\]"),
        "connection_id": part(r"Id: +(\d+)", "long"),
        "query_time": part(r"Query_time: ([\d.]+)", "double"),
        "lock_time": part(r"Lock_time: ([\d.]+)", "double"),
        "rows_sent": part(r"Rows_sent: (\d+)", "long"),
        "rows_examined": part(r"Rows_examined: (\d+)", "long"),
        "schema": part(r"(?:Schema: |\nuse )(\w+)"),
        "statement": part(r"(?s)(?:\n|^)(?!#|use |SET timestamp)([^#\n][^\n]*(?:\n(?!#)[^\n]*)*)$"),
    }


HAPROXY = (
    r"(?:.*?haproxy\[\d+\]: )?(\S+):(\d+) \[([^\]]+)\] (\S+) ([^/\s]+)/(\S+) ([\d-]+)/([\d-]+)/([\d-]+)/([\d-]+)/\+?([\d-]+) (\d{3}|-1) \+?(\d+) \S+ \S+ (\S{4}) "
    r'(\d+)/(\d+)/(\d+)/(\d+)/\+?(\d+) \d+/\d+ (?:\{[^}]*\} )*"(\S+) (\S+)(?: ([^"]+))?"'
)


def haproxy(line: Column, options: dict) -> Fields:
    names = "client_ip client_port timestamp frontend backend server tq tw tc tr tt status bytes term_state actconn feconn beconn srv_conn retries method uri protocol".split()
    text_fields = ("client_ip", "timestamp", "frontend", "backend", "server", "term_state", "method", "uri", "protocol")
    return named(line, HAPROXY, names, [n for n in names if n not in text_fields])


FIXED: dict[str, Callable[[Column, dict], Fields]] = {
    "syslog": syslog,
    "combined": lambda line, o: access(line, o, True),
    "clf": lambda line, o: access(line, o, False),
    "nginx_error": nginx_error,
    "apache_error": apache_error,
    "docker": docker,
    "redis": redis,
    "postgres": postgres,
    "mysql_slow": mysql_slow,
    "haproxy": haproxy,
}

# ---- formats with keys of their own: a map of texts


def pair_map(line: Column, delim: str, assign: str, quote: str) -> Column:
    """key<assign>value pairs; values may be quoted."""
    d, a, q = re.escape(delim), re.escape(assign), re.escape(quote)
    stop = r"\s" if delim.isspace() else d
    found = F.regexp_extract_all(line, F.lit(rf"(?:^|{stop})\s*([^{stop}{a}{q}]+){a}({q}(?:[^{q}\\]|\\.)*{q}|[^{stop}]*)"), F.lit(0))
    key = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, rf"^(?:{stop})?\s*([^{stop}{a}{q}]+){a}", 1), r"^\s+", ""))
    value = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_extract(x, rf"(?s){a}(.*)$", 1), rf"^{q}|{q}$", ""), r'\\(["\\])', "$1")
    return unique_map(F.transform(found, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))


def unique_map(entries: Column) -> Column:
    """A map of (key, value) structs in which the last of equal keys stays."""

    def last_only(xs: Column) -> Column:
        keys = F.transform(xs, lambda x: x["key"])
        return F.filter(xs, lambda x, i: (x["key"] != "") & (F.array_position(F.reverse(keys), x["key"]) == F.size(xs) - i))

    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last_only), 1))


def cef(line: Column, options: dict) -> Fields:
    names = ["cef_version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity"]
    part = r"((?:[^|\\]|\\.)*)\|"
    found = groups(line, rf".*?CEF:\s*{part * 7}(.*)", 8)
    return {n: F.regexp_replace(F.get(found, i), r"\\([|\\])", "$1") for i, n in enumerate(names)} | {"*": _extension(F.get(found, 7))}


def _extension(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(r"(\w[\w.\[\]]*)=((?:[^=\\]|\\.)*?)(?=\s+\w[\w.\[\]]*=|\s*$)"), F.lit(0))
    return unique_map(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w[\w.\[\]]*)=", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_extract(x, r"(?s)=(.*)$", 1), r"\\([=\\])", "$1")).alias("value"))))


def leef(line: Column, options: dict) -> Fields:
    names = ["leef_version", "device_vendor", "device_product", "device_version", "event_id"]
    found = groups(line, r".*?LEEF:\s*([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)", 6)
    rest = F.get(found, 5)
    # version 2 may name its delimiter: ^| or 0x09|
    marked = (F.get(found, 0) == "2.0") & rest.rlike(r"^(.|0x[0-9a-fA-F]{2,4})\|")
    sign = F.regexp_extract(rest, r"^(.|0x[0-9a-fA-F]{2,4})\|", 1)
    sign = F.when(sign.startswith("0x"), F.chr(F.conv(F.substring(sign, 3, 4), 16, 10).cast("long"))).otherwise(sign)
    body = F.when(marked, F.regexp_replace(rest, r"^(.|0x[0-9a-fA-F]{2,4})\|", "")).otherwise(rest)
    parts = F.split(F.when(marked, F.replace(body, sign, F.lit("\t"))).otherwise(body), "\t")
    kept = F.filter(parts, lambda x: x.contains("="))
    pairs = F.transform(kept, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1).alias("value")))
    return {n: F.get(found, i) for i, n in enumerate(names)} | {"*": unique_map(pairs)}


def w3c(line: Column, options: dict) -> Fields:
    header = options.get("header")
    if not header:
        raise QueryError("w3c needs header=, the names after #Fields:")
    names = [re.sub(r"[()]", "", n).replace("-", "_") for n in header.removeprefix("#Fields:").split()]
    parts = F.split(F.when(~line.startswith("#"), F.trim(line)), r"\s+")
    return {n: _value(F.get(parts, i), False) for i, n in enumerate(names)}


def flattened(line: Column, levels: int = 3) -> Column:
    """Dotted leaf names of a JSON object to texts; arrays stay JSON text, and so do objects below so many levels.

    Of equal names, repeated or made by dots, the last one stays.
    """

    def entries(source: Column) -> Column:
        found = F.map_entries(F.from_json(source, "map<string,string>"))
        return F.transform(F.filter(found, lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    def opened(own: Column) -> Column:
        def one(e: Column) -> Column:
            def below(inner: Column) -> Column:
                return F.when(F.size(inner) > 0, F.transform(inner, lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))).otherwise(F.array(e))

            return F.element_at(F.transform(F.array(F.when(e["value"].startswith("{"), entries(e["value"]))), below), 1)

        return F.flatten(F.transform(own, one))

    found = entries(F.when(F.trim(line).startswith("{"), line))
    for _ in range(levels - 1):
        found = opened(found)
    return unique_map(found)


def json_levels(df: DataFrame, line: Column) -> int:
    """How many levels the objects of the lines have, as a bound: the most braces that are open at once."""
    braces = F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]|\\.)*"', ""), "[^{}]", "")
    steps = F.transform(F.split(braces, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    most = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))["most"]
    return df.agg(F.max(most)).first()[0] or 1


MAPPED: dict[str, Callable[[Column, dict], Fields]] = {
    "json": lambda line, o: {"*": flattened(line, o.get("levels", 3))},
    "logfmt": lambda line, o: {"*": pair_map(line, " ", "=", '"')},
    "kv": lambda line, o: {"*": pair_map(line, o.get("delim", " "), o.get("assign", "="), o.get("quote", '"'))},
    "cef": cef,
    "leef": leef,
}


def pattern_fields(line: Column, pattern: str) -> Fields:
    """`%{name}` templates: :int and :float cast, :timestamp stays text, :rest takes the remainder."""
    out, names, at = "", [], 0
    for m in re.finditer(r"%\{(\w+)(?::(int|float|timestamp|rest))?\}", pattern):
        out += re.escape(pattern[at : m.start()])
        following = pattern[m.end() : m.end() + 1]
        body = "(.*)" if m[2] == "rest" or not following and m[2] is None else r"([+-]?\d+)" if m[2] == "int" else r"([+-]?\d+(?:\.\d+)?)" if m[2] == "float" else "(.*?)" if following else "(.*)"
        out += body
        names.append((m[1], m[2]))
        at = m.end()
    out += re.escape(pattern[at:])
    found = groups(line, f".*?{out}.*" if not pattern.startswith("%") else out + "(?:.*)", len(names))
    return {n: F.get(found, i).try_cast("long") if kind == "int" else F.get(found, i).try_cast("double") if kind == "float" else F.get(found, i) for i, (n, kind) in enumerate(names)}


def typed_keys(df: DataFrame, mapped: Column) -> dict[str, str]:
    """The keys of the maps and the narrowest type of all their values, by one pass over the lines."""
    pairs = df.select(F.explode(mapped).alias("key", "value")).where("value is not null")
    kinds = pairs.groupBy("key").agg(
        F.min(F.col("value").isin("true", "false").cast("int")).alias("b"), F.min(F.col("value").rlike(r"^[+-]?\d{1,18}$").cast("int")).alias("i"), F.min(F.col("value").rlike(NUMBER).cast("int")).alias("f")
    )
    rows = kinds.orderBy("key").limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise QueryError(f"the lines have over {MOST_KEYS} different keys: name those you need")
    return {r["key"]: "boolean" if r["b"] else "long" if r["i"] else "double" if r["f"] else "string" for r in rows}


def unpack(df: DataFrame, format: str, source: Column, *, only: Sequence[str] = (), prefix: str = "", if_missing: bool = False, pattern: str | None = None, options: dict | None = None) -> DataFrame:
    """Adds the fields of a format; `if_missing` keeps values that are there."""
    options = options or {}
    if format == "pattern":
        fields = pattern_fields(source, pattern or "")
    elif format == "w3c":
        fields = w3c(source, options)
    else:
        build = FIXED.get(format) or MAPPED.get(format)
        if build is None:
            raise QueryError(f"unknown format {format}")
        if format == "json":
            # the fields that are named tell how deep they lie; else the lines do
            levels = 1 + max(n.count(".") for n in only) if only else 3 if df.isStreaming else json_levels(df, source)
            options = options | {"levels": levels}
        fields = build(source, options)
    mapped = fields.pop("*", None)
    if mapped is not None:
        wanted = [n for n in only if n not in fields]
        if only:
            kinds = dict.fromkeys(wanted, "string")
        elif df.isStreaming:
            raise QueryError(f"parse {format} on a stream needs extract(...) with the fields")
        else:
            kinds = typed_keys(df, mapped)
        df = df.withColumn("__map", mapped)
        fields |= {k: F.try_element_at("__map", F.lit(k)).try_cast(t) for k, t in kinds.items() if k not in fields}
    chosen = {prefix + n: c for n, c in fields.items() if not only or n in only}
    if if_missing:
        chosen = {n: F.coalesce(quoted(n).cast("string"), c.cast("string")) if n in df.columns else c for n, c in chosen.items()}
    return df.withColumns(chosen).drop("__map")


def rex(df: DataFrame, source: Column, pattern: str) -> DataFrame:
    """Named groups to columns; where nothing matches, a column that was there keeps its value."""
    names = group_names(pattern)
    java = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    hit = source.rlike(java)
    columns = {}
    for name, at in names:
        before = quoted(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        columns[name] = F.when(hit, F.regexp_extract(source, java, at)).otherwise(before)
    return df.withColumns(columns)


def group_names(pattern: str) -> list[tuple[str, int]]:
    """The named groups of a pattern with their numbers."""
    out, number, at, in_class = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class:
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:])
            if m or not pattern.startswith("(?", at):
                number += 1
                if m:
                    out.append((m[1], number))
        at += 1
    if not out:
        raise QueryError("rex needs a named group, (?P<name>...)")
    return out


def json_paths(df: DataFrame, source: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: jsontext.extract(source, path) for path, name in pairs})
