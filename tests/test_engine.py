"""Semantics on small frames: nulls, loose types, extraction, sessions, traces, views, streams, ingest, output."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.engine import Engine, ordered_columns
from tidelog.lang.tokens import QueryError
from tidelog.operators import analytics
from tidelog.sources import readers, sinks

NOW = datetime(2026, 2, 11, tzinfo=UTC)


@pytest.fixture
def e(spark):
    return Engine(spark, now=NOW)


def table(spark, columns, *rows):
    return spark.createDataFrame(list(rows), columns)


def run(e, df, text, **kw):
    return [tuple(r) for r in e.run_on(df, text, **kw).collect()]


def test_nulls_are_sql_nulls(spark, e):
    df = table(spark, "id int, a int, s string", (1, 5, "x"), (2, None, None), (3, 0, ""))
    ids = lambda w: sorted(r[0] for r in run(e, df, f"| where {w} | fields id"))
    assert ids("a < 3") == [3] and ids("a != 5") == [3] and ids("not a = 5") == [3]
    assert ids("a is null") == [2] and ids("a?") == [1, 3] and ids("nothing is null") == [1, 2, 3]
    assert ids('s !~ "x"') == [2, 3] and ids("a in (null, 5)") == [1, 2] and ids("a") == [1] and ids("s") == [1]
    assert run(e, df, "| stats sum(a) as s, avg(a) as m, count(a) as n, count") == [(5.0, 2.5, 2, 3)]


def test_numbers_in_texts(spark, e):
    df = table(spark, "id int, s string", *enumerate(["5", "10", "abc", "", None, " 7", "1e3", "1d"]))
    ids = lambda w: sorted(r[0] for r in run(e, df, f"| where {w} | fields id"))
    assert ids("s = 5") == [0] and ids('s = "10"') == [1] and ids("s > 6 and isnum(s)") == [1, 6]
    assert run(e, df, "| eval n = tonumber(s) | where n is not null | sort n | fields n") == [(5.0,), (10.0,), (1000.0,)]
    assert [r[0] for r in run(e, df, "| sort s | fields s")][:4] == [None, "5", "10", "1e3"]
    assert run(e, df, "| stats min(s) as a, max(s) as b") == [("5", "abc")]


def test_arithmetic(spark, e):
    df = table(spark, "a long, b long, x double, s string", (7, -2, 2.5, "3"))
    got = run(e, df, '| eval q = a / b, r = a % b, z = a / 0, m = a + x, t = s + "4", u = s * 2, v = s . a, w = a - s, c = 5 ?? 6 | fields q, r, z, m, t, u, v, w, c')
    assert got == [(-3, 1, None, 9.5, "34", 6.0, "37", 4.0, 5)]


def test_globs_and_like_are_literal_elsewhere(spark, e):
    df = table(spark, "p string", ("/api/v1",), ("/api/v1.x",), ("/apiXv1",), ("/a+b(c)",))
    assert len(run(e, df, '| where p="/api/*"')) == 2 and len(run(e, df, '| where p="/api/v1.?"')) == 1
    assert run(e, df, '| where p="/a+b(*" | fields p') == [("/a+b(c)",)] and len(run(e, df, '| where p like "/API_V1%"')) == 3


def test_schema_on_read(spark, e):
    df = table(spark, "_raw string, props string", ('{"user":{"id":7},"status":500,"tags":["a","b"]}', '{"k":{"n":1}}'), ("plain", None))
    assert run(e, df, "| where status >= 500 | eval u = user.id, k = props.k.n, o = user?.id | fields u, k, o") == [("7", "1", "7")]
    assert run(e, df, "| json user.id AS u, tags[-1] AS t, tags[*] AS all | where u is not null | fields u, t, all") == [("7", "b", '["a","b"]')]


def test_order_decides_first_and_dedup(spark, e):
    df = table(spark, "_time timestamp, k string, v int", *[(datetime(2026, 1, 1, 0, m), k, v) for m, k, v in [(3, "a", 3), (1, "a", 1), (2, "b", 2), (2, None, 9)]])
    assert sorted(run(e, df, "| stats first(v) as f, last(v) as l by k"), key=str) == [("a", 1, 3), ("b", 2, 2), (None, 9, 9)]
    assert sorted(r[0] for r in run(e, df, "| dedup k | fields v")) == [1, 2, 9]
    assert sorted(r[0] for r in run(e, df, "| sort -v | dedup k | fields v")) == [2, 3, 9]
    assert [r[0] for r in run(e, df, "| sort v | tail 2 | fields v")] == [3, 9]


def test_sessions_split_after_the_gap(spark, e):
    at = lambda us: datetime.fromtimestamp(1_770_000_000 + us / 1e6)
    gap = 1800 * 1_000_000
    df = table(spark, "user string, t timestamp", ("a", at(0)), ("a", at(gap)), ("a", at(2 * gap + 1)), ("b", at(5)))
    got = run(e, df, "| sessionize maxpause=30m by user | sort user, _time | fields user, _session_id", time="t")
    assert got == [("a", 1), ("a", 1), ("a", 2), ("b", 3)]
    assert [r[0] for r in run(e, df, "| sessionize maxpause=30m | sort _time | fields _session_id", time="t")] == [1, 1, 1, 2]


def test_transactions(spark, e):
    rows = [("u", 0, "login a"), ("u", 10, "work"), ("u", 20, "logout"), ("u", 30, "login b"), ("u", 31, "logout"), ("v", 0, "login"), ("v", 9000, "work")]
    df = table(spark, "user string, s int, _raw string", *rows).withColumn("_time", F.timestamp_seconds("s"))
    got = run(e, df, "| transaction user maxspan=1h | fields user, eventcount, duration")
    assert got == [("u", 5, 31.0)]
    got = sorted(run(e, df, '| transaction user startswith="login" endswith="logout" | fields user, _raw, eventcount'))
    assert ("u", "login b\nlogout", 2) in got and ("u", "login a\nwork\nlogout", 3) in got and len(got) == 3


def test_join_keeps_left_values_and_matches_as_text(spark, e):
    e.register("r", table(spark, "k string, v string, w int", ("1", "right", 1), ("1", "again", 2), (None, "x", 3)))
    df = table(spark, "k int, v string", (1, "left"), (2, "left"), (None, "left"))
    e.register("main", df)
    assert sorted(map(tuple, e.query("| join k [from r] | fields k, v, w").collect())) == [(1, "left", 1), (1, "left", 2)]
    assert sorted(map(tuple, e.query("| lookup r on k | fields k, w").collect()), key=str) == [(1, 1), (1, 2), (2, None), (None, None)]


def test_explode_names_no_part_of_too_many_keys(spark, e):
    for n in (500, 501):
        df = table(spark, "a string", (json.dumps([{f"k{i:03}": i for i in range(n)}]),))
        if n > 500:
            with pytest.raises(QueryError):
                run(e, df, "| explode a | fields a.k000")
        else:
            assert run(e, df, "| explode a | fields a.k499") == [("499",)]


def test_explode_keeps_rows_without_arrays(spark, e):
    df = table(spark, "id int, a string, b string", (1, "[1,2]", '["x","y"]'), (2, "[]", "[]"), (3, None, "[1]"), (4, "no", "no"), (5, '[{"n":1,"m":"z"},{"n":2}]', "[1]"))
    assert sorted(run(e, df, "| explode a | fields id, a"), key=str) == sorted([(1, "1"), (1, "2"), (2, "[]"), (3, None), (4, "no"), (5, '{"n":1,"m":"z"}'), (5, '{"n":2}')], key=str)
    assert [r for r in run(e, df, "| explode a | where id = 5 | sort a.n | fields a.n, a.m")] == [("1", "z"), ("2", None)]
    assert sorted(run(e, df, "| explode a, b | where id in (1, 5) | fields id, a, b")) == [(1, "1", "x"), (1, "2", "y"), (5, '[{"n":1,"m":"z"},{"n":2}]', "[1]")]


LINES = {
    "combined": ('1.2.3.4 - bob [10/Feb/2026:08:12:03 +0000] "GET /a?b=1 HTTP/1.1" 404 123 "http://r/" "curl/8"', {"client_ip": "1.2.3.4", "user": "bob", "method": "GET", "uri": "/a?b=1", "status": 404, "bytes": 123, "referer": "http://r/", "user_agent": "curl/8", "ident": None}),
    "clf": ('1.2.3.4 - - [10/Feb/2026:08:12:03 +0000] "GET / HTTP/1.0" 200 -', {"client_ip": "1.2.3.4", "status": 200, "bytes": None, "protocol": "HTTP/1.0"}),
    "syslog": ("<165>1 2026-02-10T08:12:03Z host app 77 ID47 [a@1 x=\"y\"] hello there", {"priority": 165, "facility": 20, "severity": 5, "facility_name": "local4", "severity_name": "notice", "format": "rfc5424", "hostname": "host", "appname": "app", "procid": "77", "msgid": "ID47", "version": 1, "message": "hello there"}),
    "nginx_error": ('2026/02/10 08:12:03 [error] 12#34: *56 open() failed, client: 1.2.3.4, server: _, request: "GET /x HTTP/1.1", host: "h"', {"severity": "error", "pid": 12, "tid": 34, "cid": 56, "message": "open() failed", "client": "1.2.3.4", "method": "GET", "uri": "/x", "host": "h"}),
    "apache_error": ("[Tue Feb 10 08:12:03.123456 2026] [core:error] [pid 12:tid 34] [client 1.2.3.4:555] AH00124: too many", {"module": "core", "severity": "error", "pid": 12, "tid": 34, "client_ip": "1.2.3.4", "client_port": 555, "error_code": "AH00124", "message": "too many"}),
    "cef": ("CEF:0|Vendor|Pro\\|duct|1.0|100|Name|9|src=10.0.0.1 msg=hello there dst=2.1.2.2", {"cef_version": "0", "device_vendor": "Vendor", "device_product": "Pro|duct", "severity": "9", "src": "10.0.0.1", "msg": "hello there", "dst": "2.1.2.2"}),
    "leef": ("LEEF:2.0|V|P|1|42|^|src=1.1.1.1^usr=bob x", {"leef_version": "2.0", "event_id": "42", "src": "1.1.1.1", "usr": "bob x"}),
    "docker": ('{"log":"hi\\n","stream":"stdout","time":"2026-02-10T08:12:03Z"}', {"log": "hi\n", "stream": "stdout", "time": "2026-02-10T08:12:03Z"}),
    "redis": ("123:M 10 Feb 2026 08:12:03.456 * Ready", {"pid": 123, "role_char": "M", "role": "master", "level_char": "*", "level": "notice", "message": "Ready"}),
    "postgres": ("2026-02-10 08:12:03.456 UTC [99] bob@shop LOG:  duration: 12.5 ms  statement: SELECT 1", {"pid": 99, "user": "bob", "database": "shop", "severity": "LOG", "duration_ms": 12.5, "statement": "SELECT 1"}),
    "mysql_slow": ("# Time: 2026-02-10T08:12:03Z\n# User@Host: root[root] @ localhost [127.0.0.1]  Id: 5\n# Query_time: 2.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 100\nuse shop;\nSET timestamp=1;\nSELECT * FROM t;", {"user": "root", "host": "localhost", "client_ip": "127.0.0.1", "connection_id": 5, "query_time": 2.5, "rows_examined": 100, "schema": "shop", "statement": "SELECT * FROM t;"}),
    "haproxy": ('haproxy[1]: 1.2.3.4:555 [10/Feb/2026:08:12:03.456] fe be/srv1 10/0/30/69/109 200 2750 - - ---- 1/1/1/1/0 0/0 "GET /i HTTP/1.1"', {"client_ip": "1.2.3.4", "client_port": 555, "frontend": "fe", "backend": "be", "server": "srv1", "tq": 10, "tt": 109, "status": 200, "bytes": 2750, "retries": 0, "method": "GET", "uri": "/i"}),
    "logfmt": ('level=info msg="a \\"b\\" c" n=5 empty=', {"level": "info", "msg": 'a "b" c', "n": 5}),
    "kv": ("a=1 b='x y' c=2.5", {"a": 1, "c": 2.5}),
    "json": ('{"a":{"b":1,"c":{"d":"x"}},"e":[1,2],"f":true,"g":null}', {"a.b": 1, "a.c.d": "x", "e": "[1,2]", "f": True}),
}


@pytest.mark.parametrize("format", sorted(LINES))
def test_formats(spark, e, format):
    line, want = LINES[format]
    df = table(spark, "_raw string", (line,), ("nothing of the kind at all",))
    got = {r["_raw"]: r.asDict() for r in e.run_on(df, f"| unpack_{format}").collect()}
    assert {k: got[line].get(k) for k in want} == want
    assert set(got) == {line, "nothing of the kind at all"}


def test_format_options(spark, e):
    df = table(spark, "_raw string, level string", ("2026-02-10 GET /x 200", "kept"))
    got = e.run_on(df, '| unpack_w3c header="#Fields: date cs-method cs-uri sc-status"').first().asDict()
    assert (got["cs_method"], got["sc_status"]) == ("GET", "200")
    df = table(spark, "_raw string, level string", ("level=new other=1", "kept"), ("level=new other=1", None))
    assert sorted(run(e, df, "| parse logfmt(_raw) if_missing | fields level"), key=str) == [("kept",), ("new",)]
    got = e.run_on(df, "| parse logfmt(_raw) as p extract (other)")
    assert "p.other" in got.columns and "p.level" not in got.columns
    assert run(e, df.limit(1), '| rex "level=(?P<level>x\\\\w+)" | fields level') == [("kept",)]


def test_traces(spark):
    spans = [{"id": i, "parent": p, "time": t} for i, p, t in [("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("c", "r", 3), ("orphan", "gone", 4), ("x", "y", 5), ("y", "x", 6)]]
    got = [(spans[k]["id"], d, lead) for k, d, lead in analytics.span_tree(spans)]
    assert got[:5] == [("r", 0, ""), ("a", 1, "├── "), ("b", 2, "│   └── "), ("c", 1, "└── "), ("orphan", 0, "")]
    assert sorted(x[0] for x in got) == ["a", "b", "c", "orphan", "r", "x", "y"]


def test_topology_and_its_cap(spark, e):
    df = table(spark, "source string, dest string, w int", ("a", "b", 1), ("a", "b", 2), ("b", "c", 3), ("a", "", 1), (None, "c", 1), ("c", "c", 5), ("z", "q", 1))
    got = run(e, df.withColumnRenamed("source", "s"), "| topology source_field=s dest_field=dest weight_field=w max_nodes=3")
    assert got == [("a", "b", 2, 2, 2, 3.0), ("b", "c", 1, 1, 2, 3.0), ("c", "c", 1, 1, 2, 5.0)]


def test_registered_patterns_read_every_line_of_a_text(spark, sf, tmp_path):
    import os
    from collections import Counter

    from tidelog.queries import QUERIES

    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    texts = [f"start of a rather long first line of the text here\nuser {k} logged in\n\n{'late ' * 20}line {k % 3}" for k in range(9)] + [None, ""]
    table(spark, "doc_id long, text string, lang string, source string, n_chars long", *[(k, t, "en", "a", 1) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    masked = [" ".join("<*>" if w.isdigit() else w for w in line.split()) for t in texts for line in (t or "").split("\n") if line.strip()]
    got = {r["pattern"]: r["count"] for r in QUERIES["patterns"](spark, str(tmp_path)).collect()}
    assert got == Counter(masked) and len(got) == 3


def test_patterns_mask_and_merge(spark, e):
    lines = [f"user {i} logged in from 10.0.0.{i}" for i in range(20)] + [f"user {n} logged out now" for n in ("bob", "amy")] + ["disk full", "", None]
    df = table(spark, "m string", *[(x,) for x in lines])
    got = run(e, df, "| patterns field=m similarity=0.5 | fields pattern, count")
    assert got[0] == ("user <*> logged in from <*>", 20) and ("disk full", 1) in got and ("user <*> logged out now", 2) in got


def test_registered_glimpse_profiles_every_row(spark, sf, tmp_path):
    import os

    from tests.oracle import duck_rows, spark_rows
    from tidelog.queries import ORACLES, QUERIES

    for name in os.listdir(sf):
        if name != "customer.parquet":
            os.symlink(f"{sf}/{name}", tmp_path / name)
    customers, copies = spark.read.parquet(f"{sf}/customer.parquet"), spark.range(1000).withColumnRenamed("id", "copy")
    keys = customers.count()
    out = customers.crossJoin(copies).withColumn("c_custkey", F.col("c_custkey") + keys * F.col("copy")).withColumn("c_acctbal", F.round(F.col("c_acctbal") + F.col("copy") / 50, 2)).drop("copy")
    out.coalesce(1).write.parquet(str(tmp_path / "written"))
    (part,) = (tmp_path / "written").glob("part-*.parquet")
    part.rename(tmp_path / "customer.parquet")
    for left in (tmp_path / "written").iterdir():
        left.unlink()
    (tmp_path / "written").rmdir()
    assert keys * 1000 > 100_000
    assert spark_rows(QUERIES["glimpse"](spark, str(tmp_path))) == duck_rows(str(tmp_path), ORACLES["glimpse"])


def test_percentiles_by_rank_are_exact(spark):
    i = F.col("id")
    fields = {
        "one": F.when(i == 7, 3.5), "two": F.when(i < 2, i), "none": F.lit(None), "key": i, "skewed": F.exp(i / 40), "mostly zero": F.when(i % 5 < 3, 0.0).otherwise(-i), "few": i % 3, "half null": F.when(i % 2 == 0, i % 97),
        "at the middle": F.when(i < 2001, -1.5).otherwise(i), "odd": F.when(i == 1, float("nan")).when(i == 2, float("inf")).when(i == 3, float("-inf")).when(i == 4, -0.0).otherwise(i - 2000), "negative": -i * i,
    }
    for rows in (1, 2, 4002, 4003):
        cells = [F.struct(F.lit(k).alias("field"), v.cast("double").alias("n")) for k, v in fields.items()]
        long = spark.range(rows).select(F.inline(F.array(*cells)))
        shares = {"low": 0.0, "first": 0.01, "p50": 0.5, "p99": 0.99, "high": 1.0}
        want = long.where("n is not null").groupBy("field").agg(*[F.percentile("n", p).alias(k) for k, p in shares.items()])
        assert sorted(map(str, analytics.percentiles(long, shares).collect())) == sorted(map(str, want.collect()))


def test_glimpse_of_all_rows_and_of_a_sample_agree(spark, e):
    df = table(spark, "a int, s string, t timestamp, d double", *[(k % 7 if k % 3 else None, ["x", "5", "10", "", None, " 7", "1e3"][k % 7], datetime(2024, 1, 1 + k % 3), k / 8) for k in range(300)])
    whole = run(e, df, "| glimpse all")
    assert whole == run(e, df, "| glimpse 300") == run(e, df, "| glimpse")
    got = {r[0]: r[1:] for r in whole}
    assert got["a"] == ("int", 300, 100 * (200 / 300), 100 - 100 * (200 / 300), 7, "1 (29), 2 (29), 4 (29), 5 (29), 0 (28)", 0.0, 3.0, 6.0, 6.0)
    assert got["d"][4] == 50 and got["t"][5].endswith(" (100)") and got["s"][6:] == (5.0, 10.0, 1000.0, 1000.0)
    assert {r[2] for r in run(e, df, "| glimpse 10")} == {10} and run(e, df.where("a > 9"), "| glimpse all") == []


def test_outliers_without_spread(spark, e):
    df = table(spark, "x double", (1.0,), (1.0,), (1.0,), (1.0,), (None,))
    for method in ("iqr", "zscore", "mad"):
        assert set(run(e, df, f"| outliers field=x method={method} | fields _outlier, _score")) == {(False, 0.0)}
    assert run(e, df, "| correlate x x | fields _correlation, _n") == [(0.0, 4)]


def test_cycles_and_unknown_names(spark, e):
    e.register("main", table(spark, "a int", (1,)))
    for bad in ("$a = from $b; $b = from $a; from $a", "from nowhere", "| where nosuch(a)", "| dropview \"x\"", "| tail 3"):
        with pytest.raises(QueryError):
            e.query(bad)


def test_views_answer_only_what_they_hold(spark, e):
    e.register("main", table(spark, "k string, g int, v double", *[(k, g, float(k == "a") + g) for k in "ab" for g in range(6)]))
    e.query('| where g > 0 | stats count, sum(v), max(v) by k, g | materialize "m"')
    answered = lambda q: e.answered_by_view(e.program(q).main) is not None
    assert answered("| where g > 0 | stats count by k") and answered("| where g > 0 and k = \"a\" | stats sum(v) as s")
    assert not answered("| stats count by k") and not answered("| where g > 0 and v > 2 | stats count by k") and not answered("| where g > 0 | stats avg(v) by k") and not answered("| where g > 0 | stats count by other")
    q = '| where g > 0 and k = "a" | stats count as n, sum(v) as s, max(v) as m by k'
    fresh = Engine(spark, now=NOW)
    fresh.register("main", e.sources["main"].df)
    assert list(map(tuple, e.query(q).collect())) == list(map(tuple, fresh.query(q).collect())) == [("a", 5, 20.0, 6.0)]
    assert [r["name"] for r in e.query("| views").collect()] == ["m"]
    e.query('| views "m" retention=5d')
    assert e.catalog.get("m").retention == "5d"
    e.query('| dropview "m"')
    assert "m" not in e.catalog


def test_sources_by_list_and_glob_align_types(spark, e):
    e.register("log1", table(spark, "a int, b string", (1, "x"))).register("log2", table(spark, "a string, c int", ("y", 2)))
    got = sorted(map(tuple, e.query("from log* | fields a, b, c").collect()), key=str)
    assert got == [("1", "x", None), ("y", None, 2)]
    assert e.query('from log1, log2 | search index=log2 | stats count').first()[0] == 1


def test_tee_writes_and_passes_on(spark, e, tmp_path):
    df = table(spark, "a int", (1,), (2,))
    assert len(run(e, df, f'| tee "{tmp_path}/out"')) == 2
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_readers(spark, e, tmp_path):
    (tmp_path / "j.log").write_text('{"timestamp":"2026-02-10T08:12:03.5Z","a":{"b":1},"t":[1]}\n\n{"timestamp":"2026-02-10T08:12:04Z","x":2}\n')
    df = readers.file_source(spark, str(tmp_path / "j.log"))
    assert sorted(df.columns) == ["_raw", "_time", "a.b", "t", "timestamp", "x"] and df.where("_time is not null").count() == 2
    (tmp_path / "c.csv").write_text("time,v\n1770710400,5\n1770710401,6\n")
    assert readers.file_source(spark, str(tmp_path / "c.csv"), "csv").select(F.unix_seconds("_time")).first()[0] == 1770710400
    (tmp_path / "p.log").write_text("2026-02-10 08:12:03 start\r\n   \nno time here\n")
    rows = readers.file_source(spark, str(tmp_path / "p.log")).collect()
    assert [r["_raw"] for r in rows] == ["2026-02-10 08:12:03 start", "no time here"] and rows[1]["_time"] is None
    assert readers.from_lines(spark, "a\n\nb\n").count() == 2


@pytest.mark.parametrize("want,lines", [("json", ['{"a":1}', '{"b":2}']), ("logfmt", ["a=1 b=2", 'x="y z" q=3']), ("combined", [LINES["combined"][0]]), ("syslog", ["<13>Feb 10 08:12:03 h app: x"]), ("csv", ["a,b,c", "1,2,3"]), ("tsv", ["a\tb", "1\t2"]), ("plain", ["hello world", "more"]), ("docker", [LINES["docker"][0]]), ("plain", [])])
def test_detection(want, lines):
    assert readers.detect(lines) == want


def test_ingest_payloads(spark):
    got = readers.json_events(spark, [{"time": 1.5, "event": "hi", "host": "h", "fields": {"a": "1"}}, {"event": {"x": 1}, "index": "i"}, {"host": "none"}]).collect()
    assert [(r["_raw"], r["index"]) for r in got] == [("hi", "main"), ('{"x":1}', "i")]
    bulk = ['{"index":{"_index":"logs","_id":"1"}}', '{"@timestamp":"2026-02-10T00:00:00Z","message":"m"}', '{"create":{"_index":"logs"}}', '{"level":"x"}']
    df = table(spark, "n long, value string", *enumerate(bulk))
    got = sorted(readers.bulk_events(df, "n").collect(), key=str)
    assert {r["index"] for r in got} == {"logs"} and {r["message"] for r in got} == {"m", '{"level":"x"}'}
    otlp = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1770710400000000000", "severityNumber": 17, "body": {"stringValue": "boom"}, "attributes": [{"key": "n", "value": {"intValue": "5"}}], "traceId": "t", "spanId": "p"}]}]}]}
    (r,) = readers.otlp_logs(table(spark, "value string", (json.dumps(otlp),))).collect()
    assert (r["_raw"], r["level"], r["service"], r["trace_id"], json.loads(r["attributes"])) == ("boom", "ERROR", "api", "t", {"n": "5"})
    assert readers.without_repeats(table(spark, "_raw string", ("a",), ("a",), ("b",))).count() == 2


def test_output_formats(spark):
    df = table(spark, "b double, a string, host string", (2.0, "x", "h"), (None, 'q"r', "h"))
    assert ordered_columns(df).columns == ["host", "a", "b"]
    assert sinks.render(df, "csv") == 'host,a,b\nh,x,2\nh,"q""r",'
    assert sinks.render(df, "tsv").splitlines()[1] == "h\tx\t2" and sinks.render(df, "value") == "h"
    assert json.loads(sinks.render(df, "json").splitlines()[0]) == {"a": "x", "b": 2.0, "host": "h"}
    assert sinks.render(df, "table").splitlines()[0].split() == ["host", "a", "b"] and "host  h" in sinks.render(df, "vertical")
    assert sinks.render(df, "raw").splitlines()[0] == "h\tx\t2" and len(list(sinks.stream_json(df))) == 2
    with pytest.raises(ValueError):
        sinks.render(df, "pdf")


def test_streams(spark, e, tmp_path):
    from tidelog.lang.tree import Agg, Field
    from tidelog.streaming.live import Alert, ContinuousView, catch_up, log_channel, tail

    schema = "_time timestamp, k string, v double"
    for n in range(3):
        table(spark, schema, *[(datetime(2026, 1, 1, n, m), "ab"[m % 2], float(m)) for m in range(10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for bad in ("| stats count", "| sort v", "| dedup k", "$a = from x; from $a"):
        with pytest.raises(QueryError):
            tail(e, read(), bad)
    past, live = catch_up(e, spark.read.schema(schema).parquet(str(tmp_path / "in")).where("hour(_time) = 0"), read(), "where v > 7", 5)
    assert past.count() == 2
    live.writeStream.format("parquet").option("path", str(tmp_path / "t")).option("checkpointLocation", str(tmp_path / "tc")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    view = ContinuousView(e, "v", str(tmp_path / "view"), [Agg("count", (), "n"), Agg("avg", (Field("v"),), "m"), Agg("max", (Field("v"),), "top")], ["k"], filter="v > 0")
    view.start(read(), str(tmp_path / "vc"), once=True).awaitTermination()
    assert sorted(map(tuple, view.read().collect())) == [("a", 12, 5.0, 8.0), ("b", 15, 5.0, 9.0)]
    with pytest.raises(QueryError):
        ContinuousView(e, "v", "x", [Agg("dc", (Field("v"),), "d")])
    seen: list = []
    alert = Alert("high", "| where v > 8", [log_channel(seen)])
    alert.follow(e, read(), str(tmp_path / "ac"), once=True).awaitTermination()
    assert len(seen) == 3 and seen[0][1][0]["v"] == 9.0
    e.register("main", spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert alert.check(e) and not Alert("none", "| where v > 99", [log_channel(seen)]).check(e)


def moment(micros):
    return datetime(2026, 1, 1) + timedelta(microseconds=micros)


def test_views_lose_no_rows(spark, e, tmp_path):
    from tidelog.lang.tree import Agg
    from tidelog.streaming.live import ContinuousView

    schema = "k string"
    folder = str(tmp_path / "in")
    add = lambda n: table(spark, schema, *[("a",)] * n).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    view = ContinuousView(e, "v", str(tmp_path / "view"), [Agg("count", (), "n")], ["k"])
    add(5)
    view.start(read(), str(tmp_path / "one"), once=True).awaitTermination()
    view.pause()
    add(7)
    with pytest.raises(QueryError):
        view.start(read(), str(tmp_path / "one"), once=True)
    view.resume(read(), str(tmp_path / "one"), once=True).awaitTermination()
    add(1)
    view.start(read(), str(tmp_path / "one"), once=True).awaitTermination()
    assert view.read().collect() == [("a", 13)]
    build = view.current()
    assert len(view.versions(build)) <= 3
    view.rebuild(read(), str(tmp_path / "two"))
    assert view.read().collect() == [("a", 13)] and view.current() != build and not view.versions(build)
    view.start(read(), str(tmp_path / "three"), once=True).awaitTermination()
    assert view.read().collect() == [("a", 13)]


def test_views_answer_only_for_the_source_they_were_made_of(spark, e):
    from tidelog.engine import Engine

    rows = lambda n: table(spark, "_time timestamp, k string", *[(moment(m * 60_000_000), "ab"[m % 2]) for m in range(n)])
    e.register("t", rows(10))
    e.query('from t | stats count as n by k | materialize "m"')
    text = "from t | stats count as n by k"
    assert "m" in str(e.answered_by_view(e.program(text).main).source)
    e.register("t", rows(100))
    assert e.answered_by_view(e.program(text).main) is None
    assert sorted(map(tuple, e.query(text).collect())) == [("a", 50), ("b", 50)]
    day = moment(0).replace(tzinfo=UTC) + timedelta(minutes=30)
    one = Engine(spark, now=day)
    one.register("t", rows(10))
    one.query('from t[-1h] | stats count as n by k | materialize "hour"')
    assert one.answered_by_view(one.program("from t[-1h] | stats count as n by k").main) is not None
    one._now = day + timedelta(days=1)
    assert one.answered_by_view(one.program("from t[-1h] | stats count as n by k").main) is None
    folder = one.catalog.get("hour").path
    one.query('from t | dropview "hour"')
    assert not __import__("os").path.exists(folder.removeprefix("file:"))


def test_bulk_actions_and_json_names(spark, e):
    from tidelog.sources import readers

    lines = ['{"delete":{"_index":"x","_id":"1"}}', '{"index":{"_index":"logs","_id":"2"}}', '{"message":"m"}', "", '{"delete":{"_id":"3"}}', '{"delete":{"_id":"4"}}', '{"create":{"_index":"logs"}}', '{"delete":"me"}', '{"index":{"_index":"logs"}}', '{"message":"last"}', '{"update":{"_id":"5"}}', '{"doc":{}}']
    got = [r["_raw"] for r in readers.bulk_events(table(spark, "n long, value string", *enumerate(lines)), "n").collect()]
    assert sorted(got) == sorted(['{"message":"m"}', '{"delete":"me"}', '{"message":"last"}'])
    rows = ['{"a":1,"a":2}', '{"a.b":1,"a":{"b":2}}', '{"p":{"q":{"r":{"s":{"t":{"u":"deep {not a brace"}}}}}}}', "no json", "{}"]
    df = table(spark, "n long, line string", *enumerate(rows))
    got = {r["n"]: r.asDict() for r in e.run_on(df, "| parse json(line)").collect()}
    assert got[0]["a"] == 2 and got[1]["a.b"] == 2 and got[2]["p.q.r.s.t.u"] == "deep {not a brace" and got[3]["a"] is None


def test_compare_refuses_rows_without_a_key(spark, e):
    e.register("t", table(spark, "_time timestamp, v double", (moment(0), 1.0), (moment(1), 2.0)))
    with pytest.raises(QueryError):
        e.query("from t | fields v | compare previous 1h")


def test_shortcuts(spark, e):
    from tidelog import shortcuts

    e.register("t", table(spark, "_time timestamp, k string", *[(datetime(2026, 2, 10, h), "ab"[h % 2]) for h in range(10)]))
    assert shortcuts.count(e, "t") == 10 and shortcuts.count(e, "t", "k=a") == 5 and shortcuts.count(e, "t", '| where k="b"') == 5
    assert shortcuts.sample(e, "t", 3).collect() == shortcuts.sample(e, "t", 3).collect()
    assert [r["_time"].hour for r in shortcuts.last(e, "t", 2).collect()] == [8, 9]
    assert shortcuts.top(e, "t", "k", 1).first()["count"] == 5
    waits: list = []
    assert [df.count() for df in shortcuts.watch(e, "from t[-24h..] | where k=\"a\"", 3600, waits.append, 2)] == [5, 4] and waits == [3600]


def test_command_line(spark, tmp_path, capsys):
    from tidelog.__main__ import main

    (tmp_path / "x.log").write_text('{"level":"ERROR","n":1}\n{"level":"info","n":2}\n')
    assert main(["| stats sum(n) as s by level | sort level", "--file", str(tmp_path / "x.log"), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "level,s\nERROR,1\ninfo,2\n"
    assert main(["| nonsense here", "--file", str(tmp_path / "x.log")]) == 1
    assert "error:" in capsys.readouterr().err


def test_plans_push_filters_and_columns(spark, sf):
    from tidelog.queries import engine

    plan = engine(spark, sf).explain('from lineitem | where l_returnflag="R" and l_quantity > 10 | stats sum(l_extendedprice) by l_linestatus')
    assert "EqualTo(l_returnflag,R)" in plan and "GreaterThan(l_quantity,10" in plan
    assert "l_comment" not in plan and "l_partkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_alerts_write_all_rows_to_their_table(spark, e, tmp_path):
    from tidelog.streaming.live import Alert, log_channel

    seen = []
    table(spark, "v int", *[(k,) for k in range(250)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    alert = Alert("all", "| where v >= 10", [log_channel(seen)], limit=5, table=str(tmp_path / "out/rows"))
    alert.follow(e, spark.readStream.schema("v int").parquet(str(tmp_path / "in")), str(tmp_path / "out/state"), once=True).awaitTermination()
    assert sorted(r.v for r in spark.read.schema("v int").parquet(str(tmp_path / "out/rows/v*")).collect()) == list(range(10, 250))
    assert len(seen) == 1 and len(seen[0][1]) == 5 and alert.total == 240
