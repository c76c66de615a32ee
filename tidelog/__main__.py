"""python -m tidelog QUERY --file PATH [--format table]: a query over files, or over piped lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidelog.engine import Engine
from tidelog.lang.tokens import QueryError
from tidelog.sources.readers import file_source, from_lines
from tidelog.sources.sinks import FORMATS, render


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    parser.add_argument("query")
    parser.add_argument("--file", help="a path or glob; without it lines are read from standard input")
    parser.add_argument("--input-format", help="json, logfmt, combined, syslog, csv, tsv, plain; found out if not given")
    parser.add_argument("--format", choices=FORMATS, default="table")
    parser.add_argument("--explain", action="store_true", help="show the plan and run nothing")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rows = file_source(spark, options.file, options.input_format) if options.file else from_lines(spark, sys.stdin)
    engine = Engine(spark).register("main", rows)
    try:
        print(engine.explain(options.query) if options.explain else render(engine.query(options.query), options.format))
    except QueryError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
