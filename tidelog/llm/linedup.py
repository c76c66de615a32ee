"""Line dedup by distributed prefix doubling over line-ID sequences.

The corpus is one sequence of line IDs, document after document in ascending order of id;
lines without a word are left out. Prefix doubling names the runs of 1, 2, 4, ... lines that
begin at each position: equal runs get the same name. The positions of one name at length 2^k
are an interval of the suffix array whose longest common prefix is at least 2^k lines. The
name is the first position of the interval, which is all that a decision needs; sorting the
intervals among themselves would change nothing, so no global sort is done. Positions whose
run occurs once leave after each step, and so do runs that no window needs.

A repeated run counts when it has `min_words` words. Smallest windows are runs of whole lines
that would have fewer without their last line, or without their first; every maximal repeated
run that counts is the union of the smallest windows in it. Windows of any length follow from two overlapping names of the largest power of
two in them. All windows that have an earlier equal one are deleted.

Defined cases: null and empty texts have no lines; rows with a null id stay as they are;
rows of equal ids stand at the same positions, so equal lines there do not delete each other; of equal runs the
first by (id, line) stays, also within a document; blank lines stay unless all other lines
go, when the text becomes empty. Ids must be below 2^38 and not negative, a document may have
2^25 lines. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import small_batches, written

LINE_BITS = 25
ID_LIMIT = 1 << 38
#: The seed of Spark's xxhash64.
MARK_SEED = 42


def line_words(text: str) -> tuple[list[str], np.ndarray]:
    """The lines that hold a word, and their numbers of words (split at space and U+0009 to U+000D)."""
    lines, counts = [], []
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "replace").split())
        if n:
            lines.append(line)
            counts.append(n)
    return lines, np.array(counts, np.int64)


def smallest_windows(words: np.ndarray, least: int) -> np.ndarray:
    """(first line, lines) of all runs with `least` words that lose them with their last line, or with their first."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    starts, stops = np.arange(n), np.searchsorted(sums, sums[:-1] + least)
    ends, begins = np.arange(1, n + 1), np.searchsorted(sums, sums[1:] - least, side="right") - 1
    forward, backward = stops <= n, begins >= 0
    pairs = np.concatenate([np.stack([starts, stops - starts], 1)[forward], np.stack([begins, ends - begins], 1)[backward]])
    return np.unique(pairs, axis=0)


def positions(docs: DataFrame, *, key: str, text: str, min_words: int) -> DataFrame:
    """pos, mark (hash of the text, for rows of equal ids), ida, idb (128-bit line ID), words, needs (lengths of the smallest windows from here)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            pos, mark, ids, words, lengths, counts_of = [], [], [], [], [], []
            for key_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines, counts = line_words(t)
                if not 0 <= key_ < ID_LIMIT or len(lines) >> LINE_BITS:
                    raise ValueError(f"document {key_}: ids must be in [0, 2^38), lines below 2^25")
                pos.append((key_ << LINE_BITS) + np.arange(len(lines), dtype=np.int64))
                mark.append(np.full(len(lines), xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), MARK_SEED), np.uint64).view(np.int64))
                ids.extend(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in lines)
                words.append(counts)
                windows = smallest_windows(counts, min_words)
                lengths.append(windows[:, 1])
                counts_of.append(np.bincount(windows[:, 0], minlength=len(lines)))
            pair = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
            columns = [np.concatenate(pos), np.concatenate(mark), pair[:, 0], pair[:, 1], np.concatenate(words)] if pos else [np.zeros(0, np.int64)] * 5
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts_of))]) if pos else np.zeros(1, np.int64)
            needs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lengths) if pos else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], needs], ["pos", "mark", "ida", "idb", "words", "needs"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    return rows.mapInArrow(run, "pos long, mark long, ida long, idb long, words long, needs array<long>")


def named(runs: DataFrame, *by: str) -> DataFrame:
    """Runs that occur more than once, with `name`: the first position of the same values in `by`."""
    # partial aggregation leaves one row a task of a hot line; once the names are a table of their own,
    # the join back has nothing but exchanges below it and Spark may split its skewed partitions
    firsts = runs.groupBy(*[F.col(c).alias(f"{c}_of") for c in by]).agg(F.min("pos").alias("name"), F.max("pos").alias("last")).where("last > name").drop("last")
    firsts = written(firsts, "names")
    same = [F.col(c) == F.col(f"{c}_of") for c in by]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return runs.join(firsts, condition).drop(*[f"{c}_of" for c in by])


def later_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(doc, mark, line, need): windows of `need` lines that an earlier position holds as well."""
    lines = written(positions(docs, key=key, text=text, min_words=min_words), "lines")
    runs = written(named(lines, "ida", "idb").select("pos", "mark", "name", "needs", F.col("words").alias("sum"), F.col("words").alias("first"), F.col("words").alias("last")), "runs")
    length, found = 1, []
    while True:
        exact = runs.where(F.array_contains("needs", F.lit(length).cast("long")) & (F.col("name") < F.col("pos"))).select("pos", "mark", F.lit(length).cast("long").alias("need"))
        found.append(exact)
        second = runs.select(F.col("pos").alias("pos2"), F.col("mark").alias("mark2"), F.col("name").alias("name2"), F.col("sum").alias("sum2"), F.col("last").alias("last2"))
        # windows between this length and the next: two overlapping runs
        if length > 1:
            between = runs.select("pos", "mark", "name", F.explode(F.filter("needs", lambda n: (n > length) & (n < 2 * length))).alias("need"))
            pairs = between.join(second, (F.col("pos") + F.col("need") - length == F.col("pos2")) & (F.col("mark") == F.col("mark2"))).select("pos", "mark", "need", F.col("name").alias("name1"), "name2")
            pairs = written(pairs, "pairs")
            found.append(named(pairs, "name1", "name2", "need").where("name < pos").select("pos", "mark", "need"))
        # a part of a window has fewer than min_words words without its last line, or without its first
        doubled = runs.join(second, (F.col("pos") + length == F.col("pos2")) & (F.col("mark") == F.col("mark2")))
        doubled = doubled.where((F.shiftright("pos", LINE_BITS) == F.shiftright("pos2", LINE_BITS)) & (F.col("sum") + F.col("sum2") - F.greatest("first", "last2") < min_words))
        doubled = doubled.select("pos", "mark", F.col("name").alias("name1"), "name2", "needs", (F.col("sum") + F.col("sum2")).alias("sum"), "first", F.col("last2").alias("last"))
        doubled = written(doubled, "doubled")
        runs = written(named(doubled, "name1", "name2").select("pos", "mark", "name", "needs", "sum", "first", "last"), "runs")
        length *= 2
        if not runs.limit(1).count():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.shiftright("pos", LINE_BITS).alias("doc"), "mark", F.col("pos").bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("line"), F.col("need").cast("int").alias("need"))


def repeated_runs(windows: DataFrame) -> DataFrame:
    """doc, mark, windows: the later copies as sorted (line, stop) over the lines with a word."""
    return windows.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("line", (F.col("line") + F.col("need")).alias("stop")))).alias("windows"))


def cut(text: str, windows: list[tuple[int, int]]) -> tuple[str, int, list[int]]:
    """The text without the lines in the windows, how many lines with a word it had, and the lengths of the maximal runs."""
    lines = text.split("\n")
    worded = [bool(x.encode("utf-8", "replace").split()) for x in lines]
    total, runs, end = sum(worded), [], -1
    for start, stop in windows:
        if start > end:
            runs.append([start, stop])
        else:
            runs[-1][1] = max(runs[-1][1], stop)
        end = runs[-1][1]
    gone = np.zeros(total + 1, bool)
    for start, stop in runs:
        gone[start:stop] = True
    if total and gone[:total].all():
        return "", total, [b - a for a, b in runs]
    kept, at = [], 0
    for line, has_words in zip(lines, worded):
        if not (has_words and gone[at]):
            kept.append(line)
        at += has_words
    return "\n".join(kept), total, [b - a for a, b in runs]


REPORT = "kept_text string, n_lines long, n_removed long, n_runs long, longest_run long"


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """A struct `row` of each document's columns, its kept text, and what was removed."""
    found = repeated_runs(later_windows(docs, key=key, text=text, min_words=min_words))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (F.col("row").getField(key).cast("long") == F.col("doc")) & (F.xxhash64(F.col("row").getField(text)) == F.col("mark"))
    joined = rows.join(found, same, "left").select("row", "windows")
    return joined.withColumn("report", reported(F.col("row").getField(text), F.col("windows")))


def reported(text, windows):
    @F.pandas_udf(REPORT)
    def run(texts, found):  # noqa: ANN001
        import pandas as pd

        out = []
        for t, w in zip(texts, found):
            kept, total, runs = cut(t, [(x["line"], x["stop"]) for x in w] if w is not None else []) if t is not None else (None, 0, [])
            out.append((kept, total, sum(runs), len(runs), max(runs, default=0)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_removed", "n_runs", "longest_run"])

    return run(text, windows)


def summary(docs: DataFrame, **options) -> DataFrame:
    rows = deduplicated(docs, **options)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "report.n_lines", "report.n_removed", "report.n_runs", "report.longest_run", F.sha2(F.coalesce("report.kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def filter_documents(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents' columns with the kept text; documents of which nothing is left go."""
    rows = deduplicated(docs, text=text, **options).where((F.col("report.n_removed") == 0) | (F.col("report.n_removed") < F.col("report.n_lines")))
    return rows.select(*[F.col("report.kept_text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle(min_words: int = 50) -> str:
    """DuckDB SQL of summary() with these parameters: every window compared as text."""
    return f"""
WITH l AS (SELECT doc_id, n, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l WHERE words > 0),
d AS (SELECT doc_id, list(line ORDER BY i) AS lines FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id, a.i, b.i AS j FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= {min_words}),
w AS (SELECT doc_id, i, min(j) AS j FROM o GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM o GROUP BY doc_id, j),
t AS (SELECT w.*, array_to_string(d.lines[i + 1 : j + 1], chr(10)) AS body FROM w JOIN d USING (doc_id)),
f AS (SELECT *, min(doc_id * 33554432 + i) OVER (PARTITION BY body) AS first FROM t),
x AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE doc_id * 33554432 + i > first),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM x),
starts AS (SELECT doc_id, min(i) AS i, max(j) AS j FROM (
  SELECT doc_id, i, j, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, j) AS grp FROM (
    SELECT doc_id, i, j, CASE WHEN i > max(j + 1) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY doc_id ORDER BY i, j) = 1 THEN 1 ELSE 0 END AS fresh
    FROM f WHERE doc_id * 33554432 + i > first)) GROUP BY doc_id, grp),
r AS (SELECT doc_id, count(*) AS n_runs, max(j + 1 - i) AS longest_run FROM starts GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_removed FROM x GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id),
al AS (SELECT l.doc_id, l.n, l.line, s.i FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.n = s.n),
k AS (SELECT al.doc_id, string_agg(al.line, chr(10) ORDER BY al.n) FILTER (WHERE x.i IS NULL) AS kept FROM al LEFT JOIN x ON al.doc_id = x.doc_id AND al.i = x.i GROUP BY al.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(longest_run, 0)::BIGINT AS longest_run,
  sha256(CASE WHEN n_removed = n_lines THEN '' ELSE coalesce(kept, '') END) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
