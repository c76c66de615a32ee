"""Quality rules and cross-document line frequency, in SQL functions only.

Each text is measured on its own (base rules). Then every line is normalised and hashed, and
the different texts of each host that hold it are counted: exact copies of a text count once,
so that copies alone do not make a line frequent. The limit is a share of the host's texts,
but at least `min_docs` (in a small host a line in a few texts is no sign) and at most
`max_docs` (in a large one a line in so many is, however small their share). Lines in more
texts are removed, and a document left with less than `least_kept` of its words is rejected.
Lines are hashed once, into a table that the counts and the verdicts both read.

Defined cases: a null text is an empty one (no words: rejected); a null host is a host of its
own; repeated rows get equal answers, one each; an empty table gives an empty result; other
columns are kept by filter_documents() and not read by measure().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import SPACE, WORD, bind, written

SYMBOLS = "#*$%&|<>"
#: Frequent lines up to which they are broadcast; a row has about 40 bytes.
BROADCAST_LINES = 200_000
#: The limits of a line, and the share of its words that a document must keep.
MIN_DOCS, SHARE, MAX_DOCS = 20, 0.05, 100
LEAST_KEPT = 0.3


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more."""

    def of(w: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def covered(places: Column) -> Column:
            # each window adds its words up to the next window
            steps = F.transform(places, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(bind(windows, twice), covered))

    # F.get of a place before the first or after the last is null
    return bind(words, of)


def line_hash(line: Column) -> Column:
    """Of a normalised line: lower case, runs of white space as one space, runs of digits as 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0")
    return F.xxhash64(F.trim(plain))


def worded_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def hashed_lines(text: Column) -> Column:
    """(h, words) of each line that holds a word."""
    return F.transform(worded_lines(text), lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words")))


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The base measures of every document."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.select("doc_id", *base_columns(F.col("body")))


def base_columns(body: Column) -> list[Column]:
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    counts = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = bind(worded_lines(body), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return [
        counts.alias("counts"),
        without(body, SPACE).cast("long").alias("word_chars"),
        (F.length(body) - without(body, SYMBOLS)).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
    ]


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def line_table(docs: DataFrame, *, key: str, text: str, host: str) -> DataFrame:
    """doc_id, host, d (hash of the text) and the hashed lines of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    return written(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(body).alias("d"), hashed_lines(body).alias("lines")), "lines")


def frequent_lines(rows: DataFrame, *, min_docs: int, share: float, max_docs: int) -> DataFrame:
    """(host, h) of the lines of a host in too many of its different texts, from line_table()."""
    texts = rows.groupBy("host").agg(F.count_distinct("d").alias("texts"))
    lines = rows.select("host", "d", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = lines.groupBy("host", "h").agg(F.count_distinct("d").alias("docs"))
    counted = counted.where(F.col("docs") > min_docs)
    # a host's count meets only the lines over the fixed limit
    limits = texts.select(F.col("host").alias("of"), F.greatest(F.lit(float(min_docs)), F.least(F.lit(float(max_docs)), F.col("texts") * share)).alias("most"))
    return counted.join(limits, F.col("host").eqNullSafe(F.col("of"))).where("docs > most").select("host", "h")


def judge(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS, least_kept: float = LEAST_KEPT, keep_rows: bool = False
) -> DataFrame:
    """Measures and verdict of every document; with keep_rows as a struct `row` of its columns, and `removed`, hashes of lines to remove."""
    table = line_table(docs, key=key, text=text, host=host)
    frequent = written(frequent_lines(table, min_docs=min_docs, share=share, max_docs=max_docs), "frequent")
    few = frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    source = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    rows = docs.select(*source, F.col(key).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("d", F.xxhash64("body"))
    # the lines that are hit, once for each document of the same id, host and text
    found = table.select("doc_id", "host", "d", F.posexplode("lines").alias("at", "x")).select("doc_id", "host", "d", "at", "x.h", "x.words")
    limits = frequent.select(F.col("host").alias("of"), F.col("h").alias("line"))
    hits = found.join(F.broadcast(limits) if few else limits, (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("of")))
    hits = hits.select(F.col("doc_id").alias("k"), F.col("host").alias("of"), F.col("d").alias("e"), "at", "h", "words").distinct()
    hits = hits.groupBy("k", "of", "e").agg(F.collect_set("h").alias("removed"), F.sum("words").alias("lost"))
    measured = rows.select(*(["row"] if keep_rows else []), "doc_id", "host", "d", *base_columns(F.col("body")))
    joined = measured.join(hits, (F.col("d") == F.col("e")) & F.col("doc_id").eqNullSafe(F.col("k")) & F.col("host").eqNullSafe(F.col("of")), "left")
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    out = joined.select(
        *(["row", removed.alias("removed")] if keep_rows else []),
        "doc_id", "counts.n_words", "word_chars", "n_symbols", "n_dup_lines", "counts.n_repeat_words",
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_removed_words"),
    )
    out = out.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= least_kept * F.col("n_words")))


def filter_documents(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that are kept, without their frequent lines."""
    judged = judge(docs, text=text, keep_rows=True, **options).where("kept")
    body = F.col("row").getField(text)
    cleaned = F.array_join(F.filter(F.split(body, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("removed"), line_hash(x)))), "\n")
    judged = judged.withColumn("__text", F.when(F.size("removed") == 0, body).otherwise(cleaned))
    fields = [F.col("__text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return judged.select(*fields)


VERDICT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def oracle(min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS, least_kept: float = LEAST_KEPT) -> str:
    """DuckDB SQL of judge() with these parameters."""
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, regexp_extract_all(body, '{WORD}') AS words, body, source FROM d),
x AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) t(o) GROUP BY doc_id),
l AS (SELECT doc_id, source, body, unnest(string_split(body, chr(10))) AS line FROM d),
lw AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '{space}', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm, len(regexp_extract_all(line, '{WORD}')) AS words FROM l WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT body) AS texts FROM d GROUP BY source),
freq AS (SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT body) AS docs FROM lw GROUP BY source, norm) f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.docs > greatest({float(min_docs)}, least({float(max_docs)}, h.texts * {share}))),
lost AS (SELECT lw.doc_id, sum(lw.words) AS n FROM lw JOIN freq ON lw.norm = freq.norm AND lw.source IS NOT DISTINCT FROM freq.source GROUP BY lw.doc_id),
m AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_words, length(regexp_replace(w.body, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(w.body) - length(regexp_replace(w.body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND n_words - n_removed_words >= {least_kept} * n_words) AS kept, n_removed_words FROM b
"""
