"""Mixing sources to target weights by Poisson replication, in SQL functions only.

A source of n documents with weight w in a mixture of T documents needs w * T / n copies of
each of its documents. Every document gets a Poisson count of that mean, from the inverse of
the distribution at a number in [0, 1) that a hash of its id and the seed gives: the same
document gets the same count wherever it is computed. A mean over STEP is the sum of several
draws. Documents are exploded by their counts and dealt out by a hash of id and copy.

Defined cases: a null source is a source of its own; weights of sources that are absent are
ignored, sources without a weight in a given mapping get none; a null id hashes as the word
null; repeated rows get equal counts, each for itself; an empty table gives an empty result.
All columns of the documents are kept; `copy` and `shuffle_key` are added, and replace columns
of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import bind

#: The largest mean of one draw: exp of its negative is far from underflow.
STEP = 32.0
#: Sources up to which their rates are broadcast; a row is some tens of bytes.
BROADCAST_SOURCES = 10_000
SALTS = 32


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(rate: Column, seed: int, key: Column) -> Column:
    """The inverse of Poisson's distribution at a hash of the key."""

    def draw(mean: Column, u: Column) -> Column:
        # beyond these terms the distribution is 1 in double precision
        terms = F.sequence(F.lit(1), (mean + 12 * F.sqrt(mean) + 20).cast("int"))
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))
        step = F.aggregate(
            terms,
            start,
            lambda a, k: F.struct(
                (a["p"] * mean / k).alias("p"),
                (a["cdf"] + a["p"] * mean / k).alias("cdf"),
                (a["n"] + F.when(u >= a["cdf"], 1).otherwise(0)).alias("n"),
            ),
            lambda a: a["n"],
        )
        return step

    def drawn(r: Column) -> Column:
        parts = F.ceil(r / STEP).cast("int")
        return F.when(r > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, j: a + bind(F.struct((r / parts).alias("m"), uniform(seed, key, j).alias("u")), lambda x: draw(x["m"], x["u"])))).otherwise(F.lit(0))

    return bind(rate, drawn)


def rates(docs: DataFrame, *, source: str, weights: Mapping[str | None, float] | None, alpha: float, total: float | None) -> DataFrame:
    """source, rate: mean copies of each document. Without weights a source of n documents weighs n ** alpha."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    size = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    # one row of sums
    joined = counts.crossJoin(F.broadcast(sums))
    return joined.select("source", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * size / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """Every document as often as its source's rate and its hash say, in a global shuffle."""
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    by_source = rates(docs, source=source, weights=weights, alpha=alpha, total=total)
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    own = F.col("__row").getField(source)
    if few:
        # the number of sources is checked
        joined = left.join(F.broadcast(by_source), own.eqNullSafe(F.col("source")))
    else:
        # a source may hold a third of all rows: its documents meet copies of its rate under many salts
        salt = F.pmod(F.xxhash64(F.col("__row").getField(key)), F.lit(SALTS)).cast("int")
        spread = by_source.select("source", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = left.withColumn("__salt", salt).join(spread, own.eqNullSafe(F.col("source")) & (F.col("__salt") == F.col("salt")))
    ident = F.col("__row").getField(key)
    copies = poisson_count(F.col("rate"), seed, ident)
    counted = joined.select("__row", copies.alias("copies")).where("copies > 0")
    exploded = counted.select("__row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("deal"), F.coalesce(F.col("__row").getField(key).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    keyed = exploded.withColumn("shuffle_key", dealt)
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("__row.*", "copy", "shuffle_key")


def oracle(alpha: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL of mix() with these parameters and no others."""
    return f"""
WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {alpha}) / (SELECT sum(pow(n, {alpha})) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
d AS (SELECT d.*, r.rate, ceil(r.rate / {STEP})::BIGINT AS parts FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
j AS (SELECT DISTINCT doc_id, rate / parts AS m, unnest(range(1, parts + 1)) AS j FROM d),
u AS (SELECT doc_id, j, m, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM j),
k AS (SELECT doc_id, j, u, m, unnest(range(0, (m + 12 * sqrt(m) + 20)::BIGINT)) AS k FROM u),
c AS (SELECT doc_id, j, u, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY doc_id, j ORDER BY k) AS cdf FROM k),
copies AS (SELECT doc_id, count(*) FILTER (WHERE u >= cdf) AS copies FROM c GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, x.copy::INTEGER AS copy, md5('{seed}:deal:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || x.copy) AS shuffle_key
FROM d JOIN copies USING (doc_id), LATERAL (SELECT unnest(range(0, copies)) AS copy) x
"""
