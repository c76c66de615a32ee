"""Document fingerprints as Merkle trees, in SQL functions only.

A text is cut into sections (ended by an empty line), those into paragraphs (ended by a line
feed), and those into phrases, each with its ending, so that the cut loses nothing. A phrase
ends after a word whose hash is a multiple of PHRASE: its content alone says where, and an
inserted word moves no cut but its own. The leaves are SHA-256 of the phrases, a paragraph's
hash is that of its leaves, a section's that of its paragraphs' hashes, the root's that of its
sections'. Equal roots mean equal texts; where roots differ, the first differing section and
paragraph place the edit. The likeness of two fingerprints follows from their leaves, shown as
the first eight digits: twice the common ones by the leaves of both. Branches with equal
hashes have equal leaves, so this is the sum over all branches.

Fingerprint text: root ":" sections joined by "|", paragraphs by "/", leaves by ".".

Defined cases: a null text is an empty one (no sections; two such fingerprints are alike: 1);
null ids come first in the order of documents; rows of equal ids are ordered by a hash of
their text, and repeated rows follow each other; a table of one row is followed by itself.
Ids may be numbers or texts. Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.shared import bind, hash_fraction

#: Words in a phrase, on average.
PHRASE = 6
#: A word with the white space before it; letters of scripts without spaces stand alone, long runs are cut.
ALONE = r"\x{0E00}-\x{0E7F}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}"
TOKEN = rf"\s*+(?:[{ALONE}]|[^\s{ALONE}]{{1,64}}+)|\s+"
#: Documents in one range of ids, and ranges in one group of the two-level search.
RANGE_ROWS, GROUP = 512, 256
#: Ranges at most; with more rows each gets more. Ids sampled for each range where they are no numbers.
MOST_RANGES, SAMPLED = 50_000, 8


def filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def phrases(text: Column) -> Column:
    """The phrases of a paragraph, in order."""

    def cut(tokens: Column) -> Column:
        numbered = F.transform(tokens, lambda x, i: F.when(F.pmod(F.xxhash64(F.trim(x)), F.lit(PHRASE)) == 0, i + 1))
        ends = F.filter(numbered, lambda e, i: e.isNotNull() | (i == F.size(tokens) - 1))

        def between(stops: Column) -> Column:
            # the last phrase ends with the paragraph
            stop = lambda k: F.coalesce(F.get(stops, k), F.size(tokens))
            start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(stops, k - 1))
            return F.transform(stops, lambda e, k: F.array_join(F.slice(tokens, start(k) + 1, stop(k) - start(k)), ""))

        return bind(ends, between)

    return bind(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), cut)


def tree(text: Column) -> Column:
    """Sections of paragraphs of (hash, leaves)."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(phrases(p), lambda x: F.sha2(x, 256))
        return bind(leaves, lambda x: F.struct(F.sha2(F.array_join(x, ""), 256).alias("hash"), F.transform(x, lambda h: F.substring(h, 1, 8)).alias("leaves")))

    return F.transform(filled(F.split(text, r"(?<=\n\n)")), lambda section: F.transform(filled(F.split(section, r"(?<=\n)")), paragraph))


def section_hashes(t: Column) -> Column:
    return F.transform(t, lambda section: F.sha2(F.array_join(F.transform(section, lambda p: p["hash"]), ""), 256))


def fingerprint(text: Column) -> Column:
    """A struct: fingerprint (text), paragraphs (hashes in order), leaves (all digests)."""

    def made(t: Column) -> Column:
        root = F.sha2(F.array_join(section_hashes(t), ""), 256)
        shown = F.array_join(F.transform(t, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p["leaves"], ".")), "/")), "|")
        paragraphs = F.flatten(t)
        return F.struct(
            F.concat(root, F.lit(":"), shown).alias("fingerprint"),
            F.transform(paragraphs, lambda p: p["hash"]).alias("paragraphs"),
            F.flatten(F.transform(paragraphs, lambda p: p["leaves"])).alias("leaves"),
        )

    return bind(tree(text), made)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of leaves, 0 to 1."""

    def of(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        total = F.size(x["a"]) + F.size(x["b"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / F.greatest(total, F.lit(1)))

    return bind(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), of)


def first_difference(a: Column, b: Column) -> Column:
    """Number, from 1, of the first paragraph that differs (null: none)."""
    longest = F.greatest(F.size(a), F.size(b))
    steps = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(steps, lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1))), F.lit(0)).cast("long")


def ranges(docs: DataFrame, key: str) -> tuple[list, object, bool]:
    """Ids that begin the ranges after the first, the least id, whether there are null ids. Reads the ids alone."""
    seen = docs.select(F.col(key).alias("k"))
    n, least, nulls = seen.agg(F.count(F.lit(1)), F.min("k"), F.count(F.when(F.col("k").isNull(), 1))).first()
    count = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if count < 2 or least is None:
        return [], least, nulls > 0
    if isinstance(docs.schema[key].dataType, T.IntegralType):
        shares = [k / count for k in range(1, count)]
        found = seen.agg(F.percentile_approx("k", shares, 20 * count)).first()[0]
    else:
        # at most about SAMPLED * MOST_RANGES ids
        rate = min(1.0, SAMPLED * count / n)
        sample = sorted(r[0] for r in seen.where(F.col("k").isNotNull() & (hash_fraction(F.col("k").cast("string")) < rate)).collect())
        found = [sample[len(sample) * k // count] for k in range(1, count)] if sample else []
    return sorted({x for x in found if x > least}), least, nulls > 0


def constants(values: list, kind: str) -> Column:
    """An array that the optimiser folds to one literal, however long it is."""
    return F.from_json(F.lit(json.dumps([str(x) for x in values])), "array<string>").cast(f"array<{kind}>")


def range_of(key: Column, bounds: list, kind: str) -> Column:
    """How many bounds are at or below the key, by a search in two levels."""
    if not bounds:
        return F.lit(0)
    group = F.size(F.filter(constants(bounds[::GROUP], kind), lambda x: x <= key))
    within = lambda g: F.slice(constants(bounds, kind), (g - 1) * GROUP + 1, F.lit(GROUP))
    place = bind(group, lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * GROUP + F.size(F.filter(within(g), lambda x: x <= key))))
    return F.coalesce(place, F.lit(0))


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """Rows of ranges of ids: key, body, next_body, own (false: first row of the next range, shown again here)."""
    bounds, least, nulls = ranges(docs, key)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    rows = rows.withColumn("range", range_of(F.col("key"), bounds, kind))
    begins = F.lit(False)
    if bounds:
        begins = F.coalesce((F.col("range") > 0) & (F.get(constants(bounds, kind), F.col("range") - 1) == F.col("key")), F.lit(False))
    first = F.col("key").isNull() if nulls else F.coalesce(F.col("key") == F.lit(least), F.lit(False))

    def place(range_: Column, turn: int) -> Column:
        return F.struct(range_.cast("int").alias("range"), F.lit(turn).alias("turn"))

    nowhere = F.lit(None).cast("struct<range:int,turn:int>")
    places = F.array(place(F.col("range"), 0), F.when(begins, place(F.col("range") - 1, 1)).otherwise(nowhere), F.when(first, place(F.lit(len(bounds)), 2)).otherwise(nowhere))
    rows = rows.select("key", "body", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("at")).select("key", "body", "at.range", "at.turn")
    order = Window.partitionBy("range").orderBy("turn", F.col("key").asc_nulls_first(), F.xxhash64("body"))
    return rows.withColumn("next_body", F.lead("body").over(order)), order


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its half-replaced form, and their likeness."""
    rows, order = with_next(docs)
    size = F.length("body")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), size - half), F.substring(F.coalesce("next_body", F.lit("")), F.lit(1), half))
    rows = rows.select("key", "range", "turn", F.xxhash64("body").alias("tie"), size.cast("long").alias("n_chars"), fingerprint(F.col("body")).alias("own"), F.when(F.col("turn") == 0, edited).alias("edited"))
    rows = rows.withColumn("after", F.lead("own.leaves").over(Window.partitionBy("range").orderBy("turn", F.col("key").asc_nulls_first(), "tie")))
    rows = rows.where("turn = 0").select("key", "n_chars", "own", "after", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("other"))
    return rows.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("own.fingerprint").alias("fingerprint"),
        F.col("other.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("own.leaves"), F.col("other.leaves")).alias("near_edited"),
        likeness(F.col("own.leaves"), F.col("after")).alias("near_next"),
        first_difference(F.col("own.paragraphs"), F.col("other.paragraphs")).alias("first_edit"),
    )
