"""Secret scans with multipart credential linking, in SQL functions only.

Base spans are found by pattern alone. Weak parts (short assigned values, long mixed tokens,
account identifiers, endpoints) mean little on their own; a part is reported only when parts
that complement it lie in its scope, which are the `scope` code points before and after it:
a weak secret needs an identifier or an endpoint, an identifier a secret, an endpoint both.

The interval join runs inside the row: parts sorted by start get the furthest end of each
class before them and the nearest start after them, so that no pair is ever formed and no
document leaves its partition.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned one by
one; spans of equal start stand in the order of KINDS; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import bind

#: The base patterns, as the contract gives them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs that are too short never hide a longer one, so the least length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts.
TOKEN = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}"
IDENTIFIER = r"""(?i:client_?id|key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?i:https?|ssh|ftps?|mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"""

#: The order of kinds at equal starts: base, then weak.
KINDS = ("assign", "access", "hex", "key", "id", "endpoint")
LEAST_VALUE = 12
WEAK_VALUE = 6
CHUNK = 64
FAR = 1 << 30


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold of those before it; chunks keep the work near n * CHUNK."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.lit(zero), op)

    def within(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))

        def carried(sums: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda c: fold(F.slice(sums, F.lit(1), c)))
            return bind(
                before,
                lambda p: F.transform(
                    F.sequence(F.lit(0), F.size(v) - 1),
                    lambda i: op(F.get(p, F.floor(i / CHUNK).cast("int")), fold(F.slice(v, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK))),
                ),
            )

        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(bind(chunks, carried))

    return bind(values, within)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """start, stop (code points, end exclusive) and length of a group, of all leftmost matches that do not overlap."""
    # each match begins where the last one ended: the text between them is captured as well
    stepping = F.lit(rf"(?s)\G(.*?)({pattern})")
    gaps, matches = F.regexp_extract_all(text, stepping, F.lit(1)), F.regexp_extract_all(text, stepping, F.lit(2))
    values = F.regexp_extract_all(text, stepping, F.lit(group + 2)) if group else matches
    lengths = F.transform(F.arrays_zip(gaps.alias("g"), matches.alias("m"), values.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v")))

    def placed(n: Column) -> Column:
        before = running(F.transform(n, lambda x: x["g"] + x["m"]), 0, lambda a, b: a + b)
        return F.zip_with(n, before, lambda x, b: F.struct((b + x["g"]).alias("start"), (b + x["g"] + x["m"]).alias("stop"), x["v"].alias("value")))

    nothing = F.array().cast("array<struct<start:int,stop:int,value:int>>")
    return F.when(text.rlike(pattern), bind(lengths, placed)).otherwise(nothing)


def labelled(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop")))


def written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["stop"])), ",")


def linked(parts: Column, scope: int) -> Column:
    """The weak ones among sorted parts that have complementary parts in their scope."""
    secret, identifier, endpoint = (0, 3), (1, 4), (5,)

    def near(p: Column, ranks: tuple[int, ...]) -> Column:
        ends = F.transform(p, lambda x: F.when(x["rank"].isin(*ranks), x["stop"]).otherwise(F.lit(-FAR)))
        starts = F.transform(F.reverse(p), lambda x: F.when(x["rank"].isin(*ranks), x["start"]).otherwise(F.lit(FAR)))
        before = running(ends, -FAR, lambda a, b: F.greatest(a, b))
        after = F.reverse(running(starts, FAR, lambda a, b: F.least(a, b)))
        close = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
        return F.zip_with(p, close, lambda x, c: (x["start"] - c["b"] <= scope) | (c["a"] - x["stop"] <= scope))

    def kept(p: Column) -> Column:
        flags = F.arrays_zip(p.alias("p"), near(p, secret).alias("s"), near(p, identifier).alias("i"), near(p, endpoint).alias("e"))
        wanted = F.filter(
            flags,
            lambda x: ((x["p"]["rank"] == 3) & (x["i"] | x["e"])) | ((x["p"]["rank"] == 4) & x["s"]) | ((x["p"]["rank"] == 5) & x["s"] & x["i"]),
        )
        return F.transform(wanted, lambda x: x["p"])

    return bind(parts, kept)


def scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", scope: int = 400) -> DataFrame:
    """key, n_assign, n_access, n_hex, n_weak, and `base` and `spans`: arrays of (start, rank in KINDS, stop)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("body"))
    rows = rows.select(
        "key",
        found(F.col("body"), ASSIGN, 1).alias("assigned"),
        labelled(found(F.col("body"), ACCESS), "access").alias("access"),
        labelled(found(F.col("body"), HEX), "hex").alias("hex"),
        labelled(found(F.col("body"), TOKEN), "key").alias("token"),
        labelled(found(F.col("body"), IDENTIFIER), "id").alias("identifier"),
        labelled(found(F.col("body"), ENDPOINT), "endpoint").alias("endpoint"),
    )
    rows = rows.select(
        "key",
        labelled(F.filter("assigned", lambda x: x["value"] >= LEAST_VALUE), "assign").alias("assign"),
        "access",
        "hex",
        F.concat(labelled(F.filter("assigned", lambda x: (x["value"] < LEAST_VALUE) & (x["value"] >= WEAK_VALUE)), "key"), "token", "identifier", "endpoint").alias("weak"),
    )
    rows = rows.select("key", "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "weak")
    reported = F.when(F.size("weak") > 0, linked(F.array_sort(F.concat("assign", "access", "weak")), scope)).otherwise(F.filter("weak", lambda x: F.lit(False)))
    rows = rows.select("key", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), "base", reported.alias("reported"))
    return rows.select(
        F.col("key").alias(key), "n_assign", "n_access", "n_hex", F.size("reported").cast("long").alias("n_weak"), "base", F.array_sort(F.concat("base", "reported")).alias("spans")
    )


def digest(docs: DataFrame, **options) -> DataFrame:
    rows = scan(docs, **options)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), "n_weak")
