"""SimHash near-duplicates with sharded vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. All pairs at Hamming distance of at most
`radius` are linked, exactly, by a small forest of vantage-point trees. Each tree has a block
of the bits as its metric, and the blocks' search radii are 1 (the last one 0 where that is
enough): if every block differed by more than its radius, the whole would differ by more than
`radius`. Inside a tree the levels hold the distances, over parts of the block, to the parts
of a fixed vantage point. By the triangle inequality a fingerprint only has to look into the
shards whose distances differ from its own by at most the search radius: its own shard, and
for each part the one a step further out (the other side makes the step inwards). Shards are
compared exactly; each returns a spanning forest of its links, never all pairs. Shards with
too many rows are cut into pieces, and every two pieces meet in one task.

Components follow from alternating large-star and small-star steps over the links.

deduplicate() decides by the exact Jaccard similarity of the sets of shingles. Its candidates
come from trees over BLOCKS blocks of 256-bit fingerprints, each of radius 1: two sets with a
similarity of 0.8 differ in 15 % of the bits, so that a block of 16 brings them together with
a probability of 0.28, and sixteen blocks with 0.994 (0.999 from 0.85 on). The number of shards
grows with the documents, their size does not.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows of
equal ids count as one document and share a component; a null id gets the component of its
fingerprint's other documents, or null, and links nothing; an empty table gives an empty
result; other columns are not read. Ids are whole numbers, or text of whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.langid import mix
from tidelog.llm.shared import discard, small_batches, written

SEED = 42
VANTAGE = 0x5BD1E9955BD1E995
#: Rows of a shard above which it is cut into pieces.
SHARD_ROWS = 20_000
#: Rows of a shard at which another part is added to the trees.
FULL = 1024
#: Cells of the comparison matrix made at once.
MATRIX = 1 << 22
#: Pairs whose further bits are compared at once.
PAIRS = 1 << 18
#: Blocks of the wide fingerprints, and the bits of each.
BLOCKS, BLOCK_BITS = 16, 16
#: At a similarity of 0.8, 64 bits differ in 9.7 +- 2.9 and 256 in 39 +- 5.7: a cut beyond 3.5 and 2.7 deviations.
FIRST_RADIUS, WIDE_RADIUS = 20, 54
#: Bits of 64 within which the nearest fingerprints are tried first.
NEAREST_RADIUS = 4
#: Candidates that a node may have in a shard before parities are asked, and their bits.
FEW, PARITY = 16, 1024
#: Nodes up to which their numbers and ids are broadcast, 16 bytes each.
BROADCAST_NODES = 1_000_000

#: A search radius, and the (first bit, bits) of the parts.
Tree = tuple[int, list[tuple[int, int]]]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of `size` words; of all words where there are fewer."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def forest(radius: int, nodes: int) -> list[Tree]:
    """Trees over blocks of 64 bits, one of which brings any two fingerprints within the radius together."""
    count = (radius + 2) // 2
    radii = [1] * count
    if (radius + 1) % 2:
        radii[-1] = 0
    trees, bit = [], 0
    for t, r in enumerate(radii):
        bits = (64 - bit) // (count - t)
        trees.append((r, parts_of(bit, bits, nodes)))
        bit += bits
    return trees


def wide_forest(nodes: int) -> list[Tree]:
    """Trees over blocks of the wide fingerprints, all of radius 1."""
    return [(1, parts_of(k * BLOCK_BITS, BLOCK_BITS, nodes)) for k in range(BLOCKS)]


def parts_of(first: int, bits: int, nodes: int) -> list[tuple[int, int]]:
    """The fewest parts of a block with which a shard of random fingerprints has at most FULL of the nodes."""
    for parts in range(1, bits + 1):
        sizes = [bits * (k + 1) // parts - bits * k // parts for k in range(parts)]
        # of two random fingerprints, the share that lies in one shard
        share = np.prod([sum(math.comb(s, i) ** 2 for i in range(s + 1)) / 4.0**s for s in sizes])
        if share * nodes <= FULL:
            break
    starts = first + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return [(int(a), int(s)) for a, s in zip(starts, sizes)]


def bits_at(words: np.ndarray, first: int, size: int) -> np.ndarray:
    """A run of bits of each row of 64-bit words."""
    word, shift = divmod(first, 64)
    found = words[:, word] >> np.uint64(shift)
    if shift + size > 64:
        found = found | words[:, word + 1] << np.uint64(64 - shift)
    return found & np.uint64((1 << size) - 1)


def shard_rows(words: np.ndarray, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, shard numbers, whether the rows live there) for each tree and step."""
    every = np.arange(len(words))
    off = words ^ np.uint64(VANTAGE)
    for t, (radius, parts) in enumerate(trees):
        place, weight, steps = np.full(len(words), t, np.int64), len(trees), []
        for first, size in parts:
            distance = np.bitwise_count(bits_at(off, first, size)).astype(np.int64)
            place = place + distance * weight
            steps.append((distance < size, weight))
            weight *= size + 1
        yield every, place, True
        for further, w in steps if radius else ():
            yield every[further], place[further] + w, False


class Links:
    """Union of rows by their smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def linked_rows(fp: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """The root of every row of one shard; only pairs with a row that lives there are compared."""
    links, own = Links(len(fp)), np.flatnonzero(home)
    step = max(1, MATRIX // max(1, len(fp)))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, :]) <= radius)
        if len(i):
            links.unite(rows[i], j)
    return links.parent


def nearest_rows(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row that lives here the nearest row before it, and the nearest later one that lives elsewhere: real pairs within the radius."""
    own, every = np.flatnonzero(home), np.arange(len(fp))
    step, left, right = max(1, MATRIX // max(1, len(fp))), [], []
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        distance = np.bitwise_count(fp[rows, None] ^ fp[None, :])
        before = every[None, :] < rows[:, None]
        for allowed in (before, ~before & ~home[None, :]):
            seen = np.where(allowed, distance, 255)
            j = seen.argmin(axis=1)
            near = seen[np.arange(len(rows)), j] <= radius
            left.append(rows[near])
            right.append(j[near])
    return np.concatenate(left) if left else every[:0], np.concatenate(right) if right else every[:0]


def near_rows(words: np.ndarray, sizes: np.ndarray, home: np.ndarray, likeness: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some rows that live here at a time all pairs (row, other) whose sets may be alike, by sizes and wide fingerprints."""
    up, down = likeness
    own = np.flatnonzero(home)
    step = max(1, MATRIX // max(1, len(words)))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        i, j = np.nonzero(np.bitwise_count(words[rows, None, 0] ^ words[None, :, 0]) <= FIRST_RADIUS)
        i = rows[i]
        close = np.zeros(len(i), bool)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            close[k : k + PAIRS] = (a != b) & (small * down >= up * large) & (np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= WIDE_RADIUS)
        yield i[close], j[close]


def sparse_pairs(words: np.ndarray, sizes: np.ndarray, group: np.ndarray, home: np.ndarray, likeness: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different groups of rows with few of them; a row with more is returned with itself, and so is each of its others."""
    left, right, dense = [], [], np.zeros(len(words), bool)
    for i, j in near_rows(words, sizes, home, likeness):
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        many = np.bincount(i, minlength=len(words))[i] > FEW
        dense[i[many]] = dense[j[many]] = True
        left.append(i[~many])
        right.append(j[~many])
    found = np.flatnonzero(dense)
    return np.concatenate([*left, found]), np.concatenate([*right, found])


def parity_pairs(words: np.ndarray, sizes: np.ndarray, group: np.ndarray, parity: np.ndarray, home: np.ndarray, likeness: tuple[int, int], nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of different groups that their parities leave; with `nearest` only the closest earlier one of each row, and the closest later one from elsewhere.

    Each shingle turns one bit of a parity over: two sets differ in at least as many shingles as their parities in bits.
    """
    up, down = likeness
    left, right = [], []
    for i, j in near_rows(words, sizes, home, likeness):
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            odd, both = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1).astype(np.int64), sizes[a] + sizes[b]
            # of the shingles counted in both sets, those of one set alone
            keep = (odd * (up + down) <= (down - up) * both) & (group[a] != group[b])
            a, b, share = a[keep], b[keep], (odd / np.maximum(both, 1))[keep]
            if not nearest:
                left.append(a)
                right.append(b)
                continue
            for chosen in (b < a, (b > a) & ~home[b]):
                order = np.flatnonzero(chosen)
                order = order[np.lexsort((share[order], a[order]))]
                first = order[np.unique(a[order], return_index=True)[1]]
                left.append(a[first])
                right.append(b[first])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def dealt_out(nodes: DataFrame, trees: list[Tree], columns: str) -> DataFrame:
    """Nodes (node, words, ...) once for each shard that they live in or look into: shard, p, q (pieces that meet), home and their columns."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, places, lives in shard_rows(words_of(b.column(1)), trees):
                taken = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.full(len(rows), lives)), *taken.columns], ["shard", "home", *b.schema.names])

    names = [c.split()[0] for c in columns.split(", ")]
    dealt = nodes.select(*names).mapInArrow(deal, f"shard long, home boolean, {columns}")
    # there are at most rows / SHARD_ROWS crowded shards
    crowded = written(dealt.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).select(F.col("shard").alias("full"), F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("cuts")), "crowded")
    found = crowded.count()
    if not found:
        return dealt.select("shard", F.lit(0).alias("p"), F.lit(0).alias("q"), "home", *names)
    cut = dealt.join(F.broadcast(crowded) if found <= 100_000 else crowded, F.col("shard") == F.col("full"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
    cut = cut.select("shard", "home", *names, F.coalesce(own, F.lit(0)).alias("p"), F.explode(other).alias("q"))
    return cut.select("shard", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "home", *names)


def compared(dealt: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct pairs (a, b), b not the larger, of nodes that `compare` finds in a shard.

    `compare` gets a shard's rows by node, their words and whether they live there, and returns places.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node = table.column("node").to_numpy()
        i, j = compare(table, words_of(table.column("words")), table.column("home").to_numpy())
        a, b = node[i], node[j]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return dealt.groupBy("shard", "p", "q").applyInArrow(run, "a long, b long").distinct()


def words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 64-bit words, from binaries of one length, the highest byte of a word first."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), ">u8").astype(np.uint64).reshape(len(held), -1) if held else np.zeros((0, 4), np.uint64)


def near_links(nodes: DataFrame, *, radius: int) -> DataFrame:
    """Links (a, b), b the smaller, that join exactly the nodes (node, words of 64 bits) within the radius."""

    def compare(table: pa.Table, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(words)), linked_rows(words[:, 0], home, radius)

    return compared(dealt_out(nodes, forest(radius, nodes.count()), "node long, words binary"), compare).where("a <> b")


def nearest_pairs(nodes: DataFrame, *, radius: int) -> DataFrame:
    """For each of the nodes (node, words of 256 bits) some nearest ones within the radius of the first 64 bits."""

    def compare(table: pa.Table, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_rows(words[:, 0], home, radius)

    short = nodes.select("node", F.substring("words", 1, 8).alias("words"))
    return compared(dealt_out(short, forest(radius, nodes.count()), "node long, words binary"), compare)


def column_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def candidate_pairs(nodes: DataFrame, trees: list[Tree], *, likeness: tuple[int, int]) -> DataFrame:
    """The pairs of nodes (node, words of 256 bits, n, group) of different groups that may be alike.

    Where a node has more than FEW of them in a shard, they come as (node, node), as do their others.
    """

    def compare(table: pa.Table, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sparse_pairs(words, column_of(table, "n"), column_of(table, "group"), home, likeness)

    return compared(dealt_out(nodes, trees, "node long, words binary, n int, group long"), compare)


def crowded_pairs(dealt: DataFrame, *, likeness: tuple[int, int], nearest: bool) -> DataFrame:
    """The pairs of dealt nodes (node, words, n, group, parity) of different groups that words and parities leave, all or the nearest."""

    def compare(table: pa.Table, words: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parity = words_of(table.column("parity"))
        return parity_pairs(words, column_of(table, "n"), column_of(table, "group"), parity, home, likeness, nearest)

    return compared(dealt, compare)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node), for the nodes of links (a, b)."""
    stars = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("at")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("at")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        older, stars = stars, written(small.where("a <> b").distinct(), "links")
        discard(older)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_groups(docs: DataFrame, *, size: int = 5, radius: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id of every row."""
    prints = written(fingerprints(docs, size=size, key=key, text=text), "fingerprints")
    named = prints.where(F.col(key).isNotNull())
    # rows of equal ids count as one document: each of their fingerprints is linked to the least id
    nodes = written(named.groupBy("fp").agg(F.min(F.col(key).cast("long")).alias("node")).withColumn("words", F.unhex(F.lpad(F.hex("fp"), 16, "0"))), "nodes")
    links = near_links(nodes, radius=radius)
    repeated = named.groupBy(F.col(key).cast("long").alias("id")).agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("id")
    if repeated.limit(1).count():
        same = prints.join(repeated, F.col(key) == F.col("id")).select("id", "fp").join(nodes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
        links = links.unionByName(same)
    labels = components(links)
    grouped = nodes.join(labels, "node", "left").select(F.col("fp").alias("f"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(grouped, F.col("fp") == F.col("f"), "left").select(key, "fp", "component_id")


def grouped_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: four words, four bits."""
    rows = near_groups(docs, size=4, radius=4)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_prints(docs: DataFrame, *, size: int, key: str, text: str) -> DataFrame:
    """key, words (256 bits), d (digest of the set of shingles) and n (its size); each shingle counts once."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, digests, counts = [], [], []
            for t in b.column(1).to_pylist():
                own = np.unique(shingle_hashes(t, size))
                with np.errstate(over="ignore"):
                    seeds = [own, *(mix(own + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in (1, 2, 3))]
                words.append(np.array([majority(x) for x in seeds], ">u8").tobytes())
                digests.append(set_digest(own))
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(digests, pa.int64()), pa.array(counts, pa.int32())], ["key", "words", "d", "n"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, words binary, d long, n int").withColumnRenamed("key", key)


def set_digest(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def shingle_sets(docs: DataFrame, wanted: DataFrame, finish: Callable[[np.ndarray], object], kind: str, *, size: int, key: str, text: str) -> DataFrame:
    """node and `value`, what `finish` makes of its set of shingles, for nodes (node, id): their texts are read again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
            # an id may stand in rows of other texts
            right = [k for k, (d, s) in enumerate(zip(b.column(0).to_pylist(), sets)) if d == set_digest(s)]
            values = pa.array([finish(sets[k]) for k in right], pa.list_(pa.int64()) if kind == "array<long>" else pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(right, pa.int64())), values], ["node", "value"])

    # two longs a row: the documents need no exchange while these fit a broadcast
    held = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(held, "id").select("node", "text")
    return texts.mapInArrow(run, f"node long, value {kind}").dropDuplicates(["node"])


def packed_parity(hashes: np.ndarray) -> bytes:
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, *, likeness: tuple[int, int], **options) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles have the likeness, by comparing the sets."""
    up, down = likeness
    pairs = written(pairs.select("a", "b"), "pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node"), "wanted")
    sets = written(shingle_sets(docs, wanted, lambda s: s.view(np.int64), "array<long>", **options), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("value").alias("s")), sets.select(F.col("node").alias("b"), F.col("value").alias("t"))
    same = F.size(F.array_intersect("s", "t"))
    out = written(pairs.join(left, "a").join(right, "b").where(same * (up + down) >= up * (F.size("s") + F.size("t"))).select("a", "b"), "alike")
    for table in (pairs, wanted, sets):
        discard(table)
    return out


def with_group(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with `group`, the component that the links give them so far."""
    return written(nodes.join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "grouped")


def alike_groups(docs: DataFrame, *, size: int, likeness: tuple[int, int], key: str, text: str) -> DataFrame:
    """key and component_id of every row: components of pairs whose sets of shingles have the likeness (a Jaccard similarity, as a fraction).

    Pairs of nearest fingerprints are checked first, which joins most copies. Then every pair
    of different components that the wide trees bring together is checked. In crowds, where a
    node has many such pairs, parities of the sets decide which of them are worth a check, and
    the nearest come first, so that large groups never make all their pairs.
    """
    prints = written(shingle_prints(docs, size=size, key=key, text=text), "fingerprints")
    named = prints.where(F.col(key).isNotNull())
    nodes = named.groupBy(F.col("d").alias("node")).agg(F.min(F.struct(F.col(key).cast("long").alias("id"), "words", "n")).alias("x"))
    nodes = written(nodes.select("node", "x.*"), "nodes")
    trees = wide_forest(nodes.count())
    options = {"size": size, "key": key, "text": text}
    links = alike(docs, nodes, nearest_pairs(nodes, radius=NEAREST_RADIUS), likeness=likeness, **options)

    grouped = with_group(nodes, links)
    found = written(candidate_pairs(grouped, trees, likeness=likeness), "found")
    links = links.unionByName(alike(docs, nodes, found.where("a <> b"), likeness=likeness, **options))
    crowd = found.where("a = b").select(F.col("a").alias("node"))
    if crowd.limit(1).count():
        crowd = written(nodes.join(crowd, "node"), "crowd")
        parities = shingle_sets(docs, crowd.select("node", "id"), packed_parity, "binary", **options).withColumnRenamed("value", "parity")
        crowd = written(crowd.join(parities, "node"), "crowd")
        # fewer nodes, fewer parts: what a block brings together stays together
        dealt = written(dealt_out(crowd, wide_forest(crowd.count()), "node long, words binary, n int, parity binary"), "dealt")
        for nearest in (True, False):
            pairs = crowded_pairs(dealt.join(with_group(crowd.select("node"), links), "node"), likeness=likeness, nearest=nearest)
            links = links.unionByName(alike(docs, nodes, pairs, likeness=likeness, **options))
    discard(found)
    discard(grouped)

    # rows of equal ids count as one document: their sets are linked to the least of them
    repeated = named.groupBy(F.col(key).cast("long").alias("id")).agg(F.min("d").alias("b"), F.max("d").alias("c")).where("b < c").select("id", "b")
    if repeated.limit(1).count():
        links = links.unionByName(named.join(repeated, F.col(key) == F.col("id")).select(F.col("d").alias("a"), "b"))
    labels = with_group(nodes.select("node", "id"), links)
    least = labels.groupBy("group").agg(F.min("id").alias("component_id"))
    return prints.join(labels.join(least, "group").select(F.col("node").alias("d"), "component_id"), "d", "left").select(key, "component_id")


def deduplicate(docs: DataFrame, *, size: int = 5, likeness: tuple[int, int] = (4, 5), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id. Rows with a null id stay.

    A group is a component of the pairs with a Jaccard similarity of at least `likeness`. Of
    rows with the same id the one with the least text stays (null first), and of those with
    equal texts the first by its other columns as JSON.
    """
    groups = alike_groups(docs, size=size, likeness=likeness, key=key, text=text)
    first = groups.where(F.col(key).cast("long") == F.col("component_id")).select(F.col("component_id").alias("__first")).distinct()
    kept = docs.join(first, F.col(key).cast("long") == F.col("__first"), "left_semi")
    if groups.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        order = F.struct(F.col(text).isNotNull(), F.col(text), F.to_json(row))
        kept = kept.groupBy(F.col(key).alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return kept.unionByName(docs.where(F.col(key).isNull()))
