"""Token ids in files of canonical length-limited Huffman codes.

Documents are dealt out by ranges of doc_id, tokenised once, and kept as blocks of whole
documents. The counts of all ids give code lengths of at most LIMIT bits (package-merge);
canonical codes follow from the lengths alone. Each block is coded on its own, with the bit
offset of every CHECKPOINT-th id, so that its segments can be decoded side by side, each
step of all segments at once, through one table of 2^LIMIT entries.

File format, under one folder:
- `codebook/`: Parquet of (id, length). Codes are numbered by (length, id).
- `blocks/`: Parquet of one row a block: part, start (ids of the part before it), doc_ids and
  lengths (of its documents, in order), n_ids, checkpoints (little-endian unsigned 64-bit bit
  offsets), payload (codes, most significant bit first). Rows ascend by (part, start), and so
  do doc_ids.

Defined cases: a null text is an empty one, which still has its end id; null ids come first;
rows of equal ids are ordered by text, and repeated rows all stay; an empty table gives no
blocks and an empty result. A text longer than a block makes a block of its own. Other columns
are not read.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import removed, shared_dir, small_batches

LIMIT = 18
CHECKPOINT = 256
#: Ids after which a block is closed.
BLOCK = 1 << 17
#: Bytes of texts that are tokenised together.
TEXTS = 1 << 22

BLOCKS = "part int, start long, doc_ids array<{kind}>, lengths array<long>, n_ids long, ids binary"
CODED = "part int, start long, doc_ids array<{kind}>, lengths array<long>, n_ids long, checkpoints binary, payload binary"


class WordTokenizer:
    """The ids that the tokenizers library gives, word by word, for a lower-casing BPE tokenizer with word ends.

    White space is dropped before the merges, so the ids of a text are those of its words in a
    row. Texts are cut into words and their words numbered column-wise. The library encodes new
    words together, in one call, and their ids are told apart by the word ends of the
    vocabulary; the most used are remembered.
    Texts with characters for which lower-casing, composition or classes might look beyond a
    word go to the library whole.
    """

    _held: dict[str, WordTokenizer] = {}
    #: ASCII, and letters of Latin scripts that have one code point in either case.
    PLAIN = re.compile("[^\t\n\x0b\x0c\r -~\xa1\xab\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ňŊ-ž–—‘’“”…]")
    LETTERS = "a-z\xdf-\xf6\xf8-\xffĀ-ž"
    #: The split of the tokenizer over those characters, lower-cased: a fixed value of the format.
    SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
    #: Marks after a letter, at the end of a word, are a piece of their own: apart from their word, fewer words are new.
    MARKS = rf"([{LETTERS}])([!-/:-@\[-`{{-~]+)(\s|$)"
    REMEMBERED = 300_000
    #: Words in one call of the library, which takes some kB of memory for each.
    TOGETHER = 4096

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        if described["model"].get("end_of_word_suffix") != "</w>" or [x["type"] for x in described["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing BPE tokenizer with word ends")
        self.size = 1 + max([*(x["id"] for x in described["added_tokens"]), *described["model"]["vocab"].values()])
        self.ends = np.zeros(self.size, bool)
        for token, at in described["model"]["vocab"].items():
            self.ends[at] = token.endswith("</w>")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        #: Word to its number; by number the place and length of its ids in the pool, and how many runs of texts had it.
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, self.dtype)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def forget(self) -> None:
        """Keep the words that most runs of texts had, up to half of those that may be remembered."""
        words, most = list(self.known), self.REMEMBERED // 2
        least = max(2, int(np.partition(self.used, -most)[-most]) + 1 if len(words) > most else 0)
        keep = np.flatnonzero(self.used >= least)
        lengths = self.lengths[keep]
        ends = np.cumsum(lengths)
        self.pool = self.pool[np.repeat(self.starts[keep] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        self.starts, self.lengths, self.used = ends - lengths, lengths, self.used[keep] // 2
        self.known = dict(zip([words[k] for k in keep.tolist()], range(len(keep))))

    def learn(self, words: list[str]) -> None:
        runs = (" ".join(words[k : k + self.TOGETHER]) for k in range(0, len(words), self.TOGETHER))
        ids = np.concatenate([np.asarray(self.library.encode_batch_fast([r], add_special_tokens=False)[0].ids, self.dtype) for r in runs])
        # no piece for the empty word, which stands for white space at the ends of a text
        pieces = np.cumsum([1 if w.isalpha() else len(self.SPLIT.findall(w)) for w in words])
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[pieces]
        starts = np.concatenate([[0], ends[:-1]])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate([self.starts, starts + len(self.pool)])
        self.lengths = np.concatenate([self.lengths, ends - starts])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text, packed as self.dtype."""
        if len(self.known) > self.REMEMBERED:
            self.forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = texts.fill_null("")
        whole = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, self.PLAIN.pattern))
        lower = pc.utf8_lower(pc.if_else(whole, "", texts))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, self.MARKS, r"\1 \2\3"))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.learn([distinct[k] for k in fresh.tolist()])
        self.used[number] += 1
        row = number[numbered.indices.to_numpy()]
        lengths = self.lengths[row]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        packed = self.pool[np.repeat(self.starts[row] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.cumsum(pc.list_value_length(words).to_numpy())] * np.dtype(self.dtype).itemsize
        out = [packed[s:e] for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.asarray(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, self.dtype).tobytes()
        return out


def give_back() -> None:
    """Return freed memory to the system: an executor may hold more Python workers than run at a time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `size` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tokenised(docs: DataFrame, path: str, end_id: int, *, block: int = BLOCK) -> DataFrame:
    """Blocks of ids in ascending doc_id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        step = np.dtype(tokenizer.dtype).itemsize
        end = np.array([end_id], tokenizer.dtype).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // step for x in ids]
            columns = [[part], [start], [keys], [lengths], [held], [b"".join(ids)]]
            types = [pa.int32(), pa.int64(), pa.list_(of_key), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "start", "doc_ids", "lengths", "n_ids", "ids"])

        for b in gathered(batches, TEXTS):
            of_key = b.schema.field(0).type
            for key, packed in zip(b.column(0).to_pylist(), tokenizer.encode(b.column(1))):
                keys.append(key)
                ids.append(packed + end)
                held += len(packed) // step + 1
                if held >= block:
                    yield closed()
                    start += held
                    keys, ids, held = [], [], 0
        if keys:
            yield closed()
        give_back()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, BLOCKS.format(kind=kind))


def counts_of(blocks: DataFrame, dtype: str, size: int) -> DataFrame:
    """(id, count) of all ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for packed in b.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "count"])

    return blocks.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most `limit` bits for positive weights, by package-merge."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(weights, kind="stable")
    own = weights[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([own, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # True where an entry is a symbol, not a package
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, taken = np.zeros(n, np.int64), 2 * (n - 1)
    for symbols in reversed(levels):
        # the symbols among the first `taken` entries are the lightest ones
        chosen = int(symbols[:taken].sum())
        lengths[:chosen] += 1
        taken = 2 * (taken - chosen)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes from (id, length)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, limit: int = LIMIT):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths, self.limit = ids[order], lengths[order], limit
        span = np.left_shift(1, limit - self.lengths)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]) if len(span) else span
        self.codes = first >> (limit - self.lengths)
        self._table = None

    def table(self) -> np.ndarray:
        """For each run of `limit` bits the id that it begins with, and its length in the low 5 bits."""
        if self._table is None:
            entries = np.repeat(self.ids.astype(np.uint32) << np.uint32(5) | self.lengths.astype(np.uint32), np.left_shift(1, self.limit - self.lengths))
            self._table = np.zeros(1 << self.limit, np.uint32)
            self._table[: len(entries)] = entries
        return self._table

    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1
        code, length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids], length[self.ids] = self.codes, self.lengths
        return code, length


def encode_block(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints."""
    lengths = length[ids]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = int(ends[-1]) if len(ids) else 0
    # a code of at most 25 bits lies in one or two 32-bit words; the parts in a word have no common bits, so sums join them
    value = code[ids] << (64 - lengths - (starts & 31)).astype(np.uint64)
    word = starts >> 5
    size = (total >> 5) + 2
    joined = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    joined += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    payload = joined.astype(np.uint64).astype(">u4").tobytes()[: -(-total // 8)]
    return payload, starts[::CHECKPOINT].astype("<u8").tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n_ids: int, table: np.ndarray, limit: int) -> np.ndarray:
    """The ids of a block: all segments between checkpoints advance together."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    n = len(raw) - 3
    window = raw[:n] << np.uint32(24) | raw[1 : n + 1] << np.uint32(16) | raw[2 : n + 2] << np.uint32(8) | raw[3 : n + 3]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    last, shift = n - 1, np.uint32(32 - limit)
    for step in range(min(CHECKPOINT, n_ids)):
        bits = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        entry = table[bits >> shift]
        out[:, step] = entry >> np.uint32(5)
        at = at + (entry & np.uint32(31))
    return out.ravel()[:n_ids]


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, limit: int = LIMIT) -> None:
    """Tokenise documents and write their ids in the file format under `path`."""
    spark = docs.sparkSession
    small_batches(spark, 64)  # a row may be a block of some hundred kB
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenised(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(held)
    blocks = spark.read.schema(BLOCKS.format(kind=kind)).parquet(held)
    words = WordTokenizer.of(tokenizer)
    dtype = words.dtype
    # at most one row for each id of the vocabulary
    counts = sorted(tuple(r) for r in counts_of(blocks, dtype, max(words.size, end_id + 1)).collect())
    ids, weights = np.array([c[0] for c in counts], np.int64), np.array([c[1] for c in counts], np.int64)
    lengths = code_lengths(weights, limit)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, length = Codebook(*shared.value, limit).by_id()
        for b in batches:
            coded = [encode_block(np.frombuffer(x.as_buffer(), dtype), code, length) for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([c[1] for c in coded], pa.binary()), pa.array([c[0] for c in coded], pa.binary())], [*b.schema.names[:5], "checkpoints", "payload"])

    if len(ids):
        blocks.mapInArrow(run, CODED.format(kind=kind)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    else:
        spark.createDataFrame([], CODED.format(kind=kind)).write.parquet(f"{path}/blocks")
    removed(spark, held)


def read(spark: SparkSession, path: str, *, limit: int = LIMIT, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, and the ids (little-endian unsigned 32-bit)."""
    small_batches(spark, 64)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    book = sorted(tuple(r) for r in spark.read.parquet(f"{path}/codebook").collect())
    shared = spark.sparkContext.broadcast((np.array([b[0] for b in book], np.int64), np.array([b[1] for b in book], np.int64)))
    # one sum for each part of the files, as many as the range exchange had partitions
    sums = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before = dict(zip([s[0] for s in sums], accumulate([s[1] for s in sums], initial=0)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codebook(*shared.value, limit).table()
        for b in batches:
            for part, start, keys, lengths, n, checkpoints, payload in zip(*(c.to_pylist() for c in b.columns)):
                ids = decode_block(payload, checkpoints, n, table, limit)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                packed = [ids[s:e].astype("<u4").tobytes() for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, b.schema.field(2).type.value_type),
                        pa.array(starts + start + before[part], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(x) for x in packed], pa.int64()),
                        pa.array(packed if with_ids else [None] * len(packed), pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Write the files in the shared folder and read them back."""
    path = f"{shared_dir(docs.sparkSession)}/huffman-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, end_id=end_id)
    return read(docs.sparkSession, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
