"""Byte-level BPE by tree concatenation.

A long text is cut into 2^k parts that executors encode on their own. The parts are then
joined pairwise up the tree. At each join a window of tokens on both sides is decoded and
encoded again; while the new tokens do not run into the old ones on both sides the window
doubles. Two tokenisations that share a token at the same bytes may be spliced there, as a
sequence of BPE tokens is the encoding of its text exactly when each adjacent pair is; two
shared tokens in a row are asked for, or the end of the text.

The fast encoder holds the tokenizer's own merges as ranks. Texts with characters whose class
may differ between Unicode versions go to the tokenizers library itself, part by part and
window by window.

Defined cases: a null text is an empty one and has no tokens; repeated rows, and rows of equal
ids, are encoded one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import small_batches

#: Code points in one part of a long text, at most.
PART = 1 << 15
#: Tokens on each side of a join in the first window.
WINDOW = 16
#: Characters whose letter, digit or space class no Unicode version since 6 has changed.
STABLE = re.compile("[^\x00-ɏΑ-ΡΣ-ώЀ-ҁҊ-ԧ‐-‧、。ぁ-ゖァ-ヺ一-龥가-힣]")


class Codec:
    """Encoder and decoder of one tokenizer file."""

    _held: dict[str, Codec] = {}

    def __init__(self, path: str):
        import json

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        plain = described["normalizer"] is None and described["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or described["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        of_char = byte_of_char()
        special = {x["content"]: x["id"] for x in described["added_tokens"]}
        vocab = {k: v for k, v in described["model"]["vocab"].items() if k not in special}
        self.path, self.special = path, special
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, at in vocab.items():
            self.bytes[at] = bytes(of_char[c] for c in token)
        ranks = {self.bytes[at]: at for at in vocab.values()}
        for token, at in special.items():
            self.bytes[at] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes])
        self.span = max([8, *map(len, special)])
        # the pattern of the ByteLevel pre-tokenizer: a fixed value of the format
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._library = None

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def stable(self, text: str) -> bool:
        return text.isascii() or not STABLE.search(text)

    def encode(self, text: str) -> list[int]:
        if not self.stable(text) or any(s in text for s in self.special):
            return self.library().encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_of_char() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def parts_of(text: str, part: int = PART) -> list[str]:
    """2^k parts of nearly equal length, none over `part` code points."""
    count = 1
    while len(text) > part * count:
        count *= 2
    bounds = [len(text) * k // count for k in range(count + 1)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def whole_chars(piece: bytes) -> bool:
    """Whether the bytes begin at a character (they always end at one when the next does)."""
    return not piece or piece[0] & 0xC0 != 0x80


def splice(left: list[int], right: list[int], codec: Codec, window: int = WINDOW) -> list[int]:
    """The encoding of the concatenation of two texts from their encodings."""
    if not left or not right:
        return left or right
    size = window
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        # a special token across the join must lie in the window, and its ends between characters
        while a > 0 and (codec.lengths[left[a:]].sum() < codec.span or not whole_chars(codec.bytes[left[a]])):
            a -= 1
        while b < len(right) and (codec.lengths[right[:b]].sum() < codec.span or not whole_chars(codec.bytes[right[b]])):
            b += 1
        tail, head = left[a:], right[:b]
        tail_bytes = codec.decode_bytes(tail)
        again = codec.encode((tail_bytes + codec.decode_bytes(head)).decode("utf-8"))
        starts = np.concatenate([[0], np.cumsum(codec.lengths[again])])
        begin = (0, 0) if a == 0 else agreement(tail, np.concatenate([[0], np.cumsum(codec.lengths[tail])]), again, starts, len(tail_bytes))
        if begin is not None:
            if b == len(right):
                end = (len(head), len(again))
            else:
                # the same search from the far end, on the reversed tokens
                total = int(starts[-1])
                back_head, back_again = head[::-1], again[::-1]
                back_starts = np.concatenate([[0], np.cumsum(codec.lengths[back_again])])
                found = agreement(back_head, np.concatenate([[0], np.cumsum(codec.lengths[back_head])]), back_again, back_starts, total - len(tail_bytes))
                end = None if found is None else (len(head) - found[0], len(again) - found[1])
            if end is not None and begin[1] <= end[1]:
                return left[: a + begin[0]] + again[begin[1] : end[1]] + right[end[0] :]
        size *= 2


def agreement(old: list[int], old_starts: np.ndarray, new: list[int], new_starts: np.ndarray, limit: int) -> tuple[int, int] | None:
    """After the first token, two tokens in a row that both sequences have at the same bytes before `limit`; the place after the first of them in each."""
    at = {int(s): k for k, s in enumerate(new_starts[:-1])}
    for k in range(1, len(old) - 1):
        j = at.get(int(old_starts[k]))
        if j is not None and j + 1 < len(new) and new[j] == old[k] and new[j + 1] == old[k + 1] and old_starts[k + 2] <= limit:
            return k + 1, j + 1
    return None


def join_tree(parts: list[list[int]], codec: Codec, window: int = WINDOW) -> list[int]:
    while len(parts) > 1:
        parts = [splice(parts[k], parts[k + 1], codec, window) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


#: What is returned of a document: named Arrow types, and the values from its ids.
Finish = Callable[[list[int], Codec], tuple]


def raw_ids(ids: list[int], codec: Codec) -> tuple:
    return len(ids), np.asarray(ids, "<u4").tobytes()


RAW = ("n_tokens long, ids binary", raw_ids)


def digests(ids: list[int], codec: Codec) -> tuple:
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


DIGESTS = ("n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def encode(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", part: int = PART, finish: tuple[str, Finish] = RAW) -> DataFrame:
    """key and the columns of `finish` for each row; with RAW n_tokens and the ids as little-endian 32-bit integers."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    columns, values = finish
    schema = f"key {kind}, {columns}"
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def finished(keys: list, encoded: list[list[int]], like: pa.Schema) -> pa.RecordBatch:
        codec = Codec.of(path)
        rows = [(k, *values(ids, codec)) for k, ids in zip(keys, encoded)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(like)], schema=like)

    def whole(like: pa.Schema):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = Codec.of(path)
            for b in batches:
                yield finished(b.column(0).to_pylist(), [codec.encode(t) for t in b.column(1).to_pylist()], like)

        return run

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row, text in zip(b.column(0), b.column(2).to_pylist(), b.column(1).to_pylist()):
                pieces = parts_of(text, part)
                n = len(pieces)
                for at in range(0, n, 8):
                    own = pieces[at : at + 8]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(own), pa.int64()), pa.array([k.as_py()] * len(own), b.schema.field(0).type), pa.array(range(at, at + len(own)), pa.int32()), pa.array([n] * len(own), pa.int32()), pa.array(own, pa.string())],
                        ["row", "key", "piece", "pieces", "text"],
                    )

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            ids = [np.asarray(codec.encode(t), "<u4").tobytes() for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], ["row", "key", "piece", "pieces", "ids"])

    def joined(like: pa.Schema):
        def run(table: pa.Table) -> pa.Table:
            codec = Codec.of(path)
            n = table.column("pieces")[0].as_py()
            pieces = dict(zip(table.column("piece").to_pylist(), table.column("ids").to_pylist()))
            copies = table.num_rows // n  # rows that are equal in id and text come together
            ids = join_tree([np.frombuffer(pieces[k], "<u4").tolist() for k in range(n)], codec)
            k = table.column("key")[0].as_py()
            return pa.Table.from_batches([finished([k] * copies, [ids] * copies, like)])

        return run

    like = arrow_schema(docs, schema)
    short = rows.where(F.length("text") <= part).mapInArrow(whole(like), schema)
    long = rows.where(F.length("text") > part).withColumn("row", F.xxhash64("key", "text"))
    pieces = long.mapInArrow(cut, f"row long, key {kind}, piece int, pieces int, text string")
    encoded = pieces.repartition(F.col("row"), F.col("piece")).mapInArrow(leaves, f"row long, key {kind}, piece int, pieces int, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInArrow(joined(like), schema)).withColumnRenamed("key", key)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id") -> DataFrame:
    """key and decoded text of rows with `ids` as encode() gives them."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for b in batches:
            texts = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
