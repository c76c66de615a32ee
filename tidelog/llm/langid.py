"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. A trigram is
bound as the product of its letters' vectors, each rotated by its place; a document is the
bundle (sum) of its trigrams, a language prototype the bundle of its documents' normalised
vectors. The language whose prototype has the largest cosine with the document wins.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows with a null
language or text teach nothing; equal cosines go to the language first in the alphabet; an
empty table or one without any labelled row gives `und` for every document. Repeated rows are
scored one by one. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import hash_fraction, remainder, small_batches

UNDETERMINED = "und"
SPACE_CODE = 32
#: Cells of the table of counts for each trigram of the texts above which no such table is made.
SPARSE = 16
#: Letters handled in one piece of a text.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """One row of +1 and -1 for each code point, the same on every machine."""
    words = dim // 64
    with np.errstate(over="ignore"):
        at = codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)[None, :]
        bits = mix(at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space, a space at each end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letter_table()[codes], codes, SPACE_CODE)
    keep = np.empty(len(codes), bool)
    keep[0] = True
    np.logical_or(codes[1:] != SPACE_CODE, codes[:-1] != SPACE_CODE, out=keep[1:])
    return codes[keep]


def pieces(texts: list[str | None], limit: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Letters of the documents in groups of about `limit`; a long one comes in overlapping pieces."""
    group, owners, size = [], [], 0
    for at, text in enumerate(texts):
        codes = letters_of(text or "")
        for start in range(0, max(1, len(codes) - 2), PIECE):
            piece = codes[start : start + PIECE + 2]
            group.append(piece)
            owners.append(at)
            size += len(piece)
            if size >= limit:
                yield group, owners
                group, owners, size = [], [], 0
    if group:
        yield group, owners


def bundle(texts: list[str | None], dim: int, seed: int, limit: int = 1 << 18) -> np.ndarray:
    """A row for each text: the sum of its trigrams' vectors."""
    out = np.zeros((len(texts), dim), np.float32)
    for group, owners in pieces(texts, limit):
        codes = np.concatenate(group)
        rows = np.repeat(np.arange(len(group)), [len(x) for x in group])
        whole = rows[:-2] == rows[2:] if len(codes) > 2 else np.zeros(0, bool)
        if not whole.any():
            continue
        alphabet, letter = np.unique(codes, return_inverse=True)
        n = len(alphabet)
        grams = ((letter[:-2] * n + letter[1:-1]) * n + letter[2:])[whole]
        rows = rows[:-2][whole]
        if n**3 <= 1 << 22:
            seen = np.zeros(n**3, bool)
            seen[grams] = True
            distinct = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            which = place[grams]
        else:
            distinct, which = np.unique(grams, return_inverse=True)
        first = letter_vectors(alphabet, dim, seed)
        second, third = np.roll(first, 1, axis=1), np.roll(first, 2, axis=1)
        sums = np.zeros((len(group), dim), np.float32)
        if len(group) * len(distinct) > SPARSE * len(which):
            # few trigrams come back: every occurrence is added by itself, in the documents' order
            for at in range(0, len(which), 4096):
                part, own = grams[at : at + 4096], rows[at : at + 4096]
                vectors = third[part // (n * n)] * second[part // n % n] * first[part % n]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums[own[starts]] += np.add.reduceat(vectors, starts, axis=0, dtype=np.float32)
            np.add.at(out, owners, sums)
            continue
        counts = np.bincount(rows * len(distinct) + which, minlength=len(group) * len(distinct)).reshape(len(group), -1)
        for at in range(0, len(distinct), 4096):
            part = distinct[at : at + 4096]
            vectors = third[part // (n * n)] * second[part // n % n] * first[part % n]
            sums += counts[:, at : at + 4096].astype(np.float32) @ vectors.astype(np.float32)
        np.add.at(out, owners, sums)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def fit(train: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 4000, languages: int = 1000, dim: int = 1024, seed: int = 7) -> dict:
    """Prototypes from about `per_language` labelled rows of each of the `languages` most frequent labels, chosen by a hash of the key.

    These bounds on the sample are the only ones; every row counts for the sampling rates. Returns
    {"langs": sorted list, "prototypes": array, "dim", "seed"}.
    """
    spark = train.sparkSession
    small_batches(spark)
    labelled = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # at most `languages` rows
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().orderBy(F.desc("count"), F.col(lang)).limit(languages).collect()}
    if not counts:
        return {"langs": [], "prototypes": np.zeros((0, dim), np.float32), "dim": dim, "seed": seed}
    rates = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    chosen = labelled.where(hash_fraction(F.col(key).cast("string"), seed=seed) < rates[F.col(lang)])
    sample = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors = unit(bundle(texts, dim, seed))
            for name in set(langs):
                part = vectors[[x == name for x in langs]].sum(axis=0, dtype=np.float64)
                total[name] = total.get(name, 0) + part
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "vector"])

    # a bounded sample in a fixed number of tasks: at most 24 vectors of a language come back
    rows = sample.repartition(24).mapInArrow(sums, "lang string, vector array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for row in rows:
        total[row[0]] = total.get(row[0], 0) + np.array(row[1])
    langs = sorted(total)
    return {"langs": langs, "prototypes": unit(np.array([total[x] for x in langs])).astype(np.float32), "dim": dim, "seed": seed}


def classify(docs: DataFrame, model: dict, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (cosine, at least 0), margin over the second language."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, prototypes = m["langs"], m["prototypes"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            vectors = unit(bundle(texts, m["dim"], m["seed"]))
            cosine = vectors @ prototypes.T if langs else np.zeros((len(texts), 1), np.float32)
            best = cosine.argmax(axis=1) if len(texts) else np.zeros(0, int)
            # a doc has letters when its vector is not zero or a letter stands among its few characters
            known = [bool(langs) and t is not None and any(map(str.isalpha, t)) for t in texts]
            top = cosine[np.arange(len(texts)), best]
            second = np.partition(cosine, -2, axis=1)[:, -2] if cosine.shape[1] > 1 else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([langs[b] if ok else UNDETERMINED for b, ok in zip(best, known)], pa.string()),
                    pa.array(np.where(known, np.clip(top, 0, 1), 0).astype(np.float64)),
                    pa.array(np.where(known, np.clip(top - second, 0, 1), 0).astype(np.float64)),
                ],
                ["key", "lang_pred", "score", "margin"],
            )

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(predict, f"key {kind}, lang_pred string, score double, margin double")
    return out.withColumnRenamed("key", key)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row."""
    held_out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held_out), **options)
    out = classify(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin")
