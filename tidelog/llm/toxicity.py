"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of two rows of a hashed table: one for the word, one for its
first letters, so that inflected and compound forms share what was learnt. The first component
begins as the evidence that a bucket gives for either label in the training rows, so that a
few labels are enough to go on from. Filters of several widths run over the whole
text, each keeps its maximum, and a linear layer gives a logit. A naive Bayes head over the
same word buckets guesses the language from the text alone, and each language has its own
threshold, fitted on a calibration part of the training rows; the score maps that threshold
to 0.7.

Defined cases: null and empty texts are scored as a text of one padding word; rows without a
label teach nothing; of several labels of a document the highest counts; without labels of
both kinds every score is 0. Ties and repeated rows are scored one by one, other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import hash_fraction, remainder, small_batches

WORDS = re.compile(r"\w+")
BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
PREFIX = 5
PADDING = max(WIDTHS) - 1
#: Tokens scored at once; a longer text comes in overlapping pieces.
PIECE = 1 << 17
CUT = 0.7
#: Pulls the embeddings of words that a batch touches to zero.
DECAY = 2e-4
#: Evidence (the signed root of G) below CHANCE counts as none, and above it by STEP as one.
CHANCE, STEP, MOST_STEPS = 3.0, 4.0, 1.0


class Buckets(dict):
    """Word to the buckets of the word and of its beginning, packed in one number; 0 is the padding."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        whole, start = (1 + zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in (word, f"{word[:PREFIX]}-"))
        self[word] = packed_id = whole + start * BUCKETS
        return packed_id


def rows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two rows of the embedding table that each token adds."""
    return ids % BUCKETS, BUCKETS + ids // BUCKETS


_buckets = Buckets()


def tokens(text: str | None) -> np.ndarray:
    words = WORDS.findall(text.lower()) if text else []
    return np.fromiter(map(_buckets.__getitem__, words), np.int32, len(words))


class Network:
    """Embedding, one convolution for each width, max pooling, linear output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        # near zero: a word that the training rows don't hold moves no maximum
        self.p = {"e": rng.normal(0, 0.01, (2 * BUCKETS, EMBED)).astype(np.float32)}
        self.p["e"][[0, BUCKETS]] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def begin_from(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """The first component of the embeddings from the evidence of the training rows, and a filter that reads it."""
        for base, own in ((0, evidence([d % BUCKETS for d in docs], labels)), (BUCKETS, evidence([d // BUCKETS for d in docs], labels))):
            self.p["e"][base : base + BUCKETS, 0] += np.sign(own) * np.clip((np.abs(own) - CHANCE) / STEP, 0, MOST_STEPS)
        self.p["e"][[0, BUCKETS]] = 0
        self.p["w1"][:, 0] = 0
        self.p["w1"][0, 0], self.p["o"][0], self.p["c"][0] = 1, 2, -2

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        whole, start = rows_of(ids)
        return self.p["e"][whole] + self.p["e"][start]

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of each document and the places they came from."""
        maxima, places = [], []
        ends = stops(ids, starts)
        for w in WIDTHS:
            x = np.concatenate([self.embedded(ids[j : len(ids) - PADDING + j]) for j in range(w)], axis=1)
            z = x @ self.p[f"w{w}"] + self.p[f"b{w}"]
            at = np.array([s + z[s:t].argmax(axis=0) for s, t in zip(starts, ends)])
            places.append(at)
            maxima.append(np.take_along_axis(z, at, axis=0))
        return np.concatenate(maxima, axis=1), places

    def step(self, docs: list[np.ndarray], labels: np.ndarray, adam: dict, rate: float) -> float:
        ids, starts = packed(docs)
        top, places = self.pooled(ids, starts)
        hidden = np.maximum(top, 0)
        z = hidden @ self.p["o"] + self.p["c"]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((prob - labels) / len(labels)).astype(np.float32)
        grads = {"o": hidden.T @ dz, "c": np.array([dz.sum()], np.float32)}
        dh = np.outer(dz, self.p["o"]) * (top > 0)
        rows, parts = [], []
        for k, w in enumerate(WIDTHS):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            seen = np.stack([self.embedded(ids[places[k] + j]) for j in range(w)], axis=2)  # doc, filter, width, embed
            seen = seen.reshape(len(labels), FILTERS, w * EMBED)
            grads[f"w{w}"] = np.einsum("df,dfk->kf", g, seen)
            grads[f"b{w}"] = g.sum(axis=0)
            back = (g[:, :, None] * self.p[f"w{w}"].T[None]).reshape(len(labels), FILTERS, w, EMBED)
            for j in range(w):
                for r in rows_of(ids[places[k] + j].ravel()):
                    rows.append(r)
                    parts.append(back[:, :, j].reshape(-1, EMBED))
        touched, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        de = np.zeros((len(touched), EMBED), np.float32)
        np.add.at(de, inverse, np.concatenate(parts))
        de += DECAY * self.p["e"][touched]
        adam["t"] += 1
        for name, g in grads.items():
            self.adam(name, slice(None), g, adam, rate)
        self.adam("e", touched, de, adam, rate)
        self.p["e"][[0, BUCKETS]] = 0
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    def adam(self, name: str, at, g: np.ndarray, adam: dict, rate: float) -> None:
        m, v = adam["m"][name], adam["v"][name]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        t = adam["t"]
        self.p[name][at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def evidence(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each bucket the signed root of the G statistic of its documents and the labels: over 0 where label 1 is likelier."""
    seen = np.zeros((2, BUCKETS))
    for d, y in zip(docs, labels):
        seen[int(y), np.unique(d)] += 1
    share = labels.mean() if len(labels) else 0.0
    expected = seen.sum(axis=0) * np.array([[1 - share], [share]])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.where(seen > 0, seen * np.log(seen / expected), 0).sum(axis=0)
    return np.sign(seen[1] - expected[1]) * np.sqrt(np.maximum(g, 0))


def packed(docs: list[np.ndarray], tails: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in one array, each document followed by padding (by the first tokens that come after it, where it is a piece), and where each begins."""
    gap = np.zeros(PADDING, np.int32)
    after = [gap] * len(docs) if tails is None else [np.concatenate([t, gap[len(t) :]]) for t in tails]
    parts = [x for d, t in zip(docs, after) for x in (d if len(d) else gap[:1], t)]
    lengths = [max(1, len(d)) + PADDING for d in docs]
    return np.concatenate([*parts, gap]), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def stops(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the padding of each document begins."""
    return np.append(starts[1:], len(ids) - PADDING) - PADDING


def train_network(docs: list[np.ndarray], labels: np.ndarray, *, epochs: int = 8, least_steps: int = 400, seed: int = 11, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam over `epochs` passes, or as many more as small samples need for `least_steps` steps."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.begin_from(docs, labels)
    batch = max(8, min(batch, len(docs) // 8))
    epochs = max(epochs, -(-least_steps * batch // max(1, len(docs))))
    adam = {"t": 0, "m": {k: np.zeros_like(v) for k, v in net.p.items()}, "v": {k: np.zeros_like(v) for k, v in net.p.items()}}
    steps, total = 0, epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            net.step([docs[i] for i in chosen], labels[chosen], adam, rate * (1 - 0.9 * steps / total))
            steps += 1
    return net


def tables(net: Network) -> list[list[np.ndarray]]:
    """For each width the product of the embeddings with each slice of its filters: scoring is then sums of rows."""
    return [[net.p["e"] @ net.p[f"w{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)] for w in WIDTHS]


def maxima(ids: np.ndarray, starts: np.ndarray, net: Network, products: list[list[np.ndarray]]) -> np.ndarray:
    out = []
    n = len(ids) - PADDING
    whole, start = rows_of(ids)
    for w, parts in zip(WIDTHS, products):
        z = parts[0][whole[:n]]
        z += parts[0][start[:n]]
        for j in range(1, w):
            z += parts[j][whole[j : n + j]]
            z += parts[j][start[j : n + j]]
        # windows that begin in the padding would reach into the next document
        out.append(np.maximum.reduceat(z, np.stack([starts, stops(ids, starts)], 1).ravel(), axis=0)[::2] + net.p[f"b{w}"])
    return np.concatenate(out, axis=1)


def logits(docs: list[np.ndarray], net: Network, products: list[list[np.ndarray]]) -> np.ndarray:
    """Logits of whole documents; the maximum over overlapping pieces is that over the text."""
    out = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    group, tails, owners, size = [], [], [], 0

    def flush() -> None:
        np.maximum.at(out, owners, maxima(*packed(group, tails), net, products))

    for at, d in enumerate(docs):
        for start in range(0, max(1, len(d)), PIECE):
            group.append(d[start : start + PIECE])
            tails.append(d[start + PIECE : start + PIECE + PADDING])
            owners.append(at)
            size += len(group[-1])
            if size >= PIECE:
                flush()
                group, tails, owners, size = [], [], [], 0
    if group:
        flush()
    return np.maximum(out, 0) @ net.p["o"] + net.p["c"]


def language_table(docs: list[np.ndarray], langs: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Log probabilities of the buckets in each language."""
    names = sorted({x for x in langs if x is not None})
    counts = np.full((BUCKETS, len(names)), 0.1)
    for d, lang in zip(docs, langs):
        if lang is not None:
            counts[:, names.index(lang)] += np.bincount(d % BUCKETS, minlength=BUCKETS)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32) if names else np.zeros((BUCKETS, 1), np.float32)


def guessed(docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(docs), int)
    for at, d in enumerate(docs):
        if len(d):
            out[at] = sum(table[d[s : s + PIECE] % BUCKETS].sum(axis=0) for s in range(0, len(d), PIECE)).argmax()
    return out


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cut with the best F1."""
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    at = int(f1.argmax())
    low = z[order][at + 1] if at + 1 < len(z) else z[order][at] - 1
    return float((z[order][at] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = 2000, negatives: int = 6000, calibration: float = 0.3, seed: int = 11) -> dict | None:
    """Train on at most about `positives` and `negatives` labelled rows, chosen by a hash of their ids.

    That bound on the sample is the only one. `labels` holds doc_id and toxic, training rows only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, positives / counts[1]))).otherwise(F.lit(min(1.0, negatives / counts[0])))
    chosen = marks.where(hash_fraction(F.col("doc_id").cast("string"), seed=seed) < rate)
    # bounded by `positives` and `negatives`, so it may be broadcast
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "lang", "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [tokens(t).astype("<i4").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], ["doc_id", "toxic", "lang", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(encode, f"doc_id {kind}, toxic int, lang string, ids binary").collect()
    rows.sort(key=lambda r: zlib.crc32(f"{seed}:{r[0]}".encode()))
    encoded, y = [np.frombuffer(r[3], "<i4") for r in rows], np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    held = int(len(rows) * calibration)
    if len(set(y[held:])) < 2:
        held = 0
    net = train_network(encoded[held:], y[held:], seed=seed)
    names, table = language_table(encoded, [r[2] for r in rows])
    check = slice(0, held) if held and len(set(y[:held])) == 2 else slice(0, len(rows))
    z, truth, langs = logits(encoded[check], net, tables(net)), y[check], guessed(encoded[check], table)
    common = best_threshold(z, truth)
    thresholds = np.full(max(1, len(names)), common)
    for k in range(len(names)):
        own = langs == k
        if truth[own].sum() >= 20 and (1 - truth[own]).sum() >= 20:
            thresholds[k] = best_threshold(z[own], truth[own])
    return {"p": net.p, "langs": names, "table": table, "thresholds": thresholds}


_ready: dict[int, tuple] = {}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted and the language that the text was taken for."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    offset = float(np.log(CUT / (1 - CUT)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m is not None:
            net = Network.__new__(Network)
            net.p = m["p"]
            products = tables(net)
        for b in batches:
            n = b.num_rows
            if m is None:
                probability, taken = np.zeros(n), [None] * n
            else:
                ids = [tokens(t) for t in b.column(1).to_pylist()]
                lang = guessed(ids, m["table"])
                z = logits(ids, net, products) - m["thresholds"][lang]
                probability = 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + offset, -30, 30)))
                taken = [m["langs"][k] if m["langs"] and len(d) else None for k, d in zip(lang, ids)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(probability, pa.float64()), pa.array((probability >= CUT).astype(np.int32)), pa.array(taken, pa.string())],
                ["doc_id", "score", "predicted", "text_lang"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, text_lang string")


def detect(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every document."""
    model = fit(docs, labels.where(remainder("doc_id", 3) != 1), **options)
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "text_lang")
