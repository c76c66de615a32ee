"""Language identification and toxicity, by held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import awkward, empty
from tidelog.llm import langid, toxicity
from tidelog.llm.queries import op1_langid, op5_toxicity
from tidelog.llm.shared import documents

LARGER = "/root/testdata/sf0.01"


def test_op1_held_out(spark):
    got = op1_langid(spark, LARGER).join(documents(spark, LARGER), "doc_id").collect()
    assert len(got) == documents(spark, LARGER).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) > 0.95 * len(held)


def test_bundle_is_the_sum_of_bound_trigrams():
    codes = langid.letters_of("Ab, é")
    vectors = {int(c): langid.letter_vectors(np.array([c]), 128, 3)[0].astype(int) for c in set(codes.tolist())}
    want = sum(np.roll(vectors[int(a)], 2) * np.roll(vectors[int(b)], 1) * vectors[int(c)] for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (langid.bundle(["Ab, é"], 128, 3)[0] == want).all()


def test_op1_awkward(spark):
    docs = awkward(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    letters = {r.doc_id: bool(r.text) and any(map(str.isalpha, r.text)) for r in docs.where("doc_id <> 9 and doc_id is not null").collect()}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in got if r.doc_id in letters)
    assert langid.identify(empty(spark)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def held_out(spark, sf):
    got = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    right, toxic, found = sum(r.predicted == r.toxic for r in held), sum(r.toxic for r in held), sum(r.predicted for r in held)
    both = sum(r.predicted and r.toxic for r in held)
    assert right > len(held) - toxic  # more than "never toxic" has
    return both / toxic, both / max(1, found)


def test_op5_held_out(spark):
    recall, precision = held_out(spark, "/root/testdata/sf0.1")  # 305 toxic rows to learn from
    assert recall > 0.85 and precision > 0.85


def test_op5_held_out_of_few_labels(spark):
    recall, precision = held_out(spark, LARGER)  # 33 toxic rows
    assert recall > 0.6 and precision > 0.9


def test_op5_scores_are_those_of_plain_loops():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (1, 3, 30, 80)] * 3 + [""]
    docs = [toxicity.tokens(t) for t in texts]
    net = toxicity.train_network(docs, np.array([k % 2 for k in range(len(docs))], np.float32), epochs=1, least_steps=20)

    def row(t):
        return net.p["e"][t % toxicity.BUCKETS].astype(float) + net.p["e"][toxicity.BUCKETS + t // toxicity.BUCKETS]

    want = []
    for d in docs:
        ids = [int(t) for t in d] or [0]
        z = float(net.p["c"][0])
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(row((ids + [0] * toxicity.PADDING)[at + j]) @ net.p[f"w{w}"][j * toxicity.EMBED : (j + 1) * toxicity.EMBED, f]) for j in range(w)) for at in range(len(ids)))
                z += max(0.0, best + float(net.p[f"b{w}"][f])) * float(net.p["o"][k * toxicity.FILTERS + f])
        want.append(z)
    assert np.allclose(toxicity.logits(docs, net, toxicity.tables(net)), want, atol=1e-4)


def test_op5_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.detect(docs, labels.where("toxic = 5")).collect()} == {0.0}
    assert toxicity.detect(empty(spark), labels).collect() == []


def test_pieces_do_not_change_the_score(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [toxicity.tokens(" ".join(f"w{x}" for x in rng.integers(0, 500, n))) for n in (0, 1, 2, 50, 400)]
    net = toxicity.train_network(docs, np.array([0, 1, 0, 1, 0], np.float32), epochs=2)
    whole = toxicity.logits(docs, net, toxicity.tables(net))
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(whole, toxicity.logits(docs, net, toxicity.tables(net)), atol=1e-5)


def test_bundle_of_many_letters_is_the_same_without_a_table(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(0x4E00 + x) for x in rng.integers(0, 9000, 300)) for _ in range(30)] + ["", None, "abc abc abc"]
    monkeypatch.setattr(langid, "SPARSE", 10**9)
    table = langid.bundle(texts, 128, 3)
    monkeypatch.setattr(langid, "SPARSE", 0)
    assert np.abs(table).sum() > 0 and np.allclose(table, langid.bundle(texts, 128, 3))


def test_op1_learns_a_bounded_number_of_labels(spark):
    words = ("der und die das", "the and for with", "les des une pour")
    rows = [(i, " ".join([words[i % 3]] * 5), "abc"[i % 3]) for i in range(60)] + [(100 + i, "xyz", f"dirty{i}") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert model["langs"] == ["a", "b", "c"]
