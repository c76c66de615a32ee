"""The pipeline against plain Python versions of its stages' decisions."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import awkward
from tests.llm.test_dedup import brute_lines
from tests.llm.test_tokens import expected_bpe
from tidelog.llm import mixing, quality
from tidelog.llm.shared import documents, written


def test_stages_one_by_one(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]

    kept = written(stages["quality"](spark, docs, sf), "t")
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {k for k, v in verdict.items() if v}

    lines = written(stages["line_dedup"](spark, kept, sf), "t")
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert lines.columns == columns
    assert {r.doc_id: r.text for r in lines.collect()} == {k: t for k, (t, removed, n) in want.items() if removed == 0 or removed < n}

    near = written(stages["near_dedup"](spark, lines, sf), "t")
    assert near.columns == columns and {r.doc_id for r in near.collect()} <= {r.doc_id for r in lines.collect()}

    mixed = written(stages["mixing"](spark, near, sf), "t")
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mixing.mix(near).collect())

    ids = stages["bpe"](spark, mixed, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert sorted(map(tuple, ids), key=str) == expected_bpe(library, [(r.doc_id, r.text) for r in mixed.collect()])
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, ids))


def test_stages_take_awkward_tables(spark, sf):
    docs = awkward(spark).where("doc_id is null or doc_id <> 9").dropDuplicates(["doc_id", "text"])
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, sf), "t")
        assert table.agg(F.count(F.lit(1))).first()[0] >= 0
