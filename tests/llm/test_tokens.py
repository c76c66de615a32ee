"""BPE by tree concatenation and Huffman files, against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import awkward, empty
from tidelog.llm import bpe_tree, huffman
from tidelog.llm.queries import op3_huffman, op7_bpe
from tidelog.llm.shared import documents

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
texts = st.text(st.one_of(st.sampled_from(list("abcdes'  \n\t.,;-1234éÉßΣ漢|<>")), st.characters(exclude_categories=("Cs",))), max_size=200) | st.lists(
    st.sampled_from(["it's", " we'll", "  ", "\n\n", "<|endoftext|>", "aaaa", "1234567", "....", "don", "'", "t", "the", " "]), max_size=60
).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts)
def test_both_encoders_are_the_library(libraries, text):
    assert bpe_tree.Codec.of(BYTES).encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
    packed = huffman.WordTokenizer.of(WORDS).encode([text])[0]
    assert np.frombuffer(packed, "<u2").tolist() == libraries[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts, st.integers(1, 40))
def test_joined_parts_are_the_whole(libraries, text, part):
    codec = bpe_tree.Codec.of(BYTES)
    parts = bpe_tree.parts_of(text, part)
    assert "".join(parts) == text
    assert bpe_tree.join_tree([codec.encode(p) for p in parts], codec, window=2) == libraries[0].encode(text, add_special_tokens=False).ids


def test_long_unsplit_runs(libraries):
    codec, rng = bpe_tree.Codec.of(BYTES), random.Random(5)
    for alphabet in ("a", "ab", "abcdefgh", "0123456789abcdef", "=-", " "):
        text = "".join(rng.choice(alphabet) for _ in range(6000))
        for part in (37, 500):
            parts = [codec.encode(p) for p in bpe_tree.parts_of(text, part)]
            assert bpe_tree.join_tree(parts, codec, window=4) == libraries[0].encode(text, add_special_tokens=False).ids


def expected_bpe(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op7_whole_table(spark, sf, libraries):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    assert sorted(map(tuple, op7_bpe(spark, sf).collect()), key=str) == expected_bpe(libraries[0], rows)


def test_op7_awkward(spark, libraries):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for part in (bpe_tree.PART, 50):
        assert sorted(map(tuple, bpe_tree.encode(docs, BYTES, part=part, finish=bpe_tree.DIGESTS).collect()), key=str) == expected_bpe(libraries[0], rows)
    back = bpe_tree.decode(bpe_tree.encode(docs, BYTES), BYTES).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((k, t or "") for k, t in rows), key=str)
    assert bpe_tree.encode(empty(spark), BYTES).collect() == []


def check_files(rows, found, library):
    """found: rows of doc_id, start, n_tokens, ids_crc32."""
    start, want = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == want


def test_op3_whole_table(spark, sf, libraries):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op3_huffman(spark, sf).collect()]
    check_files(rows, found, libraries[1])


def test_op3_awkward(spark, libraries, tmp_path):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    path = f"file://{tmp_path}/files"
    huffman.write(docs, WORDS, path)
    got = huffman.read(spark, path).collect()
    check_files(rows, [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], libraries[1])
    assert all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert huffman.round_trip(empty(spark), WORDS).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=200), st.integers(0, 1 << 30))
def test_code_lengths_and_blocks(weights, seed):
    weights = np.array(weights)
    for limit in (8, 18):
        lengths = huffman.code_lengths(weights, limit)
        assert lengths.max() <= limit and (0.5 ** lengths.astype(float)).sum() <= 1
    # without a binding limit the cost is that of Huffman's tree
    import heapq

    heap, cost = list(map(int, weights)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    free = huffman.code_lengths(weights, 40)
    assert len(weights) == 1 or int((free * weights).sum()) == cost
    rng = np.random.default_rng(seed)
    ids = np.sort(rng.choice(5000, len(weights), replace=False))
    book = huffman.Codebook(ids, lengths)
    data = rng.choice(ids, int(rng.integers(0, 3000)))
    payload, points = huffman.encode_block(data, *book.by_id())
    assert huffman.decode_block(payload, points, len(data), book.table(), book.limit).tolist() == data.tolist()
