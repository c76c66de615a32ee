"""Line dedup and SimHash groups, against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import xxhash

from tests.llm.cases import awkward, empty
from tidelog.llm import linedup, simhash_vp
from tidelog.llm.queries import ORACLES, op8_linedup, op9_simhash
from tidelog.llm.shared import documents


def bits_of(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows, size, radius):
    prints = {}
    for k, t in rows:
        prints.setdefault(k, set()).add(bits_of(t or "", size))
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any((x ^ y).bit_count() <= radius for x in prints[a] for y in prints[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k in keys}


def test_op9(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    want = groups_of(rows, 4, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, sf).collect()}
    assert got == {k: (f"{bits_of(t or '', 4):016x}", want[k]) for k, t in rows}
    assert len(set(want.values())) < len(want)


def test_op9_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = groups_of([r for r in rows if r[0] is not None], 4, 4)
    got = simhash_vp.grouped_documents(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash_vp.grouped_documents(empty(spark)).collect() == []


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, n // 8, dtype=np.uint64)
    out = centres[rng.integers(0, len(centres), n)]
    for _ in range(7):
        out ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(out)


def test_links_are_exact(spark, monkeypatch):
    for radius, shard_rows, full in ((4, 20_000, 64), (4, 100, 512), (3, 20_000, 16), (12, 20_000, 64)):
        monkeypatch.setattr(simhash_vp, "SHARD_ROWS", shard_rows)
        monkeypatch.setattr(simhash_vp, "FULL", full)
        fp = clustered(1500, radius)
        nodes = spark.createDataFrame([(i, bytearray(int(x).to_bytes(8, "big"))) for i, x in enumerate(fp)], "node long, words binary")
        labels = {r.node: r.component for r in simhash_vp.components(simhash_vp.near_links(nodes, radius=radius)).collect()}
        links = simhash_vp.Links(len(fp))
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius)
        links.unite(i, j)
        assert [labels.get(k, k) for k in range(len(fp))] == links.parent.tolist()


def test_long_chains_and_hubs_become_components(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.component for r in simhash_vp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in range(1001, 1400)}


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 300)) for _ in range(12)]
    near = [b.replace(b.split()[150], "changed") for b in base[:6]]
    rows = [(i, t) for i, t in enumerate(base + near + base[:3])] + [(3, base[3]), (None, base[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash_vp.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(12), None, None], key=str)
    assert simhash_vp.deduplicate(empty(spark)).collect() == []


def test_deduplicate_groups_are_exactly_those_of_the_jaccard_similarity(spark):
    rng = np.random.default_rng(7)
    line = " ".join(f"common{i}" for i in range(30))
    rows = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**7, int(rng.integers(30, 400)))]
        rows.append(" ".join(words))
        for _ in range(4):
            # of the words so many change that the similarity lies at 0.6 to 0.95
            share, copy = rng.uniform(0.005, 0.045), list(words)
            for k in np.flatnonzero(rng.random(len(words)) < share):
                copy[k] = f"x{rng.integers(10**7)}"
            rows.append(" ".join(copy[: int(len(copy) * rng.uniform(0.85, 1.0))]))
    rows += [f"{line} {' '.join(f'own{k}w{i}' for i in range(12))}" for k in range(60)]
    # one repeated run of words outweighs all else in a fingerprint
    rows += ["again " * 300 + " ".join(f"tail{k}w{i}" for i in range(20)) for k in range(3)]
    order = rng.permutation(len(rows)).tolist()
    rows = [rows[k] for k in order] + [None, ""]
    sets = [set(simhash_vp.shingle_hashes(t, 5).tolist()) for t in rows]
    links = simhash_vp.Links(len(rows))
    close = 0
    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 5 * same >= 4 * len(sets[i] | sets[j]):
                links.unite(np.array([i]), np.array([j]))
                close += 1
    assert close > 60
    want = {k for k in range(len(rows)) if links.parent[k] == k}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in simhash_vp.deduplicate(docs).collect()} == want


def test_deduplicate_finds_near_copies_of_every_band(spark):
    rng = np.random.default_rng(23)
    texts, bands = [], []
    while len(bands) < 900:
        words = [f"w{x}" for x in rng.integers(0, 10**8, int(rng.integers(60, 300)))]
        copy = list(words)
        for k in np.flatnonzero(rng.random(len(words)) < rng.uniform(0.002, 0.035)):
            copy[k] = f"x{rng.integers(10**8)}"
        a, b = (set(simhash_vp.shingle_hashes(" ".join(x), 5).tolist()) for x in (words, copy))
        if 0.7 <= len(a & b) / len(a | b) < 1:
            bands.append(len(a & b) / len(a | b))
            texts += [" ".join(words), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_vp.deduplicate(docs).select("doc_id").collect()}
    assert {2 * k for k in range(len(bands))} <= kept
    assert all((2 * k + 1 in kept) for k, x in enumerate(bands) if x < 0.8)
    for low, high, least in ((0.8, 0.85, 0.97), (0.85, 0.9, 0.99), (0.9, 1.0, 1.0)):
        own = [2 * k + 1 not in kept for k, x in enumerate(bands) if low <= x < high]
        assert len(own) > 100 and sum(own) >= least * len(own), (low, sum(own), len(own))


def test_crowds_of_copies_are_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "FEW", 2)
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.integers(0, 10**8, 120)]
    texts = []
    for _ in range(120):
        copy = list(words)
        for k in rng.integers(0, len(words), int(rng.integers(1, 5))):
            copy[k] = f"x{rng.integers(10**8)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"y{x}" for x in rng.integers(0, 10**8, 80)) for _ in range(30)]
    sets = [set(simhash_vp.shingle_hashes(t, 5).tolist()) for t in texts]
    links = simhash_vp.Links(len(texts))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links.unite(np.array([i]), np.array([j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_vp.deduplicate(docs).select("doc_id").collect()}
    assert kept == {k for k in range(len(texts)) if links.parent[k] == k}


def test_deduplicate_has_a_rule_for_rows_of_equal_ids(spark):
    base = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(4)]
    rows = [(1, base[1], "b"), (1, base[0], "z"), (1, base[0], "a"), (2, base[2], "c"), (3, base[1], "d"), (4, None, "e"), (4, base[3], "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = sorted((tuple(r) for r in simhash_vp.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, base[0], "a"), (2, base[2], "c"), (4, None, "e")], key=str)


# ---- op8


def brute_lines(rows, least=50):
    """Kept text, and lines removed, of every document: all windows compared as text."""
    first, where = {}, []
    for k, t in sorted(rows):
        lines = [x for x in t.split("\n") if x.encode().split()]
        words = [len(x.encode().split()) for x in lines]
        # every run that has enough words, however long
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= least:
                    window = "\n".join(lines[i:j])
                    if first.setdefault(window, (k, i)) != (k, i):
                        where.append((k, i, j))
    gone = {}
    for k, i, j in where:
        gone.setdefault(k, set()).update(range(i, j))
    out = {}
    for k, t in rows:
        kept, at, n = [], 0, 0
        for line in t.split("\n"):
            worded = bool(line.encode().split())
            if not (worded and at in gone.get(k, ())):
                kept.append(line)
            at += worded
            n += worded
        out[k] = ("" if n and len(gone.get(k, ())) == n else "\n".join(kept), len(gone.get(k, ())), n)
    return out


def test_op8_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.register("d", documents(spark, sf).toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    want = con.execute(ORACLES["op8_linedup"]).fetchall()
    got = [tuple(r) for r in op8_linedup(spark, sf).collect()]
    assert Counter(got) == Counter(want)
    assert sum(r[2] for r in got) > 0


def test_op8_against_brute_force(spark):
    rng = np.random.default_rng(9)
    lines = [" ".join(f"l{k}w{i}" for i in range(int(rng.integers(1, 30)))) for k in range(25)] + ["", "  "]
    rows = []
    for k in range(60):
        picks = rng.integers(0, len(lines), int(rng.integers(0, 12)))
        rows.append((k, "\n".join(lines[p] for p in picks)))
    run = "\n".join(f"one{i}" for i in range(70))
    rows += [(100, run), (101, f"before\n{run}\nafter"), (102, "\n".join(run.split("\n")[:49])), (103, "\n".join(run.split("\n")[5:60])), (104, f"{run}\n{run}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["report"]["kept_text"], r["report"]["n_removed"], r["report"]["n_lines"]) for r in linedup.deduplicated(docs).collect()}
    assert got == brute_lines(rows)


def test_op8_rows_of_equal_ids_are_cut_apart(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, shared), (7, f"{shared}\nown words"), (7, "other words\nand more"), (7, f"{shared}\nown words")]
    got = Counter(r["report"]["kept_text"] for r in linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([shared, "own words", "other words\nand more", "own words"])


def test_op8_awkward(spark):
    docs = awkward(spark)
    got = linedup.summary(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 9)}
    assert by_id[5].n_removed == 0 and by_id[6].n_removed == by_id[6].n_lines and by_id[7].n_removed == by_id[5].n_lines
    kept = linedup.filter_documents(docs)
    assert kept.columns == docs.columns
    assert 6 not in {r.doc_id for r in kept.collect()} and kept.where("text is null").count() == 2
    assert linedup.summary(empty(spark)).collect() == []
