import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidewater.llm import simhash, similar


def changed(words, edits):
    words = list(words)
    for at in random.sample(range(len(words)), edits):
        words[at] = f"new{random.random()}"
    return words


def test_pairs_of_the_wanted_similarity_leave_one(spark):
    random.seed(11)
    rows = []
    for n in range(60):  # a chain of changes: ends are less similar than neighbours
        words = [f"w{random.randrange(3000)}" for _ in range(200)]
        for k in range(3):
            rows.append((3 * n + k, " ".join(words)))
            words = changed(words, random.randint(1, 6))
    rows += [(1000 + k, " ".join(changed([f"c{i}" for i in range(200)], 2))) for k in range(100)]  # a large group
    own = {i: np.unique(simhash.shingles(t.encode(), pipeline.SHINGLE)) for i, t in rows}
    fps = {i: simhash.fingerprint(t.encode(), pipeline.SHINGLE) for i, t in rows}
    group = {i: i for i in own}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    apart = 0
    for a in own:
        for b in own:
            if a < b:
                bits = (fps[a] ^ fps[b]).bit_count()
                alike = similar.jaccard(own[a], own[b]) >= 0.8
                apart += alike and bits > pipeline.NEAR_BITS
                if alike or bits <= pipeline.NEAR_BITS:
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in pipeline.without_near_copies(spark, docs, None).collect()}
    assert got == {i for i in own if find(i) == i} and apart > 20


def links_of_all_pairs(own, fps):
    """The components, as a map to the smallest fingerprint, of all links by comparing all pairs."""
    group = {f: f for f in fps.values()}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in own:
        for b in own:
            if a < b and similar.jaccard(own[a], own[b]) >= 0.8:
                x, y = find(fps[a]), find(fps[b])
                group[max(x, y)] = min(x, y)
    return {f: find(f) for f in group}


def test_no_link_of_a_key_is_left_to_the_draw(spark):
    """150 pairs of copies that share most keys with all others, but are each similar to its own copy only."""
    random.seed(5)
    common = [f"c{i}" for i in range(180)]
    rows = []
    for n in range(150):
        words = common + [f"p{n}w{i}" for i in range(30)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words[:-8], *(f"q{n}w{i}" for i in range(8))]))]
    own = {i: np.unique(simhash.shingles(t.encode(), 5)) for i, t in rows}
    fps = {i: i for i in own}  # instead of fingerprints, of which two may be equal
    wanted = links_of_all_pairs(own, fps)
    assert len(set(wanted.values())) == 150 and len(wanted) == 300
    texts = spark.createDataFrame(rows, "row bigint, text string")
    marked = similar.signed(texts, 5).withColumn("fp", F.col("row")).cache()
    for how in ({"rounds": 0}, {"rounds": 1, "large": 40}, {"rounds": 0, "large": 40}):  # as a whole, in blocks after a round, in blocks
        edges = [(r.a, r.b) for r in similar.links(marked, texts, 5, 0.8, **how).collect()]
        got = {f: f for f in wanted}
        for _ in wanted:
            for a, b in edges:
                got[a] = got[b] = min(got[a], got[b])
        assert got == wanted


def test_sketches_never_rule_out_what_is_similar():
    random.seed(6)
    for _ in range(300):
        size, edits = random.randint(1, 3000), random.randint(0, 400)
        one = np.unique(np.random.default_rng(size).integers(0, 1 << 64, size, dtype=np.uint64))
        two = np.unique(np.concatenate([one[edits:], np.random.default_rng(edits + 9999).integers(0, 1 << 64, edits, dtype=np.uint64)]))
        bits = int(np.bitwise_count((similar.sketch(one) ^ similar.sketch(two)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(one, two))
