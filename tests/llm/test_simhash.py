import random
import re

import numpy as np
import pytest
import xxhash

from tidewater.llm import registry, simhash
from tidewater.llm.components import components


def plain_fingerprint(text, words=3):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    parts = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def family(n, flips, seed):
    random.seed(seed)
    bases = [random.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    for _ in range(n):
        fp = random.choice(bases)
        for _ in range(random.randint(0, flips)):
            fp ^= 1 << random.randrange(64)
        out.add(fp)
    return sorted(out)


def near(fps, most):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= most]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "a b c", "A b C d É", "x\x0by\x0cz w", "a\u00a0b c d", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


@pytest.mark.parametrize("n,most", [(1, 2), (2, 2), (9, 2), (300, 2), (300, 0), (300, 5), (2000, 3)])
def test_the_tree_finds_all_pairs(n, most):
    fps = np.array(family(n, 4, n), dtype=np.uint64)
    tree = simhash.GrayTree(fps)
    got = {tuple(sorted((int(tree.fps[a]), int(tree.fps[b])))) for who, found in tree.search(tree.fps, most) for a, b in zip(who, found) if a != b}
    assert got == set(near(fps.tolist(), most))
    members, heads = simhash.forest(fps, most)
    want = roots(fps.tolist(), near(fps.tolist(), most))
    assert len(members) == len(fps) - len(set(want.values()))
    assert all(want[int(a)] == want[int(b)] for a, b in zip(members, heads))


def test_gray_order():
    ranks = np.arange(1000, dtype=np.uint64)
    code = ranks ^ (ranks >> np.uint64(1))
    assert (simhash.gray_rank(code) == ranks).all()


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_masks_catch_every_pair(most):
    random.seed(most)
    for above in (0, 0xFFFF0000FFFF0000):
        level = simhash.masks(above, most)
        for _ in range(300):
            off = sum(1 << b for b in random.sample([i for i in range(64) if not above >> i & 1], most))
            assert any(off & m == 0 for m in level)


@pytest.mark.parametrize("split", [1, 5, 8192])
@pytest.mark.parametrize("most", [2, 4])
def test_links_over_buckets_of_all_sizes(spark, split, most):
    fps = family(400, 5, split)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint").repartition(3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, most, split).collect()]
    assert all((a ^ b).bit_count() <= most or roots(fps, near(fps, most))[a] == roots(fps, near(fps, most))[b] for a, b in edges[:20])
    assert roots(fps, edges) == roots(fps, near(fps, most))


def test_components_of_paths_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7001), (7000, 7000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    groups = {}
    for node, label in got.items():
        groups.setdefault(label, set()).add(node)
    assert sorted(map(len, groups.values())) == [2, 50, 61] and all(label in g for label, g in groups.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query_against_all_pairs(spark, small):
    docs = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = sorted(docs)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (docs[a] ^ docs[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op5_simhash(spark, small).collect()}
    assert got == {i: (f"{docs[i]:016x}", want[i]) for i in ids}


def test_edges(spark, edges, none):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    assert [r.component_id for r in rows if r.doc_id is None] .count(1) == 1
    assert {r.component_id for r in rows if r.fp == 0} == {3} and sum(r.fp == 0 for r in rows) == 4
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 7, 8]
    assert simhash.keep_first(none).count() == 0
