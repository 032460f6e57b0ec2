import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import registry, sharding
from tidewater.llm.common import scratch_path


def whole(rows, shards):
    count = Counter(r.shard for r in rows)
    assert set(count) <= set(range(shards)) and max(count.values()) - min([count[s] for s in range(shards)]) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_query(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.op10_sharding(spark, small).collect()
    whole(rows, 24)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def place(rows):
    return {(r.doc_id, r.text): (r.shard, r.slot) for r in rows}


def test_the_seed_decides_and_not_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    run = lambda df, **o: place(sharding.shuffle(df, scratch_path(spark, "shards-test"), 5, bucket_bytes=50_000, **o).collect())
    first = run(docs)
    assert run(docs.repartition(7)) == first
    other = run(docs, seed=99)
    assert other != first and sum(a == other[k] for k, a in first.items()) < len(first) / 5


def test_the_order_is_uniform(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 20) AS text")
    rows = sharding.shuffle(docs, scratch_path(spark, "shards-test"), 8, bucket_bytes=8000).collect()
    whole(rows, 8)
    at = sorted(rows, key=lambda r: (r.shard, r.slot))
    ups = sum(a.doc_id < b.doc_id for a, b in zip(at, at[1:]))
    assert 1850 < ups < 2150
    for s in range(8):
        assert 1700 < sum(r.doc_id for r in rows if r.shard == s) / 500 < 2300


def test_repeated_rows_do_not_fill_a_bucket(spark):
    docs = spark.range(3000).selectExpr("IF(id < 1500, 7, id) AS doc_id", "IF(id < 1500, 'same', CAST(id AS STRING)) AS text")
    rows = sharding.shuffle(docs, scratch_path(spark, "shards-test"), 4, bucket_bytes=2000).collect()
    whole(rows, 4)
    assert len(rows) == 3000


def test_the_seed_decides_with_many_copies_too(spark):
    docs = spark.range(3000).selectExpr("IF(id < 1200, 7, id) AS doc_id", "IF(id < 1200, 'same', CAST(id AS STRING)) AS text")
    run = lambda df: sorted(map(repr, sharding.shuffle(df, scratch_path(spark, "shards-test"), 4, bucket_bytes=2000, batch=50).collect()))
    first = run(docs)
    assert run(docs.repartition(7, "text")) == first and run(docs.orderBy(F.desc("doc_id")).coalesce(2)) == first


def test_copies_are_scattered_in_batches(spark):
    docs = spark.range(0, 3000, 1, 5).selectExpr("IF(id % 3 < 2, 7, id) AS doc_id", "IF(id % 3 < 2, 'same', CAST(id AS STRING)) AS text")
    got = sharding._scattered(docs, "mix", 1, 100).groupBy("doc_id", "mix").count().collect()
    assert sorted(r["count"] for r in got if r.doc_id == 7) == [100] * 20 and sum(r["count"] for r in got) == 3000


def test_against_a_plain_shuffle_in_two_passes(spark, small):
    """The same hash, buckets in lists, and Fisher-Yates by swapping."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.lit(3), F.xxhash64(F.lit(3), "doc_id", F.xxhash64("text")), F.lit(0).cast("bigint"))).collect()]
    total = sum(len((t or "").encode()) + 8 for _, t, _ in rows)
    buckets = [[] for _ in range(-(-total // 50_000))]
    for i, t, h in rows:
        buckets[h % len(buckets)].append((h, i, t))
    order = []
    for b, records in enumerate(buckets):
        records.sort(key=lambda r: (r[0], r[1], len((r[2] or "").encode())))
        draws = np.random.default_rng([3, b]).random(max(0, len(records) - 1))
        for k, i in enumerate(range(len(records) - 1, 0, -1)):
            j = int(draws[k] * (i + 1))
            records[i], records[j] = records[j], records[i]
        order += records
    want, n = {}, len(order)
    for at, (_, i, t) in enumerate(order):
        shard = max(s for s in range(5) if -(-s * n // 5) <= at)
        want[i, t] = shard, at - -(-shard * n // 5)
    assert place(sharding.shuffle(docs, scratch_path(spark, "shards-test"), 5, seed=3, bucket_bytes=50_000).collect()) == want


def test_edges(spark, edges, none):
    got = sharding.shuffle(edges, scratch_path(spark, "shards-test"), 24)
    assert got.columns == [*edges.columns, "shard", "slot"]
    rows = got.collect()
    whole(rows, 24)
    assert sorted(map(repr, (r.text for r in rows))) == sorted(map(repr, (r.text for r in edges.collect())))
    assert sharding.shuffle(none, scratch_path(spark, "shards-test")).count() == 0
