import hashlib
import re

import pytest

from tidewater.llm import exact_dedup, registry
from tidewater.llm.common import scratch_path


def test_query_agrees_with_sql(agree):
    agree(registry.op8_exact_dedup, registry.ORACLES["op8_exact_dedup"])


def test_edges(spark, edges, none):
    rows = exact_dedup.exact_dedup(edges).collect()
    assert len(rows) == edges.count()
    texts = [re.sub("[ \t-\r]+", " ", r.text or "") for r in edges.collect()]
    assert sorted(r.text_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    by = lambda i: [(r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id == i]
    assert by(1) == [(1, 4, True)] and by(2) == [(1, 4, False)] * 2
    assert sorted(by(None)) == [(1, 4, False), (3, 3, False)]
    assert by(3) == [(3, 3, True)] and by(4) == [(3, 3, False)] and by(5) == [(5, 1, True)]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_one_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a "), (1, " a"), (1, "a"), (None, "b"), (None, "b")], "doc_id bigint, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    for sha in {r.text_sha256 for r in rows}:
        assert sum(r.kept for r in rows if r.text_sha256 == sha) == 1


def test_index_outlives_its_table_and_drops_known_texts(spark):
    path = scratch_path(spark, "index-test")
    first = spark.createDataFrame([(5, "a"), (6, "b"), (7, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "b"), (2, "c"), (3, "c"), (4, " c")], "doc_id bigint, text string")
    kept = lambda rows: sorted((r.doc_id, r.keep_id, r.kept) for r in rows.collect())
    assert kept(exact_dedup.DigestIndex(spark, path, 4).add(first)) == [(5, 5, True), (6, 6, True), (7, 5, False)]
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.rows().count() == 2
    assert kept(again.add(second)) == [(1, 6, False), (2, 2, True), (3, 2, False), (4, 4, True)]
    assert again.rows().count() == 4
    assert kept(again.add(second)) == [(1, 6, False), (2, 2, False), (3, 2, False), (4, 4, False)]


def test_index_joins_without_moving_it(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index-plan"), 4)
    index.add(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string"))
    both = index.rows().join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = both._sc._jvm.PythonSQLUtils.explainString(both._jdf.queryExecution(), "formatted")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def kept(rows):
    return sorted((r.doc_id, r.keep_id, r.kept) for r in rows.collect())


def test_bucket_count_is_the_index_s(spark):
    path = scratch_path(spark, "index-buckets")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    exact_dedup.DigestIndex(spark, path, 4).add(docs).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, path)
        assert again.buckets == 4 and not any(k for _, _, k in kept(again.add(docs))) and again.rows().count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 7)


def test_a_batch_can_be_added_again(spark):
    path = scratch_path(spark, "index-batches")
    first = spark.createDataFrame([(5, "a"), (6, "b"), (7, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "b"), (2, "c"), (3, "c")], "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, path, 3)
    one, two = kept(index.add(first, "one")), kept(index.add(second, "two"))
    rows = sorted((bytes(r.digest), r.keep_id) for r in index.rows().collect())
    index.close()
    again = exact_dedup.DigestIndex(spark, path)
    assert kept(again.add(second, "two")) == two == [(1, 6, False), (2, 2, True), (3, 2, False)]
    assert sorted((bytes(r.digest), r.keep_id) for r in again.rows().collect()) == rows
    assert one == [(5, 5, True), (6, 6, True), (7, 5, False)]


def test_compaction_keeps_the_rows_and_the_layout(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index-compact"), 2)
    for k in range(4):
        index.add(spark.createDataFrame([(i, f"text {i}") for i in range(10 * k, 10 * k + 20)], "doc_id bigint, text string")).count()
    rows = sorted((bytes(r.digest), r.keep_id) for r in index.rows().collect())
    files = len(index.rows().inputFiles())
    index.compact()
    assert sorted((bytes(r.digest), r.keep_id) for r in index.rows().collect()) == rows and len(rows) == 50
    assert len(index.rows().inputFiles()) == 2 < files
    assert exact_dedup.DigestIndex(spark, index.path).rows().count() == 50
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name == index.name]
