import hashlib
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from tidewater.llm import decontaminate, line_dedup, simhash, toxicity
from tidewater.llm.common import scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage took in and gave out."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_shape(stages):
    assert [n for n, _, _ in stages] == [n for n, _ in pipeline.STAGES] and len(stages) == 5
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_toxic_documents_go_and_no_others(spark, stages):
    _, before, after = stages[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    use = toxicity.Scorer(model)
    assert set(rows(after)) == {i for i, r in rows(before).items() if use.score(r.text)[0] < 0.5}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows(before)) - set(rows(after))
    assert sum(truth.get(i, 1) for i in gone) >= 0.95 * len(gone)


def test_lines(stages):
    _, before, after = stages[1]
    first, kept = rows(before), rows(after)
    for i, r in kept.items():
        old, new = (first[i].text or "").split("\n"), (r.text or "").split("\n")
        it = iter(old)
        assert all(x in it for x in new) and r.n_chars == (len(r.text) if r.text != first[i].text else first[i].n_chars)
    cut = {r.doc_id: r for r in line_dedup.line_dedup(before).where("deleted IS NOT NULL").collect()}
    assert set(first) - set(kept) == {i for i, r in cut.items() if len(r.text) < pipeline.REMAINDER * len(first[i].text) and len(r.text.split()) < pipeline.OWN}


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    fps = {i: simhash.fingerprint((r.text or "").encode(), pipeline.SHINGLE) for i, r in rows(before).items()}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= pipeline.NEAR_BITS:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(rows(after)) == {i for i in ids if find(i) == i}


def test_benchmark_passages_go(spark, stages):
    _, before, after = stages[3]
    matcher = decontaminate.Matcher([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    assert set(rows(after)) == {i for i, r in rows(before).items() if not matcher.find(r.text)}
    assert after.count() < before.count()


def test_tokens(stages):
    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_proto=Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())
    texts, got = rows(before), rows(after)
    assert set(texts) == set(got)
    for i, r in got.items():
        assert list(r.ids) == library.encode(texts[i].text or "")
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids)).encode()).hexdigest()


def test_stages_stand_edges(spark, edges, none):
    extra = edges.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    for name, stage in pipeline.STAGES:
        assert stage(spark, extra, SF).count() > 0, name
        assert stage(spark, extra.where("doc_id > 1000"), SF).count() == 0, name


def test_what_stages_do_with_edges(spark, edges):
    extra = edges.selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    texts = lambda df: sorted(map(repr, ((r.doc_id, r.text and r.text[:20]) for r in df.collect())))
    whole = extra.where("doc_id = 1").first().text[:20]
    assert texts(pipeline.without_repeated_lines(spark, extra, SF)) == texts(extra.where("NOT (doc_id <=> 2) AND NOT (doc_id IS NULL AND text IS NOT NULL)"))
    near = [(r.doc_id, r.text and r.text[:20]) for r in pipeline.without_near_copies(spark, extra, SF).collect()]
    assert sorted(near, key=repr) == sorted([(1, whole), (3, None), (6, extra.where("doc_id = 6").first().text[:20]), (7, "one"), (7, "two of one id"), (8, extra.where("doc_id = 8").first().text[:20])], key=repr)
    assert texts(pipeline.without_benchmarks(spark, extra, SF)) == texts(extra)
    coded = pipeline.tokenised(spark, extra, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(coded) == extra.count() and sum(r.n_tokens == 0 for r in coded) == 3
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in coded if r.doc_id in (3, 4))
