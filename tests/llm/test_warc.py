import base64
import hashlib
import struct
import uuid

import pytest
import zstandard

from tidewater.llm import registry, warc
from tidewater.llm.common import shared_dir

ROWS = [(3, "u1", "abc"), (1, "u\r\n2", "abc"), (2, None, ""), (5, "x", None), (None, "y", "abc"), (None, "z", "q"), (1, "dup", "abc"), (9, "é", "ü" * 1_500_000)]


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1) for r in ROWS], "page_id bigint, url string, html string, digest string, first int")


def test_query_agrees_with_sql(agree):
    agree(registry.op2_warc, registry.ORACLES["op2_warc"])


def test_round_trip(spark, pages, path):
    warc.write(pages, path, frame_bytes=500)
    got = warc.read(spark, path).collect()
    assert len(got) == len(ROWS)
    payload = {}
    for r in got:
        if r.record_type == "response":
            payload[r.page_id, r.payload_digest] = bytes(r.payload)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    assert (by_id[3].record_type, by_id[3].refers_to, by_id[3].payload_bytes, by_id[3].payload) == ("revisit", 1, 3, None)
    assert (by_id[5].record_type, by_id[5].refers_to, by_id[5].payload_bytes) == ("revisit", 2, 0)
    assert payload[9, by_id[9].payload_digest] == ("ü" * 1_500_000).encode()
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    assert [r.record_type for r in got if r.page_id == 1] == ["response"] * 2
    for r in got:
        text = {1: "abc", 3: "abc", 2: "", 5: "", 9: ROWS[-1][2]}.get(r.page_id)
        if text is not None:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert by_id[9].url == "é" and "u%0D%0A2" in {r.url for r in got}


def test_small_payloads_are_not_referred_to(spark, pages, path):
    warc.write(pages, path, least=1)
    assert {r.page_id: r.record_type for r in warc.read(spark, path).collect()}[5] == "response"


def test_index_leads_to_frames(spark, pages, path):
    index = warc.write(pages, path, frame_bytes=500).collect()
    assert len({(r.bundle, r.frame) for r in index}) > 1
    wanted = spark.createDataFrame([(3,), (9,), (77,)], "page_id bigint")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.find(spark, path, wanted).collect()) == [(3, 3), (9, 3_000_000)]


def test_bundles_are_read_side_by_side(spark, pages, path):
    index = warc.write(pages.repartition(4), path, frame_bytes=100, bundle_bytes=200)
    many = index.select("bundle").distinct().count()
    assert many > 2 and warc.read(spark, path).rdd.getNumPartitions() == many
    wanted = spark.createDataFrame([(1,), (1,), (3,), (None,), (99,)], "page_id bigint")
    assert sorted(r.page_id for r in warc.find(spark, path, wanted).collect()) == [1, 1, 3]


def test_bundles_are_plain_zstandard_and_seekable(spark, pages, path, tmp_path):
    index = warc.write(pages.coalesce(1), path, frame_bytes=500).collect()
    for name in {r.bundle for r in index}:
        data = open(f"{path.removeprefix('file://')}/bundles/{name}", "rb").read()
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        assert (flags, magic) == (0, 0x8F92EAB1) and count == 1 + max(r.frame for r in index if r.bundle == name)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        at = n = 0
        while at < len(whole):
            _, _, at = warc.parse(whole, at)
            n += 1
        assert n == sum(r.bundle == name for r in index)


def test_bundles_are_split(spark, pages, path):
    index = warc.write(pages.coalesce(1), path, frame_bytes=100, bundle_bytes=200).collect()
    assert len({r.bundle for r in index}) > 2
    assert warc.read(spark, path).count() == len(ROWS)


def test_broken_payloads_are_found():
    record = warc.record(1, None, b"abc", "A" * 32, None, False, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc._row(*warc.parse(record)[:2])


def test_empty_table(spark, pages, path):
    assert warc.write(pages.where("page_id > 1000"), path).count() == 0
    assert warc.read(spark, path).count() == 0
