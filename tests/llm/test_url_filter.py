import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewater.llm import registry, url_filter

ALPHABET = st.text(alphabet="aZ.:/?#-é @\n", max_size=30)


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = []
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@given(ALPHABET)
def test_split(url):
    assert url_filter.split_url(url) == plain_split(url)


@pytest.mark.parametrize("url", [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM?x/y", "a://É.com/En#f", "x://h:80/p//q://r"])
def test_split_edges(url):
    assert url_filter.split_url(url) == plain_split(url)


@pytest.mark.parametrize("host", ["com", "xcom", "a.com", "example.com", "www.example.com", "x.www.example.com", "badexample.com", "net", "n.net", "org", ""])
@pytest.mark.parametrize("path", ["", "/", "/en", "/en/", "/en/x", "/fr/1", "/es/"])
def test_rules(host, path):
    assert (url_filter.Rules(url_filter.RULES).fit(host, path) or (None, None)) == plain_rule(host, path)


def test_equal_rules_block():
    assert url_filter.Rules([("allow", "a.b/"), ("block", "a.b/")]).fit("a.b", "/") == ("a.b/", "block")


def test_model_on_hosts_it_has_not_seen():
    hosts = sorted({u.split("/")[2] for u, _ in url_filter.LABELLED})
    right = total = 0
    for k in range(4):
        out = {h for n, h in enumerate(hosts) if n % 4 == k}
        rows = [(u, y) for u, y in url_filter.LABELLED if u.split("/")[2] not in out]
        weights = url_filter.train(rows, turns=150)
        for u, y in url_filter.LABELLED:
            if u.split("/")[2] in out:
                right += (url_filter.block_score(weights, *url_filter.split_url(u)) >= 0.5) == bool(y)
                total += 1
    assert right / total > 0.8


def test_training_against_a_plain_loop():
    rows = [("http://good.org/a", 0), ("http://bad.biz/b", 1), ("http://bad.biz/c", 1), ("x", 0)]
    grams = []
    for u, _ in rows:
        host, path = plain_split(u)
        own = {k + t[i : i + n] for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(max(0, len(t) - n + 1))}
        grams.append(sorted({zlib.crc32(g.encode()) % (1 << url_filter.BITS) for g in own}))
    weights, bias = {}, 0.0
    for _ in range(7):
        slope, off_sum = {}, 0.0
        for own, (_, y) in zip(grams, rows):
            z = sum(weights.get(g, 0.0) for g in own) / max(1, len(own)) ** 0.5 + bias
            off = 1 / (1 + math.exp(-z)) - y
            off_sum += off
            for g in own:
                slope[g] = slope.get(g, 0.0) + off / max(1, len(own)) ** 0.5 / len(rows)
        weights = {g: weights.get(g, 0.0) - 0.5 * 20 * (d + 1e-3 / 20 * weights.get(g, 0.0)) for g, d in slope.items()}
        bias -= 0.5 * off_sum / len(rows)
    got = url_filter.train(rows, turns=7)
    assert got[-1] == pytest.approx(bias, abs=1e-5) and set(np.flatnonzero(got[:-1]).tolist()) <= set(weights)
    assert all(got[g] == pytest.approx(w, abs=1e-4) for g, w in weights.items())


def test_table_has_each_url_once_and_no_made_up_hosts_of_the_pages():
    urls = [u for u, _ in url_filter.LABELLED]
    assert len(urls) == len(set(urls)) and not any(".example." in u for u in urls)
    assert {y for _, y in url_filter.LABELLED} == {0, 1}


def test_training_table_is_bounded():
    with pytest.raises(ValueError):
        url_filter.train([("a://b", 0)] * (url_filter.MOST + 1))
    assert url_filter.block_score(url_filter.train([]), "a", "/") == 0.5


def test_query_against_a_plain_computation(spark, small):
    weights = url_filter.train(url_filter.LABELLED)
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = registry.op6_url_filter(spark, small).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == plain_split(urls[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        grams = {k + t[i : i + n] for k, t in (("h", f"^{r.host}$"), ("p", f"^{r.path}$")) for n in (3, 4, 5) for i in range(max(0, len(t) - n + 1))}
        own = np.array(sorted({zlib.crc32(g.encode()) % (1 << url_filter.BITS) for g in grams}))
        z = weights[own].sum() / len(own) ** 0.5 + weights[-1]
        assert r.rule == rule and r.verdict == (verdict or ("block" if z >= 0 else "allow"))


def test_edges_and_own_table(spark):
    rows = [(1, None, "r"), (2, "", "r"), (2, "", "r"), (3, "https://x.example.org/" + "a/" * 20_000, None), (None, "http://n.net/es/", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    labelled = spark.createDataFrame([("http://good.org/a", 0), ("http://x.example.org/b", 1), (None, 1)], "url string, block int")
    got = url_filter.filter_urls(pages, labelled=labelled)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "block_score"] and got.count() == 5
    assert [r.verdict for r in got.collect() if r.page_id == 3] == ["block"]
    assert url_filter.filter_urls(pages.where("page_id > 9")).count() == 0
