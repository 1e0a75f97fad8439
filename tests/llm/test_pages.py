"""URL rules and WARC archives against plain versions."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from harrow.llm import urls, warc

ODD = [
    (1, None, None), (2, "no scheme here", ""), (3, "HTTP://WWW.Example.COM/en/x?y#z", "same"), (4, "https://example.com/en/1", "same"), (5, "https://a.net/es/", "x" * 300_000), (5, "https://a.net/es/", "x" * 300_000),
    (6, "http://net/fr/é?q=1", "ñandú"), (7, "http://example.com", "same"), (None, "ftp://b.org#frag/x://y", "same"), (8, "http://x.com/\r\nInjected: 1", ""), (9, "://only", None), (10, "http://badexample.com/en/", "z"), (11, "http://u:p@h.net:80/fr/", "q\r\n\r\nr"),
]


@pytest.fixture(params=["pages", "odd", "empty"])
def pages(request, spark):
    if request.param == "pages":
        return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    df = spark.createDataFrame([(*r, "clash") for r in ODD], "page_id long, url string, html string, rule string")
    return df if request.param == "odd" else df.limit(0)


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_urls(pages, spark):
    labelled = spark.createDataFrame([("https://spam.example.org/en/1", True)] * 30 + [("https://good.example.org/de/1", False)] * 50 + [("https://spam.example.org/de/1", False)] * 30, "url string, blocked boolean")
    got = sorted((tuple(r) for r in urls.judge(pages, labelled).collect()), key=repr)
    want = []
    for r in pages.select("page_id", "url").collect():
        host, path, rule, action = plain_rule(r["url"])
        mined = r["url"] is not None and "example.org" in host and path.startswith("/en/") and host.endswith(".example.org") and "spam" in host.split(".")[-3:][0]
        want.append((r["page_id"], host, path, rule, action, mined))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=lambda w: repr((*w[:4], w[4] or "allow")))]
    verdict = {(g[0], g[1], g[2]): g[4] for g in got}
    for i, host, path, _, action, mined in want:
        if action:
            assert verdict[i, host, path] == action
        elif mined:
            assert verdict[i, host, path] == "block"
        elif not path.startswith("/en/"):
            assert verdict[i, host, path] == "allow"


def test_mined_rules(spark):
    rows = [("http://a.org/bad/1", True)] * 40 + [("http://a.org/fine/1", False)] * 40 + [("http://b.org/bad/1", False)] * 40
    labelled = spark.createDataFrame(rows, "url string, blocked boolean").select(urls.tokens(F.col("url")).alias("tokens"), "blocked")
    rules = urls.mine(labelled, confidence=0.8).collect()
    assert rules and all(r["confidence"] >= 0.8 and r["blocked"] == 40 and r["key"] in r["antecedent"] and {"label1=a", "name=org.a"} & set(r["antecedent"]) for r in rules)
    assert urls.mine(labelled.where("not blocked")).count() == 0
    assert urls.mine(labelled.where("blocked").limit(10)).count() == 0  # too few to tell


def test_mining_finds_late_parts_and_values_and_merges(spark):
    fields = "&".join(f"f{i}=1" for i in range(40))  # always together: one item
    rows = [(f"http://h{i}.org/a/b/c/casino/{i}?{fields}", True) for i in range(40)] + [(f"http://h{i}.org/a/b/c/x/{i}?{fields}", False) for i in range(80)]
    rows += [(f"http://g{i}.org/q?cat=adult", True) for i in range(40)] + [(f"http://g{i}.org/q?cat=news", i % 9 == 0) for i in range(90)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://n.org/z/casino"), (2, "http://n.org/a/b/c/x/1?" + fields), (3, "http://n.org/w?cat=adult"), (4, "http://n.org/w?cat=news"), (5, "http://h.org/a/b/c/casino/3?" + fields)], "page_id long, url string")
    rules = {tuple(r["antecedent"]) for r in urls.mine(labelled.select(urls.tokens(F.col("url")).alias("tokens"), "blocked")).collect()}
    assert any("part=casino" in r for r in rules) and ("value=cat=adult",) in rules
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_page_labels_belong_to_the_page(spark):
    sf = "/root/testdata/sf0.01/"
    pages, docs = spark.read.parquet(sf + "pages.parquet"), spark.read.parquet(sf + "documents.parquet")
    all_labelled = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert urls.labels_of_pages(pages, docs, all_labelled).count() == pages.where("html is not null").count()
    few = all_labelled.where("doc_id < 50").withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1))
    assert 0 < urls.labels_of_pages(pages, docs, few).count() < 100


def test_warc(pages, spark):
    folder = warc.new_folder(spark)
    index = warc.write(pages, folder)
    src = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in pages.select("page_id", "url", "html").collect()]
    largest, n = {}, {}
    for i, _, p in src:
        n[p] = n.get(p, 0) + 1
        largest[p] = max([x for x in (largest.get(p), i) if x is not None], default=None)
    want = []
    for i, _, p in src:
        again = largest[p] is not None and i != largest[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", largest[p] if again else None, None if again else p))
    back = warc.read(index, folder)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    some = warc.read(index.where("page_id in (5, 7)"), folder)
    assert {r["page_id"] for r in some.collect()} == {i for i, *_ in src if i in (5, 7)}
    assert index.count() == len(src)


def test_short_payloads_stay(spark):
    folder = warc.new_folder(spark)
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read(warc.write(pages, folder, least=4), folder).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
