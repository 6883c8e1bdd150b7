import io
import json
import os
import sqlite3
import urllib.error

import pytest

from quillmesh.sources import api, config
from quillmesh.sources.sqlite import SqliteSource


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute('create table "my t" (id integer primary key, name text, score real, raw blob, odd)')
        con.executemany('insert into "my t" values (?, ?, ?, ?, ?)', [(i, f"n{i}" if i % 3 else None, i / 2, bytes([i % 256]), i) for i in range(1, 101)])
        con.execute("create table empty (a text)")
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "my t").load()
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double"), ("raw", "binary"), ("odd", "string")]
    assert df.rdd.getNumPartitions() == 4
    got = {r.id: r for r in df.collect()}
    assert len(got) == 100 and got[3].name is None and got[7].score == 3.5 and bytes(got[9].raw) == b"\x09" and got[5].odd == "5"
    assert spark.read.format("sqlite").option("path", path).option("table", "empty").load().count() == 0


def test_token_bucket_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = api.TokenBucket(2.0, lambda: now[0], sleep)
    for _ in range(3):
        bucket.acquire()
    assert slept == [0.5, 0.5]


def failing(codes):
    calls = []

    def opener(url, body, headers):
        calls.append((url, body))
        code = codes.pop(0) if codes else 200
        if code != 200:
            raise urllib.error.HTTPError(url, code, "x", {}, io.BytesIO())
        return json.dumps({"data": [1], "url": url}).encode()

    return opener, calls


def test_client_tries_again_and_caches(tmp_path):
    opener, calls = failing([429, 503])
    client = api.Client("http://x/", api.JsonCache(tmp_path), 1e6, opener=opener, sleep=lambda s: None)
    assert client.get("p", fields="a,b")["data"] == [1] and len(calls) == 3
    assert client.get("p", fields="a,b")["data"] == [1] and len(calls) == 3
    assert calls[-1][0] == "http://x/p?fields=a%2Cb"
    assert api.Client("http://x", None, 1e6, opener=failing([404])[0]).get("q") is None
    with pytest.raises(urllib.error.HTTPError):
        api.Client("http://x", None, 1e6, opener=failing([400])[0]).get("q")
    with pytest.raises(urllib.error.HTTPError):
        api.Client("http://x", None, 1e6, tries=2, opener=failing([500, 500])[0], sleep=lambda s: None).get("q")


def test_batches_and_pages():
    sent = []

    def opener(url, body, headers):
        if body:
            ids = json.loads(body)["ids"]
            sent.append(len(ids))
            return json.dumps(ids).encode()
        offset = int(url.split("offset=")[1].split("&")[0])
        return json.dumps({"data": [offset], "next": offset + 1 if offset < 2 else None}).encode()

    client = api.Client("http://x", None, 1e6, opener=opener)
    assert list(client.batch("b", [str(i) for i in range(5)], 2)) == list("01234") and sent == [2, 2, 1]
    assert list(client.pages("l")) == [0, 1, 2]


def test_cache_forgets(tmp_path):
    cache = api.JsonCache(tmp_path, days=1)
    cache.put("k", {"a": 1})
    assert cache.get("k") == {"a": 1} and cache.get("other") is None
    os.utime(cache.path("k"), (0, 0))
    assert cache.get("k") is None


def test_registry_and_first_success():
    registry = api.Registry()
    registry.register("none")(lambda c: lambda r: None)
    registry.register("some")(lambda c: lambda r: b"%PDF-1.4")

    @registry.register("broken")
    def broken(c):
        raise RuntimeError("no key")

    found, skipped = registry.enabled(["none", "broken", "absent", "some"], None)
    assert [n for n, _ in found] == ["none", "some"] and len(skipped) == 2
    assert api.acquire(found, {}) == ("some", b"%PDF-1.4") and api.acquire(found[:1], {}) is None
    assert [api.kind_of(x) for x in (b"%PDF", b"\x1f\x8b", b"<html>")] == ["pdf", "gzip", "other"]


def test_links_in_order():
    record = {"openAccessPdf": {"url": "own"}, "best_oa_location": {"pdf_url": "best"}, "link": [{"URL": "html", "content-type": "text/html"}, {"URL": "pdf", "content-type": "application/pdf"}, {"URL": "tdm", "intended-application": "text-mining"}, {"URL": "own"}]}
    assert api.open_access_link(record) == ["own", "best", "tdm", "pdf", "html"]
    assert api.open_access_link({}) == []


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[compile]\nmax_papers = 7\nodd = 1\n[cache]\nfolder = "x"\n[unknown]\na = 1\n')
    c = config.load([tmp_path / "absent.toml", tmp_path / "c.toml"], {"compile.top_k": "3", "cache.days": "2"})
    assert (c.compile.max_papers, c.compile.top_k, c.cache.folder, c.cache.days) == (7, 3, "x", 2.0)
    with pytest.raises(KeyError):
        config.load([], {"compile.odd": 1})
