import re
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import registry, urls


def plain(pages):
    """page_id -> (host, path, rule, verdict) by plain Python."""
    out, ruled, links, n = {}, {}, Counter(), Counter()
    allowed, blocked = Counter(), Counter()
    for p, url, html in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = re.split("[?#]", rest[cut:])[0]
        best = None
        for r, v in urls.RULES:
            h, _, start = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + start) and (best is None or len(r) > len(best[0])):
                best = (r, v)
        out[p], ruled[p] = (host, path), best
        n[host] += 1
        allowed[host] += bool(best) and best[1] == "allow"
        blocked[host] += bool(best) and best[1] == "block"
        for m in re.finditer(urls.LINK, html or ""):
            to = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
            if host and to != host:
                links[host, to] += 1

    def walk(seed, edges):
        total = Counter()
        for (a, _), k in edges.items():
            total[a] += k
        whole = sum(seed.values())
        rank = {h: s for h, s in seed.items() if s}
        for _ in range(300 if links else 0):
            new = defaultdict(float)
            for (a, b), k in edges.items():
                new[b] += urls.DAMPING * rank.get(a, 0) * k / total[a]
            left = whole - sum(new.values())
            for h, s in seed.items():
                if s:
                    new[h] += left * s / whole
            rank = new
        return rank

    trust = walk({h: allowed[h] / n[h] for h in n}, links)
    distrust = walk({h: blocked[h] / n[h] for h in n}, Counter({(b, a): k for (a, b), k in links.items()}))
    done = {}
    for p, (host, path) in out.items():
        d, t = distrust.get(host, 0), trust.get(host, 0)
        verdict = "block" if d >= urls.LEAST and d > urls.RATIO * t + urls.NEAR else "allow"
        done[p] = (host, path, ruled[p][0] if ruled[p] else None, ruled[p][1] if ruled[p] else verdict)
    return done


def got(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_whole_table(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(registry.op3_url_filter(spark, sf)) == plain(pages)


def test_links_carry_trust_and_distrust(spark):
    a = lambda h: f'<p><a class="x" href="https://{h}/z">t</a>'
    pages = [
        (1, "https://Bad.example.com/en/1", a("other.example.org")), (2, "http://linker.example.org/fr/1", a("BAD.example.com") + a("bad.example.com")), (3, "http://good.example.net/de/1", a("friend.example.org")),
        (4, "http://friend.example.org/fr", a("linker.example.org")), (5, "http://far.example.org/x", '<a href="//linker.example.org/">'), (6, "http://alone.example.org/x?y", None), (7, None, a("bad.example.com")), (8, "no scheme", ""),
        (9, "http://x.example.com?q=1", ""), (10, "http://x.example.com/en/", ""), (11, "http://x.example.com/en/7", ""), (12, "http://notcom/en/", ""), (13, "http://com/en/", "<a href='/en/'>"), (14, "http://x.example.net/de/8/9", ""),
    ]
    df = spark.createDataFrame([(*p, "block") for p in pages], "page_id long, url string, html string, verdict string")
    rows = got(urls.filter_urls(df))
    assert rows == plain(pages)
    assert rows[2][3] == "block" and rows[5][3] == "block" and rows[6][3] == "allow" and rows[7] == ("", "", None, "allow")
    assert rows[11][2:] == ("example.com/en/7", "allow") and rows[14][2:] == ("example.net/de/8", "block")


def test_distrust_goes_up_a_long_chain(spark):
    """A closed ring of hosts keeps its mass; a chain up from a blocked host is blocked as far as the converged rank says."""
    a = lambda h: f'<a href="http://{h}/z">'
    pages = [(0, "http://bad.com/en/", "")] + [(i, f"http://h{i}.example.org/x", a("bad.com" if i == 1 else f"h{i - 1}.example.org")) for i in range(1, 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = plain(pages)
    assert got(urls.filter_urls(df)) == want
    verdicts = [want[i][3] for i in range(1, 40)]
    # 0.85 of the distrust goes on at each host, and what the last one holds comes back: 0.15 * 0.85^i / (0.15 + ...) >= 0.01.
    assert verdicts[:12] == ["block"] * 12 and verdicts[-1] == "allow" and verdicts == sorted(verdicts, reverse=True)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    assert {r[0]: r[1:] for r in con.execute(urls.oracle()).fetchall()} == want


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/x", "h"), (1, "http://a.com/en/x", "h"), (None, None, None)], "page_id long, url string, html string")
    assert urls.filter_urls(df).count() == 3
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, ()).collect()} == {"allow"}


def test_oracle_is_sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.execute("insert into pages values (1, 'http://a.com/en/x', null)")
    assert con.execute(urls.oracle()).fetchall() == [(1, "a.com", "/en/x", "com/en/", "block")]
