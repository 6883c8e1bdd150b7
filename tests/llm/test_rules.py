import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import registry, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def counted(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert counted(r) == plain(texts[r.doc_id])
        n, *_, repeat = counted(r)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [k for i, k in kept.items() if labels.get(i) == 1]
    bad = [k for i, k in kept.items() if labels.get(i) == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02


def test_edge_cases(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\n\nx\n x\n", "é|<>\n\x0b\x0cé", "𝒳 # 𝒳", "w " * 30_000, " ".join(rng.choice("abc") for _ in range(3000))]
    docs = spark.createDataFrame([(i, t, None, "s", 3) for i, t in enumerate(texts)] + [(None, "a b", "en", None, 3)] * 2, "doc_id long, text string, lang string, source string, kept int")
    rows = rules.judge(docs).collect()
    assert len(rows) == len(texts) + 2
    assert all(counted(r) == plain(texts[r.doc_id]) for r in rows if r.doc_id is not None)
    assert rules.judge(docs.limit(0)).count() == 0


def matrices(row):
    lower = np.array([[row[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    return np.array([row[f"m{i}"] for i in range(4)]), lower @ lower.T


def far_from(x, m, c):
    z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
    return (z * z).sum(axis=0)


def plain_estimate(x, begin):
    """Minimum covariance determinant of one group by numpy, from the given starts (in order)."""
    floor = np.diag(np.square(rules.FLOOR))
    half = lambda d: np.sort(b := np.minimum(rules.BUCKETS - 1, np.floor(np.log1p(d) / rules.STEP)))[int(np.ceil(rules.SHARE * len(b))) - 1]
    of = lambda y: (y.mean(axis=0), np.cov(y.T, bias=True) + floor)
    det = lambda c: np.linalg.slogdet(c)[1]

    def step(m, c):
        d = far_from(x, m, c)
        return of(x[np.floor(np.log1p(d) / rules.STEP) <= half(d)])

    tried = []
    for m, c in begin:
        for _ in range(2):
            m, c = step(m, c)
        tried.append((m, c))
    m, c = min(tried, key=lambda t: det(t[1]))
    while det((new := step(m, c))[1]) < det(c) - 1e-3:
        m, c = new
    d = far_from(x, m, c)
    scale = max(1.0, np.expm1((half(d) + 1) * rules.STEP) / rules.CHI_MEDIAN)
    m, c = of(x[d <= rules.CHI_975 * scale])
    return m, c * rules.WITHIN_975


def test_kept_against_numpy_for_a_whole_table(spark):
    """Every row's verdict, restated from counts: groups, medians, starts' steps, determinants, distances, cutoffs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 4 <> 1")
    got = rules.judge(docs).collect()
    rows = [r for r in rules.vectors(rules.counts(docs)).collect()]
    fine = [r for r in rows if not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)]
    pairs, langs = Counter((r.lang, r.source) for r in fine), Counter(r.lang for r in fine)
    group = lambda r: (r.lang, r.source) if pairs[r.lang, r.source] >= 50 else (r.lang,) if langs[r.lang] >= 50 else ()
    assert len({group(r) for r in fine if len(group(r)) == 2}) > 20 and any(len(group(r)) == 1 for r in fine)
    width = rules.STEP / 4
    spread = rules._spread(rules.vectors(rules.counts(docs)).filter(~rules.base_failed()), rules._groups(rules.vectors(rules.counts(docs))))
    begin = {}
    for r in rules.starts(rules.centred(spread)).orderBy("g", "s").collect():
        begin.setdefault(r.g, []).append(matrices(r))
    want = {}
    for g in {group(r) for r in fine}:
        inside = [r for r in fine if (r.lang, r.source)[: len(g)] == g]
        lengths = np.sort(np.floor(np.array([r.u for r in inside]) / width))
        middle = (lengths[int(np.ceil(0.5 * len(lengths))) - 1] + 1) * width
        vector = lambda r, middle=middle: [r.v * (r.u - middle), r.x1, r.x2, r.x3]
        m, c = plain_estimate(np.array([vector(r) for r in inside]), begin["\0".join(("l:" + g[0], "s:" + g[1])) if len(g) == 2 else "l:" + g[0]])
        mine = [r for r in fine if group(r) == g]
        limit = rules.CHI_999 * np.exp(547 / len(inside) ** 1.6)
        for r, d in zip(mine, far_from(np.array([vector(r) for r in mine]), m, c), strict=True):
            want[r.doc_id] = (d <= limit, d)
    assert {r.doc_id for r in got if not r.base_failed} == set(want)
    for r in got:
        if not r.base_failed:
            assert abs(r.distance - want[r.doc_id][1]) < 1e-6 * (1 + r.distance) and r.kept == want[r.doc_id][0]


def test_estimate_is_robust(spark):
    """A third of a group lies far off; the estimate follows the rest, and all of the third is beyond the cutoff."""
    rng = np.random.default_rng(5)
    good = rng.normal(size=(800, 4)) @ np.array([[0.5, 0.3, 0, 0], [0, 0.4, 0.1, 0], [0, 0, 0.6, 0.2], [0, 0, 0, 0.5]]) + 1
    x = np.vstack([good, rng.normal(9, 0.1, (400, 4))])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    shape = rules.estimate(df)
    row = shape.first()
    m, c = matrices(row)
    assert row.n == 1200 and np.allclose(m, good.mean(axis=0), atol=0.12) and np.allclose(c, np.cov(good.T), atol=0.15)
    far = np.array([r.d2 for r in rules.distances(df.join(shape, "g")).select("x0", "x1", "x2", "x3", "d2").collect()])
    assert np.allclose(np.sort(far), np.sort(far_from(x, m, c)), rtol=1e-6)
    assert (far[:800] <= rules.CHI_999 * 1.1).mean() > 0.99 and (far > 100).sum() == 400


def test_a_third_of_a_group_is_junk(spark):
    """Up to 45 % of a group is spread like bad documents; all of it is beyond the cutoff, and hardly any of the rest."""
    rng = np.random.default_rng(6)
    for bad in (300, 490):
        x = np.vstack([rng.normal(0, [0.05, 0.02, 0.1, 0.1], (600, 4)), rng.normal(1, [0.05, 0.02, 0.1, 0.1], (bad, 4))])
        df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], "g string, i int, x0 double, x1 double, x2 double, x3 double")
        far = rules.distances(df.join(rules.estimate(df.drop("i")), "g")).filter(F.col("d2") > rules.cutoff(F.col("n")))
        found = {r.i for r in far.collect()}
        assert found >= set(range(600, 600 + bad)) and len(found) <= bad + 5


def test_a_small_group_has_a_wider_cutoff(spark):
    row = spark.range(1).select(*[rules.cutoff(F.lit(n)).alias(f"n{n}") for n in (50, 100, 1000, 10**9)]).first()
    assert row.n50 > 2.5 * rules.CHI_999 and 1.3 < row.n100 / rules.CHI_999 < 1.5 and row.n1000 < 1.02 * rules.CHI_999


def test_rows_that_fail_base_rules_do_not_make_a_group(spark):
    """A source of 150 rows of which 5 pass, all alike, is judged by its language's other documents."""
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    good = [(i, " ".join(words(80)), "en", "good") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(80)), "en", "junk") for i in range(5)]
    short = [(2000 + i, "too short", "en", "junk") for i in range(145)]
    rows = rules.judge(spark.createDataFrame(good + junk + short, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(r.doc_id for r in rows if r.kept) == list(range(200))
    assert len(rows) == 350 and sum(r.distance is not None for r in rows) == 350
