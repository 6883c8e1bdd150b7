"""Hand-computed cases of scalars, classifiers and operators."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import ids
from quillmesh.functions import text as T
from quillmesh.operators import atoms, documents, evaluate, graph, memory, parse, ranking, retrieval, scoring, sinks
from quillmesh.operators.sqlgate import Gate
from quillmesh.plans.scalars import dedup_tokens, jaccard


def one(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_names_and_ids(spark):
    assert one(spark, T.canonical_name(F.lit("The Vision-Transformer encoder"))) == "encoder transformer vision"
    for name in ("The Vision-Transformer encoder", "encoder vision transformer"):
        assert one(spark, T.atom_uid(F.lit("method"), F.lit(name), F.lit("s2:x"))) == "0cafd1f81ed4cda0"


@pytest.mark.parametrize("text, quality", [("short text", 0.05), ("We train the encoder with a contrastive objective on images.", 0.727), ("0.91 | 0.88 | 0.77 | 0.65 & 12", 0.05), ("", 0.0), (None, 0.0)])
def test_prose_quality(spark, text, quality):
    assert one(spark, T.prose_quality(F.lit(text).cast("string"))) == quality


@pytest.mark.parametrize("title, text, want", [("References", "any", ("reference", 0.3)), (None, "[12] Smith et al.", ("reference", 0.3)), (None, "$$x=1$$", ("equation_block", 0.5)), (None, "too short", ("prose", 0.05))])
def test_chunk_kind(spark, title, text, want):
    assert tuple(one(spark, T.chunk_kind(F.lit(title).cast("string"), F.lit(text)))) == want


@pytest.mark.parametrize("title, want", [("Model Evaluation", "method"), ("  ABSTRACT ", "abstract"), ("Thanks", "other"), ("Results", "results")])
def test_section_type(spark, title, want):
    assert one(spark, T.section_type(F.lit(title))) == want


@pytest.mark.parametrize("token, want", [("https://arxiv.org/abs/2103.00020v1", "ARXIV:2103.00020"), ("doi:10.1038/x", "DOI:10.1038/x"), ("arxiv:2103.00020v3", "ARXIV:2103.00020"), ("a" * 40, "a" * 40), (" free text ", "free text"), ("https://doi.org/10.1000/AB-c", "DOI:10.1000/AB-c")])
def test_normalize_id(spark, token, want):
    assert one(spark, ids.normalize_id(F.lit(token))) == want


@pytest.mark.parametrize("question, want", [("survey of world models", "global"), ("what loss does it use", "local"), ("hello there", "hybrid"), ("", "hybrid"), (None, "hybrid")])
def test_route(spark, question, want):
    assert one(spark, T.route(F.lit(question).cast("string"))) == want


def test_scores(spark):
    assert round(one(spark, scoring.scholarly(F.lit(100), F.lit(6), F.lit(2020))), 4) == 2.4029
    assert one(spark, scoring.scholarly(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"))) == pytest.approx(0.3 * (1 - 26 / 30))
    for c, role, intent, want in ((0.8, "method_dependency", "method", 0.96), (0.95, "method_dependency", "background", 0.38), (0.9, "theory_dependency", "extends", 1.08), (9.0, "method_dependency", "method", 2.0)):
        assert one(spark, scoring.edge_weight(F.lit(c), F.lit(role), F.lit(intent))) == want


@pytest.mark.parametrize("a, b, similar, inside", [("ViT encoder", "Vision Transformer encoder", 0.25, 0.5), ("Heck coupling", "Heck coupling reaction", 2 / 3, 1.0), ("ImageNet", "ImageNet-21k", 0.5, 1.0)])
def test_token_sets(spark, a, b, similar, inside):
    x, y = dedup_tokens(F.lit(a)), dedup_tokens(F.lit(b))
    assert one(spark, jaccard(x, y)) == pytest.approx(similar)
    assert one(spark, F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))) == pytest.approx(inside)


def test_greedy_absorbs_in_order(spark):
    rows = [(1, "ViT encoder"), (2, "Vision Transformer encoder"), (3, "Heck coupling"), (4, "Heck coupling reaction"), (5, "ImageNet"), (6, "ImageNet-21k")]
    df = spark.createDataFrame(rows, "seq int, name string").select("seq", F.col("seq").cast("string").alias("atom_id"), F.lit("method").alias("category"), dedup_tokens(F.col("name")).alias("tokens"))
    kept = {r.atom_id: r.kept_as for r in atoms.greedy(df, "jaccard").collect()}
    assert kept == {"1": "1", "2": "2", "3": "3", "4": "3", "5": "5", "6": "5"}


def test_greedy_by_vectors(spark):
    rows = [(i, str(i), c, v) for i, (c, v) in enumerate([("data", [1.0, 0.0]), ("data", [0.99, 0.1]), ("data", [0.9, 0.4]), ("data", [0.0, 1.0]), ("method", [1.0, 0.0]), ("method", [1.0, 0.0])])]
    kept = {r.atom_id: r.kept_as for r in atoms.greedy(spark.createDataFrame(rows, "seq int, atom_id string, category string, embedding array<double>"), "cosine").collect()}
    assert kept == {"0": "0", "1": "0", "2": "2", "3": "3", "4": "4", "5": "5"}  # fewer than four of a category: left alone


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"a{i:03}", "xy"[i % 2], sorted(rng.sample("abcdefghij", rng.randint(1, 6)))) for i in range(120)]
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and len(set(p[2]) & set(q[2])) >= 0.6 * len(set(p[2]) | set(q[2]))}
    got = atoms.similar_pairs(spark.createDataFrame(rows, "atom_id string, category string, tokens array<string>"), 0.6)
    assert {tuple(r) for r in got.collect()} == want


def test_similar_pairs_of_equal_sets_are_made_where_they_are_written(spark):
    rng = random.Random(2)
    rows = [(f"a{i:03}", "xy"[i % 2], sorted(rng.sample("abcde", rng.randint(0, 3)))) for i in range(90)]
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1] and p[2] and q[2] and len(set(p[2]) & set(q[2])) >= 0.6 * len(set(p[2]) | set(q[2])))
    got = atoms.similar_pairs(spark.createDataFrame(rows, "atom_id string, category string, tokens array<string>"), 0.6, block=2)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(ids_y") < plan.index("Join") and "Aggregate" not in plan[: plan.index("explode(ids_x")]


def test_named_atoms_and_missing_parameters(spark):
    text = "We use the Adam optimizer on the ImageNet dataset. The Heck reaction follows."
    got = [tuple(x) for x in one(spark, atoms.named(F.lit(text)))]
    assert got == [("procedure", "Adam optimizer"), ("data", "ImageNet dataset"), ("procedure", "The Heck reaction")]
    gaps = atoms.missing_parameters(spark.createDataFrame([(1, "learning rate = 0.001 and dropout was tuned.")], "doc_id int, text string"))
    assert [r.name for r in gaps.collect()] == ["and dropout"]


def test_budget_stays_within_the_rest(spark):
    weights = spark.createDataFrame([(f"p{i:03}", 0.31 + i / 100) for i in range(90)], "paper_id string, weight double")
    rows = atoms.budget(weights, 100).collect()
    assert sum(r.calls for r in rows) == 60 and all(0 < r.calls <= 10 for r in rows)
    assert atoms.budget(weights, 20).count() == 0


def test_roles_and_intents(spark):
    columns = "context string, section_type string, title string, near_equations boolean, near_algorithms boolean, near_tables boolean"
    df = spark.createDataFrame([("We use the encoder of [3], unlike [4].", "method", "Attention network", True, False, False), (None, None, None, None, None, None)], columns)
    first, nothing = df.select(scoring.roles().alias("r"), scoring.intents().alias("i")).collect()
    assert first.r[0].label == "method_dependency" and len(first.r) == 3
    assert sum(x.confidence for x in first.r) <= 1.0
    assert first.i[0].label == "method"
    assert [tuple(x) for x in nothing.r] == [("related_work_only", 0.2)]
    assert [x.label for x in nothing.i] == ["mention"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), st.integers(1, 3), st.integers(1, 8))
def test_diversity_equals_the_loop(spark, papers, cap, limit):
    kept, skipped, n = [], [], {}
    for i, p in enumerate(papers):
        if n.get(p, 0) < cap:
            kept.append(i)
            n[p] = n.get(p, 0) + 1
        else:
            skipped.append(i)
    want = (kept + skipped)[:limit]
    df = spark.createDataFrame(list(enumerate(papers)), "i int, p string")
    assert [r.i for r in ranking.diversify(df, "p", [F.col("i")], cap, limit).collect()] == want


def test_diversity_backfills(spark):
    df = spark.createDataFrame(list(enumerate("aaab")), "i int, p string")
    assert [r.p for r in ranking.diversify(df, "p", [F.col("i")], 2, 4).collect()] == ["a", "a", "b", "a"]


def test_fusion(spark):
    local = spark.createDataFrame([(7, 1.0), (8, 0.5)], "chunk_id long, score double")
    communities = spark.createDataFrame([(1, "chunk", "7", 1)], "community_id int, kind string, item string, place int")
    assert retrieval.fuse(local, communities, 5).first().score == pytest.approx(1 / 60 + 1 / 62, abs=1e-9)


def test_bm25_by_hand(spark):
    texts = ["apple pie", "apple apple tart", "plum", "plum jam", "pear"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.score for r in retrieval.bm25(df, "id", F.col("text"), ["apple"]).collect()}
    lengths = [len(t.split()) for t in texts]
    mean, idf = sum(lengths) / 5, math.log((5 - 2 + 0.5) / 2.5)
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / mean)) for i, tf in ((0, 1), (1, 2))}
    assert got == {i: pytest.approx(w, abs=1e-6) for i, w in want.items()}


@settings(max_examples=8, deadline=None)
@given(st.text(alphabet="ab. !?", max_size=120))
def test_chunker_equals_plain_python(spark, text):
    import re

    def plain(t, target=30, overlap=10):
        t = t.strip(" ")
        if len(t) <= target:
            return [t]
        out, cur, n = [], [], 0
        for s in re.split(r"(?<=[.!?])\s+", t):
            if cur and n + len(s) > target:
                out.append(" ".join(cur).strip(" "))
                tail = out[-1][-overlap:]
                cur = [tail, s] if tail else [s]
                n = sum(map(len, cur))
            else:
                cur.append(s)
                n += len(s) + 1
        out.append(" ".join(cur).strip(" "))
        kept = []
        for w in out:
            if not kept or not (w.startswith(kept[-1][-overlap:]) and w in kept[-1]):
                kept.append(w)
        return kept

    assert one(spark, T.split_overlap(F.lit(text), 30, 10)) == plain(text)


def test_kappa(spark):
    rows = list(zip(("pass", "pass", "fail", "partial"), ("pass", "fail", "fail", "partial"), strict=True))
    df = spark.createDataFrame(rows, "a string, b string")
    assert evaluate.kappa(df, "a", "b").first().kappa == pytest.approx(0.636364, abs=1e-6)
    assert evaluate.kappa(df.limit(0), "a", "b").first().kappa == 0.0
    assert evaluate.kappa(df.filter("a = 'fail'"), "a", "b").first().kappa == 1.0


def test_bootstrap_holds_the_mean(spark):
    scores = spark.createDataFrame([(f"s{i}", "A", i / 20) for i in range(20)] + [("s", "B", 0.5)], "slug string, condition string, score double")
    rows = {r.condition: r for r in evaluate.bootstrap(scores, 800).collect()}
    assert rows["A"].low < 0.475 < rows["A"].high and rows["A"].high - rows["A"].low < 0.4
    assert rows["B"].low == rows["B"].high == 0.5
    assert sorted(evaluate.bootstrap(scores, 800).collect()) == sorted(rows.values())


def arcs(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs], "a string, b string, w double")


def test_paths(spark):
    g = arcs(spark, [("s", "m", 1.0), ("m", "t", 1.0), ("s", "t", 5.0), ("s", "x", 1.0), ("x", "y", 1.0), ("y", "t", 1.5)])
    assert [tuple(r) for r in graph.bounded_paths(g, "s", "t", 3, 3).collect()] == [("s>m>t", 2, 2.0), ("s>x>y>t", 3, 3.5), ("s>t", 1, 5.0)]
    assert [r.path for r in graph.k_shortest(g, "s", "t", 3, 3).collect()] == ["s>m>t", "s>x>y>t", "s>t"]
    assert [r.path for r in graph.k_shortest(g, "s", "t", 3, 2).collect()] == ["s>m>t"]  # the next by weight has too many hops
    assert graph.k_shortest(g, "s", "nowhere", 3, 2).count() == 0


def test_k_shortest_equals_enumeration(spark):
    rng = random.Random(5)
    pairs = [(f"n{i}", f"n{j}", rng.randint(1, 50) / 7) for i in range(9) for j in range(i) if rng.random() < 0.5]
    g = arcs(spark, pairs)
    every = [tuple(r)[:2] for r in graph.bounded_paths(g, "n0", "n8", 8, 6).collect()]
    assert [(r.path, r.hops) for r in graph.k_shortest(g, "n0", "n8", 6, 8).collect()] == every


def test_paths_are_searched_among_their_own_arcs(spark):
    """Arcs that no path of so many hops takes are left out; parallel ones and repeats count once, by the lightest."""
    far = [(f"far{i}", f"far{i + 1}", 0.1) for i in range(50)]
    pairs = [("s", "m", 1.0), ("s", "m", 3.0), ("s", "m", 1.0), ("m", "t", 1.0), ("s", "x", 1.0), ("x", "y", 1.0), ("y", "t", 1.5), ("t", "far0", 0.1), ("s", "far9", 0.1)]
    g = arcs(spark, pairs + far)
    assert {tuple(r) for r in graph.within(g, "s", "t", 1).collect()} == set()
    near = {(r.a, r.b): r.w for r in graph.within(g, "s", "t", 3).collect()}
    assert near["s", "m"] == 1.0 and {("m", "t"), ("s", "x"), ("x", "y"), ("y", "t")} <= set(near) and len(near) < 15
    assert [tuple(r) for r in graph.k_shortest(g, "s", "t", 3, 3).collect()] == [(0, "s>m>t", 2, 2.0), (1, "s>x>y>t", 3, 3.5)]
    assert [tuple(r) for r in graph.bounded_paths(g, "s", "t", 3, 3).collect()] == [("s>m>t", 2, 2.0), ("s>x>y>t", 3, 3.5)]


def test_references_are_resolved_by_sets_of_tokens(spark):
    rng = random.Random(3)
    titles = [(i, sorted(rng.sample("abcdefghijkl", rng.randint(0, 10)))) for i in range(160)]
    refs, records = titles[::4], [t for t in titles if t[0] % 4] + [(500, ["a", "b", "c"]), (499, ["a", "b", "c"])]
    want = {}
    for ref, x in refs:
        found = [record for record, y in records if len(set(x) & set(y)) >= max(3, len(x) // 2)]
        if found:
            want[ref] = min(found)
    got = scoring.resolved(spark.createDataFrame(refs, "ref long, tokens array<string>"), spark.createDataFrame(records, "record long, tokens array<string>"))
    assert {r.ref: r.record for r in got.collect()} == want and len(want) > 10


def test_shared_pairs_equal_brute_force(spark):
    """Repeats of a use count once; papers may be numbers; pairs are shuffled as lists."""
    rng = random.Random(4)
    category = {a: "xyz"[a % 3] for a in range(30)}
    uses = [(rng.randrange(30), rng.randrange(12)) for _ in range(200)]
    usage, items = spark.createDataFrame(uses + uses[:50], "atom_id long, paper_id long"), spark.createDataFrame(list(category.items()), "atom_id long, category string")
    for least in (2, 3):
        want = {}
        for k in "xyz":
            for x in range(12):
                for y in range(x + 1, 12):
                    n = len({a for a, p in uses if p == x and category[a] == k} & {a for a, p in uses if p == y and category[a] == k})
                    if n >= least:
                        want[k, x, y] = n
        assert {tuple(r)[:3]: r.shared for r in graph.shared_pairs(usage, items, "category", least).collect()} == want and want


def test_inputs_are_expanded_without_a_frame_for_each_document(spark):
    files = spark.createDataFrame([(i, n, t) for i in range(40) for n, t in (("main", "A \\input{part.tex} \\include{main}"), ("part", f"B{i}"))] + [(99, "other", "x")], "doc_id long, name string, text string")
    got = parse.expand_inputs(files)
    assert {r.doc_id: r.text for r in got.collect()} == {99: ""} | {i: f"A B{i} " for i in range(40)}
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_union_of_uses_is_made_distinct_once_by_numbers(spark, sf):
    from quillmesh.plans import catalogue

    plan = catalogue.queries()["set_union_distinct"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and re.search(r"Aggregate \[atom_id#\d+L, paper_id#\d+L\]", plan)


def test_promotion_counts_each_thing_by_itself(spark):
    rng = random.Random(6)
    used, areas, spans = ([(rng.randrange(9), rng.randrange(n)) for _ in range(k)] for n, k in ((6, 25), (4, 12), (9, 25)))
    want = {}
    for answer in range(9):
        a = {x for p, x in used if p == answer}
        c, s = {y for x, y in areas if x in a}, {x for p, x in spans if p == answer}
        if len(a) >= 2 and len(c) >= 2 or len(s) >= 3:
            want[answer] = (len(a), len(c), len(s))
    got = evaluate.promoted(spark.createDataFrame(used, "answer long, atom_id long"), spark.createDataFrame(areas, "atom_id long, community_id long"), spark.createDataFrame(spans, "answer long, chunk long"))
    assert {r.answer: tuple(r)[1:] for r in got.collect()} == want and want
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_quality_is_asked_of_listed_chunks_alone(spark):
    rows = [(i, "p", "apple" if i % 9 == 0 else "pear pie") for i in range(60)]
    asked = F.lit(1.0) / (F.col("chunk_id") - 7)  # fails of chunk 7, which is on no list
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_id string, text string").select("*", asked.alias("quality"), F.lit("prose").alias("chunk_kind"))
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(60)], "chunk_id long, embedding array<float>")
    found = retrieval.match(chunks, vectors, ["apple"], [59.0, 0.0], 6)
    got = {r.chunk_id for r in retrieval.candidates(found, 2).collect()}
    assert {0, 9, 18, 59, 58} <= got and 7 not in got


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i % 30, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(6)))) for i in range(36)]
    want = {}
    for term in ("ab", "cd", "ef", "gh"):
        want[term] = (len({k for k, t in rows if term in t.split()}), sum(t.split().count(term) for _, t in rows))
    items, repeated = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame([(i,) for i in range(6)], "k long")
    assert {r.term: (r.df, r.tf) for r in retrieval.vocabulary(items, "k", F.col("text"), repeated).collect()} == want
    own = retrieval.vocabulary(items.filter("k >= 6"), "k", F.col("text"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert {r.term: r.df for r in own.collect()} == {x: sum(x in t.split() for k, t in rows if k >= 6) for x in want}


def test_breadth_first(spark):
    g = arcs(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "c", 1.0)])
    assert {r.node: r.hop for r in graph.breadth_first(g, "a", 2, 10).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node for r in graph.breadth_first(g, "a", 1, 1).collect()} == {"a", "b"}


def two_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 0.1)]
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "paper_a string, paper_b string, weight double")


def test_communities(spark):
    pairs = two_cliques(spark)
    for labels in (graph.louvain(pairs), graph.label_propagation(pairs)):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.community, set()).add(r.node[0])
        assert sorted(map(sorted, groups.values())) == [["x"], ["y"]]
    one_ = graph.modularity(pairs, graph.louvain(pairs)).first().modularity
    assert one_ >= graph.modularity(pairs, graph.label_propagation(pairs)).first().modularity - 1e-9
    assert one_ > 0.45
    assert sorted(graph.louvain(pairs).collect()) == sorted(graph.louvain(pairs).collect())


def test_gate(spark):
    gate = Gate(spark, {"numbers": spark.range(10)})
    assert gate.run("SELECT count(*) AS n FROM numbers WHERE id >= ?;", [4]) == {"columns": ["n"], "rows": [{"n": 6}], "truncated": False}
    assert gate.run("with a as (select id from numbers) select * from a", limit=3)["truncated"]
    for sql in ("DROP TABLE numbers", "select 1; select 2", "select ';'", "insert into numbers values (1)", "with a as (select 1) insert into x select * from a", "select nothing from numbers", "selec 1"):
        assert set(gate.run(sql)) == {"error"}


def test_decisions_round_trip(spark):
    df = spark.createDataFrame([("2026-05-19T14:32Z", "a-b", "yes: really", "")], "t string, s string, d string, r string")
    text = df.select(memory.decision_entry(F.col("t"), F.col("s"), {"Decision": F.col("d"), "Why": F.col("r")}).alias("text"))
    row = memory.parse_decisions(text).first()
    assert (row.timestamp, row.slug, row.body) == ("2026-05-19T14:32Z", "a-b", {"Decision": "yes: really", "Why": ""})
    assert memory.parse_decisions(spark.createDataFrame([("no heading",)], "text string")).count() == 0


def test_since_is_a_string_comparison(spark):
    assert one(spark, F.lit("2026-05-19T14:32Z") >= "2026-05-19")


def test_session_notes(spark):
    note = spark.createDataFrame([(1, "n.md", "# Session x\n\n## Done\n- a\n\n## Next\n- b\n")], "conv_id int, name string, text string")
    grown = memory.append_bullet(memory.append_bullet(note, "Done", F.lit("c")), "Open", F.lit("d"))
    assert [(r.section, r.item) for r in memory.parse_sessions(grown).orderBy("section", "place").collect()] == [("Done", "- a"), ("Done", "- c"), ("Next", "- b"), ("Open", "- d")]


def test_tex(spark):
    df = spark.createDataFrame([(1, "x % gone\n5\\% kept")], "doc_id long, text string")
    assert df.select(parse.strip_comments(F.col("text")).alias("t")).first().t == "x \n5\\% kept"
    doc = spark.createDataFrame([(1, "\\begin{document}pre\n\n\\section{A}\none \\cite{k,l}\n\n$$x$$\n\\section{B}two\\end{document} after")], "doc_id long, text string")
    rows = [(r.kind, r.id, r.text) for r in parse.tex_document(doc).collect()]
    assert rows == [("paragraph", "sec-0-p1", "pre"), ("section", "sec-1", "A"), ("citation", "k", "sec-1-p1"), ("citation", "l", "sec-1-p1"), ("paragraph", "sec-1-p1", "one [cite]"), ("equation", "eq-1", "x"), ("section", "sec-2", "B"), ("paragraph", "sec-2-p1", "two")]
    files = spark.createDataFrame([(1, "main", "a \\input{b.tex} \\include{main} \\input{none}"), (1, "b", "B \\input{c}"), (1, "c", "C \\input{b}")], "doc_id long, name string, text string")
    assert parse.expand_inputs(files).first().text.split() == ["a", "B", "C"]
    bib = spark.createDataFrame([(1, '@article{k1, title = {A {Nested} one}, year = {1999}}\n@book{k2, author="Doe, J"}')], "doc_id long, text string")
    assert [(r.key, r.raw) for r in parse.bib_entries(bib).collect()] == [("k1", "title={A {Nested} one} year={1999}"), ("k2", "author={Doe, J}")]


def test_small_parsers(spark):
    assert one(spark, parse.last_names(F.lit("Doe, Jane and John O'Neil; Ann Lee"))) == ["doe", "oneil", "lee"]
    assert one(spark, parse.bib_fields(F.lit("title={A} TITLE = {B} year={1} x={y}"))) == {"title": "B", "year": "1"}
    for text, want in (('say {"a": 1} now', '{"a": 1}'), ("{broken", None), ("no", None), ("} {", None), ("{x}", None)):
        assert one(spark, parse.json_object(F.lit(text))) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    sinks.write_tables({"t": df}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    sinks.write_partition(df, f"{tmp_path}/p", "k")
    sinks.write_partition(spark.createDataFrame([(3, "b")], "id int, k string"), f"{tmp_path}/p", "k")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [1, 3]
    for _ in range(2):
        sinks.write_text(df, "k", f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 4
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert sinks.manifest({"t": df}).first().manifest == '{"t":2}'


def test_graph_shortest_uses_every_arc(spark, sf):
    """The registered query against brute force over citations, definitions and usage."""
    from quillmesh.plans import catalogue
    from quillmesh.sources.corpus import Corpus

    c, arcs = Corpus(spark, sf), {}

    def add(a, b, w):
        for x, y in ((a, b), (b, a)):
            arcs.setdefault(x, {})[y] = min(w, arcs.get(x, {}).get(y, w))

    for r in c.edges.select("from_paper", "to_paper", "confidence").collect():
        add(r.from_paper, r.to_paper, 1 / max(0.1, r.confidence or 0.5))
    for r in c.atoms.select("atom_id", "defined_by").collect():
        add(r.atom_id, r.defined_by, 0.5)
    for r in c.usage.collect():
        add(r.atom_id, r.paper_id, 0.8)
    found = []

    def walk(path, weight):
        if path[-1] == "d:9":
            found.append((round(weight, 6), ">".join(path), len(path) - 1))
        elif len(path) == 4:  # the last hop can only be to the goal
            if "d:9" in arcs[path[-1]]:
                walk([*path, "d:9"], weight + arcs[path[-1]]["d:9"])
        else:
            for y, w in arcs[path[-1]].items():
                if y not in path:
                    walk([*path, y], weight + w)

    walk(["d:5"], 0.0)
    want = [(path, hops, weight) for weight, path, hops in sorted(found)[:3]]
    assert [tuple(r) for r in catalogue.queries()["graph_shortest"](spark, sf).collect()] == want


def test_subset_search_filters_before_it_cuts(spark):
    """Hits of a small set of papers are found though a corpus-wide list of the best would hold none of them."""
    rows = [(i, f"p{i}", "apple apple apple", 1.0, "prose") for i in range(60)] + [(100 + i, f"q{i}", "apple and many other words that make it a weaker hit for the question", 0.5, "prose") for i in range(4)]
    chunks = spark.createDataFrame(rows, "chunk_id long, paper_id string, text string, quality double, chunk_kind string")
    vectors = spark.createDataFrame([(r[0], [float(r[0]), 0.0]) for r in rows], "chunk_id long, embedding array<float>")
    found = retrieval.match(chunks, vectors, ["apple"], [0.0, 0.0], 24)
    inside = retrieval.in_papers(found, spark.createDataFrame([(1, "q0"), (1, "q2"), (2, "q3"), (2, "p1")], "s int, paper_id string"), 3, "s").collect()
    assert [(r.s, r.chunk_id) for r in sorted(inside, key=lambda r: (r.s, r.place))] == [(1, 100), (1, 102), (2, 1), (2, 103)]
    assert {r.chunk_id for r in retrieval.candidates(found, 8).collect()} <= set(range(60))


def test_communities_by_vectors_else_by_label_and_summary(spark):
    communities = spark.createDataFrame([(1, "Around apples", "pears too"), (2, "Around steel", "apples never"), (3, "x", None)], "community_id int, label string, summary string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "community_id long, embedding array<float>")
    assert [r.community_id for r in retrieval.top_communities(communities, vectors, ["apples"], [1.0, 0.1], 2).collect()] == [2, 1]
    assert [tuple(r) for r in retrieval.top_communities(communities, vectors.limit(0), ["apples", "pears"], [1.0, 0.1], 2).collect()] == [(1, 0.5), (2, 1.0)]


def test_atoms_are_found_by_their_evidence_and_a_whole_phrase(spark):
    made = spark.createDataFrame([("a1", "Ring Loss", "loss", "pulls things"), ("a2", "Other", "method", "a plain thing"), ("a3", "Third", "method", "nothing"), ("a4", "Fourth", "method", "more")], "atom_id string, name string, category string, description string")
    evidence = spark.createDataFrame([("e1", "a2", "it uses zebra_stripes here"), ("e2", "a2", None)], "evidence_id string, atom_id string, verbatim string")
    vectors = spark.createDataFrame([], "atom_id string, embedding array<float>")
    assert [r.atom_id for r in retrieval.find_atoms(made, evidence, vectors, ["zebra_stripes"], [0.0], 5).collect()] == ["a2"]
    assert [r.atom_id for r in retrieval.find_atoms(made, evidence, vectors, ["ing", "loss"], [0.0], 5, "ng loss").collect()] != []
    assert [(r.atom_id, r.score) for r in retrieval.find_atoms(made, evidence, vectors, ["lain", "thi"], [0.0], 5, "lain thi").collect()] == [("a2", 1.0)]


def test_atoms_without_vectors_are_kept_and_chains_resolved(spark):
    items = spark.createDataFrame([("a1", 1, "m", "red fast car"), ("a2", 2, "m", "red fast car"), ("a3", 3, "m", "red fast car engine"), ("a4", 4, "m", "blue boat"), ("a5", 5, "n", "red fast car")], "atom_id string, seq int, category string, name string")
    vectors = spark.createDataFrame([("a1", [1.0, 0.0])], "atom_id string, embedding array<float>")
    words = F.split("name", " ")
    homes = {r.atom_id: r.kept_as for r in atoms.deduplicated(items, vectors, words, words).collect()}
    assert homes == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a4", "a5": "a5"}


def test_long_chains_get_their_layers(spark):
    from quillmesh.operators.order import layers

    items = spark.createDataFrame([(f"n{i}",) for i in range(104)] + [("x",), ("y",)], "atom_id string")
    needs = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 104)] + [("x", "y"), ("y", "x")], "atom_id string, needs string")
    assert {r.atom_id: r.layer for r in layers(items, needs).collect()} == {f"n{i}": i for i in range(104)} | {"x": None, "y": None}


def test_evidence_gate_and_protected_paths(spark):
    papers = spark.createDataFrame([("p1", True, "arxiv")], "paper_id string, acquired boolean, acquired_via string")
    made = spark.createDataFrame([("a1", "p1")], "atom_id string, defined_by string")
    spans = spark.createDataFrame([("p1", "p-0"), ("p1", "p-9")], "paper_id string, paragraph_id string")
    chunks = spark.createDataFrame([("p1", "p-0"), ("p1", "p-1")], "paper_id string, paragraph_id string")
    gate = lambda e: {r.gate: (r.passed, r.hard) for r in evaluate.gates(papers, made, e, chunks).collect()}["evidence"]
    assert gate(spans) == (False, True) and gate(spans.limit(1)) == (True, True) and gate(spans.limit(0)) == (False, False)
    calls = spark.createDataFrame([("Read", "/r/research/graph.json"), ("Edit", "/r/research/graph.json"), ("Grep", "src/graph.json"), ("Glob", None), (None, "research/research.db")], "tool string, path string")
    assert [r.blocked for r in evaluate.path_policy(calls).collect()] == [True, False, False, False, False]


def test_tables_references_equations_and_backends(spark):
    items = spark.createDataFrame(
        [(1, 0, "section_header", "A", None, None, None, None), (1, 1, "table", None, "", ["Table 1:", "sizes"], "old", [[("a",), ("b",)], [("1",), (None,)]]), (1, 2, "table", None, "said itself", None, None, None), (2, 0, "table", None, None, None, "plain", [])],
        "doc_id long, at int, label string, text string, caption_text string, captions array<string>, caption string, grid array<array<struct<text: string>>>",
    )
    assert sorted(tuple(r) for r in documents.tables(items).collect()) == [(1, "tab-1", "sec-1", "Table 1: sizes", [["a", "b"], ["1", ""]]), (1, "tab-2", "sec-1", "said itself", None), (2, "tab-1", None, "plain", None)]
    files = spark.createDataFrame([(1, "$$ x $$ first\n# One\ntext $$a=b$$ and $$c$$\n## References\nSmith 2020\n\n$$no$$ Jones\n# After\n$$d$$"), (2, "none")], "doc_id long, text string")
    assert sorted(tuple(r) for r in documents.markdown_references(files).collect()) == [(1, "ref-1", "[1]", "Smith 2020"), (1, "ref-2", "[2]", "$$no$$ Jones")]
    assert sorted(tuple(r) for r in documents.markdown_equations(files).collect()) == [(1, "eq-1", None, "x"), (1, "eq-2", "sec-1", "a=b"), (1, "eq-3", "sec-1", "c"), (1, "eq-4", "sec-3", "d")]
    kinds = spark.createDataFrame([(1, "pdf", "one"), (2, "pdf", "two"), (3, "tex", "one"), (4, "pdf", "none")], "doc_id long, kind string, text string")
    only = lambda word: lambda df: df.filter(F.col("text") == word).select("doc_id", F.col("text").alias("body"))
    rows = documents.parsed_in_turn(kinds, [("first", "pdf", only("one")), ("second", "pdf", lambda df: df.filter("text <> 'none'").select("doc_id", F.col("text").alias("body")))]).collect()
    assert sorted((r.doc_id, r.backend, r.body) for r in rows if r.backend) == [(1, "first", "one"), (2, "second", "two")] and sorted(r.doc_id for r in rows if not r.backend) == [3, 4]


def test_model_grades(spark):
    leaves = spark.createDataFrame([(x,) for x in "abcde"], "leaf_id string")
    answers = spark.createDataFrame([("a", 'So: {"status": "pass", "rationale": "' + "r" * 300 + '"} end'), ("b", "no object"), ("c", "{broken} }"), ("d", '{"rationale": 1}')], "leaf_id string, answer string")
    got = {r.leaf_id: (r.status, r.rationale) for r in documents.graded(leaves, answers).collect()}
    assert got == {"a": ("pass", "r" * 200), "b": ("fail", "grader did not return JSON"), "c": ("fail", "json decode failed"), "d": ("fail", "1"), "e": ("fail", "grader did not return JSON")}
