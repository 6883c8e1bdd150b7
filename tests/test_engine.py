import datetime as dt
import json

import pytest

from quillmesh import compile as C
from quillmesh.engine import Engine
from quillmesh.sources.schemas import TABLES

TARGET = "s2:t"


def paper(ident, title, sections, references=(), year=2020, **more):
    return {
        "schema_version": "1.0", "paper_id": ident, "metadata": {"title": title, "year": year, "authors": [{"name": "Ann Lee"}], "venue": "V", "abstract": "abs"}, "acquisition": {"source": "arxiv", "fetched_at": "2026-01-01T00:00Z"},
        "sections": [{"id": f"sec-{i}", "title": t, "level": 1, "section_type": "other", "paragraphs": [{"id": f"sec-{i}-p{j}", "text": text, "citations": [{"marker": f"[{c}]", "ref_id": f"ref-{c}", "context_window": text} for c in cites], "equation_refs": ["eq-1"] if j == 0 else []} for j, (text, cites) in enumerate(ps)]} for i, (t, ps) in enumerate(sections)],
        "equations": [{"id": "eq-1", "latex": r"\alpha_t = 1", "section_id": "sec-1"}], "tables": [{"id": "tab-1", "caption": "Scores of all models", "section_id": "sec-1"}], "figures": [],
        "references": [{"ref_id": f"ref-{k}", "marker": f"[{k}]", "raw": "x", "resolved_paper_id": v} for k, v in references], "citation_count": 10, "influential_count": 6, **more,
    }


PAPERS = [
    paper(TARGET, "A world model", [("Introduction", [("We survey recent work on latent models and related prior work in the field.", [2])]), ("Our Method", [("We use the Adam optimizer and a Vision Transformer encoder to train the network on the ImageNet dataset.", [1]), ("The contrastive loss is described at length. learning rate = 0.1 and dropout was tuned.", [1])])], [(1, "s2:a"), (2, "s2:b"), (3, "s2:c")]),
    paper("s2:a", "Adam optimizer training", [("Method", [("The Adam optimizer adapts the step for every weight of the network in turn.", [1])])], [(1, "s2:b")]),
    paper("s2:b", "ImageNet dataset", [("Experiments", [("We measure accuracy on the ImageNet dataset and report the score of each baseline.", [])])]),
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "ir.json").write_text("\n".join(map(json.dumps, PAPERS)))
    C.build(spark, C.load_ir(spark, str(folder / "ir.json")), TARGET, str(folder / "out"))
    return folder


@pytest.fixture(scope="module")
def engine(spark, built):
    return Engine(spark, str(built / "out"))


def test_tables(engine):
    papers = {r.paper_id: r for r in engine.t["papers"].collect()}
    assert set(papers) == {TARGET, "s2:a", "s2:b", "s2:c"}
    assert (papers[TARGET].rank, papers[TARGET].depth, papers["s2:a"].depth) == (1.0, 0, 1)
    assert not papers["s2:c"].acquired and papers["s2:a"].acquired_via == "arxiv"
    edges = {r.edge_id: r for r in engine.t["edges"].collect()}
    assert set(edges) == {"s2:t::s2:b::1", "s2:t::s2:a::1", "s2:t::s2:a::2", "s2:t::s2:c::ref", "s2:a::s2:b::1"}
    assert edges["s2:t::s2:c::ref"].provenance_rule == "bib_resolve" and edges["s2:t::s2:a::1"].provenance_rule == "inline_cite_match"
    assert all(0 <= e.weight <= 2 and 0 < e.confidence <= 0.95 for e in edges.values())
    names = {r.name: r for r in engine.t["atoms"].collect()}
    assert {"Adam optimizer", "Vision Transformer encoder", "ImageNet dataset"} <= set(names)
    kinds = {r.chunk_kind for r in engine.t["chunks"].collect()}
    assert kinds == {"prose", "table", "equation_block"}
    ords = {}
    for r in engine.t["chunks"].collect():
        ords.setdefault(r.paper_id, []).append(r.ord)
    assert all(sorted(v) == list(range(len(v))) for v in ords.values())
    assert all(e.chunk_id is not None for e in engine.t["atom_evidence"].collect())


def test_atoms_and_evidence(engine):
    found = engine.find_atom("adam optimizer")
    adam = next(a for a in found if a["name"] == "Adam optimizer")
    uid = adam["atom_uid"]
    spans = engine.get_evidence(uid)
    assert spans and "Adam optimizer" in spans[0]["verbatim"] and spans == engine.get_evidence(adam["atom_id"])
    other = next(r.atom_id for r in engine.t["atoms"].collect() if r.name == "ImageNet dataset")
    pair = engine.compare_methods(adam["atom_id"], other)
    assert not pair["same_category"] and TARGET in pair["shared_users"]
    assert "error" in engine.compare_methods("x", other)
    assert engine.find_atom("") == [] and engine.find_atom("zebra", 3) is not None
    traced = engine.trace_dependency("procedure")
    assert "Adam optimizer" in {a["name"] for a in traced["atoms"]}
    assert "error" in engine.trace_dependency("nothing")
    questions = [m["question"] for m in engine.list_missing_details()]
    assert "and dropout not explicitly stated." in questions


def test_retrieval(engine):
    hits = engine.query_chunks("contrastive loss", limit=3)
    assert "contrastive loss" in hits[0]["snippet"] and len(hits) <= 3
    assert {h["chunk_kind"] for h in engine.query_chunks("scores models", kinds=["table"])} == {"table"}
    assert engine.query_chunks("...")  # no tokens: vectors alone
    assert engine.route_query_only("survey of models") == "global"
    for question, mode in (("what loss does it use", "local"), ("adam network", "hybrid")):
        got = engine.query(question)
        assert got["mode"] == mode and got["items"]
    assert engine.query("survey of recent work on world model")["mode"] in ("global", "local")
    assert "error" in engine.query("x", mode="odd")
    engine.rerank = lambda q, items: items[::-1]
    assert len(engine.query("adam network", limit=2)["items"]) == 2
    engine.rerank = None
    parts = engine.paper_text(TARGET)
    assert [p["section"] for p in parts][:1] and sum(len(p["chunks"]) for p in parts) == 5
    assert engine.equation_lookup("alpha_t")[0]["paper_id"] in {p["paper_id"] for p in PAPERS}
    assert engine.equation_lookup("\\ALPHA") and engine.equation_lookup("") == [] and engine.equation_lookup("it's") == []


def test_graph(engine):
    near = engine.citation_neighbors(TARGET)
    assert {n["other"] for n in near} == {"s2:a", "s2:b", "s2:c"}
    around = engine.neighborhood_subgraph(TARGET, 1)
    assert {"s2:a", "s2:b", "s2:c"} <= {n["node"] for n in around["nodes"]} and not around["truncated"]
    paths = engine.shortest_path("s2:a", "s2:b")["paths"]
    assert paths and paths[0]["path"].startswith("s2:a>") and paths[0]["path"].endswith(">s2:b")
    assert "error" in engine.shortest_path("s2:a", "nowhere")
    for c in engine.list_communities():
        assert engine.community_summary(c["community_id"])["papers"]
    assert "error" in engine.community_summary(99)
    assert engine.graph_sql("select count(*) as n from papers")["rows"] == [{"n": 4}]
    assert "error" in engine.graph_sql("delete from papers")
    assert "papers:" in engine.schema_doc()
    assert engine.paper_summary()["paper"]["paper_id"] == TARGET
    assert engine.get_paper_context()["atoms_by_category"]["data"] == 1
    assert engine.graph_stats()["edges"] == 5


def test_memory(engine):
    day = dt.datetime(2026, 5, 19, 14, 32)
    assert engine.list_sessions() == [] and "error" in engine.resume_session()
    assert engine.record_decision("Use the small model for now, really", "cost", now=day)["slug"] == "use-the-small-model-for-now"
    engine.record_decision("Later", slug="B!", now=day + dt.timedelta(days=2))
    assert [d["slug"] for d in engine.get_decisions_since("2026-05-20")] == ["b"]
    assert engine.get_decisions_since()[0]["body"]["Reason"] == "cost"
    for i, (section, item) in enumerate((("Done", "one"), ("Next", "two"), ("Done", "three"))):
        engine.append_session_note("My work", section, item, day + dt.timedelta(minutes=i))
    assert [s["name"] for s in engine.list_sessions()] == ["2026-05-19-my-work.md"]
    assert engine.resume_session()["sections"] == {"Done": ["one", "three"], "Next": ["two"]}


def test_rebuild_and_ingest_keep_ids(spark, built, engine, tmp_path):
    more = paper("s2:d", "Another", [("Method", [("The Heck reaction follows from the Adam optimizer in every case here.", [1])])], [(1, TARGET)])
    (tmp_path / "more.json").write_text(json.dumps(more))
    before = {r.atom_uid for r in engine.t["atoms"].collect()}
    store = C.ingest(spark, C.Store(spark, str(tmp_path / "out")), C.load_ir(spark, str(tmp_path / "more.json")), C.load_ir(spark, str(built / "ir.json")), TARGET)
    after = {r.atom_uid: r for r in store.read("atoms").collect()}
    assert len(after) == len(before) + 1
    assert store.read("papers").count() == 5


def test_an_empty_corpus(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "none"))
    assert "error" in e.paper_summary() and "error" in e.get_paper_context()
    assert e.query_chunks("word") == [] and e.list_communities() == [] and e.graph_stats()["papers"] == 0
    assert e.bind_research_dir(str(tmp_path / "other")) == {"research_dir": str(tmp_path / "other"), "compiled": False}
    C.build(spark, spark.createDataFrame([], C.IR), TARGET, str(tmp_path / "empty"))
    assert {n: Engine(spark, str(tmp_path / "empty")).t[n].count() for n in TABLES if n not in ("meta", "missing_details", "wiki_answers")} == {n: 0 for n in TABLES if n not in ("meta", "missing_details", "wiki_answers")}
