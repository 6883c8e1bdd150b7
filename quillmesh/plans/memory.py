"""Decisions, sessions, answers, and the documents written from the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.text import slug, slug_sql
from quillmesh.operators import memory as M
from quillmesh.operators import sinks as S
from quillmesh.plans.base import query
from quillmesh.sources import enums as E


@query("scan_decisions", f"SELECT timestamp, {slug_sql('title')} AS slug, 'value ' || event_id AS decision, 'user' AS reason FROM decisions")
def _(c):
    entry = M.decision_entry(F.col("timestamp"), slug(F.col("title")), {"Decision": F.concat(F.lit("value "), F.col("event_id").cast("string")), "Reason": F.lit("user")})
    log = c.decisions.withColumn("file", F.col("event_id") % 20).groupBy("file").agg(F.concat(F.lit("# Decisions\n\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("text"))
    return M.parse_decisions(log).select("timestamp", "slug", F.col("body")["Decision"].alias("decision"), F.col("body")["Reason"].alias("reason"))


@query("scan_sessions", "SELECT conv_id, name, bullets, next_step FROM (SELECT conv_id, '2024-01-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') || '-talk-' || conv_id || '.md' AS name, count(*) FILTER (role <> 'system') AS bullets, bool_or(role = 'user') AS next_step FROM conversations GROUP BY conv_id)")
def _(c):
    return M.list_sessions(notes(c)).select("conv_id", "name", "bullets", "next_step")


def notes(c):
    """One note per conversation: what the assistant said under Done, what the user said under Next."""
    return M.session_notes(c.table("conversations"))


@query("scan_session_one", "SELECT conv_id, section, count(*) AS items FROM (SELECT conv_id, CASE role WHEN 'assistant' THEN 'Done' WHEN 'user' THEN 'Next' END AS section FROM conversations) WHERE section IS NOT NULL GROUP BY ALL")
def _(c):
    return M.parse_sessions(notes(c)).groupBy("conv_id", "section").agg(F.count("*").alias("items"))


@query("scan_wiki_answers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id ELSE 'slug-' || event_id END AS slug, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS sources, 'Body ' || event_id AS body FROM decisions")
def _(c):
    n = F.col("event_id").cast("string")
    plain, fronted = F.concat(F.lit("Body "), n), F.concat(F.lit("---\nslug: slug-"), n, F.lit("\nsource_atom_uids: [a1, b2]\n---\nBody "), n)
    pages = c.decisions.select("event_id", F.concat(F.lit("e"), n).alias("stem"), F.when(F.col("event_id") % 3 == 0, plain).otherwise(fronted).alias("text"))
    return M.parse_answers(pages).select("event_id", "slug", F.size("sources").alias("sources"), "body")


@query("sink_answers", "SELECT CAST(-event_id AS BIGINT) AS chunk_id, 'answer' AS chunk_kind, 0.8::DOUBLE AS quality, CAST(NULL AS VARCHAR) AS paper_id FROM decisions UNION ALL SELECT chunk_id, chunk_kind, quality, paper_id FROM chunks WHERE chunk_kind <> 'answer'")
def _(c):
    fresh = c.decisions.select((-F.col("event_id")).alias("chunk_id"), F.col("title").alias("text"))
    return M.replace_answers(c.chunks.select("chunk_id", "chunk_kind", "quality", "paper_id"), fresh)


@query("sink_decision", f"SELECT event_id, {slug_sql('title')} AS slug, '## ' || timestamp || ' · ' || {slug_sql('title')} AS heading FROM decisions")
def _(c):
    s = slug(F.col("title"))
    return c.decisions.select("event_id", s.alias("slug"), F.concat_ws(" ", F.lit("##"), "timestamp", F.lit("·"), s).alias("heading"))


@query("sink_session_note", "SELECT conv_id, count(*) FILTER (role = 'assistant') + 1 AS done FROM conversations GROUP BY conv_id")
def _(c):
    added = M.append_bullet(notes(c), "Done", F.lit("one more"))
    per = M.parse_sessions(added).filter("section = 'Done'").groupBy("conv_id").agg(F.count("*").alias("done"))
    return per


@query("sink_manifest", "SELECT '{\"papers\":' || (SELECT count(*) FROM papers) || ',\"atoms\":' || (SELECT count(*) FROM atoms) || ',\"edges\":' || (SELECT count(*) FROM edges) || '}' AS manifest")
def _(c):
    return S.manifest({"papers": c.papers, "atoms": c.atoms, "edges": c.edges})


@query("sink_graph_json", "SELECT paper_id, '{\"paper_id\":\"' || paper_id || '\",\"year\":' || year || ',\"depth\":' || depth || '}' AS node FROM papers")
def _(c):
    return c.papers.select("paper_id", F.to_json(F.struct("paper_id", "year", "depth")).alias("node"))


_RANK_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(E.CATEGORIES)) + " END"


@query("sink_brief", "SELECT category, string_agg('- ' || name || ' (' || atom_id || ')', chr(10) ORDER BY priority DESC, atom_id) AS block FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, atom_id) AS place FROM atoms) WHERE place <= 6 GROUP BY category")
def _(c):
    return S.brief(c.atoms, 6)


@query("sink_wiki", """SELECT a.atom_id, '# ' || name || chr(10) || 'Defined by [[' || defined_by || ']]' || chr(10) || 'Related: ' || coalesce((SELECT string_agg('[[' || r.atom_id || ']]', ', ' ORDER BY r.atom_id) FROM rel r WHERE r.category = a.category AND r.atom_id <> a.atom_id AND r.place <= 6), '') AS page
    FROM atoms a""".replace("rel r", "(SELECT atom_id, category, row_number() OVER (PARTITION BY category ORDER BY priority DESC, atom_id) AS place FROM atoms) r"))
def _(c):
    return S.wiki_atoms(c.atoms)


@query("sink_wiki_log", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS entries FROM events GROUP BY 1")
def _(c):
    return c.table("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("entries"))


@query("sink_evidence_files", "SELECT evidence_id, '## ' || evidence_id || chr(10) || '> ' || replace(verbatim, chr(10), chr(10) || '> ') AS page FROM evidence")
def _(c):
    return c.evidence.select("evidence_id", F.concat(F.lit("## "), "evidence_id", F.lit("\n> "), F.replace(F.col("verbatim"), F.lit("\n"), F.lit("\n> "))).alias("page"))


@query("help_links", "SELECT atom_id, '[[atoms/' || regexp_replace(name, '[^A-Za-z0-9_-]+', '_', 'g') || '|' || name || ']]' AS link FROM atoms")
def _(c):
    return c.atoms.select("atom_id", F.concat(F.lit("[[atoms/"), F.regexp_replace("name", "[^A-Za-z0-9_-]+", "_"), F.lit("|"), "name", F.lit("]]")).alias("link"))


@query("help_brief_blocks", "SELECT atom_id, length('**' || name || '** ' || description) // 4 AS tokens FROM atoms")
def _(c):
    return c.atoms.select("atom_id", F.floor(F.length(F.concat(F.lit("**"), "name", F.lit("** "), "description")) / 4).alias("tokens"))
