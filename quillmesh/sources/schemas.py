"""Schemas of the document IR and of the graph's tables."""

from __future__ import annotations

#: A parsed document, nested; one row each.
IR = """schema_version string, paper_id string, external_ids struct<arxiv: string, doi: string, corpus_id: string>,
metadata struct<title: string, authors: array<struct<name: string, s2_author_id: string>>, year: int, venue: string, abstract: string>,
acquisition struct<source: string, fetched_at: string, cache_path: string>,
sections array<struct<id: string, title: string, level: int, section_type: string, paragraphs: array<struct<id: string, text: string,
  citations: array<struct<marker: string, ref_id: string, resolved_paper_id: string, context_window: string>>, equation_refs: array<string>, algorithm_refs: array<string>, table_refs: array<string>, figure_refs: array<string>>>>>,
equations array<struct<id: string, latex: string, section_id: string, mentioned_in: array<string>>>, algorithms array<struct<id: string, title: string, pseudocode: string, section_id: string>>,
tables array<struct<id: string, caption: string, section_id: string, rows: array<array<string>>>>, figures array<struct<id: string, caption: string, section_id: string>>,
references array<struct<ref_id: string, marker: string, raw: string, resolved_paper_id: string, resolution_confidence: double>>,
citation_count int, influential_count int"""

#: The tables of a compiled corpus.
TABLES = {
    "papers": "paper_id string, title string, year int, venue string, authors array<string>, abstract string, rank double, scholarly_influence double, implementation_influence double, is_target boolean, depth int, acquired boolean, acquired_via string",
    "sections": "section_id string, paper_id string, title string, section_type string, ord int",
    "chunks": "chunk_id long, paper_id string, section_id string, paragraph_id string, ord int, text string, n_tokens int, quality double, chunk_kind string",
    "equations": "equation_id string, paper_id string, section_id string, latex string",
    "edges": "edge_id string, from_paper string, to_paper string, best_role string, confidence double, section_type string, paragraph_id string, classifier string, context string, provenance_rule string, intent string, intent_confidence double, weight double, near_equations boolean, near_algorithms boolean, near_tables boolean",
    "edge_roles": "edge_id string, label string, confidence double",
    "edge_intents": "edge_id string, intent_label string, confidence double",
    "atoms": "atom_id string, atom_uid string, name string, category string, subcategory string, defined_by string, description string, priority double",
    "atom_paper_usage": "atom_id string, paper_id string, role string",
    "atom_evidence": "evidence_id string, atom_id string, paper_id string, chunk_id long, paragraph_id string, char_start int, char_end int, verbatim string",
    "missing_details": "md_id string, question string, category string, rationale string",
    "communities": "community_id int, label string, summary string, size long",
    "community_papers": "community_id int, paper_id string",
    "community_atoms": "community_id int, atom_id string",
    "chunks_vec": "chunk_id long, embedding array<float>",
    "atoms_vec": "atom_id string, embedding array<float>",
    "communities_vec": "community_id long, embedding array<float>",
    "wiki_answers": "slug string, body string, sources array<string>",
    "meta": "key string, value string",
}
