"""Filters, limits, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.text import canonical_name, canonical_name_sql
from quillmesh.operators.ranking import top_per_group
from quillmesh.plans.base import query
from quillmesh.plans.scalars import dedup_tokens, dedup_tokens_sql
from quillmesh.sources import enums as E


@query("proj_snippet", "SELECT chunk_id, substr(text, 1, 240) AS snippet FROM chunks")
def _(c):
    return c.chunks.select("chunk_id", F.substring("text", 1, 240).alias("snippet"))


@query("filter_kinds", "SELECT chunk_id, chunk_kind FROM chunks WHERE chunk_kind IN ('reference', 'equation_block', 'prose')")
def _(c):
    return c.chunks.filter(F.col("chunk_kind").isin("reference", "equation_block", "prose")).select("chunk_id", "chunk_kind")


@query("filter_paper_subset", "SELECT chunk_id, paper_id FROM chunks WHERE paper_id IN (SELECT paper_id FROM community_papers WHERE community_id IN (1, 3))")
def _(c):
    members = c.community_papers.filter(F.col("community_id").isin(1, 3))
    return c.chunks.join(members, "paper_id", "left_semi").select("chunk_id", "paper_id")


@query("filter_role", "SELECT edge_id, best_role = 'data_dependency' AS is_best, list_contains([best_role, CASE WHEN slot = 0 THEN 'data_dependency' END], 'data_dependency') AS is_any FROM edges WHERE best_role = 'data_dependency' OR slot = 0")
def _(c):
    roles = F.array("best_role", F.when(F.col("slot") == 0, "data_dependency"))
    role = F.lit("data_dependency")
    any_role = F.exists(roles, lambda r: F.coalesce(r == role, F.lit(False)))
    return c.edges.select("edge_id", (F.col("best_role") == role).alias("is_best"), any_role.alias("is_any")).filter("is_any")


@query("filter_depth2_gate", "SELECT paper_id, depth, rank FROM papers WHERE depth < 2 OR rank >= 0.5")
def _(c):
    return c.papers.filter((F.col("depth") < 2) | (F.col("rank") >= 0.5)).select("paper_id", "depth", "rank")


@query("filter_load_bearing", "SELECT to_paper, round(sum(confidence), 6) AS weight, CASE WHEN round(sum(confidence), 6) >= 0.3 THEN 1 ELSE 0 END AS least_calls FROM edges GROUP BY to_paper")
def _(c):
    return c.edges.groupBy("to_paper").agg(F.round(F.sum("confidence"), 6).alias("weight")).withColumn("least_calls", F.when(F.col("weight") >= 0.3, 1).otherwise(0))


_STOP = ", ".join(f"'{s}'" for s in E.STOP_NAMES)


@query("filter_junk_name", rf"""SELECT doc_id, length(name) > 80 OR len(regexp_split_to_array(name, '\s+')) > 10 OR lower(name) IN ({_STOP}) OR length(regexp_replace(name, '[^\p{{L}}]', '', 'g')) < 3 AS junk
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The' WHEN 1 THEN substr(text, 1, 95) WHEN 2 THEN title ELSE '12 b' END AS name FROM papers JOIN documents USING (doc_id))""")
def _(c):
    from quillmesh.operators.atoms import junk_name

    k = F.col("doc_id") % 4
    named = c.table("documents").select("doc_id", F.when(k == 0, "The").when(k == 1, F.substring("text", 1, 95)).when(k == 2, F.substring("text", 1, 60)).otherwise("12 b").alias("name"))
    return named.select("doc_id", junk_name(F.col("name")).alias("junk"))


@query("filter_since", "SELECT event_id, timestamp FROM decisions WHERE timestamp >= '2024-01-02'")
def _(c):
    return c.decisions.filter(F.col("timestamp") >= "2024-01-02").select("event_id", "timestamp")


@query("paper_text", """SELECT chunk_id, section_type, run, text FROM (SELECT *, sum(changed) OVER (ORDER BY section_id, pos) AS run FROM (
    SELECT *, CASE WHEN section_type IS NOT DISTINCT FROM lag(section_type) OVER (ORDER BY section_id, pos) AND row_number() OVER (ORDER BY section_id, pos) > 1 THEN 0 ELSE 1 END AS changed FROM chunks WHERE paper_id = 'd:20'))""")
def _(c):
    from quillmesh.operators.ranking import adjacent_groups

    rows = adjacent_groups(c.chunks.filter("paper_id = 'd:20'"), ["paper_id"], [F.col("section_id").asc_nulls_first(), F.col("pos").asc_nulls_first()], F.col("section_type"))
    return rows.select("chunk_id", "section_type", "run", "text")


@query("equation_lookup", r"SELECT equation_id, paper_id, title, substr(latex, 1, 80) AS latex FROM equations LEFT JOIN papers USING (paper_id) WHERE latex ILIKE '%t_e%' ESCAPE '~' ORDER BY coalesce(rank, 0) DESC, equation_id LIMIT 25")
def _(c):
    found = c.equations.filter(F.expr("latex ILIKE '%t_e%' ESCAPE '~'"))
    return found.join(c.papers.select("paper_id", "title", "rank"), "paper_id", "left").orderBy(F.coalesce("rank", F.lit(0.0)).desc(), "equation_id").limit(25).select("equation_id", "paper_id", "title", F.substring("latex", 1, 80).alias("latex"))


@query("equation_lookup_legacy", "SELECT equation_id FROM equations WHERE contains(lower(latex), 'the') ORDER BY equation_id LIMIT 10")
def _(c):
    return c.equations.filter(F.lower("latex").contains("the")).orderBy("equation_id").limit(10).select("equation_id")


@query("graph_neighbors", """SELECT edge_id, CASE WHEN from_paper = 'd:5' THEN to_paper ELSE from_paper END AS other, title, substr(context, 1, 200) AS context FROM edges
    LEFT JOIN papers ON paper_id = CASE WHEN from_paper = 'd:5' THEN to_paper ELSE from_paper END WHERE from_paper = 'd:5' OR to_paper = 'd:5'""")
def _(c):
    from quillmesh.operators.graph import neighbours

    return neighbours(c.edges, c.papers, "d:5")


@query("topk_papers_in_community", "SELECT community_id, paper_id, place FROM (SELECT community_id, paper_id, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(rank, 0) DESC, paper_id) AS place FROM community_papers JOIN papers USING (paper_id)) WHERE place <= 5")
def _(c):
    rows = c.community_papers.join(c.papers.select("paper_id", "rank"), "paper_id")
    return top_per_group(rows, ["community_id"], [F.coalesce("rank", F.lit(0.0)).desc(), F.col("paper_id")], 5).select("community_id", "paper_id", "place")


@query("topk_atoms_in_community", "SELECT community_id, atom_id, place FROM (SELECT community_id, atom_id, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(priority, 0) DESC, atom_id) AS place FROM community_atoms JOIN atoms USING (atom_id)) WHERE place <= 8")
def _(c):
    rows = c.community_atoms.join(c.atoms.select("atom_id", "priority"), "atom_id")
    return top_per_group(rows, ["community_id"], [F.coalesce("priority", F.lit(0.0)).desc(), F.col("atom_id")], 8).select("community_id", "atom_id", "place")


@query("topk_candidates", "SELECT chunk_id, quality FROM chunks ORDER BY quality DESC, chunk_id LIMIT 24")
def _(c):
    return c.chunks.orderBy(F.col("quality").desc(), "chunk_id").limit(8 * 3).select("chunk_id", "quality")


# Joins


@query("join_fts_chunk_paper", "SELECT c.chunk_id, p.title FROM (SELECT chunk_id FROM chunks WHERE contains(lower(text), 'ing')) i JOIN chunks c USING (chunk_id) LEFT JOIN papers p ON c.paper_id = p.paper_id AND p.acquired")
def _(c):
    index = c.chunks.filter(F.lower("text").contains("ing")).select("chunk_id")
    return index.join(c.chunks.select("chunk_id", "paper_id"), "chunk_id").join(c.papers.filter("acquired").select("paper_id", "title"), "paper_id", "left").select("chunk_id", "title")


@query("join_vec_chunk_paper", "SELECT v.vec_id, c.chunk_id, p.title FROM vectors v JOIN chunks c USING (chunk_id) LEFT JOIN papers p USING (paper_id)")
def _(c):
    return c.vectors.join(c.chunks.select("chunk_id", "paper_id"), "chunk_id").join(c.papers.select("paper_id", "title"), "paper_id", "left").select("vec_id", "chunk_id", "title")


_SECTIONS_SQL = "(SELECT section_id, max(section_type) AS kind, min(pos) AS ord FROM paragraphs WHERE section_type <> 'other' GROUP BY section_id)"


@query("join_chunk_section", f"SELECT chunk_id, kind, ord FROM chunks LEFT JOIN {_SECTIONS_SQL} USING (section_id)")
def _(c):
    sections = c.paragraphs.filter("section_type <> 'other'").groupBy("section_id").agg(F.max("section_type").alias("kind"), F.min("pos").alias("ord"))
    return c.chunks.join(sections, "section_id", "left").select("chunk_id", "kind", "ord")


@query("join_equation_paper", "SELECT equation_id, title FROM equations LEFT JOIN (SELECT * FROM papers WHERE acquired) USING (paper_id)")
def _(c):
    return c.equations.join(c.papers.filter("acquired").select("paper_id", "title"), "paper_id", "left").select("equation_id", "title")


@query("join_comm_paper", "SELECT community_id, paper_id, year FROM community_papers JOIN papers USING (paper_id)")
def _(c):
    return c.community_papers.join(c.papers, "paper_id").select("community_id", "paper_id", "year")


@query("join_comm_atom", "SELECT community_id, atom_id, category FROM community_atoms JOIN atoms USING (atom_id)")
def _(c):
    return c.community_atoms.join(c.atoms, "atom_id").select("community_id", "atom_id", "category")


@query("join_evidence_chunk_section", f"SELECT evidence_id, chunk_id, kind FROM evidence e LEFT JOIN chunks c ON e.paper_id = c.paper_id AND e.paragraph_id = c.paragraph_id AND c.quality >= 0.5 LEFT JOIN {_SECTIONS_SQL} s ON c.section_id = s.section_id")
def _(c):
    sections = c.paragraphs.filter("section_type <> 'other'").groupBy(F.col("section_id").alias("sid")).agg(F.max("section_type").alias("kind"))
    chunks = c.chunks.filter("quality >= 0.5").select("paper_id", "paragraph_id", "chunk_id", F.col("section_id").alias("sid"))
    return c.evidence.join(chunks, ["paper_id", "paragraph_id"], "left").join(sections, "sid", "left").select("evidence_id", "chunk_id", "kind")


@query("join_evidence_to_chunk", "SELECT evidence_id, first AS chunk_id FROM evidence LEFT JOIN (SELECT paper_id, paragraph_id, min(chunk_id) AS first FROM chunks GROUP BY ALL) USING (paper_id, paragraph_id)")
def _(c):
    first = c.chunks.groupBy("paper_id", "paragraph_id").agg(F.min("chunk_id").alias("chunk_id"))
    return c.evidence.join(first, ["paper_id", "paragraph_id"], "left").select("evidence_id", "chunk_id")


@query("join_atom_usage_self", "SELECT atom_id, count(DISTINCT paper_id) AS papers FROM usage GROUP BY atom_id HAVING count(DISTINCT paper_id) >= 2")
def _(c):
    return c.usage.groupBy("atom_id").agg(F.count("paper_id").alias("papers")).filter("papers >= 2")


# Papers of one part's orders pair up per atom; users of an atom are few (the orders of a part), so pairs grow with the rows.
@query("join_paper_pair_theta", """SELECT category, a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS shared FROM usage a JOIN usage b ON a.atom_id = b.atom_id AND a.paper_id < b.paper_id JOIN atoms ON atoms.atom_id = a.atom_id
    GROUP BY ALL HAVING count(*) >= 2""")
def _(c):
    from quillmesh.operators.graph import shared_pairs

    pairs = shared_pairs(c.usage_numbers, c.atom_numbers, "category", 2)
    return pairs.select("category", *c.paper_pair("paper_a", "paper_b"), "shared")


@query("join_edge_paragraph", """SELECT paper_id, pos, arg_max(to_paper, (confidence, -slot)) AS definer FROM paragraphs JOIN edges ON from_paper = paper_id AND edges.paragraph_id = paragraphs.paragraph_id GROUP BY paper_id, pos""")
def _(c):
    e = c.edges.select(F.col("from_paper").alias("paper_id"), "paragraph_id", "to_paper", "confidence", "slot")
    return c.paragraphs.join(e, ["paper_id", "paragraph_id"]).groupBy("paper_id", "pos").agg(F.max_by("to_paper", F.struct("confidence", -F.col("slot"))).alias("definer"))


_REF_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: length(x) > 3))"


@query("join_ref_resolution", f"""WITH t AS (SELECT doc_id, acquired, len({_REF_TOKENS}) AS n, unnest({_REF_TOKENS}) AS token FROM papers),
    m AS (SELECT a.doc_id AS ref, b.doc_id AS record, a.n, count(*) AS common FROM t a JOIN t b ON a.token = b.token AND NOT a.acquired AND b.acquired GROUP BY ALL)
    SELECT ref, min(record) AS record FROM m WHERE common >= greatest(3, n // 2) GROUP BY ref""")
def _(c):
    from quillmesh.operators.scoring import resolved

    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 3))
    t = c.papers.select("doc_id", "acquired", words.alias("tokens"))
    return resolved(t.filter("not acquired").select(F.col("doc_id").alias("ref"), "tokens"), t.filter("acquired").select(F.col("doc_id").alias("record"), "tokens"))


_BIB_SQL = "(SELECT 'd:' || doc_id AS from_paper, 'd:' || ((doc_id * 3 + 1) % n) AS to_paper FROM documents, n_docs UNION ALL SELECT from_paper, to_paper FROM edges WHERE slot < 2)"


@query("join_anti_phantom", f"SELECT DISTINCT from_paper || '::' || to_paper || '::ref' AS edge_id, from_paper, to_paper FROM {_BIB_SQL} b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_paper = b.from_paper AND e.to_paper = b.to_paper) AND from_paper <> to_paper")
def _(c):
    from quillmesh.sources.corpus import paper_id

    bib = c.table("documents").select(paper_id(F.col("doc_id")).alias("from_paper"), paper_id((F.col("doc_id") * 3 + 1) % c.count).alias("to_paper")).unionByName(c.edges.filter("slot < 2").select("from_paper", "to_paper"))
    lost = bib.filter("from_paper <> to_paper").join(c.edges, ["from_paper", "to_paper"], "left_anti").distinct()
    return lost.select(F.concat_ws("::", "from_paper", "to_paper", F.lit("ref")).alias("edge_id"), "from_paper", "to_paper")


@query("join_anti_stale", "SELECT atom_id, defined_by FROM atoms WHERE NOT EXISTS (SELECT 1 FROM papers WHERE paper_id = defined_by AND acquired)")
def _(c):
    return c.atoms.join(c.papers.filter("acquired").select(F.col("paper_id").alias("defined_by")), "defined_by", "left_anti").select("atom_id", "defined_by")


@query("join_fuzzy_same_category", f"""WITH t AS (SELECT atom_id, seq, category, {dedup_tokens_sql("name || ' ' || description")} AS x FROM atoms), u AS (SELECT atom_id, category, x, unnest(x) AS token FROM t),
    p AS (SELECT DISTINCT a.atom_id AS a, b.atom_id AS b, a.x AS x, b.x AS y FROM u a JOIN u b ON a.category = b.category AND a.token = b.token AND a.atom_id < b.atom_id)
    SELECT a, b FROM p WHERE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) >= 0.6""")
def _(c):
    from quillmesh.operators.atoms import similar_pairs

    t = c.atoms.select("atom_id", "category", dedup_tokens(F.concat_ws(" ", "name", "description")).alias("tokens"))
    return similar_pairs(t, 0.6)


_NAME = canonical_name_sql("name")


@query("join_align_full", f"""SELECT coalesce(a.canonical, b.canonical) AS canonical, coalesce(a.category, b.category) AS category, CASE WHEN a.canonical IS NULL THEN 'B_ONLY' WHEN b.canonical IS NULL THEN 'A_ONLY' ELSE 'BOTH' END AS side FROM
    (SELECT DISTINCT category, {_NAME} AS canonical FROM atoms WHERE seq % 2 = 0 OR seq % 5 = 0) a FULL JOIN (SELECT DISTINCT category, {_NAME} AS canonical FROM atoms WHERE seq % 3 = 0) b ON a.category = b.category AND a.canonical = b.canonical""")
def _(c):
    side = lambda f: c.atoms.filter(f).select("category", canonical_name(F.col("name")).alias("canonical")).distinct()
    a, b = side("seq % 2 = 0 or seq % 5 = 0").withColumn("in_a", F.lit(True)), side("seq % 3 = 0").withColumn("in_b", F.lit(True))
    return a.join(b, ["category", "canonical"], "full_outer").select("canonical", "category", F.when(F.col("in_a").isNull(), "B_ONLY").when(F.col("in_b").isNull(), "A_ONLY").otherwise("BOTH").alias("side"))


# Sets


@query("set_union_distinct", "SELECT paper_id, atom_id FROM usage UNION SELECT defined_by, atom_id FROM atoms")
def _(c):
    return c.named(c.usage_numbers.union(c.atom_numbers.select("atom_id", "defined_by")).distinct()).select("paper_id", "atom_id")


@query("set_candidate_merge", "SELECT chunk_id, 'words' AS source FROM chunks WHERE contains(text, 'the') UNION ALL SELECT chunk_id, 'vector' FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE contains(text, 'the'))")
def _(c):
    words = c.chunks.filter(F.col("text").contains("the")).select("chunk_id")
    return words.withColumn("source", F.lit("words")).unionByName(c.vectors.select("chunk_id").join(words, "chunk_id", "left_anti").withColumn("source", F.lit("vector")))


_USERS = "(SELECT atom_id, list_sort(list(paper_id)) AS users FROM usage GROUP BY atom_id)"


@query("set_shared_users", f"SELECT a.atom_id, array_to_string(list_sort(list_intersect(x.users, y.users)), ',') AS shared FROM atoms a JOIN atoms b ON b.seq = a.seq + 1 JOIN {_USERS} x ON x.atom_id = a.atom_id JOIN {_USERS} y ON y.atom_id = b.atom_id")
def _(c):
    users = c.usage.groupBy("atom_id").agg(F.collect_set("paper_id").alias("users"))
    a = c.atoms.select("atom_id", "seq").join(users, "atom_id")
    b = a.select((F.col("seq") - 1).alias("seq"), F.col("users").alias("others"))
    return a.join(b, "seq").select("atom_id", F.array_join(F.array_sort(F.array_intersect("users", "others")), ",").alias("shared"))


@query("set_visited_diff", "SELECT DISTINCT to_paper FROM edges WHERE from_paper IN ('d:1', 'd:2', 'd:3') AND to_paper NOT IN ('d:1', 'd:2', 'd:3', 'd:4')")
def _(c):
    seen = c.spark.createDataFrame([(f"d:{i}",) for i in (1, 2, 3, 4)], "to_paper string")
    return c.edges.filter(F.col("from_paper").isin("d:1", "d:2", "d:3")).select("to_paper").distinct().join(seen, "to_paper", "left_anti")


@query("set_arg_missing", "SELECT doc_id, array_to_string(list_sort(list_filter(['de', 'the', 'que', 'und'], lambda w: NOT list_contains(string_split(lower(text), ' '), w))), ',') AS missing FROM documents")
def _(c):
    wanted = F.array(*[F.lit(w) for w in ("de", "the", "que", "und")])
    return c.table("documents").select("doc_id", F.array_join(F.array_sort(F.array_except(wanted, F.split(F.lower("text"), " "))), ",").alias("missing"))


@query("set_wikilink_membership", "SELECT to_paper AS target, count(*) AS links FROM edges WHERE to_paper IN (SELECT paper_id FROM papers WHERE depth < 2) GROUP BY to_paper")
def _(c):
    return c.edges.join(c.papers.filter("depth < 2").select(F.col("paper_id").alias("to_paper")), "to_paper", "left_semi").groupBy(F.col("to_paper").alias("target")).agg(F.count("*").alias("links"))
