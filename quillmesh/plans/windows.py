"""Ordered computations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.operators.ranking import adjacent_groups, diversify, top_per_group
from quillmesh.plans.base import query
from quillmesh.sources import enums as E


@query("win_occurrence", "SELECT edge_id, from_paper || '::' || to_paper || '::' || row_number() OVER (PARTITION BY from_paper, to_paper ORDER BY slot) AS occurrence FROM edges")
def _(c):
    n = F.row_number().over(Window.partitionBy("from_paper", "to_paper").orderBy("slot"))
    return c.edges.select("edge_id", F.concat_ws("::", "from_paper", "to_paper", n.cast("string")).alias("occurrence"))


@query("win_chunk_ord", "SELECT chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE chunk_kind WHEN 'prose' THEN 0 WHEN 'reference' THEN 1 ELSE 2 END, pos) - 1 AS ord FROM chunks")
def _(c):
    kind = F.when(F.col("chunk_kind") == "prose", 0).when(F.col("chunk_kind") == "reference", 1).otherwise(2)
    return c.chunks.select("chunk_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy(kind, "pos")) - 1).alias("ord"))


@query("win_adjacent_section", """SELECT paper_id, run, min(pos) AS first, count(*) AS n FROM (SELECT *, sum(changed) OVER (PARTITION BY paper_id ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN section_type IS NOT DISTINCT FROM lag(section_type) OVER (PARTITION BY paper_id ORDER BY pos) AND row_number() OVER (PARTITION BY paper_id ORDER BY pos) > 1 THEN 0 ELSE 1 END AS changed FROM paragraphs)) GROUP BY paper_id, run""")
def _(c):
    runs = adjacent_groups(c.paragraphs, ["paper_id"], [F.col("pos")], F.col("section_type"))
    return runs.groupBy("paper_id", "run").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


@query("win_diversity_cap", """SELECT chunk_id, paper_id FROM (SELECT chunk_id, paper_id, quality, row_number() OVER (PARTITION BY coalesce(paper_id, '') ORDER BY quality DESC, chunk_id) > 2 AS over_cap FROM chunks WHERE contains(text, 'Der') OR contains(text, 'The'))
    ORDER BY over_cap, quality DESC, chunk_id LIMIT 40""")
def _(c):
    rows = c.chunks.filter(F.col("text").contains("Der") | F.col("text").contains("The")).select("chunk_id", "paper_id", "quality")
    return diversify(rows, "paper_id", [F.col("quality").desc(), F.col("chunk_id")], 2, 40).select("chunk_id", "paper_id")


@query("win_rank_position", "SELECT paper_id, row_number() OVER (PARTITION BY acquired_via ORDER BY rank DESC, paper_id) - 1 AS place FROM papers")
def _(c):
    return c.papers.select("paper_id", (F.row_number().over(Window.partitionBy("acquired_via").orderBy(F.col("rank").desc(), "paper_id")) - 1).alias("place"))


@query("win_topk_per_community", "SELECT community_id, chunk_id, place FROM (SELECT community_id, chunk_id, row_number() OVER (PARTITION BY community_id ORDER BY quality DESC, chunk_id) AS place FROM chunks JOIN community_papers USING (paper_id)) WHERE place <= 4")
def _(c):
    rows = c.chunks.join(c.community_papers, "paper_id")
    return top_per_group(rows, ["community_id"], [F.col("quality").desc(), F.col("chunk_id")], 4).select("community_id", "chunk_id", "place")


@query("win_community_number", "SELECT community_id, number, size FROM (SELECT community_id, row_number() OVER (ORDER BY count(*) DESC, community_id) AS number, count(*) AS size FROM community_papers GROUP BY community_id) WHERE size >= 2")
def _(c):
    sizes = c.community_papers.groupBy("community_id").agg(F.count("*").alias("size"))
    return sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("size").desc(), "community_id"))).filter("size >= 2").select("community_id", "number", "size")


_RANK_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(E.CATEGORIES)) + " END"


@query("win_topo_order", f"SELECT atom_id, row_number() OVER (PARTITION BY defined_by ORDER BY {_RANK_SQL}, priority DESC, atom_id) AS place FROM atoms")
def _(c):
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(E.CATEGORIES) for x in (k, i)]), F.col("category"))
    return c.atoms.select("atom_id", F.row_number().over(Window.partitionBy("defined_by").orderBy(rank, F.col("priority").desc(), "atom_id")).alias("place"))


@query("win_brief_budget", "SELECT atom_id, category FROM (SELECT atom_id, category, sum(length(description) // 4) OVER (PARTITION BY category ORDER BY priority DESC, atom_id ROWS UNBOUNDED PRECEDING) AS spent FROM atoms) WHERE spent <= 60")
def _(c):
    spent = F.sum(F.floor(F.length("description") / 4)).over(Window.partitionBy("category").orderBy(F.col("priority").desc(), "atom_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return c.atoms.withColumn("spent", spent).filter("spent <= 60").select("atom_id", "category")


@query("sort_method_first", "SELECT edge_id, row_number() OVER (PARTITION BY to_paper ORDER BY section_type <> 'method', doc_id, slot) AS place FROM edges")
def _(c):
    return c.edges.select("edge_id", F.row_number().over(Window.partitionBy("to_paper").orderBy(F.col("section_type") != "method", "doc_id", "slot")).alias("place"))


@query("sort_sources_desc", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT coalesce(acquired_via, 'unavailable') AS source, count(*) AS n FROM papers GROUP BY 1)")
def _(c):
    n = c.papers.groupBy(F.coalesce("acquired_via", F.lit("unavailable")).alias("source")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")))


@query("cap_max_papers", "SELECT paper_id, rank FROM papers ORDER BY rank DESC, paper_id LIMIT 80")
def _(c):
    return c.papers.orderBy(F.col("rank").desc(), "paper_id").limit(80).select("paper_id", "rank")
