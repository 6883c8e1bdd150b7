"""Extraction and deduplication of atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.text import quote
from quillmesh.operators import atoms as A
from quillmesh.plans.base import query
from quillmesh.plans.scalars import dedup_tokens, dedup_tokens_sql
from quillmesh.sources import enums as E

# Sentences with named atoms and parameters, dealt over the paragraphs.
CUES = (
    "We use the Adam optimizer on the ImageNet dataset.", "The Heck reaction follows.", "Our Vision Transformer encoder and Kalman Filter model win.", "The Main theorem holds.", "This model is fine.", "learning rate = 0.001 and dropout was tuned.",
    "The step size was small, temperature 0.7.", "the batch size : 64; weight decay varies", "Strong Greedy baseline, Fitness function.",
)
_CUED_SQL = "(SELECT *, ([" + ", ".join(quote(s) for s in CUES) + f"])[(doc_id + pos) % {len(CUES)} + 1] || ' ' || text AS cued FROM paragraphs)"
_STOP = ", ".join(quote(s) for s in E.STOP_NAMES)
_CATEGORY = "CASE noun " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.SUFFIX_CATEGORY.items()) + " END"
_SEEN_SQL = f"""(SELECT doc_id, paper_id, pos, place, {_CATEGORY} AS category, phrase || ' ' || noun AS name, lower(phrase || ' ' || noun) AS key FROM (
    SELECT doc_id, paper_id, pos, unnest(range(len(phrases))) AS place, unnest(phrases) AS phrase, unnest(nouns) AS noun FROM (
      SELECT doc_id, paper_id, pos, regexp_extract_all(cued, {quote(E.NAMED_ATOM)}, 1) AS phrases, regexp_extract_all(cued, {quote(E.NAMED_ATOM)}, 2) AS nouns FROM {_CUED_SQL})) WHERE lower(phrase) NOT IN ({_STOP}))"""


def cued(c):
    cue = F.element_at(F.array(*[F.lit(s) for s in CUES]), ((F.col("doc_id") + F.col("pos")) % len(CUES) + 1).cast("int"))
    return c.paragraphs.withColumn("text", F.concat_ws(" ", cue, "text"))


@query("extract_atoms_heuristic", f"SELECT doc_id, pos, category, name FROM {_SEEN_SQL}")
def _(c):
    return cued(c).select("doc_id", "pos", F.explode(A.named(F.col("text"))).alias("a")).select("doc_id", "pos", "a.category", "a.name")


@query("extract_for_paper", f"""SELECT category, key, arg_min(name, (doc_id, pos, place)) AS name, arg_min(paper_id, (doc_id, pos, place)) AS defined_by, arg_min(pos, (doc_id, pos, place)) AS pos, string_agg(DISTINCT paper_id, ',' ORDER BY paper_id) AS used_by, count(*) AS sightings FROM {_SEEN_SQL} GROUP BY category, key""")
def _(c):
    return A.extract(cued(c))


@query("extract_definer", "SELECT paper_id, pos, coalesce(arg_max(to_paper, (confidence, -slot)) FILTER (best_role = 'method_dependency'), paper_id) AS definer FROM paragraphs LEFT JOIN edges ON from_paper = paper_id AND edges.paragraph_id = paragraphs.paragraph_id GROUP BY paper_id, pos")
def _(c):
    e = c.edges.filter("best_role = 'method_dependency'").groupBy(F.col("from_paper").alias("paper_id"), "paragraph_id").agg(F.max_by("to_paper", F.struct("confidence", -F.col("slot"))).alias("definer"))
    return c.paragraphs.join(e, ["paper_id", "paragraph_id"], "left").select("paper_id", "pos", F.coalesce("definer", "paper_id").alias("definer"))


@query("extract_eval_atoms", """SELECT DISTINCT e.to_paper, title AS name, split_part(best_role, '_', 1) AS category, 0.8::DOUBLE AS priority FROM paragraphs p JOIN edges e ON from_paper = p.paper_id AND e.paragraph_id = p.paragraph_id JOIN papers t ON t.paper_id = e.to_paper
    WHERE p.section_type IN ('experiments', 'results') AND best_role IN ('data_dependency', 'evaluation_dependency', 'baseline_dependency')""")
def _(c):
    roles = ("data_dependency", "evaluation_dependency", "baseline_dependency")
    e = c.edges.filter(F.col("best_role").isin(*roles)).select(F.col("from_paper").alias("paper_id"), "paragraph_id", "to_paper", "best_role")
    hit = c.paragraphs.filter(F.col("section_type").isin("experiments", "results")).join(e, ["paper_id", "paragraph_id"]).select("to_paper", "best_role").distinct()
    category = F.element_at(F.split("best_role", "_"), 1).alias("category")
    return hit.join(c.papers.select(F.col("paper_id").alias("to_paper"), F.col("title").alias("name")), "to_paper").select("to_paper", "name", category, F.lit(0.8).alias("priority")).distinct()


_W = "(SELECT to_paper AS paper_id, round(sum(confidence), 6) AS weight FROM edges GROUP BY to_paper)"


@query("extract_budget", f"""WITH s AS (SELECT paper_id, weight, least(10, CAST(round_even(60 * weight / sum(weight) OVER (), 0) AS INT)) AS share FROM {_W} WHERE weight > 0),
    r AS (SELECT paper_id, weight, CASE WHEN weight >= 0.3 AND share < 1 THEN 1 ELSE share END AS share FROM s),
    t AS (SELECT *, sum(share) OVER (ORDER BY share, weight DESC, paper_id ROWS UNBOUNDED PRECEDING) AS upto, greatest(0, sum(share) OVER () - 60) AS excess FROM r WHERE share > 0)
    SELECT paper_id, CAST(share - greatest(0, least(share, excess - (upto - share))) AS INT) AS calls FROM t WHERE share - greatest(0, least(share, excess - (upto - share))) > 0""")
def _(c):
    return A.budget(c.edges.groupBy(F.col("to_paper").alias("paper_id")).agg(F.round(F.sum("confidence"), 6).alias("weight")), 100)


_P = quote(E.PARAMETER)
_MISSING_SQL = f"""(SELECT doc_id, lower(trim(name)) AS name FROM (SELECT doc_id, unnest(regexp_extract_all(cued, {_P}, 1)) AS name, unnest(regexp_extract_all(cued, {_P}, 2)) AS value FROM {_CUED_SQL}) WHERE coalesce(value, '') = '')"""


@query("fn_missing_param", f"SELECT DISTINCT doc_id, name, name || ' not explicitly stated.' AS question FROM {_MISSING_SQL}")
def _(c):
    return A.missing_parameters(cued(c))


_NEED = ", ".join(f"('{k}')" for k in E.REQUIRED_CATEGORIES)


@query("fn_missing_category", f"SELECT DISTINCT a.defined_by AS paper_id, need FROM atoms a, (VALUES {_NEED}) v(need) WHERE NOT EXISTS (SELECT 1 FROM atoms b WHERE b.defined_by = a.defined_by AND b.category = need)")
def _(c):
    need = c.atoms.select(F.col("defined_by").alias("paper_id")).distinct().withColumn("need", F.explode(F.array(*[F.lit(k) for k in E.REQUIRED_CATEGORIES])))
    return need.join(c.atoms.select(F.col("defined_by").alias("paper_id"), F.col("category").alias("need")), ["paper_id", "need"], "left_anti")


@query("extract_missing_details", f"""SELECT 'd:' || doc_id AS paper_id, 'parameter' AS category, name || ' not explicitly stated.' AS question FROM (SELECT DISTINCT doc_id, name FROM {_MISSING_SQL})
    UNION ALL SELECT paper_id, need, 'No ' || need || ' atom extracted.' FROM (SELECT DISTINCT a.defined_by AS paper_id, need FROM atoms a, (VALUES {_NEED}) v(need) WHERE NOT EXISTS (SELECT 1 FROM atoms b WHERE b.defined_by = a.defined_by AND b.category = need))""")
def _(c):
    from quillmesh.plans.base import QUERIES
    from quillmesh.sources.corpus import paper_id

    one = A.missing_parameters(cued(c)).select(paper_id(F.col("doc_id")).alias("paper_id"), F.lit("parameter").alias("category"), "question")
    two = QUERIES["fn_missing_category"](c).select("paper_id", F.col("need").alias("category"), F.concat(F.lit("No "), "need", F.lit(" atom extracted.")).alias("question"))
    return one.unionByName(two)


_D = dedup_tokens_sql("description")


@query("dedup_exact", f"""WITH k AS MATERIALIZED (SELECT *, array_to_string({_D}, ' ') AS key FROM atoms), u AS (SELECT category, key, string_agg(DISTINCT paper_id, ',' ORDER BY paper_id) AS used_by FROM k JOIN usage USING (atom_id) GROUP BY category, key)
    SELECT atom_id, category, name, description, priority, merged, coalesce(used_by, '') AS used_by FROM (SELECT category, key, arg_min(atom_id, seq) AS atom_id, arg_min(name, seq) AS name, arg_max(description, (length(description), -seq)) AS description, max(priority) AS priority, count(*) AS merged FROM k GROUP BY category, key) LEFT JOIN u USING (category, key)""")
def _(c):
    return A.exact(c.atoms, dedup_tokens(F.col("description")), c.usage)


@query("dedup_jaccard")
def _(c):
    t = c.atoms.select("atom_id", "seq", "category", dedup_tokens(F.concat_ws(" ", "name", "description")).alias("tokens"))
    return A.greedy(t, "jaccard")


def _vectors(c):
    return c.atoms.select("atom_id", "seq").join(c.vectors.select(F.col("vec_id").alias("seq"), "embedding"), "seq").select("atom_id", "embedding")


@query("dedup_embedding")
def _(c):
    return A.by_vector(c.atoms.select("atom_id", "seq", "category"), _vectors(c))


@query("dedup_pipeline")
def _(c):
    return A.deduplicated(c.atoms, _vectors(c), dedup_tokens(F.col("description")), dedup_tokens(F.concat_ws(" ", "name", "description")))


@query("help_evidence_span", "SELECT paper_id, pos, substr(text, 1, 1200) AS verbatim, 0 AS char_start, least(length(text), 1200) AS char_end FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", F.substring("text", 1, 1200).alias("verbatim"), F.lit(0).alias("char_start"), F.least(F.length("text"), F.lit(1200)).alias("char_end"))


@query("help_subcategory", "SELECT atom_id, CAST(NULL AS VARCHAR) AS subcategory FROM atoms")
def _(c):
    return c.atoms.select("atom_id", F.lit(None).cast("string").alias("subcategory"))


@query("help_chunk_paragraphs", f"""SELECT paper_id, pos, CASE WHEN len(w) > 1 THEN paragraph_id || '-c' || i ELSE paragraph_id END AS anchor, w[i] AS piece FROM (
    SELECT paper_id, pos, paragraph_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {T.split_overlap_sql('clean')} AS w FROM (SELECT *, {T.scrub_sql('text')} AS clean FROM paragraphs))) WHERE trim(w[i]) <> ''""")
def _(c):
    w = c.paragraphs.select("paper_id", "pos", "paragraph_id", T.split_overlap(T.scrub(F.col("text"))).alias("w"))
    out = w.select("paper_id", "pos", "paragraph_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "piece")).filter(F.trim("piece") != "")
    return out.select("paper_id", "pos", F.when(F.col("n") > 1, F.concat("paragraph_id", F.lit("-c"), (F.col("i") + 1).cast("string"))).otherwise(F.col("paragraph_id")).alias("anchor"), "piece")
