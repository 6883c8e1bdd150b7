"""Roles, intents and weights of citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import scoring as S
from quillmesh.plans.base import query
from quillmesh.sources import enums as E

# Words of the keyword lists are put into the invented contexts, so that every rule fires somewhere.
CUES = (
    "we use the encoder", "unlike the loss of", "dataset and benchmark", "we extend the theorem", "reported accuracy 93.5", "baseline outperform", "adam warmup schedule", "pytorch library",
    "ablation removing", "prior work introduced", "however it fails to", "tokeniz and augment", "no", "survey",
)
_CUES_SQL = "[" + ", ".join("'" + s + "'" for s in CUES) + "]"
_E_SQL = f"(SELECT e.* EXCLUDE (context), ({_CUES_SQL})[(e.doc_id + slot) % {len(CUES)} + 1] || ' ' || ({_CUES_SQL})[(e.doc_id * 3 + slot) % {len(CUES)} + 1] || ' ' || context AS context, CASE WHEN to_doc % 3 = 0 THEN 'dataset ' WHEN to_doc % 3 = 1 THEN 'attention network ' ELSE '' END || title AS title FROM edges e LEFT JOIN papers ON paper_id = to_paper)"


def cued(c):
    cue = lambda at: F.element_at(F.array(*[F.lit(s) for s in CUES]), (at % len(CUES) + 1).cast("int"))
    titles = c.papers.select(F.col("paper_id").alias("to_paper"), "title")
    third = F.col("to_doc") % 3
    context = F.concat_ws(" ", cue(F.col("doc_id") + F.col("slot")), cue(F.col("doc_id") * 3 + F.col("slot")), "context")
    return c.edges.join(titles, "to_paper", "left").withColumn("context", context).withColumn("title", F.concat(F.when(third == 0, "dataset ").when(third == 1, "attention network ").otherwise(""), "title"))


def flat(name):
    return F.array_join(F.transform(name, lambda x: F.concat(x["label"], F.lit(":"), F.round(x["confidence"], 3).cast("string"))), ",")


_FLAT = "array_to_string(list_transform(labels, lambda x: x.label || ':' || round(x.confidence, 3)), ',')"
_ROLES_SQL = "(" + S.ranked_sql(S.role_rules(), "related_work_only", 6, _E_SQL, "edge_id, confidence") + ")"
_INTENTS_SQL = "(" + S.ranked_sql(S.intent_rules(), "mention", 3, _E_SQL, "edge_id") + ")"


@query("classify_role", f"SELECT edge_id, {_FLAT} AS roles FROM {_ROLES_SQL}")
def _(c):
    return cued(c).select("edge_id", S.roles().alias("labels")).select("edge_id", flat("labels").alias("roles"))


@query("classify_intent", f"SELECT edge_id, {_FLAT} AS intents FROM {_INTENTS_SQL}")
def _(c):
    return cued(c).select("edge_id", S.intents().alias("labels")).select("edge_id", flat("labels").alias("intents"))


@query("classify_edges", f"""SELECT edge_id, r.labels[1].label AS role, round(r.labels[1].confidence, 3) AS confidence, i.labels[1].label AS intent, r.labels[1].confidence < 0.55 AS role_unsure, i.labels[1].confidence < 0.45 AS intent_unsure,
    {S.edge_weight_sql('r.labels[1].confidence', 'r.labels[1].label', 'i.labels[1].label')} AS weight FROM {_ROLES_SQL} r JOIN {_INTENTS_SQL} i USING (edge_id)""")
def _(c):
    e = cued(c).select("edge_id", S.roles().alias("r"), S.intents().alias("i")).select("edge_id", F.get("r", F.lit(0)).alias("r"), F.get("i", F.lit(0)).alias("i"))
    weight = S.edge_weight(F.col("r.confidence"), F.col("r.label"), F.col("i.label"))
    return e.select("edge_id", F.col("r.label").alias("role"), F.round("r.confidence", 3).alias("confidence"), F.col("i.label").alias("intent"), (F.col("r.confidence") < 0.55).alias("role_unsure"), (F.col("i.confidence") < 0.45).alias("intent_unsure"), weight.alias("weight"))


@query("help_best_role", "SELECT edge_id, coalesce(roles[1], 'related_work_only') AS best FROM (SELECT edge_id, list_filter([CASE WHEN slot = 0 THEN NULL ELSE best_role END], lambda x: x IS NOT NULL) AS roles FROM edges)")
def _(c):
    roles = F.array_compact(F.array(F.when(F.col("slot") != 0, F.col("best_role"))))
    return c.edges.select("edge_id", F.coalesce(F.get(roles, F.lit(0)), F.lit("related_work_only")).alias("best"))


@query("help_is_critical", "SELECT edge_id, best_role IN (" + ", ".join(f"'{r}'" for r in E.CRITICAL_ROLES) + ") AS critical FROM edges")
def _(c):
    return c.edges.select("edge_id", F.col("best_role").isin(*E.CRITICAL_ROLES).alias("critical"))
