"""Compiling a corpus: parsed documents to the tables of the graph.

Every stage is a lazy DataFrame over the nested documents; tables are cut only where a later stage
reads one more than once. Ids are functions of content, so a rebuild gives the same ones and an
added document changes no other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import atoms as A
from quillmesh.operators import graph as G
from quillmesh.operators import scoring as S
from quillmesh.operators.embedding import embed
from quillmesh.operators.materialise import cut
from quillmesh.sources import enums as E
from quillmesh.sources.schemas import IR
from quillmesh.sources.store import Store

METHOD_SECTIONS = ("method", "experiments")


def load_ir(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, a JSON object each (one a line)."""
    return spark.read.schema(IR).json(path)


def sections(ir: DataFrame) -> DataFrame:
    s = ir.select("paper_id", F.posexplode("sections").alias("ord", "s"))
    kind = F.when(F.coalesce("s.section_type", F.lit("other")) != "other", F.col("s.section_type")).otherwise(T.section_type(F.coalesce("s.title", F.lit(""))))
    return s.select(F.concat_ws("::", "paper_id", "s.id").alias("section_id"), "paper_id", F.col("s.title").alias("title"), kind.alias("section_type"), "ord", F.col("s.paragraphs").alias("paragraphs"))


def paragraphs(sectioned: DataFrame) -> DataFrame:
    p = sectioned.select("section_id", "paper_id", "title", "section_type", "ord", F.posexplode("paragraphs").alias("pos", "p"))
    return p.select("section_id", "paper_id", F.col("title").alias("section_title"), "section_type", F.col("ord").alias("section_ord"), "pos", F.col("p.id").alias("paragraph_id"), F.coalesce("p.text", F.lit("")).alias("text"), F.col("p.citations").alias("citations"), *[(F.coalesce(F.size(f"p.{k[:-1]}_refs"), F.lit(0)) > 0).alias(f"near_{k}") for k in ("equations", "algorithms", "tables")])


def chunks(ir: DataFrame, paras: DataFrame) -> DataFrame:
    """Prose of paragraphs, then tables, figures and equations; numbered within the paper."""
    prose = paras.select("paper_id", "section_id", "paragraph_id", F.lit(0).alias("kind_ord"), "section_ord", "pos", F.col("section_title").alias("title"), F.posexplode(T.split_overlap(T.scrub(F.col("text")))).alias("part", "text")).filter(F.trim("text") != "")
    kind = T.chunk_kind(F.col("title"), F.col("text"))
    prose = prose.select("paper_id", "section_id", "paragraph_id", "kind_ord", "section_ord", "pos", "part", "text", kind["kind"].alias("chunk_kind"), kind["quality"].alias("quality"))
    every = prose
    for order, (column, label, body) in enumerate((("tables", "table", "caption"), ("figures", "caption", "caption"), ("equations", "equation_block", "latex")), 1):
        rows = ir.select("paper_id", F.posexplode(column).alias("pos", "x"))
        text = T.scrub(F.col(f"x.{body}")) if body == "caption" else F.col(f"x.{body}")
        rows = rows.select("paper_id", F.concat_ws("::", "paper_id", "x.section_id").alias("section_id"), F.col("x.id").alias("paragraph_id"), F.lit(order).alias("kind_ord"), F.lit(0).alias("section_ord"), "pos", F.lit(0).alias("part"), text.alias("text"), F.lit(label).alias("chunk_kind"), F.lit(E.KIND_QUALITY[label]).alias("quality"))
        every = every.unionByName(rows.filter(F.trim("text") != ""))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("kind_ord", "section_ord", "pos", "part")) - 1
    ident = F.xxhash64("paper_id", "kind_ord", "section_ord", "pos", "part")
    return every.select(ident.alias("chunk_id"), "paper_id", "section_id", "paragraph_id", place.alias("ord"), "text", F.floor(F.length("text") / 4).alias("n_tokens"), "quality", "chunk_kind")


def raw_edges(ir: DataFrame, paras: DataFrame) -> DataFrame:
    """Citations in reading order, and references that resolve but aren't cited inline."""
    known = ir.select("paper_id", F.explode("references").alias("r")).filter("r.resolved_paper_id is not null").select("paper_id", F.col("r.ref_id").alias("ref_id"), F.col("r.resolved_paper_id").alias("by_ref")).dropDuplicates(["paper_id", "ref_id"])
    cited = paras.select("paper_id", "section_type", "section_ord", "pos", "paragraph_id", "text", "near_equations", "near_algorithms", "near_tables", F.posexplode("citations").alias("at", "c"))
    cited = cited.withColumn("ref_id", F.col("c.ref_id")).join(known, ["paper_id", "ref_id"], "left").withColumn("to_paper", F.coalesce("c.resolved_paper_id", "by_ref")).filter("to_paper is not null and to_paper <> paper_id")
    n = F.row_number().over(Window.partitionBy("paper_id", "to_paper").orderBy("section_ord", "pos", "at"))
    context = F.coalesce(F.nullif(F.col("c.context_window"), F.lit("")), F.col("text"))
    inline = cited.select(F.concat_ws("::", "paper_id", "to_paper", n.cast("string")).alias("edge_id"), F.col("paper_id").alias("from_paper"), "to_paper", "section_type", "paragraph_id", context.alias("context"), "near_equations", "near_algorithms", "near_tables")
    pairs = known.select(F.col("paper_id").alias("from_paper"), F.col("by_ref").alias("to_paper")).filter("from_paper <> to_paper").distinct().join(inline, ["from_paper", "to_paper"], "left_anti")
    phantom = pairs.select(F.concat_ws("::", "from_paper", "to_paper", F.lit("ref")).alias("edge_id"), "from_paper", "to_paper", F.lit("").alias("section_type"), F.lit("").alias("paragraph_id"), F.lit("").alias("context"), *[F.lit(False).alias(f"near_{k}") for k in ("equations", "algorithms", "tables")])
    return inline.unionByName(phantom)


def classified(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with all roles and intents, the best of each, provenance and weight."""
    titled = edges.join(papers.select(F.col("paper_id").alias("to_paper"), "title"), "to_paper", "left")
    labelled = titled.select("*", S.roles().alias("roles"), S.intents().alias("intents"))
    best = labelled.withColumn("best_role", F.get("roles", F.lit(0))["label"]).withColumn("confidence", F.get("roles", F.lit(0))["confidence"])
    best = best.withColumn("intent", F.get("intents", F.lit(0))["label"]).withColumn("intent_confidence", F.get("intents", F.lit(0))["confidence"])
    inline = (F.coalesce("paragraph_id", F.lit("")) != "") & (F.coalesce("section_type", F.lit("")) != "")
    return best.select("*", F.lit("heuristic").alias("classifier"), F.when(inline, "inline_cite_match").otherwise("bib_resolve").alias("provenance_rule"), S.edge_weight(F.col("confidence"), F.col("best_role"), F.col("intent")).alias("weight"))


def extracted(paras: DataFrame, edges: DataFrame) -> DataFrame:
    """Atoms by (category, name): the definer is the paper that the paragraph cites most surely in that role, else its own."""
    some = paras.groupBy("paper_id").agg(F.max(F.col("section_type").isin(*METHOD_SECTIONS)).alias("has_method"))
    used = paras.join(some, "paper_id").filter(~F.col("has_method") | F.col("section_type").isin(*METHOD_SECTIONS))
    seen = used.select("paper_id", "paragraph_id", "section_ord", "pos", "text", F.posexplode(A.named(F.col("text"))).alias("at", "a")).select("*", "a.category", "a.name").filter(~A.junk_name(F.col("name")))
    category = F.element_at(F.create_map(*[F.lit(x) for kv in E.ROLE_CATEGORY.items() for x in kv]), F.col("best_role"))
    cites = edges.filter(F.col("best_role").isin(*E.CRITICAL_ROLES)).select(F.col("from_paper").alias("paper_id"), "paragraph_id", "to_paper", "confidence", category.alias("category"))
    cites = cites.groupBy("paper_id", "paragraph_id", "category").agg(F.max_by("to_paper", F.struct("confidence", "to_paper")).alias("definer"))
    seen = seen.join(cites, ["paper_id", "paragraph_id", "category"], "left").withColumn("definer", F.coalesce("definer", "paper_id")).withColumn("key", F.lower("name"))
    first = F.min(F.struct("paper_id", "section_ord", "pos", "at", "name", "definer", "paragraph_id", F.substring("text", 1, 1200).alias("verbatim")))
    return seen.groupBy("category", "key").agg(first.alias("f"), F.array_sort(F.collect_set("paper_id")).alias("users"), F.count("*").alias("sightings"))


def atom_tables(found: DataFrame, chunked: DataFrame) -> dict[str, DataFrame]:
    uid = T.atom_uid(F.col("category"), F.col("f.name"), F.col("f.definer"))
    rows = found.select(uid.alias("atom_uid"), "category", "f", "users", "sightings")
    # Names that differ only in the order of their words share a uid: one atom.
    one = rows.groupBy("atom_uid", "category").agg(F.min("f").alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("users")))).alias("users"), F.sum("sightings").alias("sightings"))
    one = cut(one)
    ident = F.concat(F.lit("atom-"), F.col("atom_uid"))
    priority = F.round(F.least(F.lit(1.0), F.log1p(F.col("sightings").cast("double")) / 4), 4)
    atoms = one.select(ident.alias("atom_id"), "atom_uid", F.col("f.name").alias("name"), "category", F.lit(None).cast("string").alias("subcategory"), F.col("f.definer").alias("defined_by"), F.substring("f.verbatim", 1, 240).alias("description"), priority.alias("priority"))
    usage = one.select(ident.alias("atom_id"), F.explode("users").alias("paper_id"), F.lit("uses").alias("role"))
    first = chunked.groupBy("paper_id", "paragraph_id").agg(F.min_by("chunk_id", "ord").alias("chunk_id"))
    evidence = one.select(F.concat(F.lit("ev-"), "atom_uid").alias("evidence_id"), ident.alias("atom_id"), F.col("f.paper_id").alias("paper_id"), F.col("f.paragraph_id").alias("paragraph_id"), F.lit(0).alias("char_start"), F.length("f.verbatim").alias("char_end"), F.col("f.verbatim").alias("verbatim"))
    return {"atoms": atoms, "atom_paper_usage": usage, "atom_evidence": evidence.join(first, ["paper_id", "paragraph_id"], "left")}


def missing(target_paras: DataFrame, atoms: DataFrame) -> DataFrame:
    texts = target_paras.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "pos", "text"))), lambda x: x["text"]), " ").alias("text")).select(F.xxhash64("paper_id").alias("doc_id"), "text")
    gaps = A.missing_parameters(texts).select("question", F.lit("parameter").alias("category"), F.lit("Mentioned without a value.").alias("rationale"))
    need = target_paras.sparkSession.createDataFrame([(k,) for k in E.REQUIRED_CATEGORIES], "category string").join(atoms, "category", "left_anti")
    none = need.select(F.concat(F.lit("No "), "category", F.lit(" atom extracted.")).alias("question"), "category", F.lit("Nothing of this category was found.").alias("rationale"))
    every = gaps.unionByName(none)
    return every.withColumn("md_id", F.concat(F.lit("md-"), F.substring(F.sha1(F.col("question").cast("binary")), 1, 8)))


def scored(ir: DataFrame, edges: DataFrame, atoms: DataFrame, target: str) -> DataFrame:
    """The papers table: metadata, depth from the target, influence and rank; papers that are only cited have stubs."""
    depth1 = edges.filter(F.col("from_paper") == target).select(F.col("to_paper").alias("paper_id")).distinct().withColumn("near", F.lit(True))
    m = ir.select("paper_id", F.col("metadata.title").alias("title"), F.col("metadata.year").alias("year"), F.col("metadata.venue").alias("venue"), F.transform("metadata.authors", lambda a: a["name"]).alias("authors"), F.col("metadata.abstract").alias("abstract"), F.lit(True).alias("acquired"), F.col("acquisition.source").alias("acquired_via"), "citation_count", "influential_count")
    stubs = edges.select(F.col("to_paper").alias("paper_id")).distinct().join(m, "paper_id", "left_anti")
    every = m.unionByName(stubs, allowMissingColumns=True).withColumn("acquired", F.coalesce("acquired", F.lit(False)))
    gain = F.col("confidence") + F.when(F.col("near_equations"), 0.3).otherwise(0.0) + F.when(F.col("near_algorithms"), 0.2).otherwise(0.0) + F.when(F.col("section_type") == "method", 0.3).otherwise(0.0)
    incoming = edges.groupBy(F.col("to_paper").alias("paper_id")).agg(F.sum(gain).alias("s"))
    defined = atoms.groupBy(F.col("defined_by").alias("paper_id")).agg(F.count("*").alias("n"))
    rows = every.join(depth1, "paper_id", "left").join(incoming, "paper_id", "left").join(defined, "paper_id", "left")
    is_target = F.col("paper_id") == target
    implementation = F.when(is_target, F.coalesce("n", F.lit(0)).cast("double")).otherwise(F.coalesce("s", F.lit(0.0)) + 0.5 * F.coalesce("n", F.lit(0)))
    influence = F.when(is_target, 0.0).when(F.col("citation_count").isNull() & F.col("year").isNull(), 0.0).otherwise(S.scholarly(F.col("citation_count"), F.col("influential_count"), F.col("year")))
    rows = rows.withColumn("implementation_influence", F.round(implementation, 4)).withColumn("scholarly_influence", F.round(influence, 4)).withColumn("is_target", is_target)
    depth = F.when(is_target, 0).when(F.col("near"), 1).otherwise(2)
    return rows.withColumn("depth", depth).withColumn("rank", F.when(is_target, 1.0).otherwise(F.round(0.7 * F.col("implementation_influence") + 0.3 * F.col("scholarly_influence"), 4)))


def community_tables(edges: DataFrame, atoms: DataFrame, usage: DataFrame, papers: DataFrame) -> dict[str, DataFrame]:
    """Communities of two papers or more, numbered by size, with a label from their titles."""
    labels = G.label_propagation(cut(G.community_graph(edges, atoms, usage)))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    numbered = sizes.withColumn("community_id", F.row_number().over(Window.orderBy(F.col("size").desc(), "community"))).filter("size >= 2")
    members = cut(labels.join(numbered, "community").select("community_id", F.col("node").alias("paper_id"), "size"))
    titled = members.join(papers.select("paper_id", "title", "rank"), "paper_id", "left").groupBy("community_id", "size").agg(F.max_by("title", F.struct(F.coalesce("rank", F.lit(0.0)), "paper_id")).alias("first"))
    label = F.concat(F.lit("Around "), F.coalesce("first", F.lit("untitled papers")))
    communities = titled.select("community_id", label.alias("label"), F.concat(label, F.lit(": "), F.col("size").cast("string"), F.lit(" papers.")).alias("summary"), "size")
    own = members.join(atoms.select("atom_id", F.col("defined_by").alias("paper_id")), "paper_id").select("community_id", "atom_id").distinct()
    return {"communities": communities, "community_papers": members.select("community_id", "paper_id"), "community_atoms": own}


def build(spark: SparkSession, ir: DataFrame, target: str, folder: str, dim: int = 64, model=None) -> Store:
    """Compile documents into a store; target is the paper that the corpus is about."""
    store = Store(spark, folder)
    # Of repeated documents, the one of the latest fetch.
    latest = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("acquisition.fetched_at").desc_nulls_last(), F.sha1(F.to_json(F.struct("metadata")).cast("binary"))))
    ir = cut(ir.filter("paper_id is not null").withColumn("_n", latest).filter("_n = 1").drop("_n"))
    sectioned = sections(ir)
    paras = cut(paragraphs(sectioned))
    chunked = chunks(ir, paras)
    store.write("sections", sectioned)
    store.write("chunks", chunked)
    store.write("equations", ir.select("paper_id", F.explode("equations").alias("e")).select(F.concat_ws("::", "paper_id", "e.id").alias("equation_id"), "paper_id", F.concat_ws("::", "paper_id", "e.section_id").alias("section_id"), F.col("e.latex").alias("latex")))
    titles = ir.select("paper_id", F.col("metadata.title").alias("title"))
    edges = cut(classified(raw_edges(ir, paras), titles))
    store.write("edges", edges)
    store.write("edge_roles", edges.select("edge_id", F.explode("roles").alias("r")).select("edge_id", "r.label", "r.confidence"))
    store.write("edge_intents", edges.select("edge_id", F.explode("intents").alias("r")).select("edge_id", F.col("r.label").alias("intent_label"), "r.confidence"))
    for name, df in atom_tables(extracted(paras, edges), store.read("chunks")).items():
        store.write(name, df)
    atoms, usage = store.read("atoms"), store.read("atom_paper_usage")
    store.write("missing_details", missing(paras.filter(F.col("paper_id") == target), atoms))
    store.write("papers", scored(ir, edges, atoms, target))
    for name, df in community_tables(edges, atoms, usage.select("atom_id", "paper_id"), store.read("papers")).items():
        store.write(name, df)
    store.write("chunks_vec", embed(store.read("chunks"), "chunk_id", dim, model))
    numbered = atoms.select(F.xxhash64("atom_id").alias("key"), "atom_id", F.concat_ws(". ", "name", "description").alias("text"))
    store.write("atoms_vec", embed(numbered, "key", dim, model).join(numbered.select("key", "atom_id"), "key").select("atom_id", "embedding"))
    named = store.read("communities").select("community_id", F.concat_ws(". ", "label", "summary").alias("text"))
    store.write("communities_vec", embed(named, "community_id", dim, model))
    store.write("meta", spark.createDataFrame([("schema_version", "2.0"), ("target_paper_id", target), ("vector_dim", str(dim))], "key string, value string"))
    return store


def ingest(spark: SparkSession, store: Store, ir: DataFrame, known: DataFrame, target: str, dim: int = 64, model=None) -> Store:
    """Add documents to those known and compile anew; ids of what was there stay the same."""
    fresh = known.join(ir.select("paper_id"), "paper_id", "left_anti").unionByName(ir)
    return build(spark, fresh, target, store.folder, dim, model)
