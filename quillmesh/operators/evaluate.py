"""Evaluation statistics, gates and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.scoring import lookup
from quillmesh.sources import enums as E

#: Words that are no assumption.
PLAIN_WORDS = ("about", "value", "which", "there", "these", "those", "their", "other", "where")


def replication(grades: DataFrame) -> DataFrame:
    """slug, condition, score: mean weight of the grades, skipped ones left out."""
    return grades.filter("status <> 'skipped'").groupBy("slug", "condition").agg(F.avg(lookup(E.GRADE_WEIGHT, F.col("status"), 0.0)).alias("score"))


def summary(scores: DataFrame) -> DataFrame:
    """condition, n, mean, median, and how far its mean lies below C's."""
    per = scores.groupBy("condition").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"))
    top = F.max(F.when(F.col("condition") == "C", F.col("mean"))).over(Window.partitionBy())
    return per.withColumn("below_c", top - F.col("mean"))


def bootstrap(scores: DataFrame, rounds: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """condition, low, high: interval of the mean. Draws are hashes of (seed, round, place), so reruns agree."""
    one = Window.partitionBy("condition")
    listed = scores.withColumn("place", F.row_number().over(one.orderBy("slug")) - 1).withColumn("n", F.count("*").over(one))
    draws = listed.select("condition", "n", F.col("place").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "condition", "round", "draw"), F.col("n")).cast("int"))
    means = draws.join(listed.select("condition", "place", "score"), ["condition", "place"]).groupBy("condition", "round").agg(F.round(F.avg("score"), 9).alias("mean"))
    ranked = means.withColumn("at", F.row_number().over(one.orderBy("mean")) - 1)
    low, high = int(rounds * alpha / 2), int(rounds * (1 - alpha / 2))
    return ranked.groupBy("condition").agg(F.max(F.when(F.col("at") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("mean"))).alias("high"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cohen's kappa of two columns; nothing: 0, chance agreement throughout: 1."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("k"))
    total = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0.0)).alias("agree"))
    one, two = cells.groupBy("a").agg(F.sum("k").alias("ka")), cells.groupBy("b").agg(F.sum("k").alias("kb"))
    chance = one.join(two, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0.0)).alias("both"))
    by_chance = F.col("both") / (F.col("n") * F.col("n"))
    value = F.when(F.coalesce("n", F.lit(0.0)) == 0, 0.0).when(by_chance >= 1, 1.0).otherwise((F.col("agree") / F.col("n") - by_chance) / (1 - by_chance))
    return total.crossJoin(chance).select(value.alias("kappa"))


#: Files that tools answer for, and the ways of reading them past the tools that are blocked.
PROTECTED = (
    "research/wiki/atoms/", "research/wiki/papers/", "research/wiki/communities/", "research/evidence/", "research/graph.json", "research/research.db", "research/embeddings.npy", "research/embeddings.json",
)
DIRECT_TOOLS = ("Read", "Glob", "Grep")


def path_policy(calls: DataFrame) -> DataFrame:
    """calls (tool, path and any others) with blocked: a direct tool on a protected path; a call without a path is open."""
    path = F.coalesce("path", F.lit(""))
    protected = F.lit(False)
    for part in PROTECTED:
        protected = protected | path.contains(part)
    return calls.withColumn("blocked", F.coalesce(F.col("tool").isin(*DIRECT_TOOLS), F.lit(False)) & protected)


def promoted(used: DataFrame, communities: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer, atoms, communities, chunks of the answers worth a page: two atoms or more of different communities, or three chunks or more.

    used: answer, atom_id; communities: atom_id, community_id; chunks: answer, chunk; repeats don't matter. Each is made
    distinct by itself, so that no row is copied for each count.
    """
    count = lambda rows, what, name: rows.distinct().groupBy("answer").agg(F.count(what).alias(name))
    atoms = count(used.select("answer", "atom_id"), "atom_id", "atoms")
    areas = count(used.join(communities, "atom_id").select("answer", "community_id"), "community_id", "communities")
    spans = count(chunks.select("answer", "chunk"), "chunk", "chunks")
    got = atoms.join(areas, "answer", "full_outer").join(spans, "answer", "full_outer").na.fill(0, ["atoms", "communities", "chunks"])
    return got.filter("atoms >= 2 and communities >= 2 or chunks >= 3")


def gates(papers: DataFrame, atoms: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """gate, passed, hard: the acceptance checks of a compiled corpus. All evidence must resolve to a chunk, which is hard where there is any."""
    p = papers.agg(F.count("*").alias("papers"), F.count(F.when(F.col("acquired"), 1)).alias("got"), F.countDistinct("acquired_via").alias("sources"))
    known = chunks.select("paper_id", "paragraph_id").distinct().withColumn("there", F.lit(1))
    resolved = evidence.join(known, ["paper_id", "paragraph_id"], "left").agg(F.count("*").alias("links"), F.count("there").alias("found"))
    every = p.crossJoin(atoms.agg(F.count("*").alias("atoms"), F.countDistinct("defined_by").alias("definers"))).crossJoin(resolved)
    n, some = F.col, lambda x: F.greatest(F.lit(1), x)
    checks = {
        "coverage": (100.0 * n("got") / some(n("papers")) >= 70, F.lit(False)), "atoms": (n("atoms") >= 30, F.lit(False)), "evidence": ((n("links") > 0) & (n("found") == n("links")), n("links") > 0),
        "sources": (n("sources") >= 2, F.lit(False)), "papers": (n("papers") >= 5, F.lit(True)), "definers": (n("definers") / some(n("got")) >= 0.6, F.lit(False)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), passed.alias("passed"), hard.alias("hard")) for k, (passed, hard) in checks.items()])
    return every.select(F.explode(rows).alias("r")).select("r.*")


def lint(edges: DataFrame, papers: DataFrame, atoms: DataFrame, usage: DataFrame) -> DataFrame:
    """problem, item: links without an article, atoms that nobody uses, atoms whose definer is missing."""
    broken = edges.join(papers.filter("depth < 2").select(F.col("paper_id").alias("to_paper")), "to_paper", "left_anti").select(F.lit("broken").alias("problem"), F.col("edge_id").alias("item"))
    orphan = atoms.join(usage, "atom_id", "left_anti").select(F.lit("orphan").alias("problem"), F.col("atom_id").alias("item"))
    stale = atoms.join(papers.filter("acquired").select(F.col("paper_id").alias("defined_by")), "defined_by", "left_anti").select(F.lit("stale").alias("problem"), F.col("atom_id").alias("item"))
    return broken.unionByName(orphan).unionByName(stale)


def assumptions(gaps: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, assumed: how many words of the open questions a file uses."""
    words = lambda p: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)))
    open_ = gaps.select(F.explode(words("[a-z]{5,}")).alias("word")).filter(~F.col("word").isin(*PLAIN_WORDS)).distinct()
    return files.select("doc_id", F.explode(words("[a-z]+")).alias("word")).join(open_, "word").groupBy("doc_id").agg(F.count("*").alias("assumed"))


def auto_checks(files: DataFrame, pattern: str, key: str, arguments: tuple[str, ...]) -> DataFrame:
    """Status of a pattern, of a configured value and of required arguments in each file."""
    value = F.regexp_extract("text", f'{key} = "([^"]*)"', 1)
    lacking = F.size(F.array_except(F.array(*[F.lit(a) for a in arguments]), F.split("text", " ")))
    return files.select(
        "doc_id", F.when(F.col("text").rlike(pattern), "pass").otherwise("fail").alias("pattern_check"),
        F.when(~F.col("text").contains(f"{key} = "), "fail").when(value == "", "partial").otherwise("pass").alias("value_check"),
        F.when(lacking == 0, "pass").when(lacking < len(arguments), "partial").otherwise("fail").alias("argument_check"),
    )


def grade(files: DataFrame, rubric: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id, leaf, status: the rubric's leaves for each file; what isn't automatic is skipped, an unknown test fails."""
    leaves = F.array(*[F.struct(F.lit(k).alias("leaf"), F.lit(test).alias("test"), F.lit(kind).alias("kind")) for k, (test, kind) in rubric.items()])
    status = F.when(F.col("r.kind") != "auto", "skipped").when(F.col("r.test") != "pattern", "fail").when(F.col("found"), "pass").otherwise("fail")
    return files.select("doc_id", "found", F.explode(leaves).alias("r")).select("doc_id", "r.leaf", status.alias("status"))
