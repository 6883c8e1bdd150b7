"""Mixing sources to target weights by repetition rates.

Sizes are summed per source; targets follow from the weights by water-filling: a target is
min(cap * size, level * weight), and the level that spends the whole total is found from the
sources ordered by cap * size / weight with running sums (no loop, no collect). A source's rate is
target / size. Each document is emitted floor(rate) times, and once more if its hash falls below
the rate's fraction. The hash is the first three hex digits of md5(doc_id), so reruns agree.

A Bernoulli draw over few or very unequal documents misses its expected words by chance. Therefore
the hashes' words are summed per source and 4096th, and the threshold is put at the boundary whose
words come nearest to fraction * size: the expected fraction, corrected for these very draws.

Edge cases. Null text: size 0. Null source: a source of its own, last in order. Null doc_id: all
such rows share one hash. A source without words: target 0, rate 0. Repeated rows: counted and
drawn each, alike. Ties in the order: by weight, then source; of two thresholds equally near, the
lower. Very long texts: counted whole; one that is most of its source is taken or not, so the source
misses its target by up to half of that text. Empty table: no rows. Other columns, whatever their
names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import WORD, cut

#: The weights, repeating over the sources in order; the largest repetition.
WEIGHTS = (5, 2, 1)
CAP = 3
DRAWS = 4096


def words(text: Column) -> Column:
    """Words of a text as long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """0 to 4095, from md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source; null sorts last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sources = sizes.withColumn("weight", weight.cast("long"))
    capped = (F.lit(cap) * F.col("source_size")).cast("long")
    # Sources in the order in which they reach their caps as the level rises.
    rank = Window.orderBy((capped.cast("double") / F.col("weight")), "weight", F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    onward = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(capped).over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    sources = sources.withColumn("level", level).withColumn("full", capped.cast("double") <= F.col("level") * F.col("weight"))
    # The level holds from the first source that it doesn't fill.
    final = F.min(F.when(~F.col("full"), F.struct((capped.cast("double") / F.col("weight")).alias("at"), F.col("weight"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), F.col("level")))).over(everything)["level"]
    sources = sources.withColumn("final", final)
    return sources.select("source", "source_size", F.when(F.col("final").isNull(), capped.cast("double")).otherwise(F.least(capped.cast("double"), F.col("final") * F.col("weight"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate's whole part, and the draw below which a further copy is made."""
    cells = docs.select(F.col("source").cast("string").alias("source"), draw(F.col("doc_id")).alias("draw"), words(F.col("text")).alias("size")).groupBy("source", "draw").agg(F.sum("size").alias("size"))
    per = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    per = per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("copies", F.least(F.floor("rate"), F.lit(cap)).cast("long"))
    per = per.withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    run = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = cells.withColumn("upto", F.sum("size").over(run)).withColumnRenamed("source", "cell_source")
    near = per.join(steps, F.col("source").eqNullSafe(F.col("cell_source")), "left")
    best = near.groupBy("source", "source_size", "target", "copies", "wanted").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("wanted")).alias("miss"), (F.col("draw") + 1).alias("below"))).alias("best"))
    # No threshold at all (draw below 0) is the nearest where even the first step misses by more.
    below = F.when(F.col("wanted") <= F.col("best.miss"), F.lit(0)).otherwise(F.coalesce("best.below", F.lit(0)))
    return best.select("source", "source_size", "target", "copies", below.alias("below"))


def _weighed(docs: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """row (all columns of docs), mix (size, source_size, target, copies). Two columns: nothing can clash with docs' own."""
    per = cut(plan(docs, weights, cap)).select(F.col("source").alias("mix_source"), F.struct("source_size", "target", "copies", "below").alias("per"))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words(F.col("text")).alias("size"), F.col("source").cast("string").alias("by"), draw(F.col("doc_id")).alias("draw"))
    joined = sized.join(per, F.col("by").eqNullSafe(F.col("mix_source")), "left")
    copies = F.least(F.col("per.copies") + (F.col("draw") < F.col("per.below")).cast("long"), F.lit(cap).cast("long"))
    return joined.select("row", F.struct("size", F.col("per.source_size").alias("source_size"), F.col("per.target").alias("target"), copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and copies (times that the document is in the mix) for every row of docs."""
    return _weighed(docs, weights, cap).select("row.doc_id", "mix.*")


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Every row of docs, all its columns untouched, as often as the mix takes it."""
    taken = _weighed(docs, weights, cap).filter(F.col("mix.copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))).alias("copy")).select("row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3))::INT AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
cells AS (SELECT source, draw, sum(size)::BIGINT AS size FROM d GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM cells GROUP BY ALL),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (
  SELECT *, 3 * source_size AS most,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
f AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN most::DOUBLE <= level * weight THEN 1 ELSE 0 END, most::DOUBLE / weight, weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top,
    min(CASE WHEN most::DOUBLE <= level * weight THEN 1 ELSE 0 END) OVER () AS all_full
  FROM l),
t AS (SELECT source, source_size, CASE WHEN all_full = 1 THEN most::DOUBLE ELSE least(most::DOUBLE, top * weight) END AS target FROM f),
r AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS copies FROM t),
n AS (SELECT *, greatest(0.0::DOUBLE, target - copies * source_size) AS wanted FROM r),
u AS (SELECT source, draw, sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM cells),
b AS (
  SELECT n.source, n.source_size, n.target, n.copies, n.wanted, abs(u.upto - n.wanted) AS miss, u.draw + 1 AS below,
    row_number() OVER (PARTITION BY n.source ORDER BY abs(u.upto - n.wanted), u.draw) AS rn
  FROM n JOIN u ON n.source IS NOT DISTINCT FROM u.source),
p AS (SELECT source, source_size, target, copies, CASE WHEN wanted <= miss THEN 0 ELSE below END AS below FROM b WHERE rn = 1)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * least(p.copies + CASE WHEN d.draw < p.below THEN 1 ELSE 0 END, 3) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
