"""Quality rules: fixed counts with fixed limits, and robust multivariate outliers.

Base: words, characters in words, symbols, repeated lines and words in repeated three-word windows
are counted over the whole text. A document fails with fewer than 50 words or with more than half of
its words in repeated windows.

Method: each document's counts are transformed to a vector of four: the log of its mean word length
less the group's median, times n / (n + ``WORDS``) for n words; and the square roots of symbols per
character, of repeated lines per (lines + ``LINES``) and of repeated words per (n + ``WORDS``). So
short texts, whose shares vary most, are drawn to the middle and vary like long ones. Per language and source the
centre and covariance are estimated by minimum covariance determinant: from ``RANDOM`` random
subsets of five vectors and from medians and median deviations, two concentration steps each (take
the half of the group that lies nearest, estimate both anew); the start of the least determinant
goes on until its determinant falls no more; then all vectors within the 97.5 % quantile estimate
both once more. A document is rejected beyond the 99.9 % quantile of chi-square with four degrees of
freedom, corrected for the group's size as simulated for normal groups: times exp(547 / n ** 1.6).

Groups of fewer than ``LEAST_GROUP`` rows that pass the base rules (where that correction is beyond
3, so that an estimate of their own tells little) borrow their language's estimate, and those of
languages as rare that of all rows. Quantiles come from counts in at most ``BUCKETS`` buckets a
group, and random subsets from hashes, so they are the same in every run and no group is ever collected.

All of it is DataFrame operations: counts are higher-order functions inside a row, estimates are
sums per group (combined before the shuffle), and only group tables of a few numbers are joined.

Edge cases. Null or empty text: no words, base_failed. Null language or source: a group of their
own. Null doc_id: kept as null. Repeated rows: alike, each counts (but a random subset takes different
vectors). A constant statistic: the covariance has a floor (``FLOOR``). Equal distances: in or out of
a half together. Equal determinants: the start of the least number. Very long texts: counted whole.
Empty table: no rows. No row passes the base rules: no estimates, none kept. Columns other than
doc_id, text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import WORD, cut, release

LEAST_WORDS = 50
LEAST_GROUP = 50
WORDS, LINES = 200, 10
SHARE, RANDOM, SUBSET = 0.5, 4, 5
#: Quantiles of chi-square with 4 degrees of freedom; what the covariance within the 97.5 % one lacks.
CHI_MEDIAN, CHI_975, CHI_999, WITHIN_975 = 3.3567, 11.1433, 18.4668, 0.975 / 0.9155
#: Least standard deviation of each statistic.
FLOOR = (0.03, 0.025, 0.1, 0.1)
DIMS = range(4)
BUCKETS, WIDTH, STEP = 512, 0.004, 0.02
#: Group tables are broadcast where a count shows no more groups than these; beyond, they are joined like others.
FEW_GROUPS = 20_000
SYMBOLS = "#*$%&|<>"


Mark = Callable[[DataFrame], DataFrame]


def plainly(table: DataFrame) -> DataFrame:
    return table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that are in a three-word window found twice or more."""

    def of_hashes(h: Column) -> Column:
        # Equal windows come together when sorted; their places, sorted again, cover min(3, gap) words each.
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        numbered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(numbered, of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, of_hashes)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words and the base counts of every row, with lines and characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    per_word = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    out = docs.select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), per_word.alias("w"), per_line.alias("l"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return out.select("doc_id", "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.repeat").alias("n_repeat_words"), F.col("l.lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors(counted: DataFrame) -> DataFrame:
    """counted with u (log of the mean word length), v (its weight) and x1 to x3; x0 = v * (u - the group's median)."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    x = (F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / (lines + LINES)), F.sqrt(F.col("n_repeat_words") / (n + WORDS)))
    return counted.select("*", F.log(chars / n).alias("u"), (F.col("n_words") / (F.col("n_words") + WORDS)).alias("v"), *[c.alias(f"x{i}") for i, c in enumerate(x, 1)])


def _names() -> tuple[Column, Column]:
    """The groups of a row's language and of its pair."""
    lang = F.coalesce(F.concat(F.lit("l:"), "lang"), F.lit("null"))
    return lang, F.concat(lang, F.lit("\u0000"), F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))


def _groups(rows: DataFrame) -> DataFrame:
    """lang, source -> group: the pair's own, else the language's, else that of all; rows that fail the base rules have a group but don't count."""
    pairs = rows.groupBy("lang", "source").agg(F.count(F.when(~base_failed(), 1)).alias("n"))
    lang, pair = _names()
    return pairs.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.when(F.col("n") >= LEAST_GROUP, pair).when(F.sum("n").over(Window.partitionBy("lang")) >= LEAST_GROUP, lang).otherwise(F.lit("all")).alias("g"))


def _spread(rows: DataFrame, groups: DataFrame, mark: Mark = plainly) -> DataFrame:
    """Each row once for every group whose estimate it takes part in: its own, its language's and all, as far as someone uses them."""
    used = mark(groups.select("g").distinct())
    lang, pair = _names()
    return rows.select("u", "v", "x1", "x2", "x3", F.explode(F.array(pair, lang, F.lit("all"))).alias("g")).join(used, "g", "left_semi")


def _bucket(value: Column, width: float) -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor(value / width)).cast("int")


def quantiles(values: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, bucket -> keys, q: the bucket in which the running count reaches the share, and n, the group's rows.

    Counts are combined before the shuffle; a group's at most BUCKETS of them meet in one row.
    """
    cells = values.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    held = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("n").alias("n"))
    first = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("q")), lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.coalesce(a["q"], F.when(a["upto"] + x["n"] >= share * F.col("n"), x["bucket"])).alias("q")))
    return held.select(*keys, first["q"].alias("q"), "n")


def _of_each(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """g, q0.. : the median of each column (the upper edge of its bucket) by group."""
    long = rows.select("g", F.posexplode(F.array(*[_bucket(c, WIDTH if i else STEP / 4) for i, c in enumerate(columns)])).alias("k", "bucket"))
    found = quantiles(long, ["g", "k"], 0.5)
    return found.groupBy("g").agg(*[F.max(F.when(F.col("k") == i, (F.col("q") + 1) * (WIDTH if i else STEP / 4))).alias(f"q{i}") for i in range(len(columns))])


def centred(spread: DataFrame, mark: Mark = plainly) -> DataFrame:
    """g, x0.. of rows, with word lengths taken from the group's median; and that median as m."""
    middle = cut(_of_each(spread, [F.col("u")]).withColumnRenamed("q0", "m"))
    return cut(spread.join(mark(middle), "g").select("g", "m", (F.col("v") * (F.col("u") - F.col("m"))).alias("x0"), "x1", "x2", "x3"))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"t{i}") for i in DIMS], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"t{i}{j}") for i in DIMS for j in range(i + 1)]]


def _shape(found: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """keys, sums -> keys, means m0.., the Cholesky factor l_ij of the covariance with its floor, and the log of its determinant."""
    out = found
    for i in DIMS:
        out = out.withColumn(f"m{i}", F.col(f"t{i}") / F.col("n"))
    for i in DIMS:
        for j in range(i + 1):
            rest = factor * (F.col(f"t{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR[i] ** 2 if i == j else 0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The floor makes the covariance definite; only rounding could undo it.
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*keys, *[f"m{i}" for i in DIMS], *[f"l{i}{j}" for i in DIMS for j in range(i + 1)], sum((2 * F.log(f"l{i}{i}") for i in DIMS), F.lit(0.0)).alias("det"))


def distances(rows: DataFrame) -> DataFrame:
    """rows with x, m and l columns -> with d2, the squared Mahalanobis distance (forward substitution)."""
    for i in DIMS:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS), F.lit(0.0)))


def starts(rows: DataFrame, mark: Mark = plainly) -> DataFrame:
    """g, s, shapes to start from: 0 by medians and median deviations, the others by random subsets."""
    medians = cut(_of_each(rows, [F.abs(F.col("x0")), *[F.col(f"x{i}") for i in (1, 2, 3)]]).select("g", F.lit(0.0).alias("m0"), *[F.col(f"q{i}").alias(f"m{i}") for i in (1, 2, 3)]))
    spread = _of_each(rows.join(mark(medians), "g"), [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in DIMS])
    deviation = lambda i: F.greatest(1.4826 * F.col(f"q{i}"), F.lit(FLOOR[i]))
    zero = medians.join(spread, "g").select("g", F.lit(0).alias("s"), *[f"m{i}" for i in DIMS], *[(deviation(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in DIMS for j in range(i + 1)], sum((2 * F.log(deviation(i)) for i in DIMS), F.lit(0.0)).alias("det"))
    # A start is the vectors of the least hashes: one of each seed.
    seeds = [(s, k) for s in range(1, RANDOM + 1) for k in range(SUBSET)]
    draw = lambda s, k: F.xxhash64(*[F.col(f"x{i}") for i in DIMS], F.lit(100 * s + k))
    least = cut(rows.groupBy("g").agg(*[F.min(draw(s, k)).alias(f"h{s}_{k}") for s, k in seeds]))
    picked = rows.join(mark(least), "g").select("g", *[f"x{i}" for i in DIMS], F.filter(F.array(*[F.when(draw(s, k) == F.col(f"h{s}_{k}"), F.lit(100 * s + k)) for s, k in seeds]), lambda x: x.isNotNull()).alias("seeds")).filter(F.size("seeds") > 0)
    picked = picked.select("g", *[f"x{i}" for i in DIMS], F.explode("seeds").alias("seed")).distinct().withColumn("s", F.floor(F.col("seed") / 100).cast("int"))
    return cut(zero.unionByName(_shape(picked.groupBy("g", "s").agg(*_sums()), ["g", "s"])))


def concentrate(rows: DataFrame, shapes: DataFrame, mark: Mark = plainly) -> DataFrame:
    """One concentration step of every g, s of shapes."""
    near = distances(rows.join(mark(shapes), "g")).select("g", "s", *[f"x{i}" for i in DIMS], _bucket(F.log1p("d2"), STEP).alias("bucket"))
    limit = cut(quantiles(near, ["g", "s"], SHARE).select("g", "s", "q"))
    inside = near.join(mark(limit), ["g", "s"]).filter(F.col("bucket") <= F.col("q"))
    out = cut(_shape(inside.groupBy("g", "s").agg(*_sums()), ["g", "s"]))
    release(limit)
    return out


def estimate(rows: DataFrame, mark: Mark = plainly) -> DataFrame:
    """g, x0.. -> g, m, l, and n, the group's rows; see the module's head."""
    shapes = starts(rows, mark)
    for _ in range(2):
        shapes = concentrate(rows, shapes, mark)
    best = shapes.groupBy("g").agg(F.min(F.struct("det", "s")).alias("least"))
    shapes = cut(shapes.join(best, "g").filter(F.col("s") == F.col("least.s")).drop("least"))
    falling = True
    while falling:
        # A step never raises a determinant, but for halves that end at a bucket's edge; a group that has settled stays.
        following = concentrate(rows, shapes, mark).select("g", F.struct("*").alias("new"))
        both = shapes.join(following, "g").withColumn("falls", F.col("new.det") < F.col("det") - 1e-3)
        falling = not both.filter("falls").isEmpty()
        shapes = cut(both.select("g", *[F.when(F.col("falls"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in shapes.columns if c != "g"]))
    shapes = shapes.drop("s")
    near = distances(rows.join(mark(shapes), "g")).select("g", *[f"x{i}" for i in DIMS], "d2", _bucket(F.log1p("d2"), STEP).alias("bucket"))
    scale = cut(quantiles(near, ["g"], 0.5).select("g", F.greatest(F.expm1((F.col("q") + 1) * STEP) / CHI_MEDIAN, F.lit(1.0)).alias("scale"), F.col("n").alias("rows")))
    inside = near.join(mark(scale), "g").filter(F.col("d2") <= CHI_975 * F.col("scale"))
    return cut(_shape(inside.groupBy("g").agg(*_sums()), ["g"], WITHIN_975).join(scale.select("g", F.col("rows").alias("n")), "g"))


def cutoff(n: Column) -> Column:
    """The quantile beyond which a vector is an outlier, corrected for an estimate from n rows."""
    return CHI_999 * F.exp(547.0 / F.pow(n.cast("double"), F.lit(1.6)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, distance and kept for every row of docs."""
    rows = cut(vectors(counts(docs)))
    groups = cut(_groups(rows))
    # Hot groups' rows needn't move where the group tables can: as their number, checked here, allows.
    mark = F.broadcast if groups.count() <= FEW_GROUPS else plainly
    # The estimates are made of documents that pass the base rules; what fails them is rejected anyway.
    fit = centred(_spread(rows.filter(~base_failed()), groups, mark), mark)
    shape = cut(estimate(fit, mark).join(mark(fit.select("g", "m").distinct()), "g"))
    release(fit)
    own = cut(groups.join(mark(shape), "g", "left"))
    mine = rows.join(mark(own), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    far = distances(mine.withColumn("x0", F.col("v") * (F.col("u") - F.col("m"))))
    failed = base_failed()
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(F.coalesce(F.col("d2") <= cutoff(F.col("n")), F.lit(True))).alias("kept"), F.col("d2").alias("distance"))
