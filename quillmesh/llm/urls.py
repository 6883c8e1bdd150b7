"""URL filtering: host and path rules, and link-graph propagation for what no rule judges.

Rules come first: a rule fits its host and all subdomains where the path starts with the rule's
path; the longest fitting rule wins. Hosts get two scores over the graph of hyperlinks between
hosts: trust by personalised PageRank that restarts at hosts in proportion to their share of allowed
pages, along the links, and distrust the same way from blocked pages, against the links (who links
to a blocked host is suspect). Rounds go on until no rank moves by more than ``TOLERANCE``. A page
that no rule fits is blocked where its host's distrust is at least ``LEAST`` (of a host all of whose
pages are blocked) and more than ``RATIO`` times its trust. All steps are DataFrame operations; only
the tables of hosts and of host pairs are iterated over, and each round is written to the shared
folder, from where the round before it is deleted.

Edge cases. Null url or one without ``://``: host and path empty, no rule; the empty host is a host
like others, takes no seeds and has no links, so it is allowed. Null html: no links. Very long html:
read whole, each link counts. Relative links and links within a host: no edges. Equal rule lengths:
the first in the list wins. Equal trust and distrust: allowed. Repeated rows: judged alike, and
counted each as a seed. Empty table: no rows. Columns other than page_id, url and html are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, release

#: (rule, verdict); a rule is host/path. At most some hundred: they are part of the plan.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
DAMPING = 0.85
#: Rounds go on until no rank moves by more; 0.85 of a change is left each round, so they end.
TOLERANCE = 1e-5
#: Distrust that blocks: at least so much, and more than so many times the trust (NEAR: equal but for rounding).
LEAST, RATIO, NEAR = 0.01, 1.0, 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links of a page; the host is the first group.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null where none fits), html."""
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled: Column = F.lit(None).cast("struct<rule: string, verdict: string>")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))
    for i in reversed(order):
        host, _, path = rules[i][0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        ruled = F.when(fits, F.struct(F.lit(rules[i][0]).alias("rule"), F.lit(rules[i][1]).alias("verdict"))).otherwise(ruled)
    return out.withColumn("which", ruled).select("page_id", "host", "path", F.col("which.rule").alias("rule"), F.col("which.verdict").alias("ruled"), "html")


def host_scores(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust for every host of judged pages that seeds or links reach.

    The restart vector is seeds / total. Ranks are kept times total: linear, so the same walk, but in
    units of one host whose pages are all seeds, whatever the size of the graph. What hosts without
    links hold goes back to the restart vector, so ranks always sum to total.
    """
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    kinds = (("trust", "allowed"), ("distrust", "blocked"))
    seeds = cut(hosts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("host"), (F.col(n) / F.col("pages")).alias("seed")) for k, n in kinds])).alias("s")).select("s.*").filter("seed > 0"))
    links = pages.select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b")).select("a", F.translate("b", UPPER, LOWER).alias("b")).filter("a <> b AND a <> ''").groupBy("a", "b").agg(F.count("*").alias("n"))
    links = cut(links)
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    if not links.isEmpty():
        both = links.select(F.lit("trust").alias("kind"), F.col("a").alias("host"), F.col("b").alias("to"), "n").union(links.select(F.lit("distrust").alias("kind"), F.col("b").alias("host"), F.col("a").alias("to"), "n"))
        out = both.groupBy("kind", "host").agg(F.sum("n").alias("of"))
        edges = cut(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("of")).alias("share")))
        total = cut(seeds.groupBy("kind").agg(F.sum("seed").alias("total")))
        restart = cut(seeds.join(F.broadcast(total), "kind").select("kind", "host", "seed", (F.col("seed") / F.col("total")).alias("part")))  # total has two rows
        change, before = 1.0, None
        while change > tolerance:
            sent = edges.join(ranks, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            walked = cut(sent.union(restart.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
            lost = total.join(walked.groupBy("kind").agg(F.sum("rank").alias("held")), "kind").select("kind", (F.col("total") - F.col("held")).alias("lost"))
            back = restart.join(F.broadcast(lost), "kind").select("kind", "host", (F.col("lost") * F.col("part")).alias("rank"))
            following = cut(walked.union(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
            moved = following.toDF("kind", "host", "now").join(ranks, ["kind", "host"], "full")
            change = moved.agg(F.max(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("rank", F.lit(0.0))))).first()[0] or 0.0
            release(walked, before)
            ranks = before = following
    return ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k, _ in kinds])


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page, with its host's trust and distrust."""
    seen = judged(pages, rules)
    scores = cut(host_scores(seen)).withColumnRenamed("host", "scored")
    out = seen.drop("html").join(scores, F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust >= LEAST) & (distrust > RATIO * trust + NEAR), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def oracle(rules=RULES, rounds: int = 70, damping: float = DAMPING) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict, so many rounds written out as bring ranks within the tolerance."""
    cases = []
    for i in sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i)):
        host, _, path = rules[i][0].partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN {i}")
    names = "[" + ", ".join(f"'{r}'" for r, _ in rules) + "]"
    verdicts = "[" + ", ".join(f"'{v}'" for _, v in rules) + "]"
    link = LINK.removeprefix("(?i)").replace("'", "''")
    steps = "".join(
        f""",
s{i + 1} AS MATERIALIZED (SELECT e.kind, e.dest AS host, sum({damping}::DOUBLE * r.rank * e.share) AS rank FROM e JOIN r{i} r ON e.kind = r.kind AND e.host = r.host GROUP BY ALL),
r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT * FROM s{i + 1}
  UNION ALL SELECT kind, host, seed * (1 - coalesce((SELECT sum(rank) FROM s{i + 1} WHERE s{i + 1}.kind = seeds.kind), 0) / total) FROM seeds) GROUP BY ALL)"""
        for i in range(rounds)
    )
    return f"""
WITH u AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
w AS (SELECT *, CASE {' '.join(cases)} END AS which FROM u),
j AS (SELECT page_id, html, host, path, ({names})[which + 1] AS rule, ({verdicts})[which + 1] AS ruled FROM w),
h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM j GROUP BY host),
seeds AS MATERIALIZED (SELECT *, sum(seed) OVER (PARTITION BY kind) AS total FROM (SELECT 'trust' AS kind, host, allowed / n AS seed FROM h UNION ALL SELECT 'distrust', host, blocked / n FROM h) WHERE seed > 0),
l AS (SELECT a, b, count(*) AS n FROM (
  SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1, 'i')), '{UPPER}', '{LOWER}') AS b FROM j) WHERE a <> b AND a <> '' GROUP BY ALL),
d AS (SELECT 'trust' AS kind, a AS host, b AS dest, n FROM l UNION ALL SELECT 'distrust', b, a, n FROM l),
e AS MATERIALIZED (SELECT kind, host, dest, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM d),
r0 AS MATERIALIZED (SELECT kind, host, seed AS rank FROM seeds){steps},
s AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.ruled, CASE WHEN coalesce(s.distrust, 0) >= {LEAST} AND coalesce(s.distrust, 0) > {RATIO} * coalesce(s.trust, 0) + {NEAR} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host
"""
