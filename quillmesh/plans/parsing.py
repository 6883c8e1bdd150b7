"""Sources and parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions.text import quote, section_type_sql
from quillmesh.operators import parse as P
from quillmesh.operators.ranking import top_per_group
from quillmesh.plans.base import query

_TEX = "(text || ' % note ' || doc_id || chr(10) || '50\\% kept' || chr(10) || '%all')"


def tex(c):
    return c.table("documents").select("doc_id", F.concat("text", F.lit(" % note "), F.col("doc_id").cast("string"), F.lit("\n50\\% kept\n%all")).alias("text"))


# RE2 has no lookbehind: the character before is captured and put back.
@query("parse_tex_strip_comments", f"SELECT doc_id, regexp_replace({_TEX}, '(^|[^\\\\])%[^\\n]*', '\\1', 'g') AS text FROM documents")
def _(c):
    return tex(c).select("doc_id", P.strip_comments(F.col("text")).alias("text"))


@query("parse_tex_main", "SELECT kind, doc_id FROM (SELECT source AS kind, doc_id, row_number() OVER (PARTITION BY source ORDER BY contains(text, '%%%') DESC, length(text) DESC, doc_id) AS place FROM documents) WHERE place = 1")
def _(c):
    rows = c.table("documents").select(F.col("source").alias("kind"), "doc_id", F.col("text").contains("%%%").alias("root"), F.length("text").alias("n"))
    return top_per_group(rows, ["kind"], [F.col("root").desc(), F.col("n").desc(), F.col("doc_id")], 1).select("kind", "doc_id")


def _bib(c):
    return c.papers.select("doc_id", F.concat(F.lit("\\begin{thebibliography}\\bibitem{k"), F.col("doc_id").cast("string"), F.lit("} First work.\n \\bibitem[x]{z} Other,  1999 \\end{thebibliography}")).alias("text"))


@query("parse_tex_bbl", "SELECT doc_id, 'k' || doc_id AS key, 'First work.' AS body FROM papers UNION ALL SELECT doc_id, 'z', 'Other, 1999' FROM papers")
def _(c):
    return P.bibitems(_bib(c))


@query("parse_tex_bib")
def _(c):
    text = F.concat(F.lit("@article{a"), F.col("doc_id").cast("string"), F.lit(", title = {A {Nested} title}, year = {"), F.col("year").cast("string"), F.lit("}}\n@book{b, author=\"Doe, Jane\"}"))
    return P.bib_entries(c.papers.select("doc_id", text.alias("text")))


@query("parse_tex_inputs")
def _(c):
    d = c.papers.select("doc_id", "title")
    files = d.select("doc_id", F.lit("main").alias("name"), F.lit("A \\input{part} B \\include{main}").alias("text")).unionByName(d.select("doc_id", F.lit("part").alias("name"), F.col("title").alias("text")))
    return P.expand_inputs(files)


@query("parse_tex_doc")
def _(c):
    body = F.concat(F.lit("\\begin{document}\\section{Intro}\n"), "title", F.lit(" \\cite{a,b}\n\n$$x=1$$ more\n\\section{Method}\\begin{align}y\\end{align} end % gone\n\\end{document}"))
    return P.tex_document(c.papers.select("doc_id", body.alias("text")))


_MD = "('# Introduction' || chr(10) || replace(text, '#', '') || chr(10) || chr(10) || '## Our Model' || chr(10) || 'one' || chr(10) || 'two')"


@query("parse_md_doc", f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split({_MD}, chr(10)), 1) - 1 AS line_no, unnest(string_split({_MD}, chr(10))) AS line FROM documents),
    r AS (SELECT *, regexp_matches(line, '^#{{1,4}} ') AS heading, trim(line) = '' AS blank FROM l), s AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, sum(CAST(heading OR blank AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM r),
    h AS (SELECT doc_id, section, regexp_replace(line, '^#+ ', '') AS title FROM s WHERE heading), p AS (SELECT doc_id, section, block, string_agg(line, ' ' ORDER BY line_no) AS text FROM s WHERE NOT heading AND NOT blank GROUP BY ALL)
    SELECT doc_id, section, title, {section_type_sql('title')} AS section_type, row_number() OVER (PARTITION BY doc_id, section ORDER BY block) AS paragraph, text FROM p JOIN h USING (doc_id, section)""")
def _(c):
    text = F.concat(F.lit("# Introduction\n"), F.regexp_replace("text", "#", ""), F.lit("\n\n## Our Model\none\ntwo"))
    return P.markdown(c.table("documents").select("doc_id", text.alias("text")))


_LABEL = "CASE (doc_id + pos) % 6 WHEN 0 THEN 'section_header' WHEN 1 THEN 'page_footer' ELSE 'text' END"


@query("parse_pdf_doc", f"""WITH i AS (SELECT doc_id, pos AS line_no, {_LABEL} AS label, CASE WHEN (doc_id + pos) % 12 = 0 THEN 'References' ELSE text END AS text FROM paragraphs), k AS (SELECT *, sum(CAST(label = 'section_header' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM i WHERE label <> 'page_footer'),
    h AS (SELECT doc_id, section, text AS title FROM k WHERE label = 'section_header') SELECT k.doc_id, k.section, coalesce(h.title, 'Body') AS title, row_number() OVER (PARTITION BY k.doc_id, k.section ORDER BY line_no) AS paragraph, k.text, regexp_matches(lower(coalesce(h.title, 'Body')), 'reference|bibliograph') AS is_reference
    FROM k LEFT JOIN h ON k.doc_id = h.doc_id AND k.section = h.section WHERE label <> 'section_header'""")
def _(c):
    k = F.col("doc_id") + F.col("pos")
    label = F.when(k % 6 == 0, "section_header").when(k % 6 == 1, "page_footer").otherwise("text")
    return P.labelled_items(c.paragraphs.select("doc_id", F.col("pos").alias("at"), label.alias("label"), F.when(k % 12 == 0, "References").otherwise(F.col("text")).alias("text")))


@query("parse_inline_citations", """SELECT paper_id, pos, '[' || n || ']' AS marker, substr(cited, 1, 400) AS context FROM (SELECT paper_id, pos, cited, unnest(list_distinct(list_transform(string_split(array_to_string(regexp_extract_all(cited, '\\[(\\d{1,3}(?:\\s*,\\s*\\d{1,3})*)\\]', 1), ','), ','), lambda x: trim(x)))) AS n
    FROM (SELECT paper_id, pos, 'As in [' || (pos % 90) || ', 7] and [12]: ' || text AS cited FROM paragraphs))""")
def _(c):
    cited = F.concat(F.lit("As in ["), (F.col("pos") % 90).cast("string"), F.lit(", 7] and [12]: "), "text")
    return P.inline_citations(c.paragraphs.withColumn("text", cited))


@query("parse_bib_fields", "SELECT doc_id, title AS bib_title, CAST(year AS VARCHAR) AS bib_year FROM papers WHERE NOT contains(title, '}')")
def _(c):
    raw = F.concat(F.lit("Title = {"), "title", F.lit("} year={"), F.col("year").cast("string"), F.lit("} note={x}"))
    return c.papers.filter(~F.col("title").contains("}")).select("doc_id", P.bib_fields(raw).alias("m")).select("doc_id", F.col("m")["title"].alias("bib_title"), F.col("m")["year"].alias("bib_year"))


@query("parse_author_last_names", "SELECT doc_id, 'doe,' || coalesce(nullif(regexp_replace(lower(list_extract(string_split(trim(title), ' '), 1)), '[^a-z]', '', 'g'), '') || ',', '') || 'oneil' AS names FROM (SELECT doc_id, regexp_extract(title, '^[A-Za-z]+') AS title FROM papers)")
def _(c):
    word = F.regexp_extract("title", "^[A-Za-z]+", 0)
    authors = F.concat(F.lit("Doe, Jane and "), word, F.lit(", X; Sean O'Neil"))
    return c.papers.select("doc_id", F.array_join(P.last_names(authors), ",").alias("names"))


@query("parse_json_object", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS body FROM events")
def _(c):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("no object {")).otherwise(F.concat(F.lit("answer: "), "props", F.lit(" done")))
    return c.table("events").select("event_id", P.json_object(text).alias("body"))


# Sources


@query("src_resolve", "SELECT e.event_id, CASE WHEN p.paper_id IS NOT NULL THEN p.paper_id ELSE 'none' END AS paper_id, CASE WHEN p.paper_id IS NULL THEN 0.4::DOUBLE WHEN e.event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM events e LEFT JOIN papers p ON p.doc_id = e.event_id")
def _(c):
    p = c.papers.select("paper_id", F.col("doc_id").alias("event_id"))
    found = F.col("paper_id").isNotNull()
    return c.table("events").select("event_id").join(p, "event_id", "left").select("event_id", F.coalesce("paper_id", F.lit("none")).alias("paper_id"), F.when(~found, 0.4).when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.6).alias("confidence"))


@query("src_first_success", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'arxiv' WHEN doc_id % 3 = 0 THEN 'openalex' WHEN doc_id % 2 = 0 THEN 'unpaywall' END AS source FROM documents")
def _(c):
    d = c.table("documents").select("doc_id")
    tries = d.filter("doc_id % 2 = 0").select("doc_id", F.lit(3).alias("priority"), F.lit("unpaywall").alias("source")).unionByName(d.filter("doc_id % 5 = 0").select("doc_id", F.lit(1).alias("priority"), F.lit("arxiv").alias("source"))).unionByName(d.filter("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("priority"), F.lit("openalex").alias("source")))
    return d.join(tries.groupBy("doc_id").agg(F.min_by("source", "priority").alias("source")), "doc_id", "left")


@query("src_pdf_magic_check", "SELECT page_id, starts_with(html, '<!DOCTYPE') AS is_html, starts_with(html, '%PDF') AS is_pdf FROM pages")
def _(c):
    return c.table("pages").select("page_id", F.col("html").startswith("<!DOCTYPE").alias("is_html"), F.col("html").startswith("%PDF").alias("is_pdf"))


@query("src_json_cache", "SELECT sha1('key:' || event_id) AS key, substr(sha1('key:' || event_id), 1, 2) AS shard FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(c):
    key = F.sha1(F.concat(F.lit("key:"), F.col("event_id").cast("string")).cast("binary"))
    e = c.table("events")
    newest = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return e.crossJoin(newest).filter("ts >= since").select(key.alias("key"), F.substring(key, 1, 2).alias("shard"))


@query("scan_csv", "SELECT slug, condition, leaf_id, status FROM grades")
def _(c):
    """The grades as lines of CSV, read with the schema of the grades file."""
    lines = c.grades.select(F.concat_ws(",", "slug", "condition", F.col("leaf_id").cast("string"), "status").alias("line"))
    return lines.select(F.from_csv("line", "slug string, condition string, leaf_id long, status string").alias("r")).select("r.*")


@query("scan_rows_from_db", "SELECT atom_id, count(DISTINCT evidence_id) AS spans, string_agg(DISTINCT u.paper_id, ',' ORDER BY u.paper_id) AS users FROM atoms LEFT JOIN evidence USING (atom_id) LEFT JOIN usage u USING (atom_id) GROUP BY atom_id")
def _(c):
    spans = c.evidence.groupBy("atom_id").agg(F.countDistinct("evidence_id").alias("spans"))
    users = c.usage.groupBy("atom_id").agg(F.array_join(F.array_sort(F.collect_set("paper_id")), ",").alias("users"))
    return c.atoms.select("atom_id").join(spans, "atom_id", "left").join(users, "atom_id", "left").select("atom_id", F.coalesce("spans", F.lit(0)).alias("spans"), "users")


@query("help_ref_lookup", "SELECT from_paper, to_doc, max(slot) AS slot FROM edges WHERE confidence > 0.2 GROUP BY ALL")
def _(c):
    return c.edges.filter("confidence > 0.2").groupBy("from_paper", "to_doc").agg(F.max("slot").alias("slot"))


@query("help_candidate_from_record", "SELECT 's2:' || p_partkey AS paper_id, p_name AS title, p_size AS year, CASE WHEN p_size % 2 = 0 THEN 'ax' || p_partkey END AS arxiv FROM part")
def _(c):
    record = F.struct(F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ax"), F.col("p_partkey").cast("string"))).alias("ArXiv")).alias("externalIds"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_partkey").alias("paperId"))
    r = c.table("part").select(record.alias("r"))
    return r.select(F.concat(F.lit("s2:"), F.col("r.paperId").cast("string")).alias("paper_id"), "r.title", "r.year", F.col("r.externalIds.ArXiv").alias("arxiv"))


@query("help_openalex_url", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'works/doi:10.1/' || doc_id WHEN doc_id % 3 = 0 THEN 'works/doi:10.48550/arXiv.' || doc_id END AS url FROM documents")
def _(c):
    n = F.col("doc_id").cast("string")
    return c.table("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("works/doi:10.1/"), n)).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("works/doi:10.48550/arXiv."), n)).alias("url"))


@query("help_missing_list", f"SELECT 'd:' || doc_id AS paper_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), {quote('licen')})")
def _(c):
    return c.paragraphs.filter(F.lower("text").contains("licen")).select("paper_id", F.col("text").alias("line"))


@query("help_repo_walk", "SELECT source, doc_id, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 30")
def _(c):
    """The first 30 files of each repository: a listing's own limit."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return c.table("documents").withColumn("place", place).filter("place <= 30").select("source", "doc_id", F.length("text").alias("size"))


@query("graph_sql", "SELECT p.acquired_via, count(*) AS n, round(avg(e.confidence), 6) AS mean FROM edges e JOIN papers p ON p.paper_id = e.to_paper WHERE p.year >= 2000 GROUP BY p.acquired_via HAVING count(*) > 1")
def _(c):
    from quillmesh.operators.sqlgate import Gate

    gate = Gate(c.spark, {"edges": c.edges, "papers": c.papers})
    return gate.frame("SELECT p.acquired_via, count(*) AS n, round(avg(e.confidence), 6) AS mean FROM edges e JOIN papers p ON p.paper_id = e.to_paper WHERE p.year >= ? GROUP BY p.acquired_via HAVING count(*) > 1", [2000])


# Documents as Markdown: every third paragraph a heading (each second of these of references), an equation in every fourth line.
_MD = """md AS (SELECT doc_id, nr, CASE WHEN nr % 6 = 2 THEN '# Some References' WHEN nr % 6 = 5 THEN '## Part' WHEN nr % 4 = 1 THEN line || ' $$x_' || nr || '$$ and $$ y $$' ELSE line END AS line FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS nr, unnest(string_split(text, chr(10))) AS line FROM documents)),
    placed AS (SELECT *, count(*) FILTER (regexp_matches(line, '^#{1,4} ')) OVER (PARTITION BY doc_id ORDER BY nr) AS section, last_value(CASE WHEN regexp_matches(line, '^#{1,4} ') THEN contains(lower(line), 'reference') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nr) AS in_refs FROM md)"""


def _markdown(c):
    at = F.col("at")
    lines = c.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.when(at % 6 == 2, "# Some References").when(at % 6 == 5, "## Part").when(at % 4 == 1, F.concat("line", F.lit(" $$x_"), at.cast("string"), F.lit("$$ and $$ y $$"))).otherwise(F.col("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


@query("parse_md_references", f"""WITH {_MD} SELECT doc_id, 'ref-' || n AS ref_id, '[' || n || ']' AS marker, trim(line) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS n FROM placed WHERE in_refs AND NOT regexp_matches(line, '^#{{1,4}} ') AND trim(line) <> '')""")
def _(c):
    from quillmesh.operators.documents import markdown_references

    return markdown_references(_markdown(c))


@query("parse_md_equations", f"""WITH {_MD}, e AS (SELECT doc_id, nr, section, unnest(regexp_extract_all(line, '[$][$](.+?)[$][$]', 1)) AS latex, generate_subscripts(regexp_extract_all(line, '[$][$](.+?)[$][$]', 1), 1) AS pos FROM placed WHERE NOT coalesce(in_refs, false) AND NOT regexp_matches(line, '^#{{1,4}} '))
    SELECT doc_id, 'eq-' || row_number() OVER (PARTITION BY doc_id ORDER BY nr, pos) AS id, CASE WHEN section > 0 THEN 'sec-' || section END AS section, trim(latex) AS latex FROM e""")
def _(c):
    from quillmesh.operators.documents import markdown_equations

    return markdown_equations(_markdown(c))
