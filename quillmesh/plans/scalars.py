"""Scalar functions and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import scoring as S
from quillmesh.plans.base import query
from quillmesh.sources import enums as E

# A line with what its function looks for, so that every branch runs on invented prose.
def laced():
    return F.concat("text", F.lit(" <cit.> \\ref{a:1} <g r a p h i c s> \\label{x}\n\\eqref{e}  end"))



LACED_SQL = "(text || ' <cit.> \\ref{a:1} <g r a p h i c s> \\label{x}' || chr(10) || '\\eqref{e}  end')"


@query("fn_scrub_placeholders", f"SELECT paper_id, pos, {T.scrub_sql(LACED_SQL)} AS clean FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", T.scrub(laced()).alias("clean"))


@query("fn_scrub_atoms", f"SELECT paper_id, pos, {T.scrub_sql(LACED_SQL, E.PLACEHOLDERS[:4])} AS clean FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", T.scrub(laced(), E.PLACEHOLDERS[:4]).alias("clean"))


@query("fn_prose_quality", f"SELECT paper_id, pos, {T.prose_quality_sql('text')} AS quality FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", T.prose_quality(F.col("text")).alias("quality"))


def marked():
    return F.when(F.col("pos") % 7 == 1, F.concat(F.lit("[12] "), "text")).when(F.col("pos") % 7 == 2, F.concat("text", F.lit(" $$x=1$$"))).otherwise(F.col("text"))
MARKED_SQL = "CASE WHEN pos % 7 = 1 THEN '[12] ' || text WHEN pos % 7 = 2 THEN text || ' $$x=1$$' ELSE text END"
def titled():
    return F.when(F.col("pos") % 11 == 3, "References and notes").when(F.col("pos") % 11 == 4, "Bibliography")
TITLED_SQL = "CASE WHEN pos % 11 = 3 THEN 'References and notes' WHEN pos % 11 = 4 THEN 'Bibliography' END"


@query("fn_chunk_kind", f"SELECT paper_id, pos, k.kind AS kind, k.quality AS quality FROM (SELECT paper_id, pos, {T.chunk_kind_sql('title', 'marked')} AS k FROM (SELECT *, {MARKED_SQL} AS marked, {TITLED_SQL} AS title FROM paragraphs))")
def _(c):
    return c.paragraphs.select("paper_id", "pos", T.chunk_kind(titled(), marked()).alias("k")).select("paper_id", "pos", "k.kind", "k.quality")


@query("fn_split_overlap", f"SELECT doc_id, w - 1 AS place, windows[w] AS piece FROM (SELECT doc_id, windows, unnest(range(1, len(windows) + 1)) AS w FROM (SELECT doc_id, {T.split_overlap_sql('clean')} AS windows FROM (SELECT doc_id, {T.scrub_sql('text')} AS clean FROM documents)))")
def _(c):
    clean = c.table("documents").select("doc_id", T.scrub(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.posexplode(T.split_overlap(F.col("clean"))).alias("place", "piece"))


TITLES = ("Abstract", "Introduction", "Related Work", "Model Evaluation", "Training Details", "Analysis of Results", "Discussion", "Summary", "Supplementary", "Thanks", "Our Approach", "Prior Work and Setup")


def titles_sql() -> str:
    return "(SELECT doc_id, ([" + ", ".join(T.quote(t) for t in TITLES) + f"])[doc_id % {len(TITLES)} + 1] || ' ' || substr(title, 1, 12) AS heading FROM papers)"


def titles(c):
    return c.papers.select("doc_id", F.concat(F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("doc_id") % len(TITLES) + 1).cast("int")), F.lit(" "), F.substring("title", 1, 12)).alias("heading"))


@query("parse_section_type", f"SELECT doc_id, {T.section_type_sql('heading')} AS section_type FROM {titles_sql()}")
def _(c):
    return titles(c).select("doc_id", T.section_type(F.col("heading")).alias("section_type"))


@query("fn_method_adjacent_title", f"SELECT doc_id, {T.hits_sql('lower(heading)', E.METHOD_TITLES)} > 0 AS adjacent FROM {titles_sql()}")
def _(c):
    return titles(c).select("doc_id", T.any_of(F.lower("heading"), E.METHOD_TITLES).alias("adjacent"))


@query("fn_n_tokens", "SELECT paper_id, pos, length(text) // 4 AS n_tokens FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", F.floor(F.length("text") / 4).alias("n_tokens"))


@query("fn_tokenize_fts", "SELECT paper_id, pos, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) > 2), ' ') AS terms FROM paragraphs")
def _(c):
    return c.paragraphs.select("paper_id", "pos", F.array_join(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 2), " ").alias("terms"))


@query("fn_tokenize_atoms", "SELECT atom_id, array_to_string(regexp_extract_all(lower(name || ' ' || description), '[a-z0-9_-]+'), ' ') AS terms FROM atoms")
def _(c):
    return c.atoms.select("atom_id", F.array_join(T.tokens(F.lower(F.concat_ws(" ", "name", "description")), "[a-z0-9_-]+"), " ").alias("terms"))


STOP = "[" + ", ".join(T.quote(s) for s in E.STOP_TOKENS) + "]"


def dedup_tokens(name):
    stop = F.array(*[F.lit(s) for s in E.STOP_TOKENS])
    return F.array_sort(F.array_distinct(F.filter(T.tokens(F.lower(name), "[a-z0-9]+"), lambda x: ~F.array_contains(stop, x))))


def dedup_tokens_sql(name: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({name}), '[a-z0-9]+'), lambda x: NOT list_contains({STOP}, x))))"


@query("fn_tokens_dedup", f"SELECT atom_id, array_to_string({dedup_tokens_sql('description')}, ' ') AS terms FROM atoms")
def _(c):
    return c.atoms.select("atom_id", F.array_join(dedup_tokens(F.col("description")), " ").alias("terms"))


@query("fn_tokens_ref", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: length(x) > 3))), ' ') AS terms FROM papers")
def _(c):
    return c.papers.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(T.tokens(F.lower("title"), "[a-z0-9]+"), lambda x: F.length(x) > 3))), " ").alias("terms"))


PAIRS_SQL = f"(SELECT a.atom_id, {dedup_tokens_sql('a.description')} AS x, {dedup_tokens_sql('b.description')} AS y FROM atoms a JOIN atoms b ON b.seq = a.seq + 1)"


def token_pairs(c):
    """Each atom beside the next one."""
    t = c.atoms.select("atom_id", "seq", dedup_tokens(F.col("description")).alias("x"))
    return t.join(t.select((F.col("seq") - 1).alias("seq"), F.col("x").alias("y")), "seq").drop("seq")


def jaccard(x, y):
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


@query("fn_jaccard", f"SELECT atom_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS jaccard FROM {PAIRS_SQL}")
def _(c):
    return token_pairs(c).select("atom_id", jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query("fn_containment", f"SELECT atom_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)) END AS containment FROM {PAIRS_SQL}")
def _(c):
    return token_pairs(c).select("atom_id", F.coalesce(F.try_divide(F.size(F.array_intersect("x", "y")), F.least(F.size("x"), F.size("y"))), F.lit(0.0)).alias("containment"))


@query("fn_canonical_name", f"SELECT doc_id, {T.canonical_name_sql('title')} AS canonical FROM papers")
def _(c):
    return c.papers.select("doc_id", T.canonical_name(F.col("title")).alias("canonical"))


@query("fn_atom_uid", f"SELECT atom_id, {T.atom_uid_sql('category', 'name', 'defined_by')} AS atom_uid FROM atoms")
def _(c):
    return c.atoms.select("atom_id", T.atom_uid(F.col("category"), F.col("name"), F.col("defined_by")).alias("atom_uid"))


@query("fn_seq_ids", "SELECT doc_id, format('md-{:03d}', row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id)) AS id FROM documents")
def _(c):
    from pyspark.sql import Window

    return c.table("documents").select("doc_id", F.format_string("md-%03d", F.row_number().over(Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id"))).alias("id"))


@query("fn_slugify", f"SELECT event_id, {T.slug_sql(chr(39) + chr(34) + chr(39) + ' || title || props')} AS slug FROM decisions")
def _(c):
    return c.decisions.select("event_id", T.slug(F.concat(F.lit('"'), "title", "props")).alias("slug"))


@query("fn_safe_id", "SELECT page_id, replace(replace(url, ':', '_'), '/', '_') AS cache_id, regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g') AS wiki_id FROM pages")
def _(c):
    return c.table("pages").select("page_id", F.translate("url", ":/", "__").alias("cache_id"), F.regexp_replace("url", "[^A-Za-z0-9_-]+", "_").alias("wiki_id"))


@query("fn_norm_title", "SELECT doc_id, regexp_replace(lower(title), '[^a-zA-Z0-9 ]+', ' ', 'g') AS title FROM papers")
def _(c):
    return c.papers.select("doc_id", F.regexp_replace(F.lower("title"), "[^a-zA-Z0-9 ]+", " ").alias("title"))


REF_SQL = """(SELECT a.doc_id, a.year, b.year AS other, [split_part(a.acquired_via, 'c', 2)] AS authors, [split_part(b.acquired_via, 'c', 2), 'x'] AS found,
    list_filter(list_distinct(string_split(regexp_replace(lower(a.title), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' ')), lambda t: t <> '') AS t,
    list_filter(list_distinct(string_split(regexp_replace(lower(b.title), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' ')), lambda t: t <> '') AS u
    FROM papers a JOIN papers b ON b.doc_id = (a.doc_id * 7 + 30) % (SELECT n FROM n_docs))"""


@query("fn_ref_match_score", f"""SELECT doc_id, round(score, 6) AS score, CASE WHEN score >= 0.4 THEN round(least(0.9::DOUBLE, 0.4::DOUBLE + score / 2), 6) END AS confidence FROM (
    SELECT doc_id, CASE WHEN authors[1] IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_intersect(authors, found))::DOUBLE / greatest(1, len(authors))) END + CASE WHEN year = other THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
      + least(0.6::DOUBLE, len(list_intersect(t, u))::DOUBLE / 20.0::DOUBLE) AS score FROM {REF_SQL})""")
def _(c):
    words = lambda t: F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(t), "[^a-zA-Z0-9 ]+", " "), " ")), lambda w: w != "")
    p = c.papers.select("doc_id", "year", F.element_at(F.split("acquired_via", "c"), 2).alias("author"), words(F.col("title")).alias("t"))
    other = p.select(F.col("doc_id").alias("other_id"), F.col("year").alias("other"), F.array("author", F.lit("x")).alias("found"), F.col("t").alias("u"))
    pairs = p.join(other, F.col("other_id") == (F.col("doc_id") * 7 + 30) % c.count)
    overlap = F.when(F.col("author").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(F.array("author"), "found")).cast("double")))
    score = overlap + F.when(F.col("year") == F.col("other"), 0.4).otherwise(0.0) + F.least(F.lit(0.6), F.size(F.array_intersect("t", "u")) / 20.0)
    return pairs.select("doc_id", score.alias("s")).select("doc_id", F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.4, F.round(F.least(F.lit(0.9), 0.4 + F.col("s") / 2), 6)).alias("confidence"))


@query("fn_keyword_hits", f"SELECT doc_id, {T.hits_sql('lower(text)', E.ROLE_KEYWORDS['procedure_dependency'][1])} AS procedure_hits, {T.hits_sql('lower(text)', E.ROLE_KEYWORDS['theory_dependency'][1])} AS theory_hits FROM documents")
def _(c):
    low = F.lower("text")
    return c.table("documents").select("doc_id", T.hits(low, E.ROLE_KEYWORDS["procedure_dependency"][1]).alias("procedure_hits"), T.hits(low, E.ROLE_KEYWORDS["theory_dependency"][1]).alias("theory_hits"))


@query("fn_hint_stop_list", "SELECT paper_id, pos, word FROM (SELECT paper_id, pos, split_part(text, ' ', 1) AS word FROM paragraphs) WHERE lower(word) IN (" + ", ".join(T.quote(s) for s in E.STOP_NAMES) + ")")
def _(c):
    return c.paragraphs.select("paper_id", "pos", F.element_at(F.split("text", " "), 1).alias("word")).filter(F.lower("word").isin(*E.STOP_NAMES))


@query("fn_provenance", "SELECT edge_id, CASE WHEN coalesce(paragraph_id, '') <> '' AND coalesce(section_type, '') <> '' THEN 'inline_cite_match' ELSE 'bib_resolve' END AS rule FROM edges")
def _(c):
    return c.edges.select("edge_id", F.when((F.coalesce("paragraph_id", F.lit("")) != "") & (F.coalesce("section_type", F.lit("")) != ""), "inline_cite_match").otherwise("bib_resolve").alias("rule"))


@query("fn_edge_weight", f"SELECT edge_id, {S.edge_weight_sql('confidence', 'best_role', 'intent')} AS weight FROM edges")
def _(c):
    return c.edges.select("edge_id", S.edge_weight(F.col("confidence"), F.col("best_role"), F.col("intent")).alias("weight"))


@query("fn_confidence_norm", "SELECT edge_id, round(least(0.95::DOUBLE, CASE WHEN total <= 0 THEN 0.0::DOUBLE ELSE confidence / total END), 6) AS share FROM (SELECT edge_id, confidence, sum(confidence) OVER (PARTITION BY from_paper) AS total FROM edges)")
def _(c):
    from pyspark.sql import Window

    total = F.sum("confidence").over(Window.partitionBy("from_paper"))
    return c.edges.select("edge_id", "confidence", total.alias("total")).select("edge_id", F.round(F.least(F.lit(0.95), F.coalesce(F.try_divide(F.col("confidence"), F.col("total")), F.lit(0.0))), 6).alias("share"))


@query("fn_json", """SELECT event_id, '{"session":' || CAST(json_extract(props, '$.session') AS VARCHAR) || '}' AS body, json_extract_string(props, '$.session') AS session FROM events""")
def _(c):
    value = F.get_json_object("props", "$.session")
    body = F.concat(F.lit('{"session":'), F.when(F.col("props").rlike('"session"\\s*:\\s*"'), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value), F.lit("}"))
    return c.table("events").select("event_id", body.alias("body"), value.alias("session"))


@query("fn_extract_wikilinks", r"SELECT doc_id, unnest(regexp_extract_all('[[' || title || '|x]] and [[p' || doc_id || ']] [[open', '\[\[([^\]|]+)[\]|]', 1)) AS target FROM papers WHERE NOT contains(title, ']')")
def _(c):
    page = F.concat(F.lit("[["), "title", F.lit("|x]] and [[p"), F.col("doc_id").cast("string"), F.lit("]] [[open"))
    return c.papers.filter(~F.col("title").contains("]")).select("doc_id", F.explode(F.regexp_extract_all(page, F.lit(r"\[\[([^\]|]+)[\]|]"), F.lit(1))).alias("target"))


PROMPTS = ("continue please", "compare the papers on arxiv", "port this", "is the code correct", "it failed again", "implement the loss", "implement the dataset", "code up the solver", "build the metric", "reproduce the baseline", "implement it", "training diverged", "hello", "port the encoder", "remember that")


def _case(text: str, classes, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {T.quote(p)}) THEN '{label}'" for label, p in classes) + f" ELSE {otherwise} END"


def prompts_sql() -> str:
    return "(SELECT conv_id, turn, lower(([" + ", ".join(T.quote(p) for p in PROMPTS) + f"])[(conv_id + turn) % {len(PROMPTS)} + 1] || ' ' || substr(text, 1, 20)) AS p FROM conversations)"


def prompts(c):
    words = F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), ((F.col("conv_id") + F.col("turn")) % len(PROMPTS) + 1).cast("int"))
    return c.table("conversations").select("conv_id", "turn", F.lower(F.concat(words, F.lit(" "), F.substring("text", 1, 20))).alias("p"))


# RE2 has no lookahead: the two conditions of a comparison stand apart.
_PROMPT_SQL = _case("p", E.PROMPT_CLASSES[:1], "NULL")
_PROMPT_SQL = f"CASE WHEN regexp_matches(p, {T.quote(E.PROMPT_CLASSES[0][1])}) THEN 'resume' WHEN regexp_matches(p, '(compare|differ|differs|versus|\\svs\\s)') AND regexp_matches(p, '(arxiv|s2:|doi:|paper\\s[ab]|both\\spapers|two\\spapers)') THEN 'compare' ELSE {_case('p', E.PROMPT_CLASSES[2:], f'CASE WHEN regexp_matches(p, {T.quote(E.IMPLEMENT)}) THEN ' + _case('p', E.IMPLEMENT_CLASSES, chr(39) + 'implement' + chr(39)) + f' WHEN regexp_matches(p, {T.quote(E.DIVERGENCE)}) THEN ' + chr(39) + 'debug-divergence' + chr(39) + ' END')} END"


@query("fn_detect_intent", f"SELECT conv_id, turn, {_PROMPT_SQL} AS intent FROM {prompts_sql()}")
def _(c):
    return prompts(c).select("conv_id", "turn", T.prompt_intent(F.col("p")).alias("intent"))


@query("fn_select_playbook", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN q = '{k}' THEN '{v}'" for k, v in E.PLAYBOOK_NAMES.items()) + f" ELSE {_case('q', E.PLAYBOOK_CLASSES, 'NULL')} END AS playbook FROM (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'parameter' WHEN conv_id % 4 = 1 THEN 'debug' ELSE p END AS q FROM {prompts_sql()})")
def _(c):
    phrase = F.when(F.col("conv_id") % 4 == 0, "parameter").when(F.col("conv_id") % 4 == 1, "debug").otherwise(F.col("p"))
    return prompts(c).select("conv_id", "turn", T.playbook(phrase).alias("playbook"))


QUESTIONS = ("survey of world models", "what loss does it use", "", "how is the temperature set", "key papers", "value of x", "hello there")


@query("fn_route_query", f"SELECT conv_id, turn, {T.route_sql('q')} AS mode FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 2 THEN '' ELSE ([" + ", ".join(T.quote(q) for q in QUESTIONS) + f"])[(conv_id + turn) % 7 + 1] || ' ' || substr(text, 1, 30) END AS q FROM conversations)")
def _(c):
    at = (F.col("conv_id") + F.col("turn")) % 7
    q = F.when(at == 2, "").otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in QUESTIONS]), (at + 1).cast("int")), F.lit(" "), F.substring("text", 1, 30)))
    return c.table("conversations").select("conv_id", "turn", T.route(q).alias("mode"))


IDS = ("https://arxiv.org/abs/2103.00020v1", "arxiv:2103.00020v2", "doi:10.1038/x", "https://doi.org/10.1000/AB-c", "2103.00020", "10.1/x", "a" * 40, "https://www.semanticscholar.org/paper/" + "b" * 40, "s2:" + "c" * 40, "free text")


def ids_sql() -> str:
    return "(SELECT page_id, i, CASE WHEN i = 0 THEN url ELSE ([" + ", ".join(T.quote(x) for x in IDS) + "])[i] END AS s FROM (SELECT page_id, url, page_id % 11 AS i FROM pages))"


@query("src_normalize_id", rf"""SELECT page_id, CASE WHEN host LIKE '%arxiv.org%' AND regexp_matches(path, '\d{{4}}\.\d{{4,5}}') THEN 'ARXIV:' || regexp_extract(path, '(\d{{4}}\.\d{{4,5}})', 1)
    WHEN host LIKE '%doi.org%' AND regexp_matches(path, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+') THEN 'DOI:' || regexp_extract(path, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+')
    WHEN host LIKE '%semanticscholar.org%' AND regexp_matches(path, '(?i)/[0-9a-f]{{40}}/?$') THEN regexp_extract(path, '(?i)([0-9a-f]{{40}})/?$', 1)
    WHEN regexp_full_match(rest, '(?i)(?:arxiv[:/])?\d{{4}}\.\d{{4,5}}(?:v\d+)?') THEN 'ARXIV:' || regexp_extract(rest, '(\d{{4}}\.\d{{4,5}})', 1)
    WHEN regexp_full_match(rest, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+') THEN 'DOI:' || rest ELSE rest END AS id FROM (
    SELECT page_id, regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1) AS path,
      CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN coalesce(nullif(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1), ''), s) ELSE s END AS rest FROM (SELECT page_id, trim(s) AS s FROM {ids_sql()}))""")
def _(c):
    from quillmesh.functions.ids import normalize_id

    pages = c.table("pages").withColumn("i", F.col("page_id") % 11)
    s = F.when(F.col("i") == 0, F.col("url")).otherwise(F.element_at(F.array(*[F.lit(x) for x in IDS]), F.greatest(F.lit(1), F.col("i")).cast("int")))
    return pages.select("page_id", normalize_id(s).alias("id"))
