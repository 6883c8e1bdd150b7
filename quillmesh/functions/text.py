"""Scalar text functions as Column expressions, each beside its SQL twin where an oracle needs one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.sources import enums as E


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many different words the text contains, as substrings."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def hits_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {quote(w)}) AS INT)" for w in words) + ")"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def scrub(text: Column, patterns: tuple[str, ...] = E.PLACEHOLDERS) -> Column:
    """Without parser placeholders, white space collapsed; null gives the empty text."""
    out = F.coalesce(text, F.lit(""))
    for p in patterns:
        out = F.regexp_replace(out, F.lit(p), F.lit(""))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def scrub_sql(text: str, patterns: tuple[str, ...] = E.PLACEHOLDERS) -> str:
    out = f"coalesce({text}, '')"
    for p in patterns:
        out = f"regexp_replace({out}, {quote(p)}, '', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def prose_quality(text: Column) -> Column:
    """0 for nothing, 0.05 under 20 characters, else 0.05 to 1 by shares of letters, digits and table marks."""
    n = F.length(text).cast("double")
    count = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / n
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 1)
    number = F.size(words).cast("double")
    mean = F.length(F.array_join(words, "")) / F.greatest(number, F.lit(1.0))
    score = 0.5 * F.least(F.lit(1.0), (count(r"\p{L}") - 0.3) / 0.4) + 0.3 * F.least(F.lit(1.0), number / 100.0) + 0.2 * (1.0 - F.least(F.lit(1.0), count(r"\p{Nd}") / 0.5))
    score = score - 0.4 * F.least(F.lit(1.0), count(r"[|&\\]") / 0.05) - F.when((mean > 14) | (mean < 2.5), 0.2).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(n < 20, 0.05).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), score)), 3))


def prose_quality_sql(t: str) -> str:
    n = f"CAST(length({t}) AS DOUBLE)"
    share = lambda p: rf"(({n} - length(regexp_replace({t}, '{p}', '', 'g'))) / {n})"
    words = rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: length(w) > 1)"
    mean = f"(length(array_to_string({words}, '')) / greatest(CAST(len({words}) AS DOUBLE), 1.0))"
    score = (
        rf"0.5::DOUBLE * least(1.0::DOUBLE, ({share(chr(92) + 'p{L}')} - 0.3::DOUBLE) / 0.4::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, CAST(len({words}) AS DOUBLE) / 100.0::DOUBLE) + 0.2::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, {share(chr(92) + 'p{Nd}')} / 0.5::DOUBLE))"
        rf" - 0.4::DOUBLE * least(1.0::DOUBLE, {share('[|&' + chr(92) * 2 + ']')} / 0.05::DOUBLE) - CASE WHEN {mean} > 14 OR {mean} < 2.5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
    )
    return f"CASE WHEN coalesce(length({t}), 0) = 0 THEN 0.0::DOUBLE WHEN length({t}) < 20 THEN 0.05::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.05::DOUBLE, {score})), 3) END"


def chunk_kind(title: Column, text: Column) -> Column:
    """struct(kind, quality): references by the section's title or a numbered entry, display equations, prose."""
    low = F.lower(F.coalesce(title, F.lit("")))
    fixed = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(E.KIND_QUALITY[kind]).alias("quality"))
    return (
        F.when(low.contains("reference") | low.contains("bibliograph") | F.coalesce(text.rlike(E.REFERENCE_ENTRY), F.lit(False)), fixed("reference"))
        .when(text.rlike(E.EQUATION_BLOCK), fixed("equation_block"))
        .otherwise(F.struct(F.lit("prose").alias("kind"), prose_quality(text).alias("quality")))
    )


def chunk_kind_sql(title: str, t: str) -> str:
    low = f"lower(coalesce(CAST({title} AS VARCHAR), ''))"
    return f"""CASE WHEN contains({low}, 'reference') OR contains({low}, 'bibliograph') OR coalesce(regexp_matches({t}, {quote(E.REFERENCE_ENTRY)}), false) THEN {{'kind': 'reference', 'quality': 0.30::DOUBLE}}
        WHEN regexp_matches({t}, {quote(E.EQUATION_BLOCK)}) THEN {{'kind': 'equation_block', 'quality': 0.50::DOUBLE}} ELSE {{'kind': 'prose', 'quality': {prose_quality_sql(t)}}} END"""


def section_type(title: Column) -> Column:
    """The first label one of whose words the title contains."""
    low = F.lower(F.trim(title))
    out = F.lit("other")
    for label, words in reversed(E.SECTION_TITLES):
        out = F.when(sum((low.contains(w).cast("int") for w in words), F.lit(0)) > 0, label).otherwise(out)
    return out


def section_type_sql(title: str) -> str:
    return "CASE " + " ".join(f"WHEN {hits_sql(f'lower(trim({title}))', words)} > 0 THEN '{label}'" for label, words in E.SECTION_TITLES) + " ELSE 'other' END"


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def split_overlap(text: Column, target: int = 750, overlap: int = 200) -> Column:
    """Windows of about target characters that begin with the end of the one before.

    A fold over sentences: full windows, the open one, its length; a window that its predecessor
    contains from its tail on is dropped.
    """
    text = F.trim(text)
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("open"))

    def step(a: Column, s: Column) -> Column:
        full = a["open"] & (a["n"] + F.length(s) > target)
        done = F.trim(a["cur"])
        tail = F.when(F.length(done) > overlap, F.substring(done, -overlap, overlap)).otherwise(done)
        fresh = F.struct(
            F.concat(a["out"], F.array(done)).alias("out"), F.when(tail != "", F.concat(tail, F.lit(" "), s)).otherwise(s).alias("cur"),
            (F.length(tail) + F.length(s)).alias("n"), F.lit(True).alias("open"),
        )
        longer = F.struct(a["out"].alias("out"), F.when(a["open"], F.concat(a["cur"], F.lit(" "), s)).otherwise(s).alias("cur"), (a["n"] + F.length(s) + 1).alias("n"), F.lit(True).alias("open"))
        return F.when(full, fresh).otherwise(longer)

    windows = F.aggregate(split_sentences(text), zero, step, lambda a: F.when(a["open"], F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"]))

    def unique(out: Column, w: Column) -> Column:
        last = F.element_at(out, -1)
        tail = F.when(F.length(last) > overlap, F.substring(last, -overlap, overlap)).otherwise(last)
        return F.when(F.size(out) == 0, F.array(w)).when(w.startswith(tail) & last.contains(w), out).otherwise(F.concat(out, F.array(w)))

    return F.when(F.length(text) <= target, F.array(text)).otherwise(F.aggregate(windows, F.array().cast("array<string>"), unique))


def split_overlap_sql(text: str, target: int = 750, overlap: int = 200) -> str:
    """The two folds as list_reduce over structs."""
    t = f"trim({text})"
    sentences = rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    items = f"list_transform({sentences}, lambda s: {{'out': CAST([] AS VARCHAR[]), 'cur': s, 'n': CAST(length(s) AS INT) + 1}})"
    tail = f"right(trim(a.cur), {overlap})"
    step = f"""CASE WHEN a.n + length(b.cur) > {target} THEN {{'out': list_append(a.out, trim(a.cur)), 'cur': CASE WHEN {tail} <> '' THEN {tail} || ' ' || b.cur ELSE b.cur END, 'n': CAST(length({tail}) + length(b.cur) AS INT)}}
        ELSE {{'out': a.out, 'cur': a.cur || ' ' || b.cur, 'n': a.n + b.n}} END"""
    folded = f"list_reduce({items}, lambda a, b: {step})"
    windows = f"list_transform([{folded}], lambda r: list_append(r.out, trim(r.cur)))[1]"
    unique = f"""list_reduce(list_transform({windows}, lambda w: {{'out': [w]}}), lambda a, b:
        CASE WHEN starts_with(b.out[1], right(a.out[-1], {overlap})) AND contains(a.out[-1], b.out[1]) THEN a ELSE {{'out': list_append(a.out, b.out[1])}} END).out"""
    return f"CASE WHEN length({t}) <= {target} THEN [{t}] ELSE {unique} END"


def canonical_name(name: Column) -> Column:
    """Lower-case tokens without articles, sorted."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    stop = F.array(*[F.lit(s) for s in E.NAME_STOP_TOKENS])
    return F.array_join(F.array_sort(F.filter(tokens, lambda x: (x != "") & ~F.array_contains(stop, x))), " ")


def canonical_name_sql(name: str) -> str:
    stop = "[" + ", ".join(quote(s) for s in E.NAME_STOP_TOKENS) + "]"
    return f"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains({stop}, x))), ' ')"


def atom_uid(category: Column, name: Column, paper: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("/", F.lit("v1"), category, canonical_name(name), paper).cast("binary")), 1, 16)


def atom_uid_sql(category: str, name: str, paper: str) -> str:
    return f"substr(sha1('v1/' || {category} || '/' || {canonical_name_sql(name)} || '/' || {paper}), 1, 16)"


def slug(text: Column, longest: int = 40, default: str = "decision") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, longest), "-+$", "")
    return F.when(s == "", default).otherwise(s)


def slug_sql(text: str, longest: int = 40, default: str = "decision") -> str:
    s = f"regexp_replace(regexp_replace(lower(trim(coalesce({text}, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(regexp_replace(substr({s}, 1, {longest}), '-+$', ''), ''), '{default}')"


def first_class(text: Column, classes: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
    out = otherwise
    for label, pattern in reversed(classes):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def prompt_intent(prompt: Column) -> Column:
    """The class of a prompt; null where none fits."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    build = first_class(p, E.IMPLEMENT_CLASSES, F.lit("implement"))
    return first_class(p, E.PROMPT_CLASSES, F.when(p.rlike(E.IMPLEMENT), build).when(p.rlike(E.DIVERGENCE), "debug-divergence"))


def playbook(phrase: Column) -> Column:
    """The playbook of a category or a free phrase; null where none fits."""
    p = F.lower(F.coalesce(phrase, F.lit("")))
    named = F.create_map(*[F.lit(x) for kv in E.PLAYBOOK_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, p), first_class(p, E.PLAYBOOK_CLASSES, F.lit(None).cast("string")))


def route(question: Column) -> Column:
    """global, local or hybrid."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.when(q == "", "hybrid").when(q.rlike(E.GLOBAL_QUESTION), "global").when(q.rlike(E.LOCAL_QUESTION), "local").otherwise("hybrid")


def route_sql(q: str) -> str:
    return f"CASE WHEN trim(coalesce({q}, '')) = '' THEN 'hybrid' WHEN regexp_matches({q}, {quote(E.GLOBAL_QUESTION)}) THEN 'global' WHEN regexp_matches({q}, {quote(E.LOCAL_QUESTION)}) THEN 'local' ELSE 'hybrid' END"


def tokens(text: Column, pattern: str = "[A-Za-z0-9]+") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
