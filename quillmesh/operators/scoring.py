"""Rule-based classification of citations, and scores of edges and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import hits, hits_sql, quote
from quillmesh.sources import enums as E

#: A rule: (kind, what, weight). Both engines' expressions are generated from the same rules.
Rule = tuple[str, object, float]


def role_rules() -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {r: [] for r in E.ROLES}
    for section, gains in E.ROLE_SECTIONS.items():
        for role, w in gains.items():
            out[role].append(("section", section, w))
    for role, (w, words) in E.ROLE_KEYWORDS.items():
        out[role].append(("words", words, w))
    out["contradicts"].append(("negation", E.ROLE_NEGATION, 0.35))
    for artifact, gains in E.ROLE_ARTIFACTS.items():
        for role, w in gains.items():
            out[role].append(("near", (artifact,), w))
    for role, words in E.TITLE_KEYWORDS.items():
        out[role].append(("title", words, 0.2))
    return out


def intent_rules() -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {r: [] for r in E.INTENTS}
    for section, gains in E.INTENT_SECTIONS.items():
        for intent, w in gains.items():
            out[intent].append(("section", section, w))
    for intent, (w, words) in E.INTENT_KEYWORDS.items():
        out[intent].append(("words", words, w))
    out["contrasts"].append(("negation", E.INTENT_NEGATION, 0.25))
    out["method"].append(("near", ("equations", "algorithms"), 0.25))
    out["result"] += [("near", ("tables",), 0.2), ("pattern", E.DECIMAL, 0.1)]
    return out


def _term(rule: Rule, text: Column, title: Column) -> Column:
    kind, what, w = rule
    if kind == "section":
        return F.when(F.coalesce("section_type", F.lit("")) == what, w).otherwise(0.0)
    if kind == "words":
        return F.lit(w) * hits(text, what)
    test = {
        "negation": lambda: F.substring(text, 1, 300).rlike("(?U)" + what), "pattern": lambda: text.rlike("(?U)" + what), "title": lambda: sum((title.contains(x).cast("int") for x in what), F.lit(0)) > 0,
        "near": lambda: F.greatest(*[F.coalesce(f"near_{a}", F.lit(False)) for a in what], F.lit(False)),
    }[kind]()
    return F.when(test, w).otherwise(0.0)


def _edged(pattern: str) -> str:
    """RE2 knows ASCII word boundaries only; a test needs no lookaround."""
    return pattern.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])", 1)[::-1].replace(r"\b"[::-1], r"(?:$|[^\p{L}\p{N}_])"[::-1], 1)[::-1]


def _term_sql(rule: Rule) -> str:
    kind, what, w = rule
    text = "lower(coalesce(context, ''))"
    if kind == "section":
        test = f"coalesce(section_type, '') = '{what}'"
    elif kind == "words":
        return f"{w}::DOUBLE * {hits_sql(text, what)}"
    else:
        test = {
            "negation": lambda: f"regexp_matches(substr({text}, 1, 300), {quote(_edged(what))})", "pattern": lambda: f"regexp_matches({text}, {quote(what)})", "title": lambda: hits_sql("lower(coalesce(title, ''))", what) + " > 0",
            "near": lambda: "(" + " OR ".join(f"coalesce(near_{a}, false)" for a in what) + ")",
        }[kind]()
    return f"CASE WHEN {test} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"


def ranked(rules: dict[str, list[Rule]], default: str, decimals: int) -> Column:
    """array<struct<label, confidence>>: the three best labels of a positive score, each over the sum of all positive ones; ties in the labels' order."""
    # The lower-cased text and title are bound once for all rules: higher-order functions don't share subexpressions.
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in (("context", "title") if any(k == "title" for terms in rules.values() for k, *_ in terms) else ("context", "context"))]

    def scores(t: Column) -> Column:
        found = [F.struct((-sum((_term(r, t["text"], t["title"]) for r in terms), F.lit(0.0))).alias("minus"), F.lit(i).alias("place"), F.lit(label).alias("label")) for i, (label, terms) in enumerate(rules.items())]
        return F.array(*found)

    bound = F.get(F.transform(F.array(F.struct(lowered[0].alias("text"), lowered[1].alias("title"))), scores), F.lit(0))
    positive = F.filter(F.array_sort(bound), lambda s: s["minus"] < 0)

    def shares(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda a, s: a - s["minus"])
        some = F.transform(F.slice(p, 1, 3), lambda s: F.struct(s["label"].alias("label"), F.round(F.least(F.lit(0.95), F.try_divide(-s["minus"], total)), decimals).alias("confidence")))
        return F.when(F.size(p) == 0, F.array(F.struct(F.lit(default).alias("label"), F.lit(0.2).alias("confidence")))).otherwise(some)

    return F.get(F.transform(F.array(positive), shares), F.lit(0))


def ranked_sql(rules: dict[str, list[Rule]], default: str, decimals: int, relation: str, keys: str) -> str:
    """The same over a relation: keys, labels (a list of structs)."""
    items = ", ".join(f"{{'minus': -({' + '.join(_term_sql(r) for r in terms) or '0.0::DOUBLE'}), 'place': {i}, 'label': '{label}'}}" for i, (label, terms) in enumerate(rules.items()))
    return f"""SELECT {keys}, CASE WHEN len(p) = 0 THEN [{{'label': '{default}', 'confidence': 0.2::DOUBLE}}] ELSE
        list_transform(p[1:3], lambda s: {{'label': s.label, 'confidence': round(least(0.95::DOUBLE, -s.minus / total), {decimals})}}) END AS labels
        FROM (SELECT *, list_reduce(list_transform(p, lambda s: -s.minus), lambda a, b: a + b, 0.0::DOUBLE) AS total
              FROM (SELECT *, list_filter(list_sort([{items}]), lambda s: s.minus < 0) AS p FROM {relation}))"""


def roles() -> Column:
    return ranked(role_rules(), "related_work_only", 6)


def intents() -> Column:
    return ranked(intent_rules(), "mention", 3)


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def lookup_sql(values: dict[str, float], key: str, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


def edge_weight(confidence: Column, role: Column, intent: Column) -> Column:
    """Confidence times the weights of role and intent, within 0 and 2."""
    return F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.0), confidence * lookup(E.ROLE_WEIGHT, role, 1.0) * lookup(E.INTENT_WEIGHT, intent, 1.0))), 4)


def edge_weight_sql(confidence: str, role: str, intent: str) -> str:
    return f"round(least(2.0::DOUBLE, greatest(0.0::DOUBLE, {confidence} * {lookup_sql(E.ROLE_WEIGHT, role, 1.0)} * {lookup_sql(E.INTENT_WEIGHT, intent, 1.0)})), 4)"


def scholarly(citations: Column, influential: Column, year: Column) -> Column:
    """Influence of a paper by its citations and age; no record: 0."""
    age = 2026 - F.when(F.coalesce(year, F.lit(0)) == 0, 2000).otherwise(year)
    return 0.3 * F.log1p(F.coalesce(citations, F.lit(0)).cast("double")) + 0.4 * F.log1p(F.coalesce(influential, F.lit(0)).cast("double")) + 0.3 * F.greatest(F.lit(0.0), 1 - age / 30.0)


def scholarly_sql(citations: str, influential: str, year: str) -> str:
    return f"(0.3::DOUBLE * ln(1 + coalesce({citations}, 0)::DOUBLE) + 0.4::DOUBLE * ln(1 + coalesce({influential}, 0)::DOUBLE) + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - (2026 - coalesce(nullif({year}, 0), 2000)) / 30.0::DOUBLE))"


def _subsets(tokens: str, size: Column) -> Column:
    """Each set of so many of the sorted tokens, as one string; for a title's tokens, of which there are at most some 15."""
    masks = F.filter(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(tokens)) - 1), lambda m: F.bit_count(m) == size)
    return F.transform(masks, lambda m: F.array_join(F.filter(tokens, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1), " "))


def resolved(refs: DataFrame, records: DataFrame, least: int = 3) -> DataFrame:
    """ref, record: the first record whose title has at least max(least, half) of the reference's distinct tokens.

    refs: ref, tokens; records: record, tokens. A record has t of a reference's tokens if and only if both have a set of t
    tokens. So the first record of each such set is looked up, and references are never paired with all records of a token.
    """
    wanted = F.greatest(F.lit(least), F.floor(F.size("tokens") / 2).cast("int"))
    sought = refs.select("ref", F.array_sort("tokens").alias("tokens"), wanted.alias("t")).filter(F.size("tokens") >= F.col("t"))
    sizes = F.broadcast(sought.select("t").distinct())  # a few numbers
    titles = records.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("record").alias("record"))
    firsts = titles.join(sizes, F.size("tokens") >= F.col("t")).select("record", F.explode(_subsets("tokens", F.col("t"))).alias("key")).groupBy("key").agg(F.min("record").alias("record"))
    return sought.select("ref", F.explode(_subsets("tokens", F.col("t"))).alias("key")).join(firsts, "key").groupBy("ref").agg(F.min("record").alias("record"))
