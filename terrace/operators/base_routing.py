"""Routing of questions to knowledge bases: who may answer, which rule and category each base has, and points by matched terms.

Questions and bases meet through the terms that both have, never all with all. Rule tables: ``domains`` and ``categories``
(category, pos, keyword); ``rules`` (rule, pos, category); ``rule_terms`` (rule, kind, term), kind match, alias, priority or exclude;
``query_rules`` (rule, name, all_of, any_of, none_of, boost).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import normalise, terms
from terrace.operators.retrieval import contained, dense
from terrace.operators.routing import ALIAS, EXCLUDE, KEYWORD, PREFERRED, PRIORITY, TERM_LEAST, TERM_MOST, detect

# Points for the same category, how far a requested base may lie behind, states of bases that answer, and files of a profile.
CATEGORY, KEEP = 10, 3
ANSWERING = ("ready", "indexing")
FILES = 8
#: Rules without a term that must be there hold for all questions; so many may be stated.
MOST_OPEN = 1000


def _words(df: DataFrame, term: str = "term") -> DataFrame:
    return df.withColumn("word", normalise(term)).where("word != ''")


def _matched(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``words`` whose word is in a text, by the text's key."""
    return contained(texts, words.select("word").distinct(), key, text).select(key, "word").join(words, "word")


def base_rules(bases: DataFrame, rule_terms: DataFrame, rules: DataFrame) -> DataFrame:
    """(knowledge_base_id, rule): of each base (knowledge_base_id, plain: its normalised texts) the rule of most match terms that are in
    these or are the base's id; the first one of ties. Bases without a match are left out."""
    match = _words(rule_terms.where("kind = 'match'")).select("rule", "word", F.monotonically_increasing_id().alias("nth"))
    inside = _matched(bases.select("knowledge_base_id", "plain"), match, "knowledge_base_id", "plain").select("knowledge_base_id", "rule", "nth")
    named = bases.select("knowledge_base_id", normalise("knowledge_base_id").alias("word")).join(match, "word").select("knowledge_base_id", "rule", "nth")
    hits = inside.union(named).distinct().groupBy("knowledge_base_id", "rule").agg(F.count("*").alias("hits")).join(rules.select("rule", "pos"), "rule")
    return hits.groupBy("knowledge_base_id").agg(F.min_by("rule", F.struct(-F.col("hits"), "pos", "rule")).alias("rule"))


def base_profiles(bases: DataFrame, documents: DataFrame, rules: DataFrame, rule_terms: DataFrame, query_rules: DataFrame, categories: DataFrame, files: int = FILES) -> DataFrame:
    """(knowledge_base_id, rule, category, keyword_category, profile) of each base (knowledge_base_id, name, subject, description).

    The profile is name, subject, description and the first file names, then the terms of the base's rule, normalised. A rule's
    category comes before the one that the profile's keywords tell; its keywords count if it has any, else those of the told one.
    """
    first = documents.withColumn("_n", F.row_number().over(Window.partitionBy("knowledge_base_id").orderBy("created_at", "filename"))).where(F.col("_n") <= files)
    named = first.groupBy("knowledge_base_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "filename"))), lambda x: x["filename"]), " ").alias("files"))  # at most ``files``
    plain = bases.join(named, "knowledge_base_id", "left").select("knowledge_base_id", normalise(F.concat_ws(" ", "name", "subject", "description", "files")).alias("plain"))
    found = plain.join(base_rules(plain, rule_terms, rules), "knowledge_base_id", "left")
    said = rule_terms.where("kind in ('alias', 'priority')").select("rule", F.col("term").alias("t"), F.when(F.col("kind") == "alias", 0).otherwise(1).alias("o"), F.col("pos").alias("p"))
    asked = query_rules.select("rule", F.posexplode(F.concat("all_of", "any_of")).alias("p", "t"), F.lit(2).alias("o"), F.col("name").alias("n"))
    both = said.select("rule", "o", F.lit("").alias("n"), "p", "t").union(asked.select("rule", "o", "n", "p", "t"))
    texts = both.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "n", "p", "t"))), lambda x: x["t"]), " ").alias("own"))  # one rule's terms
    found = found.join(texts, "rule", "left").withColumn("profile", F.concat("plain", normalise("own")))
    told = detect(found.select("knowledge_base_id", "profile"), categories, "knowledge_base_id", "profile").select("knowledge_base_id", F.col("category").alias("told"))
    found = found.join(told, "knowledge_base_id", "left").join(rules.select("rule", F.col("category").alias("ruled")), "rule", "left")
    has = categories.select(F.col("category").alias("ruled"), F.lit(True).alias("has")).distinct()
    ruled = F.nullif(F.col("ruled"), F.lit(""))
    return found.join(has, "ruled", "left").select(
        "knowledge_base_id", "rule", F.coalesce(ruled, "told").alias("category"), F.when(ruled.isNotNull() & F.col("has"), ruled).otherwise(F.col("told")).alias("keyword_category"), "profile"
    )


def rule_points(queries: DataFrame, rule_terms: DataFrame, query_rules: DataFrame) -> DataFrame:
    """(query_id, rule, points) of questions (query_id, q: normalised) that have points by a rule's terms or by its clauses."""
    q = queries.select("query_id", "q")
    points = F.when(F.col("kind") == "alias", ALIAS).when(F.col("kind") == "priority", PRIORITY).otherwise(-EXCLUDE)
    by_terms = _matched(q, _words(rule_terms.where("kind in ('alias', 'priority', 'exclude')")), "query_id", "q").select("query_id", "rule", points.alias("p"))
    by_clauses = clause_rules(q, query_rules).select("query_id", "rule", F.col("boost").alias("p"))
    return by_terms.union(by_clauses).groupBy("query_id", "rule").agg(F.sum("p").cast("long").alias("points"))


def clause_rules(queries: DataFrame, query_rules: DataFrame) -> DataFrame:
    """(query_id, rule, name, boost) of the rules that a question (query_id, q: normalised) meets: all terms of ``all_of``, one of
    ``any_of`` if there are any, none of ``none_of``; a rule without clauses is met by none. Terms that are empty when normalised
    are passed over."""
    rules = query_rules.select("rule", "name", "boost", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("all_of", "any_of", "none_of")])
    filled = lambda c: F.filter(F.transform(c, lambda t: normalise(t)), lambda t: t != "")
    rules = rules.where(F.size("all_of") + F.size("any_of") + F.size("none_of") > 0).select("*", F.size(F.array_distinct(filled("all_of"))).alias("need"), (F.size("any_of") > 0).alias("choice"))
    parts = [rules.select("rule", "name", F.lit(kind).alias("kind"), F.explode(F.array_distinct(filled(kind))).alias("word")) for kind in ("all_of", "any_of", "none_of")]
    met = _matched(queries, reduce(DataFrame.union, parts), "query_id", "q").groupBy("query_id", "rule", "name").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("all_of", "any_of", "none_of")])
    told = rules.select("rule", "name", "boost", "need", "choice")
    closed = met.join(told.where("need > 0 or choice"), ["rule", "name"]).where("all_of = need and (not choice or any_of > 0) and none_of = 0")
    open_ = [(r["rule"], r["name"], r["boost"]) for r in told.where("need = 0 and not choice").limit(MOST_OPEN + 1).collect()]
    if len(open_) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} rules without a term that must be there")
    found = closed.select("query_id", "rule", "name", "boost")
    if not open_:
        return found
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("name"), F.lit(b).alias("boost")) for r, n, b in open_]))
    rest = queries.select("query_id", each.alias("x")).select("query_id", "x.*").join(met.where("none_of > 0").select("query_id", "rule", "name"), ["query_id", "rule", "name"], "left_anti")
    return found.unionByName(rest)


def _ranked(bases: DataFrame) -> DataFrame:
    """Bases that answer, with their places in the list of all and in that of their domain. A base's list is one row set of its own."""
    live = bases.where(F.col("status").isin(*ANSWERING)).select("knowledge_base_id", "pos", F.coalesce(F.nullif("domain", F.lit("")), F.lit("general")).alias("domain"))
    both = live.unionByName(live.withColumn("domain", F.lit(None).cast("string")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("pos", "knowledge_base_id")))  # of bases, not of questions


def routes(
    queries: DataFrame, bases: DataFrame, documents: DataFrame, domains: DataFrame, categories: DataFrame, rules: DataFrame, rule_terms: DataFrame, query_rules: DataFrame,
    vectors: DataFrame | None = None, least: float = 0.45, margin: float = 0.03, keep: int = KEEP,
) -> DataFrame:
    """(query_id, knowledge_base_id, score, auto_routed) of questions (query_id, query, requested and, with ``vectors``, query_vector).

    Bases that are ready or being indexed may answer; if the question's keywords tell a domain and one of these has it, only such.
    Points: keywords of the base's category in question and profile, the question's terms in the profile by their length, the
    requested base, the base's rule, and the same category. The best base wins, the first in the list of ties; where no base has
    points above 0 the first without any comes before those with fewer. With ``vectors`` (knowledge_base_id, embedding) the nearest
    base wins instead, with its similarity times 1000, if it is near enough and leads the second by ``margin``. A requested base
    that may answer stays if the winner has fewer points than it and ``keep`` more. Questions have no row if no base may answer.
    """
    q = queries.withColumn("q", normalise("query"))
    told = lambda words, name: detect(queries.select("query_id", "query"), words).select("query_id", F.col("category").alias(name))
    listed = _ranked(bases)
    has = listed.where("domain is not null").select(F.col("domain").alias("said_domain"), F.col("domain").alias("in_domain")).distinct()
    asked = q.join(told(domains, "said_domain"), "query_id", "left").join(has, "said_domain", "left").join(told(categories, "q_category"), "query_id", "left")
    asked = asked.select("query_id", "q", "requested", "in_domain", "q_category", *(["query_vector"] if vectors is not None else []))
    known = base_profiles(bases.where(F.col("status").isin(*ANSWERING)), documents, rules, rule_terms, query_rules, categories)

    own = _words(categories, "keyword").select(F.col("category").alias("keyword_category"), "word", F.monotonically_increasing_id().alias("nth"))
    in_base = _matched(known.select("knowledge_base_id", "profile"), own.select("word").distinct(), "knowledge_base_id", "profile").join(known.select("knowledge_base_id", "keyword_category"), "knowledge_base_id")
    in_base = in_base.join(own, ["keyword_category", "word"]).select("knowledge_base_id", "word", "nth")
    by_keyword = _matched(q.select("query_id", "q"), in_base, "query_id", "q").select("query_id", "knowledge_base_id", F.lit(KEYWORD).alias("p"))

    some = F.when(F.size(terms("query")) > 0, terms("query")).otherwise(F.array("q"))
    words = q.select("query_id", F.explode(F.array_distinct(some)).alias("t")).select("query_id", "t", normalise("t").alias("word")).where(F.length("word") >= 2)
    by_term = _matched(known.select("knowledge_base_id", "profile"), words, "knowledge_base_id", "profile").select("query_id", "knowledge_base_id", F.greatest(F.lit(TERM_LEAST), F.least(F.length("word"), F.lit(TERM_MOST))).alias("p"))
    by_choice = queries.where("requested is not null").select("query_id", F.col("requested").alias("knowledge_base_id"), F.lit(PREFERRED).alias("p"))
    by_rule = rule_points(q, rule_terms, query_rules).join(known.select("knowledge_base_id", "rule"), "rule").select("query_id", "knowledge_base_id", F.col("points").alias("p"))
    by_category = asked.select("query_id", F.col("q_category").alias("category")).join(known.select("knowledge_base_id", "category"), "category").select("query_id", "knowledge_base_id", F.lit(CATEGORY).alias("p"))
    scored = reduce(DataFrame.union, [by_keyword, by_term, by_choice, by_rule, by_category]).groupBy("query_id", "knowledge_base_id").agg(F.sum("p").cast("long").alias("score"))

    mine = lambda d: F.col(d).eqNullSafe(F.col("in_domain"))
    places = listed.select("knowledge_base_id", F.col("domain").alias("list_domain"), "place")
    met = scored.join(asked.select("query_id", "in_domain"), "query_id").join(places, "knowledge_base_id").where(mine("list_domain"))
    best = met.groupBy("query_id").agg(F.min_by(F.struct("knowledge_base_id", "score", "place"), F.struct(-F.col("score"), "place")).alias("b"), F.collect_set("place").alias("taken"))
    free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), "taken")), F.lit(1))  # the first in the list without points
    found = asked.join(best, "query_id", "left").withColumn("free", free)
    spare = listed.select(F.col("knowledge_base_id").alias("spare"), F.col("domain").alias("spare_domain"), F.col("place").alias("spare_place"))
    found = found.join(spare, F.col("spare_domain").eqNullSafe(F.col("in_domain")) & (F.col("spare_place") == F.col("free")), "left")
    wins = F.col("b").isNull() | F.coalesce((F.col("b.score") < 0) | ((F.col("b.score") == 0) & (F.col("spare_place") < F.col("b.place"))), F.lit(False)) & F.col("spare").isNotNull()
    found = found.select("query_id", "requested", "in_domain", F.when(wins, F.col("spare")).otherwise(F.col("b.knowledge_base_id")).alias("best"), F.when(wins, F.lit(0).cast("long")).otherwise(F.col("b.score")).alias("score"))
    if vectors is not None:
        found = _nearest(found, asked, listed, vectors, least, margin)
    held = met.select(F.col("query_id").alias("_q"), F.col("knowledge_base_id").alias("_b"), F.col("score").alias("own"))
    found = found.join(held, (F.col("query_id") == F.col("_q")) & (F.col("requested") == F.col("_b")), "left")  # it has points for being requested, if it may answer
    stays = F.coalesce((F.col("best") != F.col("requested")) & (F.col("score") < F.col("own") + keep), F.lit(False))
    chosen = F.when(stays, F.col("requested")).otherwise(F.col("best"))
    return found.where("best is not null").select("query_id", chosen.alias("knowledge_base_id"), F.when(stays, F.col("own")).otherwise(F.col("score")).alias("score"), (~chosen.eqNullSafe(F.col("requested"))).alias("auto_routed"))


def _nearest(found: DataFrame, asked: DataFrame, listed: DataFrame, vectors: DataFrame, least: float, margin: float) -> DataFrame:
    """Winners by vector where they are clear; each domain's questions meet its bases in blocks."""
    at = [r[0] for r in listed.select("domain").distinct().collect()]  # a domain of the rule table each, and null for all
    near = None
    for d in at:
        here = listed.where(F.col("domain").eqNullSafe(F.lit(d))).select("knowledge_base_id").join(vectors, "knowledge_base_id").select(F.col("knowledge_base_id").alias("chunk_id"), "embedding")
        part = dense(here, asked.where(F.col("in_domain").eqNullSafe(F.lit(d))).select("query_id", "query_vector"), 2, "cosine")
        near = part if near is None else near.union(part)
    if near is None:
        return found
    two = near.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("chunk_id", "similarity"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    clear = two.where((F.col("a.similarity") >= least) & (F.col("second").isNull() | (F.round(F.col("a.similarity") - F.col("second"), 6) >= margin)))
    told = clear.select(F.col("query_id").alias("_n"), F.col("a.chunk_id").alias("near"), F.round(F.col("a.similarity") * 1000).cast("long").alias("points"))
    both = found.join(told, F.col("query_id") == F.col("_n"), "left")
    return both.select("query_id", "requested", "in_domain", F.coalesce("near", "best").alias("best"), F.coalesce("points", "score").alias("score"))
