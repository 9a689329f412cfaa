"""Questions to knowledge bases and intents: rule tables joined to queries, score sums, first matches and guards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.text import clauses, contains_any, keywords, normalise, stem, strip, terms, text_or_empty
from terrace.functions.vectors import cosine, dot, softmax
from terrace.operators.retrieval import contained

# Points of the routing rules.
KEYWORD, TERM_LEAST, TERM_MOST, PREFERRED, ALIAS, PRIORITY, EXCLUDE = 8, 2, 6, 2, 12, 6, 12


def expand_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, aliases): the aliases (term, pos, alias) of all terms that a query contains, distinct, in order of the table."""
    met = contained(queries, aliases, "query_id", "query", "term").select("query_id", F.col("word").alias("term"))
    found = met.join(aliases, "term")
    first = found.groupBy("query_id", "alias").agg(F.min("pos").alias("pos"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"]).alias("aliases"))  # as many as the table has


def expand_conditional(queries: DataFrame, clauses_: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias) of rules (rule_id, group_id, keyword) of which every group has a keyword in the query."""
    groups = clauses_.groupBy("rule_id").agg(F.count_distinct("group_id").alias("groups"))
    found = contained(queries, clauses_, "query_id", "query", "keyword").select("query_id", F.col("word").alias("keyword"))
    met = found.join(clauses_, "keyword").groupBy("query_id", "rule_id").agg(F.count_distinct("group_id").alias("met"))
    full = met.join(groups, "rule_id").where("met = groups")
    return full.join(aliases, "rule_id").select("query_id", "alias").distinct()


def is_overview(query: Column, markers: Sequence[str], topics: Sequence[str]) -> Column:
    return contains_any(query, markers) & contains_any(query, topics)


def is_policy_question(query: Column, words: Sequence[str], phrases: Sequence[str], behaviour: Sequence[str]) -> Column:
    return (contains_any(query, words) | contains_any(query, phrases)) & ~contains_any(query, behaviour)


def first_rule(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, rule): of rules (pos, rule, terms) the first whose terms are all in the query; queries without one are left out.

    Empty terms are in every query; a rule without others meets none.
    """
    terms_ = rules.select("rule", "pos", F.explode(F.array_distinct(F.filter("terms", lambda t: t != ""))).alias("word"))
    need = terms_.groupBy("rule", "pos").agg(F.count("*").alias("need"))
    met = contained(queries, terms_, "query_id", "query").select("query_id", "word").join(terms_, "word").groupBy("query_id", "rule", "pos").agg(F.count("*").alias("met"))
    return met.join(need, ["rule", "pos"]).where("met = need").groupBy("query_id").agg(F.min_by("rule", F.struct("pos", "rule")).alias("rule"))


def rule_scores(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, rule, score) of rule terms (rule, kind, term): 12 for an alias in the query, 6 for a priority term, minus 12 for an excluded one."""
    q = queries.select("query_id", normalise("query").alias("q"))
    t = rules.select("rule", "kind", normalise("term").alias("word")).where("word != ''")
    met = contained(q, t, "query_id", "q").select("query_id", "word").join(t, "word")
    points = F.when(F.col("kind") == "alias", ALIAS).when(F.col("kind") == "priority", PRIORITY).when(F.col("kind") == "exclude", -EXCLUDE).otherwise(0)
    return met.groupBy("query_id", "rule").agg(F.sum(points).cast("long").alias("score"))


def detect(texts: DataFrame, rules: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, category, hits): the category (category, pos, keyword) of most keywords in the text, the first one of ties; texts without a hit are left out."""
    words = rules.select("category", "pos", normalise("keyword").alias("word")).where("word != ''")
    met = contained(texts.select(key, normalise(text).alias("q")), words, key, "q").select(key, "word").join(words, "word")
    counts = met.groupBy(key, "category").agg(F.count("*").alias("hits"), F.min("pos").alias("pos"))
    best = counts.groupBy(key).agg(F.min_by(F.struct("category", "hits"), F.struct(-F.col("hits"), "pos", "category")).alias("b"))
    return best.select(key, "b.category", "b.hits")


def nearest(queries: DataFrame, profiles_: DataFrame, key: str, least: float, margin: float) -> DataFrame:
    """(query_id, key, similarity) by cosine of query_vector and centroid, where it is enough and leads the second by ``margin``."""
    scored = profiles_.crossJoin(queries.select("query_id", "query_vector")).select("query_id", key, F.round(cosine("query_vector", "centroid"), 6).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    two = scored.withColumn("_n", F.row_number().over(w)).where("_n <= 2").withColumn("_next", F.lead("similarity").over(w))
    clear = (F.col("similarity") >= least) & (F.col("_next").isNull() | (F.round(F.col("similarity") - F.col("_next"), 6) >= margin))
    return two.where("_n = 1").where(clear).select("query_id", key, "similarity")


def linear_head(vectors: DataFrame, weights: DataFrame, key: str = "query_id", vector: str = "query_vector") -> DataFrame:
    """(key, label, probability) of the best label of a linear model (pos, label, weights, bias), by softmax over all labels."""
    head = weights.agg(F.array_sort(F.collect_list(F.struct("pos", "label", "weights", "bias"))).alias("head"))  # one row per label
    scored = vectors.crossJoin(F.broadcast(head)).withColumn("_p", softmax(F.transform("head", lambda h: dot(F.col(vector), h["weights"]) + h["bias"])))
    at = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    return scored.select(key, F.get("head", at)["label"].alias("label"), F.round(F.array_max("_p"), 6).alias("probability"))


def is_meaningless(query: Column, characters: str = "啊哦嗯呃额哈呵嘿唉喂噢呀嘛吗呢吧") -> Column:
    """Nothing left, up to two interjections, or one interjection or character repeated."""
    n = normalise(query)
    same = F.size(F.array_distinct(F.filter(F.split(n, ""), lambda x: x != ""))) == 1
    return (n == "") | n.rlike(f"^[{characters}]{{1,2}}$") | ((F.length(n) <= 4) & same & n.rlike(f"^[{characters}]")) | ((F.length(n) <= 6) & n.rlike(r"^(.)\1+$"))


def light_intent(query: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Name of the first rule (name, pattern) that matches the whole query, or of the last clause that is no greeting where every clause matches one."""

    def match(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            out = F.when(n.rlike(f"^(?:{pattern})$"), name).otherwise(out)
        return out

    names = F.transform(clauses(query), match)
    other = F.filter(names, lambda x: x != "greeting")
    by_clause = F.when((F.size(names) > 1) & F.forall(names, lambda x: x.isNotNull()), F.coalesce(F.try_element_at(other, F.lit(-1)), F.try_element_at(names, F.lit(-1))))
    return F.coalesce(match(normalise(query)), by_clause)


def intent(query: Column, has_history: Column, light: Sequence[tuple[str, str]], faq: Sequence[tuple[str, str]], off_topic: Sequence[str], policy: Sequence[str], follow_up: Sequence[str]) -> Column:
    """The first that applies of meaningless, light:name, faq:name, off_topic, follow_up and business."""
    n = normalise(query)
    first = light_intent(query, light)
    asked = light_intent(query, faq)
    whole = lambda patterns: F.lit(False) if not patterns else n.rlike(f"^(?:{'|'.join(patterns)})$")
    off = ~contains_any(text_or_empty(query), policy) & whole(off_topic)
    follows = has_history & (F.length(n) <= 18) & whole(follow_up)
    return (
        F.when(is_meaningless(query), "meaningless").when(first.isNotNull(), F.concat(F.lit("light:"), first)).when(asked.isNotNull(), F.concat(F.lit("faq:"), asked))
        .when(off, "off_topic").when(follows, "follow_up").otherwise("business")
    )


def crosses_domains(query: Column, connectors: Sequence[str], domains: dict[str, Sequence[str]]) -> Column:
    """Whether a query joins two domains by a connective."""
    met = sum((F.when(contains_any(query, words), 1).otherwise(0) for words in domains.values()), F.lit(0))
    return contains_any(query, connectors) & (met >= 2)


def unsupported(query: Column, context: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """Whether a rule's qualifier is in the query and none of its evidence in the context."""
    out = F.lit(False)
    for qualifiers, evidence in rules:
        out = out | (contains_any(query, qualifiers) & ~contains_any(context, evidence))
    return out


def classifier_label(reply: Column, labels: Sequence[str]) -> Column:
    """The label that a model's reply is, or that its first JSON object has; null otherwise."""
    said = strip(F.lower(text_or_empty(reply)))
    inner = F.get_json_object(F.regexp_extract(text_or_empty(reply), r"(?s)\{.*?\}", 0), "$.label")
    return F.when(said.isin(*labels), said).when(inner.isin(*labels), inner)


def is_no_answer(answer: Column, negative: Sequence[str], positive: Sequence[str]) -> Column:
    return (strip(text_or_empty(answer)) == "") | (contains_any(answer, negative) & ~contains_any(answer, positive))


def error_message(error: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The message of the first rule (substring, message) that the error contains."""
    out = F.lit(default)
    for part, message in reversed(rules):
        out = F.when(F.contains(F.lower(text_or_empty(error)), F.lit(part)), message).otherwise(out)
    return out


def source_name(filename: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule whose keyword the file name has, else the file's stem in title marks."""
    out = F.concat(F.lit("《"), stem(filename), F.lit("》"))
    for keyword, name in reversed(rules):
        out = F.when(F.contains(filename, F.lit(keyword)), name).otherwise(out)
    return out


# Words that point back to what was said before.
WEAK_REFERENCES = ("这个", "这个情况", "这种", "那种", "这样", "那样", "上述", "前面", "刚才", "上面")


def needs_second_classifier(query: Column, has_history: Column, policy: Sequence[str], weak: Sequence[str] = WEAK_REFERENCES) -> Column:
    """Whether rules alone are too little: a weak reference in a short question or one with history, or a very short question that
    isn't about policy."""
    n = normalise(query)
    pointing = contains_any(n, weak) & (has_history | (F.length(n) <= 12))
    brief = ~contains_any(text_or_empty(query), policy) & ((F.length(n) <= 6) | (has_history & (F.length(n) <= 12)))
    return (n != "") & (pointing | brief)


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {name} marks replaced; null values are empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), text_or_empty(value))
    return template


def assembled_query(query: Column, rewritten: Column, aliases: Column, overview: Column) -> tuple[Column, Column]:
    """(keywords, search query): keywords of aliases and overview words, or if there are none of the rewrite and overview words; the
    search query has all four parts."""
    own = keywords(aliases, overview)
    return F.when(F.size(own) > 0, own).otherwise(keywords(rewritten, overview)), F.trim(F.concat_ws(" ", *[text_or_empty(c) for c in (query, rewritten, aliases, overview)]))


def profile_rules(spark: SparkSession, root: str, filename: str, schema: str, profile: str | None = None) -> DataFrame:
    """Rules from a JSON file of a profile (root/profiles/profile/filename), or the default one (root/filename) where it has none."""
    if profile is not None and not re.fullmatch("[A-Za-z0-9_-]+", profile):
        raise ValueError(f"Invalid config profile: {profile}")
    for folder in ([f"{root}/profiles/{profile}"] if profile else []) + [root]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{filename}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).json(f"{folder}/{filename}", multiLine=True)
    raise FileNotFoundError(filename)
