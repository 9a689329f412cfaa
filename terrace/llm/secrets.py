"""Secret scan: candidate strings, and a random forest that tells secrets from look-alikes.

Everything on the path is a DataFrame expression or Spark's own random forest.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import stored, table

CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
BLANKS = r"[\x20\x09-\x0D]+"
#: Words that name a value as secret when they stand before it.
NAMING = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential", "apikey", "api_key", "bearer")
DICTIONARY = 400
SAMPLE = 20_000
TREES, DEPTH, SEED = 24, 8, 11
CUTOFF = 0.5

FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "vowels", "distinct", "switches", "alternations", "hex_only", "covered",
    "in_path", "in_address", "quoted", "named", "assigned", "before_plain", "after_plain", "before_covered",
)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", *extra: str) -> DataFrame:
    """(key, word, nth, value, whole, before, before2, after): each run of 16 or more of ``CANDIDATE``'s characters.

    ``word`` is the place of its word in the text, ``nth`` its place among the candidates of that word. Null and empty texts
    have none.
    """
    some = docs.where(F.col(text).rlike(CANDIDATE)).select(F.col(key), *extra, F.split(F.trim(text), BLANKS).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("whole"))), lambda x: (F.length(x["whole"]) >= 16) & x["whole"].rlike(CANDIDATE))
    hits = some.select(key, *extra, "words", F.explode(at).alias("h"))
    near = lambda d: F.coalesce(F.get("words", F.col("h.word") + d), F.lit(""))
    rows = hits.select(key, *extra, "h.word", "h.whole", near(-1).alias("before"), near(-2).alias("before2"), near(1).alias("after"))
    return rows.select("*", F.posexplode(F.regexp_extract_all("whole", F.lit(CANDIDATE), F.lit(0))).alias("nth", "value"))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to twelve letters in all texts; ties by word. ``size`` bounds what is collected."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BLANKS)).alias("w")).where("length(w) between 3 and 12")
    plain = words.groupBy("w").count().where(F.col("w").rlike(r"^\p{L}+$"))
    return [r["w"] for r in plain.orderBy(F.desc("count"), "w").limit(size).collect()]


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """Add the forest's inputs: length, kinds of characters and how they alternate, what the dictionary covers, path, words around."""
    size = F.length("value").cast("double")
    left = lambda c, pattern: F.length(F.regexp_replace(c, pattern, "")).cast("double")
    share = lambda pattern: 1 - left(F.col("value"), pattern) / size
    words = "|".join(sorted(map(re.escape, known), key=lambda w: (-len(w), w))) or "(?!)"
    ratio = lambda c: F.when(F.length(c) > 0, 1 - left(F.lower(c), words) / F.length(c)).otherwise(0.0)
    flag = lambda c: c.cast("double")
    names = f"(?i)(?:{'|'.join(NAMING)})[^A-Za-z]*$"
    ahead = F.concat_ws(" ", "before2", "before")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003"), "[+/_=\\-]+", "\u0004")
    made: dict[str, Column] = {
        "length": F.log(size),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "signs": share(r"[+/_=\-]"), "vowels": share("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
        "switches": (F.length(kinds) - 1) / size,
        "alternations": F.length(F.regexp_replace(F.regexp_replace(F.lower("value"), "[aeiou]+", "1"), "[^1]+", "0")) / size,
        "hex_only": flag(F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "covered": ratio(F.col("value")),
        "in_path": flag(F.col("whole").rlike(r"[/\\].*[/\\]|://")), "in_address": flag(F.col("whole").contains("@")), "quoted": flag(F.col("whole").rlike("^[\"'`(].*[\"'`)]")),
        "named": flag(ahead.rlike(names) | F.col("whole").rlike(f"(?i)(?:{'|'.join(NAMING)})[^A-Za-z]*[=:]")),
        "assigned": flag(F.col("before").rlike("[=:]$") | F.col("whole").rlike("^[A-Za-z_]{2,}[=:]")),
        "before_plain": flag(F.col("before").rlike(r"^\p{L}+[,.]?$")), "after_plain": flag(F.col("after").rlike(r"^\p{L}+[,.]?$")),
        "before_covered": ratio(F.col("before")),
    }
    return found.select("*", *[F.coalesce(made[f], F.lit(0.0)).alias(f) for f in FEATURES])


def train(labelled: DataFrame, sample: int = SAMPLE, label: str = "label") -> RandomForestClassificationModel | None:
    """A forest of at most ``sample`` labelled findings, those of least hash; None unless both labels occur.

    The sample is put in a fixed order, so that the same findings give the same forest.
    """
    chosen = labelled.select(F.col(label).cast("double").alias("label"), *FEATURES).where("label in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64(*FEATURES), *FEATURES, "label").limit(sample).coalesce(1)
    chosen = stored(chosen.sortWithinPartitions(*FEATURES, "label"), "findings")
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, maxMemoryInMB=64)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="inputs").transform(chosen))


def judge(found: DataFrame, model: RandomForestClassificationModel | None, cutoff: float = CUTOFF) -> DataFrame:
    """Add probability and is_secret; without a model, that is without examples of both kinds, every candidate stays."""
    if model is None:
        return found.withColumns({"probability": F.lit(1.0), "is_secret": F.lit(True)})
    out = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="inputs").transform(found))
    chance = vector_to_array("probability")[1]
    return out.withColumn("probability", chance).withColumn("is_secret", F.col("probability") >= cutoff).drop("inputs", "rawPrediction", "prediction")


def known_formats(value: Column, before: Column, before2: Column, whole: Column) -> Column:
    """Labels for findings where a table has none: 1 for documented key formats, 0 for known look-alikes, else null.

    Formats, in any case: an access key id of 20 characters; a hexadecimal value of 40 that is assigned to a name; prefixed
    tokens. Look-alikes: numbers, plain words, rulers, and parts of paths and addresses. What is neither may be a secret of
    another kind, so the forest does not learn from it.
    """
    hexed = value.rlike("(?i)^[0-9a-f]{40}$") & before.rlike("[=:]$") & before2.rlike("(?i)token|key|secret")
    secret = value.rlike("(?i)^AKIA[A-Z0-9]{16}$") | value.rlike("(?i)^gh[pousr]_[A-Z0-9]{36}$") | hexed
    other = value.rlike(r"^(?:[0-9]+|[+/_=\-]+|(?:[A-Z]?[a-z]*[+/_=\-]+)*[A-Z]?[a-z]*)$") | whole.rlike(r"[/\\].*[/\\]|://") | whole.contains("@")
    return F.when(secret, 1).when(other, 0)


def scan(docs: DataFrame, labelled_docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate of every document with the forest's probability that it is a secret.

    The forest learns from the findings in documents of ``labelled_docs`` (default: all), labelled by their formats, on inputs
    that don't state the format. Repeated rows give repeated findings; null keys are kept; other columns are ignored.
    """
    found = stored(features(candidates(docs, key, text), dictionary(docs, text)), "candidates")
    labelled = found.withColumn("label", known_formats(*map(F.col, ("value", "before", "before2", "whole"))))
    if labelled_docs is not None:
        labelled = labelled.join(labelled_docs.select(key).distinct(), key, "left_semi")
    return judge(found, train(labelled)).select(key, "word", "nth", "value", "before", "after", "covered", "switches", "probability", "is_secret")


def op5_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score and decision; null and empty texts have none."""
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
