"""Evaluation of answers and retrieval: hits, causes of errors, summaries, differences, drift, percentiles, gates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import normalise, normalise_for_eval, text_or_empty


def missing_groups(text: Column, groups: Column) -> Column:
    """First keywords of the groups (array<array<string>>) of which no member is in the normalised text; empty groups are met."""
    none = F.array().cast("array<array<string>>")
    met = lambda said, g: (F.size(g) == 0) | F.exists(g, lambda k: F.contains(said, normalise_for_eval(k)))
    left = lambda said: F.transform(F.filter(F.coalesce(groups, none), lambda g: ~met(said, g)), lambda g: F.get(g, F.lit(0)))
    return F.get(F.transform(F.array(normalise_for_eval(text)), left), F.lit(0))  # the text is bound, so it is normalised once


def keyword_hit(text: Column, groups: Column) -> Column:
    """Whether every group has a member in the text."""
    return F.size(missing_groups(text, groups)) == 0


def hit_ratio(text: Column, groups: Column, mode: Column | None = None) -> Column:
    """Share of groups met, 0 for no groups; of questions without an answer 1 or 0."""
    n = F.size(F.coalesce(groups, F.array().cast("array<array<string>>")))
    part = F.when(n > 0, 1 - F.size(missing_groups(text, groups)) / n).otherwise(0.0)
    return part if mode is None else F.when(mode == "no_answer", keyword_hit(text, groups).cast("double")).otherwise(part)


def debug_text(chunks: Column) -> Column:
    """The parent and child texts of an array of retrieved chunks, a line each."""
    return F.array_join(F.flatten(F.transform(chunks, lambda c: F.array(c["parent_text"], c["child_text"]))), "\n")


def error_type(mode: Column, retrieval: Column, context: Column, answer: Column, citation: Column) -> Column:
    """ok, or the first stage that failed; questions without an answer are ok or a fallback error."""
    return (
        F.when(mode == "no_answer", F.when(answer, "ok").otherwise("fallback_error")).when(~retrieval, "retrieval_error").when(~context, "rerank_or_filter_error")
        .when(~answer, "generation_error").when(~citation, "citation_error").otherwise("ok")
    )


def shadow_summary(cases: DataFrame, rates: Sequence[str], fields: str = "mismatch_fields", drift: Sequence[str] = ()) -> DataFrame:
    """(metric, value) of compared runs: cases, the rate of each flag, mean latencies, and counts by status, field and drift field.

    ``cases``: id, status, mismatch_fields (array), legacy_ms, graph_ms and the flags. Fields in ``drift`` make a case a drift.
    """
    drifted = F.array_intersect(F.col(fields), F.array(*map(F.lit, drift)))
    rows = cases.withColumn("drifted", drifted)
    one = rows.agg(
        F.count("*").cast("double").alias("case_count"), *[F.round(F.avg(F.col(r).cast("int")), 4).alias(f"{r}_rate") for r in rates],
        F.count_if(F.size("drifted") > 0).cast("double").alias("retrieval_drift_case_count"), F.round(F.avg((F.size("drifted") > 0).cast("int")), 4).alias("retrieval_drift_rate"),
        *[F.round(F.avg((F.col("status") == x).cast("int")), 4).alias(f"core_{x}_rate") for x in ("match", "error")],
        *[F.round(F.avg(f"{x}_ms"), 2).alias(f"avg_{x}_latency_ms") for x in ("legacy", "graph")],
    )
    wide = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
    count = lambda prefix, c: rows.select(F.explode(c).alias("x")).groupBy(F.concat(F.lit(prefix), "x").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return wide.unionAll(count("status:", F.array("status"))).unionAll(count("mismatch:", F.col(fields))).unionAll(count("drift:", F.col("drifted")))


def benchmark_diff(baseline: DataFrame, contender: DataFrame, stats: Sequence[str] = ("avg", "p50", "p95", "max")) -> DataFrame:
    """(metric, stat, baseline, contender, delta, improved) of two tables of :func:`blocks`; lower is better, missing sides are null."""
    long = lambda df, side: df.select("metric", F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.col(x).alias(side)) for x in stats])).alias("s")).select("metric", "s.*")
    both = long(baseline, "baseline").join(long(contender, "contender"), ["metric", "stat"], "full_outer")
    return both.withColumn("delta", F.round(F.col("contender") - F.col("baseline"), 2)).withColumn("improved", F.col("contender") < F.col("baseline"))


def cause(retrieval: Column, context: Column, answer: Column, citation: Column) -> Column:
    """The first stage that failed, null for none."""
    return F.when(~retrieval, "retrieval").when(~context, "rerank_or_filter").when(~answer, "generation").when(~citation, "citation")


def summary(results: DataFrame, flags: Sequence[str], means: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Rates of the flags and means of the values, of all results or by group."""
    rates = [F.round(F.avg(F.col(f).cast("int")), 6).alias(f"{f}_rate") for f in flags]
    return results.groupBy(*by).agg(F.count("*").alias("cases"), *rates, *[F.round(F.avg(m), 6).alias(f"{m}_mean") for m in means])


def histogram(results: DataFrame, column: str) -> DataFrame:
    return results.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def blocks(runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n, avg, min, max, p50, p95) of each metric: an unpivot and one aggregate. Percentiles interpolate."""
    long = runs.select(*by, F.explode(F.map_entries(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]))).alias("e"))
    long = long.select(*by, F.col("e.key").alias("metric"), F.col("e.value").alias("v")).where("v is not null")
    stats = [F.count("*").alias("n"), *[F.round(x, 2).alias(a) for x, a in ((F.avg("v"), "avg"), (F.min("v"), "min"), (F.max("v"), "max"), (F.percentile("v", 0.5), "p50"), (F.percentile("v", 0.95), "p95"))]]
    return long.groupBy(*by, "metric").agg(*stats)


def compare(baseline: DataFrame, contender: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """(metric, baseline_avg, contender_avg, delta, improved, regressed, unchanged) over the cases that both have."""
    names = lambda df, side: df.select(key, *[F.col(m).cast("double").alias(f"{side}_{m}") for m in metrics])
    both = names(baseline, "b").join(names(contender, "c"), key)
    rows = both.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("b"), F.col(f"c_{m}").alias("c")) for m in metrics])).alias("x")).select(key, "x.*")
    count = lambda cond: F.count_if(cond)
    return rows.groupBy("metric").agg(
        F.round(F.avg("b"), 4).alias("baseline_avg"), F.round(F.avg("c"), 4).alias("contender_avg"), F.round(F.avg("c") - F.avg("b"), 4).alias("delta"),
        count(F.col("c") > F.col("b")).alias("improved"), count(F.col("c") < F.col("b")).alias("regressed"), count(F.col("c") == F.col("b")).alias("unchanged"),
    )


def membership(baseline: DataFrame, contender: DataFrame, key: str) -> DataFrame:
    """(key, side): whether a case is in both, or missing in one."""
    both = baseline.select(key, F.lit(True).alias("b")).distinct().join(contender.select(key, F.lit(True).alias("c")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("b").isNull(), "missing_in_baseline").when(F.col("c").isNull(), "missing_in_contender").otherwise("shared").alias("side"))


def signatures(rows: DataFrame, case: str, fields: Sequence[str]) -> DataFrame:
    """(case, signature): sorted distinct normalised concatenations of the fields."""
    one = F.concat_ws("|", *[normalise(F.col(f).cast("string")) for f in fields])
    return rows.groupBy(case).agg(F.array_sort(F.collect_set(one)).alias("signature"))


def drift(baseline: DataFrame, contender: DataFrame, case: str) -> DataFrame:
    """Cases whose signatures differ or that one side lacks."""
    both = baseline.select(case, F.col("signature").alias("b")).join(contender.select(case, F.col("signature").alias("c")), case, "full_outer")
    return both.where(~F.col("b").eqNullSafe(F.col("c"))).select(case)


def differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, verdict, mismatched): match, mismatch with the fields that differ, or error where a side is missing."""
    a, b = (df.select(key, F.lit(True).alias(f"{s}_here"), *[F.col(f).alias(f"{s}_{f}") for f in fields]) for df, s in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    off = F.filter(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), f) for f in fields]), lambda x: x.isNotNull())
    there = F.col("l_here") & F.col("r_here")
    return both.select(key, F.when(there.isNull(), "error").when(F.size(off) == 0, "match").otherwise("mismatch").alias("verdict"), F.when(there, F.array_join(off, ",")).alias("mismatched"))


def gates(one: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(gate, passed) of each rule over a one-row summary; null counts as failed."""
    made = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules])
    return one.select(F.explode(made).alias("g")).select("g.*")


def ready(found: DataFrame) -> DataFrame:
    """(ready, failed): whether all gates passed, and the names of the others."""
    return found.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ready"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failed"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1), 0 where undefined."""
    pairs = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("label"), truth, guess).where("label is not null")
    hit, t, g = F.col(truth) == F.col(guess), F.col(truth) == F.col("label"), F.col(guess) == F.col("label")
    n = pairs.groupBy("label").agg(F.count_if(hit & t).alias("tp"), F.count_if(g & ~F.coalesce(t, F.lit(False))).alias("fp"), F.count_if(t & ~F.coalesce(g, F.lit(False))).alias("fn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 6))


def macro(found: DataFrame) -> DataFrame:
    return found.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("recall"), 6).alias("macro_recall"))


def page_checks(pages: DataFrame, checks: DataFrame) -> DataFrame:
    """(case, page_number, kind, wanted, passed) of checks contains and lacks on page texts; a missing page fails."""
    both = checks.join(pages.select("case", "page_number", "text"), ["case", "page_number"], "left")
    inside = F.contains(text_or_empty("text"), F.col("wanted"))
    return both.withColumn("passed", F.col("text").isNotNull() & F.when(F.col("kind") == "contains", inside).otherwise(~inside)).drop("text")


def unfinished(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The cases without a result, for a run that resumes."""
    return cases.join(results.select(key), key, "left_anti")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)


def stream_events(text: Column) -> Column:
    """Blocks of a server-sent event text as structs of event and data."""
    block = lambda b: F.struct(F.regexp_extract(b, r"(?m)^event:[ ]?(.*)$", 1).alias("event"), F.array_join(F.regexp_extract_all(b, F.lit(r"(?m)^data:[ ]?(.*)$"), F.lit(1)), "\n").alias("data"))
    return F.transform(F.filter(F.split(F.replace(text_or_empty(text), F.lit("\r\n"), F.lit("\n")), "\n\n+"), lambda b: F.trim(b) != ""), block)


def test_log(text: Column, labels: Sequence[str] = ("passed", "failed", "errors", "skipped")) -> dict[str, Column]:
    """Counts by label and seconds of a test run's last line."""
    found = {n: F.coalesce(F.nullif(F.regexp_extract(text_or_empty(text), rf"([0-9]+) {n.rstrip('s') if n == 'errors' else n}", 1), F.lit("")).cast("int"), F.lit(0)) for n in labels}
    return found | {"seconds": F.nullif(F.regexp_extract(text_or_empty(text), r"in ([0-9.]+)s", 1), F.lit("")).cast("double")}


#: What a contender must not lose against the baseline, and what its shadow runs must show: (gate, condition).
ROLLOUT = (
    ("retrieval_drift_free", "coalesce(case_drift_count, 0) = 0"),
    *[(f"{gate}_parity_ok", f"{metric}_delta >= 0") for gate, metric in (("retrieval_hit", "retrieval_hit_rate"), ("final_context", "final_context_hit_rate"), ("citation", "citation_hit_rate"))],
    ("live_eval_available", "live_available"),
    *[(f"live_eval_{gate}_parity_ok", f"live_available and live_{metric}_delta >= 0") for gate, metric in (("retrieval", "retrieval_hit"), ("final_context", "final_context_hit"), ("citation", "citation_hit"), ("answer", "answer_hit"))],
    ("shadow_graph_error_free", "coalesce(graph_error_count, 0) = 0"),
    ("shadow_retrieval_drift_free", "coalesce(retrieval_drift_case_count, 0) = 0"),
    ("shadow_citation_alignment_ok", "final_citation_ids_match_rate >= 0.95"),
    ("shadow_context_alignment_ok", "final_context_ids_match_rate >= 0.95"),
    ("shadow_answer_hit_parity_ok", "final_answer_hit_parity_rate >= 1.0"),
)


def rollout_gates(one: DataFrame) -> DataFrame:
    """(gate, passed) of the fourteen conditions over a row of deltas and shadow rates; what is missing fails, but for counts."""
    return gates(one, [(name, F.expr(condition)) for name, condition in ROLLOUT])


def retrieval_summary(cases: DataFrame, times: Sequence[str]) -> DataFrame:
    """One row: cases by mode, hit rates, and means of the times."""
    return cases.agg(
        F.count("*").alias("case_count"), *[F.count_if(F.col("mode") == m).alias(f"{m}_case_count") for m in ("grounded", "no_answer")],
        *[F.round(F.avg(F.col(f"{h}_hit").cast("int")), 4).alias(f"{h}_hit_rate") for h in ("retrieval", "context", "citation")], *[F.round(F.avg(t), 2).alias(f"avg_{t}") for t in times],
    )


def case_blocks(runs: DataFrame, metrics: Sequence[str], case: str) -> DataFrame:
    """:func:`blocks` of each case and, with a null case, of all runs together: the stages' times of a report."""
    both = runs.withColumn("_scope", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(case, F.when(F.col("_scope") == 0, F.col(case)))
    return blocks(both, metrics, ["_scope", case]).drop("_scope")


def intent_summary(examples: DataFrame) -> DataFrame:
    """(kind, name, n): examples in all, by label, by split, and follow-ups with history."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    follows = (F.col("label") == "follow_up_query") & (F.size(F.coalesce("history_messages", F.array())) > 0)
    made = F.array(entry("count", F.lit("all")), entry("label", F.col("label")), entry("split", F.col("split")), F.when(follows, entry("follow_up", F.lit("with_history"))))
    rows = examples.select(F.explode(made).alias("x"))
    return rows.where("x is not null").select("x.*").groupBy("kind", "name").agg(F.count("*").alias("n"))


def select_cases(cases: DataFrame, ids: Sequence[str] = (), limit: int | None = None, key: str = "id") -> DataFrame:
    """The wanted cases, or all, in order of their ids and at most ``limit``; unknown ids and an empty choice are errors."""
    chosen = cases.where(F.col(key).isin(*ids)) if ids else cases
    if ids and (missing := set(map(str, ids)) - {str(r[0]) for r in chosen.select(key).distinct().collect()}):  # as many as are asked for
        raise ValueError(f"Unknown case ids: {', '.join(sorted(missing))}")
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be greater than 0")
        chosen = chosen.orderBy(key).limit(limit)
    if not chosen.limit(1).count():
        raise ValueError("No evaluation cases selected")
    return chosen
