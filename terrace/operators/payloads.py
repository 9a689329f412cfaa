"""Nested JSON payloads of unlike shape: fields with defaults, entries, and reports compared case by case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, out: str = "payload") -> DataFrame:
    """Add the payload as a variant, and ``malformed``: texts that aren't JSON stay, with a null payload. A null text isn't malformed."""
    return df.withColumn(out, F.try_parse_json(text)).withColumn("malformed", F.col(out).isNull() & F.col(text).isNotNull())


def field(payload: Column | str, path: str, kind: str, default: object) -> Column:
    """A value at a path as a type; the default where it is missing, null or of another nature."""
    found = F.try_variant_get(F.col(payload) if isinstance(payload, str) else payload, path, kind)
    return F.coalesce(found, F.lit(default).cast(kind))


def number(payload: Column | str, path: str) -> Column:
    """Numbers, texts of numbers, and truth as 1 or 0; all else, and what is missing, is 0."""
    return field(payload, path, "double", 0.0)


def nature(value: Column) -> Column:
    """object, array, text, boolean, null or number."""
    kind = F.schema_of_variant(value)
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.when(value.isNull(), None)
    for name, say in named.items():
        out = out.when(kind.startswith(name), say)
    return out.otherwise("number")


def entries(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each entry at the top of each payload, object or array, with ``pos``, ``key`` (null in arrays) and ``value``; others have none."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(payload).outer()))


def case_changes(baseline: DataFrame, contender: DataFrame, metrics: dict[str, str], lower: Sequence[str] = ()) -> DataFrame:
    """(metric, case_id, baseline, contender, change) of the cases that both reports (case_id, payload) have.

    ``metrics``: paths by name. A change is improved, regressed or unchanged; for metrics in ``lower`` less is better. The lists of
    cases are rows, so that they may be of any length.
    """
    values = lambda df, name: df.select("case_id", F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[number("payload", p) for p in metrics.values()])).alias(name))
    both = values(baseline, "a").join(values(contender, "b"), "case_id").select("case_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric"), "a", "b")
    rows = both.select("metric", "case_id", F.col("a")[F.col("metric")].alias("baseline"), F.col("b")[F.col("metric")].alias("contender"))
    less = F.col("metric").isin(*lower) if lower else F.lit(False)
    up = F.when(less, F.col("contender") < F.col("baseline")).otherwise(F.col("contender") > F.col("baseline"))
    return rows.withColumn("change", F.when(F.col("baseline") == F.col("contender"), "unchanged").when(up, "improved").otherwise("regressed"))


def change_summary(changes: DataFrame) -> DataFrame:
    """(metric, cases, baseline_avg, contender_avg, delta, improved, regressed, unchanged) of :func:`case_changes`."""
    count = lambda name: F.count_if(F.col("change") == name).alias(name)
    return changes.groupBy("metric").agg(
        F.count("*").alias("cases"), F.round(F.avg("baseline"), 4).alias("baseline_avg"), F.round(F.avg("contender"), 4).alias("contender_avg"),
        F.round(F.avg(F.col("contender") - F.col("baseline")), 4).alias("delta"), count("improved"), count("regressed"), count("unchanged"),
    )


def drifted_cases(cases: DataFrame, drift: Sequence[str], fields: str = "mismatch_fields") -> DataFrame:
    """(id, field): for each case that drifted the fields of ``drift`` in which it did."""
    return cases.select("id", F.explode(F.array_intersect(F.col(fields), F.array(*map(F.lit, drift)))).alias("field"))
