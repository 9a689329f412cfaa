"""Ingest task analytics: counts, overview, trends, alerts, claims and timelines. ``now`` is always a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ago(now: Column, seconds: int) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def seconds_between(first: Column, last: Column) -> Column:
    return (F.unix_timestamp(last.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))).cast("long")


def status_counts(lease: Column) -> list[Column]:
    stale = (F.col("status") == "running") & (F.col("locked_at") < lease)
    return [
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed")],
        F.count_if(F.col("attempt_count") > 1).alias("retrying"),
        F.count_if(stale).alias("stale_running"),
    ]


def stats(tasks: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """One row of counts by status, of retried tasks, and of running ones whose lease is over."""
    return tasks.agg(*status_counts(ago(now, lease_seconds)))


def failing_groups(tasks: DataFrame, now: Column, hours: int, top: int = 5) -> DataFrame:
    """The ``top`` knowledge bases of most failures in the window, ties by id."""
    recent = tasks.where((F.col("status") == "failed") & (F.col("updated_at") >= ago(now, hours * 3600)))
    return recent.groupBy("knowledge_base_id").agg(F.count("*").alias("task_count")).orderBy(F.desc("task_count"), "knowledge_base_id").limit(top)


def retried(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Retry events with the knowledge base of their task."""
    mine = events.where("event_type = 'retrying'").select("task_id", F.col("created_at").alias("event_at"))
    return mine.join(tasks.select(F.col("id").alias("task_id"), "knowledge_base_id"), "task_id")


def overview(tasks: DataFrame, events: DataFrame, now: Column, lease_seconds: int, hours: int, long_seconds: int) -> DataFrame:
    """One row: the counts, active workers, age of the oldest pending task, long-running, recent failures and retries, and the
    knowledge bases that fail most. One pass over tasks and one join with events."""
    lease, start, slow = ago(now, lease_seconds), ago(now, hours * 3600), ago(now, long_seconds)
    running, live = F.col("status") == "running", F.col("locked_at") >= lease
    one = tasks.agg(
        *status_counts(lease),
        F.count_distinct(F.when(running & live & F.col("locked_by").isNotNull(), F.col("locked_by"))).alias("active_workers"),
        F.min(F.when(F.col("status") == "pending", F.col("created_at"))).alias("_oldest"),
        F.count_if(running & (F.col("started_at") < slow) & (F.col("locked_at").isNull() | live)).alias("long_running"),
        F.count_if((F.col("status") == "failed") & (F.col("updated_at") >= start)).alias("recent_failed"),
    )
    again = retried(tasks, events).agg(F.count_if(F.col("event_at") >= start).alias("recent_retried"))
    worst = failing_groups(tasks, now, hours).agg(F.sort_array(F.collect_list(F.struct((-F.col("task_count")).alias("n"), "knowledge_base_id"))).alias("w"))
    names = F.concat_ws(",", F.transform("w", lambda x: F.concat_ws(":", x["knowledge_base_id"], -x["n"])))
    joined = one.crossJoin(again).crossJoin(worst)  # one row each
    age = F.greatest(F.lit(0).cast("long"), seconds_between(F.col("_oldest"), now))
    return joined.withColumn("oldest_pending_age_seconds", F.when(F.col("_oldest").isNotNull(), age)).withColumn("failing_knowledge_bases", names).drop("_oldest", "w")


def trends(bases: DataFrame, tasks: DataFrame, events: DataFrame, now: Column, hours: int, limit: int = 20) -> DataFrame:
    """Per knowledge base the failures, retries and completions of this window and of the one before, with their differences.

    One conditional aggregate of tasks, one of events, both joined to the bases; the ``limit`` bases that worsened most.
    """
    start, before = ago(now, hours * 3600), ago(now, 2 * hours * 3600)
    at = F.col("updated_at")
    this, last = at >= start, (at >= before) & (at < start)
    done = tasks.groupBy("knowledge_base_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running")],
        *[F.count_if((F.col("status") == s) & w).alias(f"{p}_{s}") for s in ("failed", "completed") for p, w in (("recent", this), ("previous", last))],
        F.max("updated_at").alias("updated_at"),
    )
    again = retried(tasks, events).groupBy("knowledge_base_id").agg(
        F.count_if(F.col("event_at") >= start).alias("recent_retried"), F.count_if((F.col("event_at") >= before) & (F.col("event_at") < start)).alias("previous_retried")
    )
    out = bases.select("knowledge_base_id", "knowledge_base_name").join(done, "knowledge_base_id", "left").join(again, "knowledge_base_id", "left")
    counts = [c for c in out.columns if c not in ("knowledge_base_id", "knowledge_base_name", "updated_at")]
    out = out.fillna(0, counts)
    for k in ("failed", "retried", "completed"):
        out = out.withColumn(f"{k}_delta", F.col(f"recent_{k}") - F.col(f"previous_{k}"))
    keys = [F.desc("failed_delta"), F.desc("retried_delta"), F.desc(F.col("pending") + F.col("running")), F.desc("recent_failed"), F.desc("recent_retried"), F.asc("knowledge_base_id")]
    return out.orderBy(*keys).limit(limit)


def alerts(one: DataFrame, failure_threshold: int, retry_threshold: int) -> DataFrame:
    """A row (code, severity, count) for each rule that an overview breaks."""
    rules = [
        ("PENDING_WITHOUT_ACTIVE_WORKERS", "critical", "pending", (F.col("pending") > 0) & (F.col("active_workers") == 0)),
        ("STALE_RUNNING_TASKS", "warning", "stale_running", F.col("stale_running") > 0),
        ("LONG_RUNNING_TASKS", "warning", "long_running", F.col("long_running") > 0),
        ("RECENT_FAILURE_SPIKE", "warning", "recent_failed", F.col("recent_failed") >= failure_threshold),
        ("RECENT_RETRY_SPIKE", "warning", "recent_retried", F.col("recent_retried") >= retry_threshold),
    ]
    made = F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(n).cast("long").alias("count"))) for code, severity, n, when in rules])
    return one.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("a")).select("a.*")


def alert_severities(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count("*").alias("total"))


def claim(tasks: DataFrame, workers: int, now: Column, lease_seconds: int, max_attempts: int) -> DataFrame:
    """The oldest claimable tasks, one for each of ``workers``, with the attempt that the claim begins.

    Claimable are pending tasks and running ones whose lease is over, with attempts left.
    """
    stale = (F.col("status") == "running") & F.col("locked_at").isNotNull() & (F.col("locked_at") < ago(now, lease_seconds))
    open_ = tasks.where((F.col("attempt_count") < max_attempts) & ((F.col("status") == "pending") | stale))
    first = open_.orderBy("created_at", "id").limit(workers)
    turn = F.row_number().over(Window.orderBy("created_at", "id"))  # of as many rows as there are workers
    return first.select("id", "created_at", (F.col("attempt_count") + 1).alias("attempt_count"), turn.alias("worker"))


def monotone_times(events: DataFrame, task: str, at: str, order: list[str]) -> DataFrame:
    """Add event_at: the time in whole seconds, at least a second after the task's event before it.

    t(i) = max(c(i), t(i-1) + 1) is i plus the running maximum of c(j) - j.
    """
    w = Window.partitionBy(task).orderBy(*order)
    sec = F.unix_timestamp(F.col(at).cast("timestamp")) - F.row_number().over(w)
    ranked = events.withColumn("_lag", sec).withColumn("_n", F.row_number().over(w))
    top = F.max("_lag").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")
    return ranked.withColumn("event_second", top.cast("long")).drop("_lag", "_n")


def after_failure(tasks: DataFrame, failed_ids: DataFrame, max_attempts: int) -> DataFrame:
    """Tasks with those that failed set back to pending while attempts are left, and to failed otherwise; locks are released."""
    hit = tasks.join(failed_ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    out = hit.withColumn("status", F.when(F.col("_hit") & (F.col("attempt_count") < max_attempts), "pending").when(F.col("_hit"), "failed").otherwise(F.col("status")))
    return out.withColumn("locked_by", F.when(F.col("_hit"), None).otherwise(F.col("locked_by"))).select(*tasks.columns)


def heartbeat(tasks: DataFrame, beats: DataFrame) -> DataFrame:
    """Renew the lease of running tasks by beats (id, worker, at) of the worker that holds them; the latest beat counts."""
    latest = beats.groupBy("id", "worker").agg(F.max("at").alias("_at"))
    hit = tasks.join(latest, (tasks["id"] == latest["id"]) & (tasks["locked_by"] == latest["worker"]), "left").select(*[tasks[c] for c in tasks.columns], "_at")
    return hit.withColumn("locked_at", F.when(F.col("status") == "running", F.greatest("locked_at", "_at")).otherwise(F.col("locked_at"))).select(*tasks.columns)


def delete_with_children(parents: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, bool]]) -> dict[str, DataFrame]:
    """The parents without those in ``gone``; of each child table (frame, foreign key, cascade) the rows of deleted parents go,
    or, without cascade, lose their key."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    out = {"parents": parents.join(ids, parents[key] == ids["_gone"], "left_anti")}
    for name, (df, fk, cascade) in children.items():
        if cascade:
            out[name] = df.join(ids, df[fk] == ids["_gone"], "left_anti")
        else:
            joined = df.join(ids, df[fk] == ids["_gone"], "left")
            out[name] = joined.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).select(*df.columns)
    return out


def retry_payload(events: DataFrame, path: str, alias: str) -> DataFrame:
    """Events with a field of their JSON payload."""
    return events.withColumn(alias, F.get_json_object("payload", path))


def recent(tasks: DataFrame, n: int) -> DataFrame:
    """The ``n`` tasks updated last, then created last, lower ids first."""
    return tasks.orderBy(F.desc("updated_at"), F.desc("created_at"), "id").limit(n)


def timeline(events: DataFrame, n: int, task: str = "task_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The first ``n`` events of each task in order, with their place."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy(task).orderBy(*order))).where(F.col("place") <= n)


def failed(tasks: DataFrame) -> DataFrame:
    """Failed tasks with their place among those of their knowledge base, the one updated last first."""
    w = Window.partitionBy("knowledge_base_id").orderBy(F.desc("updated_at"), "id")
    return tasks.where("status = 'failed'").withColumn("place", F.row_number().over(w))


def event_summary(events: DataFrame, by: str, top: int = 4) -> DataFrame:
    """Per group (``by``) the number of events and distinct users, the worker of the latest event, and the most frequent types.

    ``events``: by, event_type, user_id, worker, at, id.
    """
    types = events.groupBy(by, "event_type").agg(F.count("*").alias("n"))
    types = types.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "event_type"))).where(F.col("place") <= top)
    named = types.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "event_type", "n").alias("t")))), lambda x: x["t"]), ",").alias("top_types"))  # ``top`` at most
    one = events.groupBy(by).agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.max_by("worker", F.struct("at", "id")).alias("latest_worker"))
    return one.join(named, by)


def enqueue(documents: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """A pending task for each knowledge base with documents that no pending or running task of it covers: ids and documents.

    ``documents``: knowledge_base_id, document_id; ``tasks``: knowledge_base_id, status, document_ids.
    """
    busy = tasks.where("status in ('pending', 'running')").select("knowledge_base_id", F.explode("document_ids").alias("document_id"))
    rows = documents.join(busy, ["knowledge_base_id", "document_id"], "left_anti")
    made = rows.groupBy("knowledge_base_id").agg(F.count("*").alias("documents"), F.min("document_id").alias("first_document"))  # the list itself stays a table
    return made.select("knowledge_base_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"), now.alias("created_at"), "documents", "first_document")


def stage_events(tasks: DataFrame) -> DataFrame:
    """(task_id, stage, at) of what has happened to each task: queued, claimed, retried and ended, in whole seconds apart."""
    stages = [("queued", F.lit(True), F.col("created_at")), ("claimed", F.col("locked_at").isNotNull(), F.col("locked_at")), ("retrying", F.col("attempt_count") > 1, F.col("updated_at")), ("completed", F.col("status") == "completed", F.col("updated_at")), ("failed", F.col("status") == "failed", F.col("updated_at"))]
    made = F.array(*[F.when(when, F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), at.alias("at"))) for i, (name, when, at) in enumerate(stages)])
    return tasks.select(F.col("id").alias("task_id"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("task_id", "e.*")


def fill_domains(bases: DataFrame, detected: DataFrame) -> DataFrame:
    """Knowledge bases with an empty domain given the one that most of their documents were found to have, by name of ties."""
    n = detected.groupBy("knowledge_base_id", "domain").agg(F.count("*").alias("n"))
    best = n.groupBy("knowledge_base_id").agg(F.min_by("domain", F.struct((-F.col("n")).alias("n"), "domain")).alias("_found"))
    return bases.join(best, "knowledge_base_id", "left").withColumn("domain", F.coalesce(F.nullif(F.trim("domain"), F.lit("")), "_found")).drop("_found")
