"""Jobs, tasks and reviews as append-only events; the present state is a query over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TERMINAL_JOBS, TERMINAL_TASKS

# Progress by job status, and which state may follow which in a task.
PROGRESS = {"UPLOADED": 0, "PARSING": 10, "PARSED": 45, "ENTITY_EXTRACTION": 55, "GRAPH_BUILDING": 75, "READY": 100, "PARTIAL": 100}
FOLLOWS = {
    "prepared": ("submitted", "waiting-manual", "dry-run", "blocked"),
    "waiting-manual": ("submitted", "waiting-manual", "dry-run", "blocked"),
    "dry-run": ("submitted", "waiting-manual", "dry-run", "blocked"),
    "submitted": ("accepted", "rejected", "blocked", "escalated", "revision-requested", "main-repair-requested"),
    "revision-requested": ("submitted", "waiting-manual", "dry-run", "blocked"),
    "main-repair-requested": ("submitted", "waiting-manual", "dry-run", "blocked"),
}
LEASE_SECONDS = 300


def latest(events: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """The last event's fields a key, by a maximum and not by a sort."""
    top = F.max_by(F.struct(*fields), F.struct(*order)).alias("_l")
    return events.groupBy(key).agg(top).select(key, *(F.col(f"_l.{f}").alias(f) for f in fields))


def claimable(jobs: DataFrame, now: Column, terminal: tuple[str, ...] = TERMINAL_JOBS) -> DataFrame:
    """The one job to claim: of those open with an expired lease the longest untouched; ties by id."""
    open_ = jobs.where(~F.col("status").isin(*terminal) & (F.col("lease_until") < now))
    return open_.orderBy("updated_at", "id").limit(1).withColumn("attempt", F.col("attempt") + 1)


def lease_gaps(events: DataFrame, key: str, ts: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """(key, events, gaps): how often the next event came later than a lease lasts."""
    w = W.partitionBy(key).orderBy(ts)
    gap = F.unix_micros(F.lead(ts).over(w)) - F.unix_micros(F.col(ts)) > seconds * 1_000_000
    return events.withColumn("_gap", gap).groupBy(key).agg(F.count("*").alias("events"), F.count_if("_gap").alias("gaps"))


def funnel(events: DataFrame, key: str, status: str) -> DataFrame:
    """(status, events, keys): events and distinct keys that reached each status."""
    return events.groupBy(status).agg(F.count("*").alias("events"), F.count_distinct(key).alias("keys"))


def retryable(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("retry", F.col("status") == "FAILED")


def transitions(events: DataFrame, key: str, order: list[str], status: str, follows: dict[str, tuple[str, ...]] | None = None, terminal: tuple[str, ...] = TERMINAL_TASKS) -> DataFrame:
    """Adds previous and legal: a first state, or one that may follow the previous; nothing follows a terminal state."""
    w = W.partitionBy(key).orderBy(*order)
    rows = events.withColumn("previous", F.lag(status).over(w))
    prev, now = F.col("previous"), F.col(status)
    legal = F.when(prev.isNull(), True).when(prev.isin(*terminal), False)
    for before, after in (FOLLOWS if follows is None else follows).items():
        legal = legal.when(prev == before, now.isin(*after))
    return rows.withColumn("legal", legal.otherwise(False))


def attempts(events: DataFrame, key: str, order: list[str], is_attempt: Column, most: int) -> DataFrame:
    """(key, attempts, blocked): attempts counted, and whether they went beyond the most allowed."""
    per = events.groupBy(key).agg(F.count_if(is_attempt).alias("attempts"))
    return per.withColumn("blocked", F.col("attempts") > most)


def review_fault(decision: Column, criteria: Column, passed: Column, failed: Column, issues: Column, changes: Column, checks: Column) -> Column:
    """The first rule a review breaks; null if it is sound.

    Criteria are known and not both passed and failed; accept needs all passed, nothing open and a source check; revise
    needs failures, each with an issue and a change.
    """
    none = lambda a: F.size(a) == 0
    unknown = ~none(F.array_except(F.array_union(passed, failed), criteria))
    clash = F.arrays_overlap(passed, failed)
    stray = ~none(F.array_except(F.array_union(issues, changes), criteria))
    accept = none(F.array_except(criteria, passed)) & none(failed) & none(issues) & none(changes) & ~none(checks)
    revise = ~none(failed) & none(F.array_except(failed, issues)) & none(F.array_except(failed, changes))
    return F.when(unknown, "unknown criterion").when(F.coalesce(clash, F.lit(False)), "passed and failed").when(stray, "issue without criterion").when((decision == "accept") & ~accept, "accept with open points").when((decision == "revise") & ~revise, "revise without issue and change")


def carried(drafts: DataFrame, key: list[str], order: str, content: str) -> DataFrame:
    """Fills content that an attempt left unchanged (null) with the last one before it."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return drafts.withColumn(content, F.last(content, ignorenulls=True).over(w))


def applied(outputs: DataFrame, stored: DataFrame) -> DataFrame:
    """All-or-nothing acceptance: outputs(task, path, base_hash, content) apply only if every base hash of the task still holds; adds apply."""
    rows = outputs.join(stored.select("path", F.col("hash").alias("_now")), "path", "left")
    holds = F.col("base_hash").eqNullSafe(F.col("_now"))
    return rows.withColumn("apply", F.min(holds.cast("int")).over(W.partitionBy("task")) == 1).drop("_now")


def backfill(nodes: DataFrame, anchors: DataFrame, present: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Subtype rows (node_id, source_anchor_id) for nodes of these kinds that lack one and whose first anchor is of their paper; others are skipped."""
    rows = nodes.where(F.col("type").isin(*kinds)).select(F.col("id").alias("node_id"), "paper_id", F.get("provenance", F.lit(0)).alias("source_anchor_id"))
    rows = rows.join(present.select("node_id"), "node_id", "left_anti")
    return rows.join(anchors.select(F.col("id").alias("source_anchor_id"), "paper_id"), ["source_anchor_id", "paper_id"], "left_semi").select("node_id", "source_anchor_id")


def versions(reviews: DataFrame) -> DataFrame:
    """(object_id, version, conflicts): a review of version v makes v + 1; a second review of the same version is a conflict."""
    per = reviews.groupBy("object_id", "object_version").agg(F.count("*").alias("n"))
    return per.groupBy("object_id").agg((F.max("object_version") + 1).alias("version"), F.sum(F.col("n") - 1).alias("conflicts"))


def contract_faults(tasks: DataFrame, contracts: DataFrame) -> DataFrame:
    """(task, fault) of tasks(task, type, route, attempts, size) against contracts(type, routes, max_attempts, max_size): the first limit that one breaks."""
    rows = tasks.join(contracts, "type", "left")
    fault = F.when(F.col("routes").isNull(), "unknown type").when(~F.array_contains("routes", F.col("route")), "route").when(F.col("attempts") > F.col("max_attempts"), "attempts").when(F.col("size") > F.col("max_size"), "size")
    return rows.select("task", fault.alias("fault")).where("fault is not null")


def fallbacks(links: DataFrame) -> DataFrame:
    """links(alias, id, disabled) without the disabled ones, for graph.resolved: where a role's chain of fallbacks ends."""
    return links.where(~F.coalesce("disabled", F.lit(False))).select("alias", "id")
