"""Bibliography sync: filters, match cascade, merges and the report, as joins over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as tx

FIELDS = ("title", "authors", "year", "venue", "doi", "url", "language")


def wanted(collections: list[str], required: list[str], ignored: list[str]) -> Column:
    """In any of the collections (if there are some), with all required tags and none of the ignored."""
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    keep = F.lit(True) if not collections else F.arrays_overlap("collection_keys", lits(collections))
    return keep & (F.size(F.array_except(lits(required), F.col("tags"))) == 0) & ~F.coalesce(F.arrays_overlap("tags", lits(ignored)), F.lit(False))


def with_facts(rows: DataFrame, facts: DataFrame, key: list[str], present: Column) -> DataFrame:
    """rows left-joined with facts by key; rows whose key is not present take no part, so an empty key makes no hot one."""
    some = rows.where(present).join(facts, key, "left")
    return some.unionByName(rows.where(~present), allowMissingColumns=True)


def batch_repeats(records: DataFrame, key: list[str]) -> DataFrame:
    """Adds same_key and same_doi: does the batch hold the key, or the DOI, more than once? Counted before the join, and an empty DOI not at all."""
    have = F.coalesce(F.col("doi_key") != "", F.lit(False))
    often = lambda on, name, rows: rows.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").select(*on, F.lit(True).alias(name))
    rows = records.join(often(key, "same_key", records), key, "left")
    rows = with_facts(rows, often(["doi_key"], "same_doi", records.where(have)), ["doi_key"], have)
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("same_key", "same_doi")})


def matched(records: DataFrame, existing: DataFrame, key: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """Each record with its outcome: matched to a paper, created, or reported as a duplicate with a reason; never merged.

    records: key columns, doi_key, title_key, year, cite_key; existing: paper, key columns, doi_key, title_key, year.
    Cascade: alias, key, DOI; targets that differ are a duplicate. Without a match a same title and year is one too; an
    empty title or DOI is not looked for, so that records without one don't meet under one key.
    """
    ids_of = lambda on, name: existing.where(F.concat_ws("", *on) != "").groupBy(*on).agg(F.array_sort(F.collect_set("paper")).alias(name))
    rows = batch_repeats(records, key)
    rows = rows.join(ids_of(key, "by_key"), key, "left")
    rows = with_facts(rows, ids_of(["title_key", "year"], "by_title"), ["title_key", "year"], F.coalesce(F.col("title_key") != "", F.lit(False)))
    rows = with_facts(rows, ids_of(["doi_key"], "by_doi"), ["doi_key"], F.coalesce(F.col("doi_key") != "", F.lit(False)))
    kind = existing.select(F.array("paper")).schema[0].dataType
    none = F.array().cast(kind)
    rows = rows.join(aliases.select(*key, F.array("paper").alias("by_alias")), key, "left") if aliases is not None else rows.withColumn("by_alias", F.lit(None).cast(kind))
    a, k, d = (F.coalesce(c, none) for c in ("by_alias", "by_key", "by_doi"))
    taken = existing.select(F.lower("cite_key").alias("_low")).distinct().withColumn("_taken", F.lit(True)) if "cite_key" in existing.columns else None
    if taken is not None:
        rows = rows.join(taken, F.lower("cite_key") == F.col("_low"), "left")
    occupied = F.coalesce("_taken", F.lit(False)) if taken is not None else F.lit(False)
    targets = F.array_distinct(F.concat(a, k, d))
    reason = F.when(F.col("same_key"), "key repeats in the batch").when(F.col("same_doi"), "doi repeats in the batch").when((F.size(a) > 0) & (F.size(targets) > 1), "alias and key or doi differ").when(F.size(targets) > 1, "several papers").when((F.size(targets) == 0) & (F.size(F.coalesce("by_title", none)) > 0), "same title and year").when((F.size(targets) == 0) & occupied, "cite key is taken")
    outcome = F.when(reason.isNotNull(), "duplicate").when(F.size(targets) == 1, "matched").otherwise("created")
    return rows.select(*records.columns, outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "matched", F.get(targets, F.lit(0))).alias("paper"))


def cite_key(key: Column, item: Column) -> Column:
    """A file-safe citation key: the record's own, else one of its item key, else of that key's hash."""
    second = F.concat(F.lit("zotero-"), item)
    return F.when(ids.valid_cite_key(key), key).when(ids.valid_cite_key(second), second).otherwise(F.concat(F.lit("zotero-"), F.substring(F.sha2(item, 256), 1, 12)))


def merged(local: Column, base: Column, incoming: Column, preserve: bool = True) -> Column:
    """Three-way merge of a field: the incoming value where the local one is missing or still what was last synced."""
    return F.when(~tx.meaningful(local.cast("string")) | local.eqNullSafe(base), incoming).otherwise(local) if preserve else incoming


def merged_rows(local: DataFrame, base: DataFrame, incoming: DataFrame, key: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Merges fields by key and adds change: created, updated, unchanged or missing (only local)."""
    l, b, i = (df.select(key, F.struct(*fields).alias(n)) for n, df in (("_l", local), ("_b", base), ("_i", incoming)))
    rows = l.join(i, key, "full").join(b, key, "left")
    out = {f: F.when(F.col("_i").isNull(), F.col(f"_l.{f}")).otherwise(merged(F.col(f"_l.{f}"), F.col(f"_b.{f}"), F.col(f"_i.{f}"))) for f in fields}
    rows = rows.select(key, "_l", "_i", F.struct(*(v.alias(f) for f, v in out.items())).alias("_m"))
    change = F.when(F.col("_l").isNull(), "created").when(F.col("_i").isNull(), "missing").when(F.col("_m").eqNullSafe(F.col("_l")), "unchanged").otherwise("updated")
    return rows.select(key, "_m.*", change.alias("change"))


def union_values(local: Column, incoming: Column, preserve: bool = True) -> Column:
    """Categories or tags: both sides' values sorted, or only the incoming."""
    return F.array_sort(F.array_union(F.coalesce(local, F.array().cast("array<string>")), incoming)) if preserve else F.array_sort(F.array_distinct(incoming))


def category_links(records: DataFrame, categories: dict[str, str], stored: DataFrame, key: str = "paper") -> DataFrame:
    """(key, topic, origin, status): links of records' collections, by a map of names, and tags to topics, laid over the stored ones: a manual link, and a reviewed status, stay as they are."""
    mapped = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    names = F.concat(F.array_compact(F.transform("collection_keys", lambda c: mapped[c])), F.col("tags"))
    fresh = records.select(key, F.explode(F.array_distinct(F.transform(names, ids.topic_id))).alias("topic"), F.lit("sync").alias("origin"), F.lit("auto").alias("status"))
    both = stored.select(key, "topic", "origin", "status", F.lit(0).alias("_r")).unionByName(fresh.withColumn("_r", F.lit(2)))
    rank = F.when(F.col("origin") == "manual", 0).when(F.col("status").isin("verified", "rejected"), 1).otherwise(2)
    return both.groupBy(key, "topic").agg(F.min_by(F.struct("origin", "status"), F.struct(rank.alias("rank"), "_r")).alias("b")).select(key, "topic", "b.*")


def missing_attachments(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, path) of attachments that the file listing lacks."""
    rows = records.select(key, F.explode("attachment_paths").alias("path"))
    return rows.join(files.select("path").distinct(), "path", "left_anti").select(key, "path")
