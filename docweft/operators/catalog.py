"""The artifact index and its views: groupings, orders, existence, moves, merges of kept decisions, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .graph import components, degree, resolved

# Kinds of artifacts, and what a paper's role for a concept becomes as a relation.
KINDS = ("paper", "concept", "principle", "topic", "artifact", "analysis", "reading", "translation", "source.text", "research-profile", "task", "claim", "formula")
ROLE_RELATION = {"introduced": "introduces", "used": "uses", "compared": "contrasts", "extended": "extends"}
CARD_RELATION = {"prerequisites": "prerequisite", "related": "related", "contrasts": "contrasts", "extends": "extends", "replaces": "replaces"}


def card_edges(cards: DataFrame) -> DataFrame:
    """(source, target, type) of concept cards' lists; a prerequisite points from what is needed."""
    parts = []
    for field, kind in CARD_RELATION.items():
        rows = cards.select(F.concat(F.lit("concept:"), "id").alias("own"), F.explode(F.transform(field, lambda x: F.concat(F.lit("concept:"), x))).alias("other"))
        ends = ("other", "own") if kind == "prerequisite" else ("own", "other")
        parts.append(rows.select(F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionByName, parts).where("source <> target").distinct()


def role_relation(role: Column) -> Column:
    out = F.when(role == "used", "uses")
    for name, relation in ROLE_RELATION.items():
        out = out.when(role == name, relation)
    return out.otherwise("uses")


def index(projections: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records, repeats) of projections(id, kind, path, content_hash, source): the first path of an id stays, the others are repeats."""
    rows = reduce(DataFrame.unionByName, projections)
    n = F.row_number().over(W.partitionBy("id").orderBy("path"))
    rows = rows.withColumn("_n", n)
    return rows.where("_n = 1").drop("_n"), rows.where("_n > 1").drop("_n")


def best_links(links: DataFrame) -> DataFrame:
    """One link for each (source, target, rel): a manual one before an inferred one, then the first by evidence."""
    order = F.struct((F.col("origin") != "manual").cast("int"), F.col("evidence"))
    return links.groupBy("source", "target", "rel").agg(F.min_by(F.struct("origin", "evidence", "weight", "status"), order).alias("_b")).select("source", "target", "rel", "_b.*")


def canonical_links(links: DataFrame, aliases: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, issues): both ends resolved through alias chains; links to nothing, without evidence, or of a bad status or weight become issues."""
    ends = resolved(aliases)
    rows = links
    for end in ("source", "target"):
        rows = rows.join(ends.select(F.col("alias").alias(end), F.col("id").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    for end in ("source", "target"):
        rows = rows.join(records.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    status = F.when(F.col("rel").startswith("similar-") & (F.col("status") == "auto"), "candidate").otherwise(F.col("status"))
    fault = F.when(F.col("_source").isNull(), "dangling source").when(F.col("_target").isNull(), "dangling target").when(F.size("evidence") == 0, "no evidence")
    fault = fault.when(~F.col("status").isin("auto", "candidate", "verified", "rejected"), "bad status").when(~F.coalesce(F.col("weight").between(0, 1), F.lit(False)) | F.isnan("weight"), "bad weight")
    rows = rows.withColumns({"status": status, "fault": fault}).drop("_source", "_target")
    return rows.where("fault is null").drop("fault"), rows.where("fault is not null")


def carried_reviews(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New links with their review carried over: verified stays only where inputs, evidence and weight are equal, else it lapses to candidate."""
    o = old.select(*key, F.struct("inputs", "evidence", "weight").alias("_was"), F.col("status").alias("_status"), F.col("reviewer").alias("_reviewer"))
    rows = new.join(o, key, "left")
    same = F.struct("inputs", "evidence", "weight").eqNullSafe(F.col("_was"))
    reviewed = F.col("_status") == "verified"
    out = rows.withColumns({"lapsed": F.coalesce(reviewed & ~same, F.lit(False)), "status": F.when(reviewed & same, "verified").when(reviewed, "candidate").otherwise(F.col("status"))})
    return out.withColumn("reviewer", F.col("_reviewer")).drop("_was", "_status", "_reviewer")


def lapsed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Links whose dependency hashes(key, path, hash) changed: the sets of both sides differ."""
    both = [df.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws("=", "path", "hash"))).alias(n)) for n, df in (("_o", old), ("_n", new))]
    return both[0].join(both[1], key).where("_o <> _n").select(key)


def moves(registered: DataFrame, present: DataFrame) -> DataFrame:
    """(id, old_path, new_path): unregistered paths whose content is that of one registered path that is gone; ambiguous content moves nothing."""
    gone = registered.join(present.select("path"), "path", "left_anti").select("id", F.col("path").alias("old_path"), "content_hash")
    fresh = present.join(registered.select("path"), "path", "left_anti").select(F.col("path").alias("new_path"), "content_hash")
    single = lambda df: df.withColumn("_n", F.count("*").over(W.partitionBy("content_hash"))).where("_n = 1").drop("_n")
    return single(gone).join(single(fresh), "content_hash").select("id", "old_path", "new_path")


def upserted(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored records with incoming fields laid over, new ones added."""
    s, i = stored.select(key, *(F.col(f).alias(f"_s_{f}") for f in fields)), incoming.select(key, *(F.col(f).alias(f"_i_{f}") for f in fields))
    return s.join(i, key, "full").select(key, *(F.coalesce(f"_i_{f}", f"_s_{f}").alias(f) for f in fields))


def lookup(wanted: DataFrame, aliases: DataFrame, records: DataFrame) -> DataFrame:
    """(asked, id, path, fault) of asked ids: through aliases to a record; faults for unknown, repeated and changed ones."""
    ends = resolved(aliases)
    rows = wanted.join(ends.withColumnRenamed("alias", "asked").withColumnRenamed("id", "_to"), "asked", "left").withColumn("id", F.coalesce("_to", "asked"))
    n = records.groupBy("id").agg(F.count("*").alias("_n"), F.first("path").alias("path"), F.first("content_hash").alias("_hash"))
    rows = rows.join(n, "id", "left")
    changed = F.col("expected_hash").isNotNull() & (F.col("expected_hash") != F.col("_hash"))
    return rows.select("asked", "id", "path", F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(changed, "changed").alias("fault"))


def index_faults(records: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """(object, fault): aliases and link ends that lead nowhere, links without evidence or with a value out of range, ids twice."""
    known = records.select("id").distinct()
    ends = resolved(aliases)
    out = [ends.join(known, "id", "left_anti").select(F.col("alias").alias("object"), F.lit("dangling alias").alias("fault"))]
    for end in ("source", "target"):
        out.append(links.join(known.withColumnRenamed("id", end), end, "left_anti").select(F.concat_ws(">", "source", "target").alias("object"), F.lit(f"dangling {end}").alias("fault")))
    out.append(links.where((F.size("evidence") == 0)).select(F.concat_ws(">", "source", "target").alias("object"), F.lit("no evidence").alias("fault")))
    out.append(links.where(~F.coalesce(F.col("weight").between(0, 1), F.lit(False))).select(F.concat_ws(">", "source", "target").alias("object"), F.lit("bad weight").alias("fault")))
    out.append(records.groupBy("id").count().where("count > 1").select(F.col("id").alias("object"), F.lit("repeated id").alias("fault")))
    return reduce(DataFrame.unionByName, out)


def groupings(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): independent counts of several columns in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return df.select(pairs).select("p.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def multi_valued(df: DataFrame, column: str, none: str = "(none)") -> DataFrame:
    """(value, n) of a list column; rows without values count under `none`."""
    rows = df.select(F.explode_outer(column).alias("value"))
    return rows.groupBy(F.coalesce("value", F.lit(none)).alias("value")).agg(F.count("*").alias("n"))


def existence(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A row a key and a count a value."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, its number from 1 in an order, without a task that sees all rows: ranges of the order are numbered each, and what the ranges before hold is added."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, order, strict=True)))
    sort = [F.asc_nulls_last(n) for n in names]
    rows = written(rows.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()), "ranges")
    before = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a task
    before = before.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy(*sort))).join(F.broadcast(before), "_range")
    return rows.withColumn("place", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before", *names)


def newest(df: DataFrame, created: str, key: str) -> DataFrame:
    """Newest first, then by key, with places."""
    return placed(df, -F.unix_micros(F.col(created).cast("timestamp")), F.col(key))


def timeline(df: DataFrame, year: str, key: str) -> DataFrame:
    """By year as text, then key, with places."""
    return placed(df, F.col(year).cast("string"), F.col(key))


def reading_order(df: DataFrame, manual: DataFrame, key: str, priority: str) -> DataFrame:
    """Manual positions first, then priority, then key, with places."""
    rows = df.join(manual.select(key, "position"), key, "left")
    return placed(rows, F.col("position"), F.col(priority), F.col(key))


def role_sections(papers: DataFrame, roles: tuple[str, ...], key: str, role: str, topics: str, topic_paths: DataFrame) -> DataFrame:
    """(role, key, path): the papers of these roles, each with the paths of its topics (joined by ` / `; the topic itself where no path is known)."""
    rows = papers.where(F.col(role).isin(*roles)).select(F.col(role).alias("role"), key, F.explode_outer(topics).alias("topic"))
    rows = rows.join(topic_paths.select("topic", F.array_join("path", " / ").alias("_path")), "topic", "left")
    return rows.select("role", key, F.coalesce("_path", "topic").alias("path"))


def knowledge_report(nodes: DataFrame, edges: DataFrame, frequencies: DataFrame, bridges: DataFrame) -> DataFrame:
    """(section, item, value) of a knowledge graph: concepts by frequency, those not understood, sizes of clusters, types, bridges, gaps and isolated nodes.

    nodes(id, type, understood), edges(source, target, type), frequencies(id, frequency), bridges(id, score). Gaps are
    concepts that some node needs but no paper has.
    """
    part = lambda section, df, item, value: df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"))
    one = lambda df: df.withColumn("_one", F.lit(1.0))
    clusters = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).groupBy("component").agg(F.count("*").alias("n"))
    needed = edges.where("type = 'prerequisite'").select(F.col("source").alias("id")).distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    sections = [
        part("frequency", frequencies, "id", "frequency"),
        part("not understood", one(nodes.where("not coalesce(understood, false)")), "id", "_one"),
        part("cluster", clusters, "component", "n"),
        part("type", nodes.groupBy("type").agg(F.count("*").alias("n")), "type", "n"),
        part("bridge", bridges.where("score > 0"), "id", "score"),
        part("gap", one(needed.join(frequencies.where("frequency > 0"), "id", "left_anti")), "id", "_one"),
        part("isolated", one(nodes.join(ends, "id", "left_anti")), "id", "_one"),
    ]
    return reduce(DataFrame.unionByName, sections)


def full_index(projections: list[DataFrame], aliases: DataFrame, links: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """The artifact index in one build: records, repeats, aliases (to where their chains end), links (a manual one over inferred ones, both ends resolved), tasks with their record, and issues (object, fault)."""
    records, repeats = index(projections)
    records = written(records, "records")
    good, bad = canonical_links(best_links(links), aliases, records)
    ends = resolved(aliases)
    own = tasks.join(records.select(F.col("id").alias("target"), F.lit(True).alias("_have")), "target", "left")
    name = F.concat_ws(">", "source", "target")
    issues = [
        repeats.select(F.col("id").alias("object"), F.concat(F.lit("repeated id at "), F.col("path")).alias("fault")),
        bad.select(name.alias("object"), "fault"),
        ends.join(records.select("id"), "id", "left_anti").select(F.col("alias").alias("object"), F.lit("dangling alias").alias("fault")),
        own.where("_have is null").select(F.col("task").alias("object"), F.lit("task without a record").alias("fault")),
        records.where(~F.col("kind").isin(*KINDS)).select(F.col("id").alias("object"), F.lit("unknown kind").alias("fault")),
    ]
    return {"records": records, "repeats": repeats, "aliases": ends, "links": good, "tasks": own.where("_have").drop("_have"), "issues": reduce(DataFrame.unionByName, issues)}


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of files(path, hash): equal, conflict, to copy, or only at the new place."""
    rows = old.select("path", F.col("hash").alias("_o")).join(new.select("path", F.col("hash").alias("_n")), "path", "full")
    return rows.select("path", F.when(F.col("_n").isNull(), "copy").when(F.col("_o").isNull(), "new only").when(F.col("_o") == F.col("_n"), "equal").otherwise("conflict").alias("state"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges).select("id"), "id", "left_anti")


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object, fault) of a knowledge graph: repeated ids, ends that are no node, weights out of range, edges without evidence."""
    out = [nodes.groupBy("id").count().where("count > 1").select(F.col("id").alias("object"), F.lit("repeated id").alias("fault"))]
    name = F.concat_ws(">", "source", "target").alias("object")
    for end in ("source", "target"):
        out.append(edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_anti").select(name, F.lit(f"no {end}").alias("fault")))
    out.append(edges.where(F.isnan("weight") | ~F.coalesce(F.col("weight").between(0, 1), F.lit(False))).select(name, F.lit("bad weight").alias("fault")))
    out.append(edges.where(F.size("evidence") == 0).select(name, F.lit("no evidence").alias("fault")))
    return reduce(DataFrame.unionByName, out)


def missing_references(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference column names no target."""
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(target).alias(column)).distinct(), column, "left_anti")
