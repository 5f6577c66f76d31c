"""Ranked literal search over nodes and the source anchors that no hit node uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import starts


def search(nodes: DataFrame, anchors: DataFrame, query: str, limit: int = 50, unicode: bool = True) -> DataFrame:
    """Hits by falling score, page, anchor and node; limit at most.

    A node counts if its text and one of its anchors have every word; the first such anchor in provenance order stands
    for it. Anchors that no hit node took count for themselves. query is in searchable form.
    """
    hit = lambda df: df.withColumn("score", tx.relevance(tx.searchable(F.col("text"), unicode), query)).where("score > 0")
    found = hit(anchors).select(F.col("id").alias("anchor_id"), "page_number", F.col("text").alias("anchor_text"), F.col("score").alias("anchor_score"))
    own = hit(nodes).select(F.col("id").alias("node_id"), "text", F.col("type").alias("kind"), "score", F.posexplode("provenance").alias("pos", "anchor_id"))
    best = own.join(found, "anchor_id").withColumn("n", F.row_number().over(W.partitionBy("node_id").orderBy("pos"))).where("n = 1")
    rest = found.join(best.select("anchor_id").distinct(), "anchor_id", "left_anti")
    rows = best.select("score", "page_number", "anchor_id", "node_id", "text", "kind")
    rows = rows.unionByName(rest.select(F.col("anchor_score").alias("score"), "page_number", "anchor_id", F.lit(None).cast("string").alias("node_id"), F.col("anchor_text").alias("text"), F.lit("SOURCE_SPAN").alias("kind")))
    return rows.orderBy(F.desc("score"), "page_number", "anchor_id", F.coalesce("node_id", F.lit(""))).limit(limit)


def ranked_documents(df: DataFrame, query: str, doc: str = "doc_id", text: str = "text", limit: int = 50) -> DataFrame:
    """The best documents for a query in searchable form, without leaving the JVM."""
    rows = df.select(doc, tx.relevance(tx.searchable(F.col(text), False), query).alias("score"))
    return rows.orderBy(F.desc("score"), doc).limit(limit).where("score > 0")  # misses sort last, so the filter can follow the limit


def lexical_audit(lines: DataFrame, terms: str, classes: list[tuple[str, str]], rest: str, path: str, line: str = "line", text: str = "text") -> DataFrame:
    """Every hit of a pattern of terms, without regard to case: (path, line, hit, term, byte_column, class, line_sha256).

    byte_column counts UTF-8 bytes from 1. classes: (name, pattern over the path), the first that fits, else rest.
    """
    hits = F.regexp_extract_all(text, F.lit(f"(?i)({terms})"), F.lit(1))
    gaps = F.split(text, f"(?i)(?:{terms})", -1)
    rows = lines.where(F.col(text).rlike(f"(?i)(?:{terms})")).select(F.col(path).alias("path"), F.col(line).alias("line"), F.col(text).alias("text"), hits.alias("hits"), gaps.alias("gaps"))
    sizes = F.zip_with("hits", "gaps", lambda h, g: F.struct(h.alias("term"), F.octet_length(g).alias("gap"), F.octet_length(h).alias("size")))
    found = F.filter(sizes, lambda x: x["term"].isNotNull())
    before = starts(F.transform(found, lambda x: x["gap"] + x["size"]))
    rows = rows.select("path", "line", "text", F.posexplode(F.zip_with(found, before, lambda x, at: F.struct(F.lower(x["term"]).alias("term"), (at + x["gap"] + 1).alias("byte_column")))).alias("hit", "h"))
    kind = F.lit(rest)
    for name, pattern in reversed(classes):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    return rows.select("path", "line", "hit", "h.term", "h.byte_column", kind.alias("class"), F.sha2("text", 256).alias("line_sha256"))


def audit_counts(hits: DataFrame) -> DataFrame:
    """(class, hits, lines) of an audit."""
    return hits.groupBy("class").agg(F.count("*").alias("hits"), F.count_distinct("path", "line").alias("lines"))
