"""Line segments of bounded size and the coverage of a text by intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import folded


def packed(lengths: Column, most: int) -> Column:
    """Greedy ranges of lines (first, last; from 1) of at most `most` characters with newlines between; null if a line is too long.

    One fold over the line lengths: the open range's start and size are carried along.
    """
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("size"))
    closed = lambda a: F.array(F.struct(a["first"].alias("first"), a["n"].alias("last")))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        n = a["n"] + 1
        size = a["size"] + x + F.when(n > a["first"], 1).otherwise(0)
        full = (size > most) & (n > a["first"])
        state = F.struct(F.when(full, n).otherwise(a["first"]).alias("first"), n.alias("n"), F.when(full, x).otherwise(size).alias("size"))
        return state, F.when(full, closed(a)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))

    ranges = folded(lengths, start, step, "struct<first:int,last:int>", lambda a: F.filter(closed(a), lambda r: r["last"] > 0))
    return F.when(~F.exists(lengths, lambda x: x > most), ranges)


def segments(df: DataFrame, doc: str = "doc_id", text: str = "text", most: int = 5500) -> DataFrame:
    """(doc, segment, first, last, text_hash) of every text whose lines all fit; `fits` is false, and the rest null, for the others."""
    lines = F.split(F.col(text), "\n", -1)
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(doc, lines.alias("lines"))
    rows = rows.withColumn("ranges", packed(F.transform("lines", lambda x: F.length(x)), most))
    rows = rows.select(doc, "lines", F.col("ranges").isNotNull().alias("fits"), F.posexplode_outer("ranges").alias("segment", "r"))
    body = F.array_join(F.slice("lines", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1), "\n")
    return rows.select(doc, "fits", "segment", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.sha2(body, 256).alias("text_hash"))


def coverage(intervals: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """(key, gaps, overlaps, complete): do intervals(key, first, last) cover 1 to totals(key, total) without gap or overlap?"""
    w = W.partitionBy(key).orderBy("first", "last")
    due = F.coalesce(F.lag("last").over(w), F.lit(0)) + 1
    rows = intervals.select(key, "first", "last", due.alias("due"))
    per = rows.groupBy(key).agg(F.count_if(F.col("first") > F.col("due")).alias("gaps"), F.count_if(F.col("first") < F.col("due")).alias("overlaps"), F.max("last").alias("end"))
    out = totals.join(per, key, "left")
    whole = (F.col("gaps") == 0) & (F.col("overlaps") == 0) & (F.col("end") == F.col("total"))
    return out.select(key, F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce(whole, F.col("total") == 0).alias("complete"))


def marker_faults(ledger: DataFrame, markers: DataFrame) -> DataFrame:
    """(segment_id, fault): segments missing or repeated among markers(segment_id, body), with an empty body, or not in the ledger."""
    per = markers.groupBy("segment_id").agg(F.count("*").alias("n"), F.max(F.trim("body")).alias("body"))
    rows = ledger.select("segment_id", F.lit(True).alias("listed")).distinct().join(per, "segment_id", "full")
    fault = F.when(F.col("listed").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.coalesce("body", F.lit("")) == "", "empty")
    return rows.select("segment_id", fault.alias("fault")).where("fault is not null")


def sections_fit(found: Column, expected: list[str]) -> Column:
    """Are a delivery's sections exactly these, in this order?"""
    return F.coalesce(found == F.array(*map(F.lit, expected)), F.lit(False))


def context_budget(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int, each: int) -> DataFrame:
    """Greedy context in order: every item takes what the budget leaves, at most `each` characters; adds taken, included, truncated."""
    want = F.least(F.col(size), F.lit(each))
    before = F.coalesce(F.sum(want).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.least(want, budget - before), F.lit(0))
    return rows.withColumn("taken", taken.cast("long")).withColumns({"included": F.col("taken") > 0, "truncated": (F.col("taken") > 0) & (F.col("taken") < F.col(size))})
