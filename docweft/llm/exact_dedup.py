"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Pass 1 hashes every normalised text in the JVM (SHA-256) and keeps a narrow table. Each task gives the bits of its hashes
in a Bloom filter `once`, and those of hashes that it has several times in a second filter `twice`, as the positions that
are set. Filters of tasks are merged segment by segment (a bit that two tasks have set counts as twice), so `twice` holds
every repeated hash and few others. Pass 2 tests each row against the broadcast `twice`: rows that miss it are unique and
go straight through; the others are grouped exactly.

A filter has BITS_A_ROW bits a row and at most MAX_BITS, which bounds the broadcast. More rows than that are taken in
several parts of the hash space, one filter each: the narrow table is written by part, so each part is read once, and no
filter fills up however many rows there are. `keep_first` tests texts against one filter of the hashes that lose a row;
where these number over MAX_BITS / BITS_A_ROW (33 million) more texts than need to meet the exact join: 4 % of the others
at twice as many, 15 % at four times, 47 % at eight times; the result stays the same.

Defined results: a null text counts as empty, and empty texts equal each other. A null id ranks after all others
(null keeps only if its whole group has null ids). `assign` gives a row for each row; rows that repeat both id and text
are all kept or all not, and `keep_first` keeps one of them. Empty tables give empty results. Extra columns are kept by
`keep_first` and ignored by `assign`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.session import new_path

from .common import WHITE, free_name, stored, text_of

#: Bits of a broadcast filter at most (64 MB), probes a hash, and bits of the filter for each row.
MAX_BITS = 1 << 29
PROBES = 3
BITS_A_ROW = 16
#: Bits of a segment at least, and segments of a filter at most.
SEGMENT, SEGMENTS = 1 << 16, 1 << 12


def normalised(column: str) -> Column:
    """The text with every white-space run replaced by one space."""
    return F.regexp_replace(text_of(column), WHITE + "+", " ")


def text_hash(column: str) -> Column:
    """SHA-256 of the normalised text in UTF-8, as lowercase hex."""
    return F.sha2(normalised(column), 256)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit positions of 64-bit hashes, one row a hash."""
    h = h.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)], 1)


def filter_bits(rows: int, limit: int = MAX_BITS) -> int:
    """A power of two with BITS_A_ROW bits a row, between one segment and the limit."""
    return min(limit, max(SEGMENT, 1 << (max(1, rows) * BITS_A_ROW - 1).bit_length()))


def segment_bits(bits: int) -> int:
    return max(SEGMENT, bits // SEGMENTS)


def _marks(bits: int):
    """Per task: the positions set in both filters by its hashes, by segment, compressed. Memory in proportion to the task's rows."""
    size = segment_bits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]), return_counts=True)
        for kind, hashes in enumerate((h, h[n > 1])):
            at = np.unique(_places(hashes, bits).ravel())
            segment, start = np.unique(at // np.uint64(size), return_index=True)
            at = (at % np.uint64(size)).astype(np.uint32)
            for first in range(0, len(segment), 64):
                ends = [*start[first + 1 : first + 65], len(at)][: len(start[first : first + 64])]
                packed = [zlib.compress(np.diff(at[s:e], prepend=np.uint32(0)).tobytes(), 1) for s, e in zip(start[first : first + 64], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(segment[first : first + 64].astype(np.int32)), pa.array([kind] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["segment", "kind", "bits"])

    return run


def _merge(bits: int):
    """One segment: `twice` has what any task had twice and every bit that two tasks set."""
    size = segment_bits(bits)

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for batch in tables:
            for kind, packed in zip(batch.column("kind").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                at = np.frombuffer(zlib.decompress(packed), np.uint32).cumsum(dtype=np.uint32)
                if kind:
                    twice[at] = True
                else:
                    twice[at[once[at]]] = True
                    once[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], ["segment", "bits"])

    return run


def repeated_filter(hashes: DataFrame, rows: int, limit: int = MAX_BITS) -> np.ndarray:
    """The packed filter of the possibly repeated values of the one long column of hashes; limit / 8 bytes at most."""
    bits = filter_bits(rows, limit)
    size = segment_bits(bits)
    merged = hashes.mapInArrow(_marks(bits), "segment int, kind int, bits binary").groupBy("segment").applyInArrow(_merge(bits), "segment int, bits binary")
    packed = np.zeros((bits // size, size // 8), np.uint8)
    for row in merged.toLocalIterator():
        packed[row.segment] = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
    return packed.ravel()


def holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes the packed Bloom filter has."""
    at = _places(h, len(packed) * 8).astype(np.int64)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def member(spark: SparkSession, packed: np.ndarray):
    """A pandas UDF: does the packed Bloom filter hold the 64-bit hash?"""
    shared = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, h.to_numpy()))

    test.shared = shared
    return test


def value_filter(values: DataFrame, limit: int = MAX_BITS) -> np.ndarray:
    """The packed Bloom filter of the one long column of values; no value is missed."""
    twice = values.union(values)  # each value twice, so that the filter of repeated ones has it
    return repeated_filter(twice, 2 * values.count(), limit)


def contained(values: DataFrame, limit: int = MAX_BITS):
    """A pandas UDF that tests 64-bit hashes against value_filter(values)."""
    return member(values.sparkSession, value_filter(values, limit))


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose id is in the one column of gone; rows that a Bloom filter of gone lacks never shuffle."""
    gone = stored(gone.toDF("_gone").distinct(), "gone")
    test = contained(gone.select(F.xxhash64("_gone").alias("h")))
    flag = free_name(df, "_maybe")
    rows = df.withColumn(flag, test(F.xxhash64(id_col)))
    met = rows.where(F.col(flag)).select(df.columns)
    met = met.join(gone, met[id_col].eqNullSafe(gone["_gone"]), "left_anti")
    return rows.where(~F.col(flag)).select(df.columns).unionByName(met)


def _flagged(df: DataFrame, id_col: str, text_col: str, limit: int):
    """(doc, sha, maybe) of every row, written once; their number; the test of a hash, if one filter held all."""
    spark = df.sparkSession
    keyed = stored(df.select(F.col(id_col).alias("doc"), text_hash(text_col).alias("sha")), "hashes").withColumn("h", F.xxhash64("sha"))
    rows = keyed.count()
    parts = -(-filter_bits(rows, 1 << 62) // limit)
    if parts == 1:
        maybe = member(spark, repeated_filter(keyed.select("h"), rows, limit))
        return stored(keyed.withColumn("maybe", maybe("h")).drop("h"), "flagged"), rows, maybe
    # A power of two of parts, by high bits of the hash, which place nothing within a filter.
    by_part = stored(keyed.withColumn("part", F.shiftrightunsigned("h", 64 - (parts - 1).bit_length()).cast("int")), "by_part", "part")
    out = new_path(spark, "flagged")
    for part in range(parts):  # one filter at a time is in memory: it goes once its part is written
        here = by_part.where(F.col("part") == part).drop("part")
        maybe = member(spark, repeated_filter(here.select("h"), limit // BITS_A_ROW, limit))
        one = here.withColumn("maybe", maybe("h")).drop("h")
        one.write.parquet(f"{out}/part={part}")
        maybe.shared.destroy()
    return spark.read.schema(one.schema).parquet(*(f"{out}/part={part}" for part in range(parts))), rows, None


def _groups(flagged: DataFrame) -> DataFrame:
    """(sha, keep, n) of the possibly repeated rows; n counts rows."""
    return stored(flagged.where("maybe").groupBy("sha").agg(F.min("doc").alias("keep"), F.count("*").alias("n")), "groups")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_BITS) -> DataFrame:
    """doc, keep, n (rows of the group), kept, sha for every row, dropped ones too."""
    flagged, rows, _ = _flagged(df, id_col, text_col, limit)
    one = flagged.where("not maybe").select("doc", F.col("doc").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha")
    several = _grouped(flagged.where("maybe").drop("maybe"), _groups(flagged), rows)
    return one.unionByName(several.select("doc", "keep", "n", F.col("doc").eqNullSafe(F.col("keep")).alias("kept"), "sha"))


def _grouped(several: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """Each possibly repeated row with its group. Groups of over a thousandth of all rows number under a thousand: bounded, so broadcast, and their copies do not shuffle."""
    hot = F.broadcast(groups.where(F.col("n") * 1000 > rows))
    rest = groups.where(F.col("n") * 1000 <= rows)
    return several.join(hot, "sha").unionByName(several.join(hot.select("sha"), "sha", "left_anti").join(rest, "sha"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_BITS) -> DataFrame:
    """The rows of df that stay, with df's columns. Rows whose hash the filter lacks never shuffle."""
    flagged, rows, maybe = _flagged(df, id_col, text_col, limit)
    groups = _groups(flagged)
    if maybe is None:
        maybe = member(df.sparkSession, value_filter(groups.where("n > 1").select(F.xxhash64("sha").alias("h")), limit))
    sha, flag = free_name(df, "_sha"), free_name(df, "_maybe")
    several = flagged.where("maybe").groupBy("sha", "doc").agg(F.count("*").alias("copies"))
    gone = _grouped(several, groups, rows).where(~F.col("doc").eqNullSafe(F.col("keep"))).select(F.col("doc").alias("_gone_doc"), F.col("sha").alias("_gone_sha"))
    rows = df.withColumn(sha, text_hash(text_col))
    rows = rows.withColumn(flag, maybe(F.xxhash64(sha)))
    # (hash, id) is unique in `gone` and all but unique in the rows, so a hot text spreads over all tasks.
    met = rows.where(F.col(flag)).drop(flag)
    met = met.join(gone, (met[sha] == gone["_gone_sha"]) & met[id_col].eqNullSafe(gone["_gone_doc"]), "left_anti")
    return rows.where(~F.col(flag)).select(df.columns).unionByName(met.dropDuplicates([sha, id_col]).select(df.columns))
