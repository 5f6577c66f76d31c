"""Embedding near-dedup by lattice hashing.

Unit vectors are projected on `blocks` times eight random directions, scaled, and each eight decoded to the nearest point
of the E8 lattice; these points together are the vector's cell. Each of several tables has its own directions, and
besides its own cell a vector is put into neighbouring ones: one block's point at a time is replaced by the lattice
points across the faces that the projection lies nearest to. Within a cell, cosines in double precision give links; no
cell, of whatever size, links what was not compared (common.bucket_links). Clusters are the connected components of
links, and every two members of a cluster meet in exactly one task of bounded size, where the cosine is computed again;
tasks return per member the number of links and the smallest member reached, never pairs. Equal vectors are one member
from the start, with their number of copies.

`shape` gives more blocks a cell for more rows, so that unrelated vectors of a cell stay few, and as many tables as keep
the recall, about 0.99 and more at cosine 0.95 on random pairs, the same at every size (tests measure it).

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing. Equal vectors
are linked. Vectors of several lengths are compared within their length only. Rows that repeat id and vector count once;
an id with several vectors is one id, linked wherever one of them is, and its links add up over them. Rows with a null id
come out with no links and a null component. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import block_pairs, bucket_links, by_key, components, give_back, roots, spread_over_tasks, stored

THRESHOLD, PROBES, WIDTH, SEED = 0.95, 1, 0.6, 9
#: Vectors of a block: what a task compares with each other at a time.
BLOCK = 512
#: Share of pairs at cosine 0.95 that meet in a table of two blocks, and what each more block leaves of it (measured, see
#: tests); pairs that may meet in no table; rows for which two blocks do, and how many times as many one more block does.
MEET, MORE, MISSED, ROWS, GROWTH = 0.415, 0.52, 0.002, 1 << 20, 1 << 6


def shape(rows: int) -> tuple[int, int]:
    """(tables, blocks) for so many different vectors."""
    blocks = 2 + (max(0, math.ceil(math.log(rows / ROWS, GROWTH))) if rows > ROWS else 0)
    return math.ceil(math.log(MISSED) / math.log1p(-MEET * MORE ** (blocks - 2))), blocks


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    err = x - r
    worst = np.abs(err).argmax(1)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    w = worst[odd]
    r[odd, w] += np.where(err[odd, w] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the better of the nearest in D8 and in D8 moved by one half everywhere."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=8)
def directions(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(tables, blocks, dim, 8))


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int = PROBES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """64-bit cell names of unit vectors: one row a vector, 1 + blocks * probes a table."""
    out = []
    mult = np.random.default_rng(seed).integers(1, 1 << 62, (blocks, 8), np.int64).view(np.uint64) | np.uint64(1)
    step = _shortest()
    for t, table in enumerate(directions(unit.shape[1], tables, blocks, seed)):
        homes, near = [], []
        for d, m in zip(table, mult, strict=True):
            y = unit @ d / (width * 8**0.5)
            home = nearest_e8(y)
            # Neighbours: beyond the faces that the projection is nearest to, among the lattice's shortest vectors.
            across = np.argsort(-((y - home) @ step.T), 1)[:, :probes]
            name = lambda p, m=m: ((2 * p).astype(np.int64).view(np.uint64) * m).sum(1, dtype=np.uint64)
            homes.append(name(home))
            near.append([name(home + step[across[:, i]]) for i in range(probes)])
        names = [homes] + [[*homes[:b], other, *homes[b + 1 :]] for b in range(blocks) for other in near[b]]
        for parts in names:
            h = np.full(len(unit), t + 1 + unit.shape[1] * 64, np.uint64)
            for p in parts:
                h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            out.append(h)
    return np.stack(out, 1).view(np.int64)


@lru_cache(maxsize=1)
def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = [1 - 2 * (bits >> k & 1) for k in range(8)]
        if signs.count(-1) % 2 == 0:
            out.append(np.array(signs) / 2)
    return np.array(out)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; the largest component goes first, so that squares neither vanish nor overflow."""
    m = m.astype(float)
    m /= np.abs(m).max(1)[:, None]
    return m / np.sqrt((m * m).sum(1))[:, None]


def usable(column: pa.Array) -> list[int]:
    """Indices of vectors without null or non-finite components that are not zero or empty."""
    return [i for i, v in enumerate(column.to_pylist()) if v and None not in v and np.isfinite(v).all() and any(v)]


def _vectors(kind: str):
    """id, key (128 bits of the vector) and vector (bytes of its own type) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                part = part.take(pa.array(usable(part.column(1)), pa.int64()))
                # Adding 0 makes -0.0 equal 0.0.
                raw = [(np.array(v, kind) + np.array(0, kind)).tobytes() for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "vector"])

    return run


def _cells(kind: str, tables: int, blocks: int):
    """Rows of (rep, vector): rep and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                raw = part.column(1).to_pylist()
                by_size: dict[int, list[int]] = {}
                for k, v in enumerate(raw):
                    by_size.setdefault(len(v), []).append(k)
                for ks in by_size.values():
                    m = np.frombuffer(b"".join(raw[k] for k in ks), kind).reshape(len(ks), -1)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ks)), pa.array(cells(unit_rows(m), tables, blocks).tolist(), pa.list_(pa.int64()))], ["rep", "cells"])
        give_back()

    return run


def _matrix(column: pa.ChunkedArray, s: int, e: int, kind: str) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(column.slice(s, e - s).to_pylist()), kind).reshape(e - s, -1))


def _group_links(column: pa.ChunkedArray, own: np.ndarray, a: int, b: int, s: int, e: int, threshold: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (within s..e) of the pairs of one work item at or above the threshold, each once."""
    v = _matrix(column, s, e, kind)
    p = np.flatnonzero(own[s:e] == a)
    q = p if a == b else np.flatnonzero(own[s:e] == b)
    if a == b:  # of a whole block, with the pivots that are its guests
        return np.nonzero(np.triu(v @ v.T >= threshold, 1))
    i, j = np.nonzero(v[p] @ v[q].T >= threshold)
    return p[i], q[j]


def linker(threshold: float, kind: str):
    """Pairs of vectors at or above the threshold, for common.bucket_links."""

    def run(values: pa.ChunkedArray, own: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            i, j = _group_links(values, own, a[s], b[s], s, e, threshold, kind)
            x.append(i + s)
            y.append(j + s)
        return np.concatenate(x), np.concatenate(y)

    return run


def _verify(threshold: float, kind: str):
    """Rows of (cluster, a, b, own, rep, copies, vector) sorted by (cluster, a, b, rep): links and the smallest member reached, by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["cluster", "a", "b"], 2 * BLOCK):
            rep, own, a, b, copies = (table.column(c).to_numpy() for c in ("rep", "own", "a", "b", "copies"))
            links, reach = np.zeros(len(rep), np.int64), rep.copy()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                i, j = _group_links(table.column("vector"), own, a[s], b[s], s, e, threshold, kind)
                links[s:e] += np.bincount(i, copies[s:e][j], e - s).astype(np.int64) + np.bincount(j, copies[s:e][i], e - s).astype(np.int64)
                reach[s:e] = rep[s:e][roots(e - s, i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(reach)], ["rep", "links", "reach"])
        give_back()

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, rows_a_block: int = BLOCK) -> DataFrame:
    """id, n_links, component (smallest id reachable by links, itself included) and kept of every row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if df.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    good = stored(rows.where("id is not null").mapInArrow(_vectors(kind), "id long, key binary, vector binary"), "vectors")
    own = good.groupBy("key", "id").agg(F.first("vector").alias("vector"))
    sets = own.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    sets = stored(sets.withColumn("rep", F.xxhash64("key")), "sets")
    tables, blocks = shape(sets.count())
    put = stored(sets.select("rep", "vector").mapInArrow(_cells(kind, tables, blocks), "rep long, cells array<long>"), "cells")
    vectors = sets.select(F.col("rep").alias("id"), F.col("vector").alias("value"))
    near = bucket_links(put.select(F.explode(F.array_distinct("cells")).alias("bucket"), F.col("rep").alias("id")), vectors, linker(threshold, kind), rows_a_block)
    clusters = stored(components(near).select(F.col("id").alias("rep"), F.col("comp").alias("cluster")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    work = block_pairs(clusters, sizes, "cluster", "rep", rows_a_block).join(sets.select("rep", "copies", "vector"), "rep")
    work = spread_over_tasks(work, "cluster", F.col("place"), ["cluster", "a", "b", "rep"], parts)
    verified = stored(work.mapInArrow(_verify(threshold, kind), "rep long, links long, reach long"), "verified")
    # Components over the ids: each rep stands for its smallest id, and every copy hangs on it.
    low = sets.select("rep", "low")
    reached = verified.where("rep <> reach").select("rep", "reach").distinct()
    reached = reached.join(low, "rep").select(F.col("low").alias("a"), F.col("reach").alias("rep")).join(low, "rep").select("a", F.col("low").alias("b"))
    links = sets.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "copies")
    links = stored(links.where("links > 0"), "links")
    # Vectors with over a thousandth of all copies number a thousand at most: bounded, so broadcast; their copies are not dealt out by vector.
    total = good.count()
    ids = good.select("id", "key").distinct()
    hot, rest = F.broadcast(links.where(F.col("copies") * 1000 > total)), links.where(F.col("copies") * 1000 <= total)
    linked = stored(ids.join(hot, "key").unionByName(ids.join(hot.select("key"), "key", "left_anti").join(rest, "key")).select("id", "low", "links"), "linked")
    comps = components(reached.unionByName(linked.select(F.col("id").alias("a"), F.col("low").alias("b"))))
    found = linked.groupBy("id").agg(F.sum("links").alias("links")).join(comps, "id")
    out = rows.select("id").join(found, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("comp", "id").alias("component"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
