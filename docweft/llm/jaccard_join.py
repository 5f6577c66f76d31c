"""N-gram Jaccard join by MinHash banding.

Texts become sets of N-word n-grams (lower-case word runs; 64-bit hashes). Texts with equal sets are one class from the
start. `bands` chooses bands and rows for the target recall at the threshold. Class representatives shuffle on their
band hashes; within a bucket, two members whose full MinHash signatures agree by half or more (a pair at the threshold
fails that with a chance below 1e-6) join a cluster. No bucket, of whatever size, joins members whose signatures were not
compared: a large one is dealt out by blocks of signatures (common.bucket_links). Clusters are connected components;
then every two members of a cluster meet in exactly one task of bounded size (common.block_pairs) and are verified on
their full n-gram sets. Tasks return, per member, its number of links and the smallest member that it reaches there; no
pair leaves a task. Classes are the connected components of verified links.

Defined results: a text with fewer than N words (and at least one) has one n-gram, all its words; a null or empty text,
or one without a word, has none, links with nothing and is a class of its own. Texts with equal n-gram sets are linked
(Jaccard 1). Rows that repeat an id are one document if their sets are equal; the same id with different sets gives a
row for each. A null id takes part as any other and is never the class id unless all of its class are null. Texts are
read whole; extra columns are ignored by `classes` and kept by `keep_one`; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, bucket_links, by_key, components, give_back, roots, spread_over_tasks, stored, text_of, with_hot_keys
from .exact_dedup import holds, value_filter, without_ids

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 64
#: Members of a block: signatures compared with each other at a time, and texts verified against another block's.
SIGNATURES, BLOCK = 512, 256
WORD = re.compile(r"\w+")
CACHE = 150_000


def bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for few false candidates, with which pairs at the threshold still share a band with the recall asked for."""
    for rows in range(hashes, 0, -1):
        n = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if n * rows <= hashes:
            return n, rows
    raise ValueError("too few hashes for this recall")


class Shingler:
    """n-gram hashes of texts. Word hashes are kept in a cache of bounded size."""

    def __init__(self, n: int = N):
        self.n, self.cache = n, {}

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = {w for w in found if w not in cache}
        if new:
            cache.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))

    def set_of(self, text: str) -> np.ndarray:
        """The sorted distinct n-gram hashes of a text."""
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash signatures (32-bit) of non-empty sets, one row a set."""
    a, b = _multipliers(k)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((k, len(sets)), np.uint32)
    for i in range(k):
        h = low * a[i] + (high ^ b[i])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[i] = np.minimum.reduceat(h, starts)
    return np.ascontiguousarray(out.T)


def _set_key(grams: np.ndarray) -> bytes | None:
    """128 bits that stand for an n-gram set; null for the empty one."""
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _sketch(shape: tuple[int, int], n: int):
    """Per text: a hash of its n-gram set (two longs; null without n-grams) and its signature."""
    k = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler.set_of(t) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, k).view(np.uint8).reshape(len(full), 4 * k) if full else ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_set_key, sets), pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc", "grams", "sig"])
        shingler.cache.clear()
        give_back()

    return run


def linker(rows: int):
    """Pairs whose signatures of so many rows agree by half or more, for common.bucket_links."""

    def run(values: pa.ChunkedArray, own: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(values.to_pylist()), np.uint32).reshape(-1, rows)
        sizes = np.diff(at)
        two = at[:-1][(sizes == 2) & (a[at[:-1]] == b[at[:-1]])]
        two = two[(sig[two] == sig[two + 1]).mean(1) >= 0.5]
        x, y = [two], [two + 1]
        rest = (sizes > 2) | (a[at[:-1]] != b[at[:-1]])
        for s, e in zip(at[:-1][rest].tolist(), at[1:][rest].tolist(), strict=True):
            same = a[s] == b[s]
            p, q = (np.arange(s, e),) * 2 if same else (s + np.flatnonzero(own[s:e] == a[s]), s + np.flatnonzero(own[s:e] == b[s]))
            alike = agreement(sig[p], sig[q]) * 2 >= rows
            i, j = np.nonzero(np.triu(alike, 1) if same else alike)
            x.append(p[i])
            y.append(q[j])
        return np.concatenate(x), np.concatenate(y)

    return run


def agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many rows each two signatures agree."""
    out = np.zeros((len(one), len(other)), np.uint8 if one.shape[1] < 256 else np.uint32)
    for k in range(one.shape[1]):
        out += one[:, k, None] == other[None, :, k]
    return out


def jaccard(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarities of two lists of sets, by one product of their incidence matrices, in parts of the vocabulary."""
    vocab, col = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(other)), [len(s) for s in (*one, *other)])
    both = np.zeros((len(one), len(other)))
    for first in range(0, len(vocab), 1 << 12):
        width = min(1 << 12, len(vocab) - first)
        part = (col >= first) & (col < first + width)
        m = np.zeros((len(one) + len(other), width), np.float32)
        m[row[part], col[part] - first] = 1
        both += m[: len(one)] @ m[len(one) :].T
    sizes = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in other])[None]
    return both / (sizes - both)


def _verify(n: int, threshold: float):
    """Rows of (cluster, a, b, own, rep, copies, text) sorted by (cluster, a, b): links and the smallest member reached, by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for table, at in by_key(batches, ["cluster", "a", "b"], 2 * BLOCK):
            rep, own, copies = (table.column(c).to_numpy() for c in ("rep", "own", "copies"))
            a, b, texts = table.column("a").to_numpy(), table.column("b").to_numpy(), table.column("text")
            links, reach = np.zeros(len(rep), np.int64), rep.copy()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = [shingler.set_of(t.as_py()) for t in texts.slice(s, e - s)]
                if e - s == 2 and a[s] == b[s]:
                    both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                    alike = np.array([[False, both / (len(sets[0]) + len(sets[1]) - both) >= threshold], [False, False]])
                    i, j = np.nonzero(alike)
                elif a[s] == b[s]:
                    i, j = np.nonzero(np.triu(jaccard(sets, sets) >= threshold, 1))
                else:
                    p, q = np.flatnonzero(own[s:e] == a[s]), np.flatnonzero(own[s:e] == b[s])
                    if not len(p) or not len(q):
                        continue
                    i, j = np.nonzero(jaccard([sets[x] for x in p], [sets[x] for x in q]) >= threshold)
                    i, j = p[i], q[j]
                links[s:e] += np.bincount(i, copies[s:e][j], e - s).astype(np.int64) + np.bincount(j, copies[s:e][i], e - s).astype(np.int64)
                # The group's rows are sorted by rep, so the smallest index is the smallest member.
                reach[s:e] = rep[s:e][roots(e - s, i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(reach)], ["rep", "links", "reach"])
        shingler.cache.clear()
        give_back()

    return run


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """doc, class_id (smallest id reachable by links) and n_links (other documents linked directly) of every document."""
    shape = bands(threshold, recall)
    docs = df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    kind = docs.schema["doc"].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = stored(docs.mapInArrow(_sketch(shape, n), f"doc {kind}, grams binary, sig binary"), "sketches")
    own = sketches.where("grams is not null").groupBy("grams", "doc").agg(F.first("sig").alias("sig"))
    sets = own.groupBy("grams").agg(F.min("doc").alias("rep_doc"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = stored(sets.withColumn("rep", F.xxhash64("grams")), "sets")
    clusters = _clusters(sets, shape)
    members = stored(clusters.join(sets.select("rep", "rep_doc", "grams", "copies"), "rep"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    work = block_pairs(members.select("cluster", "rep", "copies"), sizes, "cluster", "rep", BLOCK).join(_texts(docs, members, n), "rep")
    work = spread_over_tasks(work, "cluster", F.col("place"), ["cluster", "a", "b", "rep"], parts)
    verified = stored(work.mapInArrow(_verify(n, threshold), "rep long, links long, reach long"), "verified")
    comps = components(verified.select(F.col("rep").alias("a"), F.col("reach").alias("b"))).select(F.col("id").alias("rep"), "comp").join(members.select("rep", "rep_doc"), "rep")
    comps = stored(comps, "comps")
    heads = stored(comps.groupBy("comp").agg(F.min("rep_doc").alias("head"), F.count("*").alias("n")), "heads")
    linked = with_hot_keys(comps.select("rep", "comp"), heads.select("comp", "head"), "comp", heads, comps.count()).select("rep", "head")
    linked = linked.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep")
    per_set = sets.join(linked, "rep", "left").select("grams", "copies", F.when(F.col("links").isNull(), F.col("rep_doc")).otherwise(F.col("head")).alias("head"), F.coalesce("links", F.lit(0)).alias("links"))
    per_set = stored(per_set, "classes")
    total = sketches.count()
    every = sketches.select("doc", "grams").where("grams is not null").distinct()
    # Sets of over a thousandth of the documents number a thousand at most: bounded, so broadcast; their copies are not dealt out by set.
    hot = F.broadcast(per_set.where(F.col("copies") * 1000 > total))
    rest = per_set.where(F.col("copies") * 1000 <= total)
    found = every.join(hot, "grams").unionByName(every.join(hot.select("grams"), "grams", "left_anti").join(rest, "grams"))
    empty = sketches.where("grams is null").select("doc", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    return found.select("doc", F.col("head").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links")).unionByName(empty)


def _clusters(sets: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(rep, cluster) of the representatives that may have links: components of resembling members of shared buckets."""
    width = 4 * shape[1]
    band = F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))).alias("band")
    part = F.substring("sig", F.col("band") * width + 1, F.lit(width))
    banded = sets.select("rep", "sig", band).select(F.xxhash64(part, F.col("band")).alias("bucket"), F.col("rep").alias("id"))
    near = bucket_links(banded, sets.select(F.col("rep").alias("id"), F.col("sig").alias("value")), linker(shape[0] * shape[1]), SIGNATURES)
    return components(near).select(F.col("id").alias("rep"), F.col("comp").alias("cluster"))


def _texts(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """rep and text of the members: a Bloom filter of their ids first, then the exact join on id and n-gram set."""

    wanted = docs.sparkSession.sparkContext.broadcast(value_filter(members.select(F.xxhash64("rep_doc").alias("h"))))

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            batch = batch.filter(pa.array(holds(wanted.value, batch.column("h").to_numpy())))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [_set_key(shingler.set_of(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text"), pa.array(keys, pa.binary())], ["doc", "text", "grams"])
        shingler.cache.clear()
        give_back()

    # One Python step for filter and sets: two in a stage would keep twice as many workers.
    near = docs.withColumn("h", F.xxhash64("doc")).mapInArrow(gram_sets, f"doc {docs.schema['doc'].dataType.simpleString()}, text string, grams binary").where("grams is not null")
    near = near.groupBy("grams", "doc").agg(F.first("text").alias("text"))
    m = members.select("rep", F.col("grams").alias("_grams"), "rep_doc")
    return near.join(m, (near["grams"] == m["_grams"]) & near["doc"].eqNullSafe(m["rep_doc"])).select("rep", "text")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose document is its class's smallest id, with df's columns. An id whose rows have several n-gram sets goes only if all of them do."""
    found = classes(df, id_col, text_col, threshold)
    stays = F.max(F.col("doc").eqNullSafe(F.col("class_id")).cast("int")).alias("stays")
    return without_ids(df, id_col, found.groupBy("doc").agg(stays).where("stays = 0").select("doc"))
