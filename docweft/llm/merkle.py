"""Merkle dataset manifest: an external-memory node store, built and read level by level.

Every row is a leaf, the hash of its columns. Of each tree (a value of one column) the leaves stand in the order of their
ids; every two neighbours become their hash until one node remains, the subroot. Subroots are leaves of one more tree,
whose top is the root.

`build` sorts the leaves by ranges and writes them once: sorted runs. A node's coordinate is (tree, level, place), its
parent's place is half its own. So 2^STRIP neighbours of a level are all that the STRIP levels above them need: a task
streams such runs, each level from the one before, and the nodes go to Parquet partitioned by level. The next pass reads
the topmost of these. Passes are few (one for each STRIP levels), a run is bounded, and a tree that has a third of all
rows is as many runs as it needs.

`paths` goes down again by merge scans: runs of a strip's nodes and the way from their common ancestor to the root come
together by coordinate, sorted, and give the way of each node. A step of a way is `<` or `>` with the sibling's hash (left
or right of the node), or empty where the node is hashed alone. `proofs` adds what a way proves: its siblings' hash, and
the root that folding a leaf over it gives.

Defined results: a null column is hashed as such, not as empty. Leaves with equal ids follow by their hash; null ids come
first. Equal rows are leaves each for itself. A null tree value is a tree, the first one. Texts are hashed whole. The
proof of a lone row is the hash of nothing. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweft.session import scratch
from docweft.session import written as stored

from .common import by_key, give_back

#: Levels that one pass makes; a run has 2^STRIP nodes.
STRIP = 10
#: Rows that a task holds beside those of a run.
HELD = 8192

NODE = "tree string, level int, place long, hash string, n long"


class Store(NamedTuple):
    """leaves(tree, place, id, hash, changed, n); strips[s]: nodes(tree, level, place, hash, n) of levels s * STRIP + 1 and up; tops(tree, hash, n). n: the tree's leaves."""

    leaves: DataFrame
    strips: list[DataFrame]
    tops: DataFrame


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def hashed(*columns: Column) -> Column:
    """The hash of columns: each `-` if null, else its number of UTF-8 bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaf_rows(df: DataFrame, fields: list[str], tree: str, id_col: str, changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, hash, changed) of df's rows; changed: the hash with changes in place of some fields, for the rows `where`, else null."""
    changed = F.when(where, hashed(*((changes or {}).get(c, F.col(c)) for c in fields))) if where is not None else F.lit(None).cast("string")
    return df.select(F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("id"), hashed(*map(F.col, fields)).alias("hash"), changed.alias("changed"))


def _sorted(leaves: DataFrame) -> DataFrame:
    """Adds each leaf's place in its tree, from 0, and n. Ranges of the order are sorted and written once; a range's part of a tree starts where the ranges before end."""
    leaves = stored(leaves, "hashes")  # so that finding the ranges doesn't hash again
    order = [F.asc_nulls_first(c) for c in ("tree", "id", "hash", "_salt")]
    rows = leaves.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "runs").withColumn("_range", F.shiftright("_row", 33))
    starts = rows.groupBy("tree", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("tree").orderBy("_range")) - F.col("_n")
    starts = starts.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(W.partitionBy("tree")).alias("n"))
    return stored(rows.join(starts, ["tree", "_range"]).select("tree", (F.col("_row") + F.col("_shift")).alias("place"), "id", "hash", "changed", "n"), "leaves")


def nodes_at(n: int, level: int) -> int:
    """How many nodes a tree of n leaves has on a level."""
    return (n + (1 << level) - 1) >> level


def height(n: int) -> int:
    """The level of the top of a tree of n leaves."""
    return (n - 1).bit_length()


def _pass(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From nodes of level `base`, sorted by tree, run and place, those of the STRIP levels above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["tree", "run"], HELD):
            trees, runs, counts, hashes = (table.column(c).to_pylist() for c in ("tree", "run", "n", "hash"))
            out: list[list] = [[], [], [], [], []]
            for start, stop in zip(at[:-1], at[1:], strict=True):
                below, first, n = hashes[start:stop], runs[start] << STRIP, counts[start]
                for level in range(base + 1, min(base + STRIP, height(n)) + 1):
                    below, first = [digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)], first >> 1
                    for column, more in zip(out, ([trees[start]] * len(below), [level] * len(below), range(first, first + len(below)), below, [n] * len(below)), strict=True):
                        column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["tree", "level", "place", "hash", "n"])
        give_back()

    return run


def build(leaves: DataFrame) -> Store:
    """The node store over leaves(tree, id, hash, changed)."""
    leaves = _sorted(leaves)
    tops, strips, base = leaves.where("n = 1").select("tree", "hash", "n"), [], 0
    below = leaves.select("tree", "place", "hash", "n")
    top = height(leaves.agg(F.max("n")).first()[0] or 1)
    while base < top:
        runs = below.where(F.col("n") > F.lit(1 << base)).withColumn("run", F.shiftright("place", STRIP)).repartition("tree", "run").sortWithinPartitions("tree", "run", "place")
        nodes = stored(runs.mapInArrow(_pass(base), NODE), "nodes", "level")
        strips.append(nodes)
        tops = tops.unionByName(nodes.where(F.col("n") <= F.expr("shiftleft(1L, level)")).select("tree", "hash", "n"))
        base += STRIP
        below = nodes.where(F.col("level") == base).select("tree", "place", "hash", "n")
    return Store(leaves, strips, tops)


def way(levels: list[list[str]], i: int) -> list[str]:
    """The steps up from node i of the lowest of a run's levels."""
    out = []
    for nodes in levels:
        k = i ^ 1
        out.append("" if k >= len(nodes) else (">" if k > i else "<") + nodes[k])
        i >>= 1
    return out


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf's hash and its way give."""
    for step in steps:
        leaf = digest(step[1:] + leaf if step[:1] == "<" else leaf + step[1:])
    return leaf


def _merge(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a strip's nodes and the ways above its runs, sorted by tree, run, level and place: the nodes of level `base` with their whole ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["tree", "run"], HELD):
            level, hashes, counts = table.column("level").to_numpy(), table.column("hash").to_pylist(), table.column("n").to_numpy()
            steps, subroots = [], []
            for start, stop in zip(at[:-1], at[1:], strict=True):
                above = table.slice(start, 1)  # level -1 sorts first
                on, subroot = above.column("steps")[0].as_py(), above.column("subroot")[0].as_py()
                own = hashes[start + 1 : stop]
                of = level[start + 1 : stop]
                levels = [own[of.searchsorted(k) : of.searchsorted(k, "right")] for k in range(base, min(base + STRIP, height(int(counts[stop - 1]))))]
                nodes = int((of == base).sum())
                steps += [way(levels, i) + on for i in range(nodes)]
                subroots += [subroot] * nodes
            nodes = table.filter(pa.array(level == base)).select(["tree", "place", "id", "hash", "changed", "n"])
            nodes = nodes.append_column("steps", pa.array(steps, pa.list_(pa.string()))).append_column("subroot", pa.array(subroots, pa.string()))
            yield from nodes.to_batches()
        give_back()

    return run


def paths(store: Store, above: DataFrame) -> DataFrame:
    """(tree, place, id, hash, changed, n, steps, subroot) of every leaf; above(tree, steps, subroot): the way on from each tree's top."""
    kind = store.leaves.schema["id"].dataType.simpleString()
    tops = store.tops.select("tree", "n").join(above, "tree")
    none = {"id": F.lit(None).cast(kind), "changed": F.lit(None).cast("string"), "steps": F.lit(None).cast("array<string>"), "subroot": F.lit(None).cast("string")}
    columns = ["tree", "run", "level", "place", "hash", "n", "id", "changed", "steps", "subroot"]
    out = None
    for s in reversed(range(max(1, len(store.strips)))):
        base = s * STRIP
        ways = tops.where((F.col("n") <= F.lit(1 << (base + STRIP))) & (F.lit(s == 0) | (F.col("n") > F.lit(1 << base)))).select("tree", F.lit(0).cast("long").alias("run"), "n", "steps", "subroot")
        if out is not None:
            ways = ways.unionByName(out.select("tree", F.col("place").alias("run"), "n", "steps", "subroot"))
        rows = ways.withColumns({"level": F.lit(-1), "place": F.lit(0).cast("long"), "hash": F.lit("")} | {c: none[c] for c in ("id", "changed")}).select(columns)
        if s == 0:
            nodes = store.leaves.withColumns({"level": F.lit(0), "run": F.shiftright("place", STRIP), "steps": none["steps"], "subroot": none["subroot"]})
        else:
            nodes = store.strips[s - 1].where((F.col("level") == base) & (F.col("n") > F.lit(1 << base))).withColumns({"run": F.shiftright("place", STRIP)} | none)
        rows = rows.unionByName(nodes.select(columns))
        if s < len(store.strips):  # siblings: levels of the strip with more than one node of the tree
            inner = store.strips[s].where((F.col("level") < base + STRIP) & (F.col("n") > F.expr("shiftleft(1L, level)")))
            rows = rows.unionByName(inner.withColumns({"run": F.expr(f"shiftright(place, {base + STRIP} - level)")} | none).select(columns))
        merged = rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "level", "place")
        out = merged.mapInArrow(_merge(base), f"tree string, place long, id {kind}, hash string, changed string, n long, steps array<string>, subroot string")
        if s:
            out = stored(out, "ways")
    return out


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = batch.column("steps").to_pylist()
        leaves = zip(batch.column("hash").to_pylist(), batch.column("changed").to_pylist(), strict=True)
        proofs = [digest("".join(step[1:] for step in way)) for way in steps]
        folded = [fold(leaf if changed is None else changed, way) for (leaf, changed), way in zip(leaves, steps, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), batch.column("subroot"), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["id", "leaf", "subroot", "proof_sha256", "folded_root"])


class Manifest(NamedTuple):
    """store: the trees' nodes; root: the hash over all, None for an empty table; ways(tree, place, id, hash, changed, n, steps, subroot): every leaf's way to the root."""

    store: Store
    root: str | None
    ways: DataFrame


def manifest(df: DataFrame, fields: list[str], tree: str, id_col: str, changes: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of df's rows, with a tree for each value of a column."""
    store = build(leaf_rows(df, fields, tree, id_col, changes, where))
    over = build(store.tops.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "hash", F.lit(None).cast("string").alias("changed")))
    root = over.tops.first()
    above = paths(over, over.tops.select("tree", F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot")))
    above = stored(above.select(F.col("id").alias("tree"), "steps", F.col("hash").alias("subroot")), "above")
    return Manifest(store, root.hash if root else None, paths(store, above))


def verify(df: DataFrame, fields: list[str], tree: str, id_col: str, changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; for rows `where`, the leaf with `changes` is folded."""
    with scratch(df.sparkSession) as keep:
        made = manifest(df, fields, tree, id_col, changes, where)
        kind = df.schema[id_col].dataType.simpleString()
        proved = made.ways.select("id", "hash", "changed", "steps", "subroot").mapInArrow(_prove, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
        keep.append(stored(proved.withColumn("root", F.lit(made.root).cast("string")), "proofs"))
        return keep[0].withColumn("verified", F.col("folded_root") == F.col("root"))
