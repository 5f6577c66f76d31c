"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.session import scratch
from docweft.session import written as stored

#: Space and the ASCII control white space, as the contracts name them.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def text_of(column: str) -> Column:
    """A text column, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def with_hot_keys(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """rows left-joined with facts (one row a key), where some keys may have a large part of the rows.

    counts(key, n) are the rows of each key, total their sum. Keys of over a thousandth of all rows number a thousand at
    most: bounded, so their facts are broadcast and their rows stay where they are; the others are joined as tables.
    """
    hot = counts.where(F.col("n") * 1000 > total).select(key)
    of_hot = F.broadcast(hot.join(facts, key, "left"))
    return rows.join(of_hot, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), as (id, comp): comp is the smallest id that links reach.

    Contracts the graph round by round: every component of the last round hooks on its smallest neighbour, chains are
    shortened by pointer jumping, and only edges between different components stay. Minima are combined before the
    shuffle and joins on hot ids are plain equi-joins, which adaptive execution splits; rounds are logarithmic.
    Empty edges give an empty table; loops give single-node components; null ends are ignored.
    """
    with scratch(edges.sparkSession) as keep:
        keep.append(_components(edges))
        return keep[0]


def _components(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    nodes = stored(edges.select(F.explode(F.array("a", "b")).alias("id"), F.least("a", "b").alias("low")).groupBy("id").agg(F.min("low").alias("low")), "nodes")
    own = nodes.select("id", F.col("low").alias("comp"))
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    parent = own
    while True:
        parent = _jumped(parent)
        to = parent.select(F.col("id").alias("hi"), F.col("comp").alias("hi_comp"))
        fro = parent.select(F.col("id").alias("lo"), F.col("comp").alias("lo_comp"))
        both = edges.join(to, "hi", "left").join(fro, "lo", "left").select(F.coalesce("hi_comp", "hi").alias("x"), F.coalesce("lo_comp", "lo").alias("y")).where("x <> y")
        edges = stored(both.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        own = stored(own.join(parent.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "own")
        if edges.isEmpty():
            return own
        parent = edges.groupBy("hi").agg(F.min("lo").alias("comp")).select(F.col("hi").alias("id"), "comp")


def _jumped(parent: DataFrame) -> DataFrame:
    """Follows parent(id, comp) to its roots; comp never exceeds id, so chains end."""
    parent = stored(parent, "parent")
    while True:
        up = parent.select(F.col("id").alias("comp"), F.col("comp").alias("up")).where("comp <> up")
        moved = stored(parent.join(up, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"), F.col("up").isNotNull().alias("moved")), "moved")
        parent = moved.select("id", "comp")
        if moved.where("moved").isEmpty():
            return parent


def spread_over_tasks(work: DataFrame, group: str, place: Column, keys: list[str], parts: int) -> DataFrame:
    """Deals work items out to `parts` tasks, sorted by keys: a group's items go to tasks one after the other, by their place."""
    task = F.pmod(F.xxhash64(group, F.lit(31)) + place, F.lit(parts)).cast("int")
    return work.withColumn("_task", task).repartitionById(parts, "_task").drop("_task").sortWithinPartitions(*keys)


def _other_blocks(own: Column, others: Column) -> dict[str, Column]:
    """The pair of blocks (a <= b) as columns, and its number in the group."""
    a, b = F.least(own, others), F.greatest(own, others)
    return {"a": a, "b": b, "place": (b.cast("long") * (b + 1) / 2).cast("long") + a}


def block_pairs(members: DataFrame, sizes: DataFrame, group: str, member: str, rows: int = 256) -> DataFrame:
    """Deals the members of every group out so that each two of them meet in exactly one task of bounded size.

    A group of at most `rows` members is one block. A larger one is cut by a hash of the member into blocks of about
    that many; each pair of blocks becomes its own key (group, a, b) with a <= b, and a member goes to every key that has
    its block. Adds the columns a, b, own (the member's block) and place (the pair's number in its group, for
    spread_over_tasks). sizes(group, n) gives the group sizes.
    """
    m = members.join(sizes.select(group, F.ceil(F.col("n") / rows).cast("int").alias("_blocks")), group)
    m = m.withColumn("own", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_blocks")).cast("int"))
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return m.withColumns(_other_blocks(F.col("own"), F.col("_other"))).drop("_blocks", "_other")


#: Members of a large bucket that meet all others of it in the first round of bucket_links.
PIVOTS = 32

#: Links among the groups of a table sorted by group, as row numbers: f(values, own, a, b, offsets) -> (i, j). Rows of a
#: group with a == b are all compared with each other, else those of block a with those of block b.
Linker = Callable[[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _linked(linker: Linker, rows: int):
    """Rows of (bucket, a, b, own, id, value) sorted by (bucket, a, b, id): edges from members to the smallest one that they reach in the task's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in by_key(batches, ["bucket", "a", "b"], 4 * rows):
            ids, own, a, b = (table.column(c).to_numpy() for c in ("id", "own", "a", "b"))
            i, j = linker(table.column("value"), own, a, b, at)
            x, y = ids, ids[roots(len(ids), i, j)]
            yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], ["a", "b"])
        give_back()

    return run


def bucket_links(buckets: DataFrame, values: DataFrame, linker: Linker, rows: int) -> DataFrame:
    """edges(a, b) that connect, within every bucket, exactly the members that its verified links connect.

    buckets(bucket, id) has distinct memberships, values(id, value) what the linker compares. A bucket of at most `rows`
    members is one work item. A larger one is never joined as a whole unseen. Round 1 compares its members within blocks
    of that size, to each of which about PIVOTS of its members go besides: that connects groups of many near copies at a
    cost in proportion to their number. Round 2 compares all pairs of blocks that round 1 leaves open: in each bucket the
    members outside its largest connected group with each other and with that group's, every two in one work item of
    bounded size. So a bucket of near copies costs little, and one of unlike members the comparison of all its pairs.
    """
    spark = buckets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "a", "b", "id"]
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = stored(buckets.join(sizes, "bucket"), "dealt")
    k = F.ceil(F.col("n") / rows).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(17)), k).cast("int")
    pivot = (k > 1) & (F.pmod(F.xxhash64("id", F.lit(23)), F.col("n")) < PIVOTS)
    first = dealt.select("bucket", "id", F.explode(F.when(pivot, F.sequence(F.lit(0), k - 1)).otherwise(F.array(mine))).alias("a"))
    first = first.withColumns({"b": F.col("a"), "own": F.col("a")}).join(values, "id")
    edges = stored(spread_over_tasks(first, "bucket", F.col("a"), keys, parts).mapInArrow(_linked(linker, rows), "a long, b long").distinct(), "near")
    large = dealt.where(F.col("n") > rows)
    if large.isEmpty():
        return edges
    comps = components(edges)
    large = stored(large.join(comps, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp")), "large")
    top = large.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("n"))
    top = top.where("n > m").select("bucket", "top", F.ceil(F.col("m") / rows).cast("int").alias("_tops"), F.ceil((F.col("n") - F.col("m")) / rows).cast("int").alias("_rest"))
    left = large.join(top, "bucket")
    h, of_top = F.xxhash64("id", F.lit(17)), F.col("comp") == F.col("top")
    left = left.withColumn("own", F.when(of_top, F.pmod(h, F.col("_tops"))).otherwise(F.col("_tops") + F.pmod(h, F.col("_rest"))).cast("int"))
    others = F.sequence(F.when(of_top, F.col("_tops")).otherwise(F.lit(0)), F.col("_tops") + F.col("_rest") - 1)
    left = left.select("bucket", "id", "own", F.explode(others).alias("_other"))
    left = left.withColumns(_other_blocks(F.col("own"), F.col("_other"))).drop("_other").join(values, "id")
    more = spread_over_tasks(left, "bucket", F.col("place"), keys, parts).mapInArrow(_linked(linker, rows), "a long, b long")
    return stored(edges.unionByName(more.distinct()), "near")


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys, tables of whole groups, with the offsets at which their groups start and end.

    A table has at least `rows` rows but for the last, and at most those and the rows of one group and one batch more.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            at = cut(table)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
                table = table.slice(at[-2])
            held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For links x-y among 0..n-1, the smallest index that each reaches."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        if (low == label[x]).all() and (low == label[y]).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    return label


def give_back() -> None:
    """At the end of a task, or of work in the driver: returns freed memory to the system, as Python workers and the driver stay for later work of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
