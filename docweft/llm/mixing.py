"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Every text is cut into blocks of BLOCK_WORDS words. A source's blocks have a permuted order, that of a seeded hash; its
draws go through that order as often as its target asks: whole passes, then the blocks whose words come nearest to what
is left. So each source has an exact quota of block draws. A binary tree splits the vector of quotas among output shards,
each node by a multivariate hypergeometric draw of its part of the blocks; the leaves are the shards' exact source
quotas. Shard after shard takes the next blocks of each source's draws, as many as its leaf says; so the leaves alone
decide which blocks are drawn, how often and where to. Within a shard, draws are shuffled by a second hash.

Texts never shuffle to be chosen: the places where shards begin and end (SHARDS for each source) are found as hash keys
from a histogram and one look into the histogram's buckets around them; a block then knows by its own key which shards
draw it. Only `mixed` and `draws`, which write the shards, move texts to them, once. What the driver holds is a few
numbers a source and shard; more than MOST_SOURCES sources are an error.

Defined results: a null text has size 0 and no block. A null source is a source, the last in order. Sources without
words get target 0. Rows that repeat id and text have equal keys: their blocks tie and are drawn by the same shards.
Empty tables give empty results. Extra columns are ignored by `report` and kept by `mixed`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_WHITE, WHITE, stored, text_of

WEIGHTS, MOST, BLOCK_WORDS, SHARDS, SEED = (5, 2, 1), 3, 128, 16, 11
#: The key histogram's buckets are a key's top bits: a source has its part of 2^17 buckets by its size, 2^12 at most and one at least; so the driver holds 2^17 counts and one a source at most.
BUCKET_BITS, COUNT_BITS = 12, 17
#: Bits of a key; a draw's place is its pass times 2^KEY_BITS plus its key.
KEY_BITS = 60
#: Sources that the driver plans for at most, and sources whose plan is broadcast (under 500 bytes each).
MOST_SOURCES, BROADCAST_SOURCES = 1_000_000, 20_000


def words(column: str) -> Column:
    """Number of maximal runs of what is not white space."""
    dots = F.regexp_replace(text_of(column), NOT_WHITE + "+", ".")
    return F.length(F.translate(dots, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Shares of the whole size by cycling weights over the sources in order; none above `most` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, cycle(weights)))
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), [*order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def split(quotas: np.ndarray, shards: int, seed: int = SEED, node: int = 1) -> np.ndarray:
    """The shards' source quotas, one row a shard: the tree below `node` over exact quotas."""
    if shards == 1:
        return quotas[None]
    left_shards = shards // 2
    rng = np.random.default_rng([seed, node])
    take = int(quotas.sum()) * left_shards // shards
    left = np.zeros_like(quotas)
    rest, need = int(quotas.sum()), take
    for i, q in enumerate(quotas.tolist()):  # a multivariate draw as a chain of hypergeometric ones
        rest -= q
        left[i] = _hypergeometric(rng, q, rest, need)
        need -= int(left[i])
    return np.concatenate([split(left, left_shards, seed, 2 * node), split(quotas - left, shards - left_shards, seed, 2 * node + 1)])


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """Up to numpy's limit of a billion by numpy; beyond it by inversion of the same distribution, around its mode and out to where it vanishes."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    part = good / total
    reach = int(12 * (draws * part * (1 - part) * (total - draws) / (total - 1)) ** 0.5) + 50
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=float)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.r_[0.0, steps.cumsum()]
    weight = np.exp(weight - weight.max()).cumsum()
    return max(low, mode - reach) + int(np.searchsorted(weight, rng.random() * weight[-1]))


@dataclass
class Plan:
    """What a block needs to know: the places of the last draws of the shards in its source; and how they came about."""

    sizes: dict
    targets: dict
    ends: dict
    quotas: np.ndarray
    sources: list


def block_key(doc_key: Column, block: Column, seed: int = SEED) -> Column:
    """A block's place in its source's permuted order, from 0 to 2^KEY_BITS."""
    return F.shiftrightunsigned(F.xxhash64(doc_key, block, F.lit(seed)), 64 - KEY_BITS)


def narrow(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc, source, size and the document's key, written once so that the texts are read once."""
    return stored(df.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), doc_key(id_col, text_col).alias("key")), "sizes")


def doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), text_of(text_col))


def bucket_bits(sizes: dict) -> dict:
    """The bits of the sources that have any: such a source has over 2^-COUNT_BITS of all words, so there are fewer than 2^COUNT_BITS of them."""
    total = max(1, sum(sizes.values()))
    bits = {s: min(BUCKET_BITS, ((n << COUNT_BITS) // total).bit_length() - 1) for s, n in sizes.items()}
    return {s: b for s, b in bits.items() if b > 0}


def plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, weights=WEIGHTS, most: int = MOST) -> Plan:
    """Quotas, cuts and borders for narrow() rows."""
    sizes = {r[0]: r[1] or 0 for r in docs.groupBy("source").agg(F.sum("size")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets(sizes, weights, most)
    bits = bucket_bits(sizes)
    n_blocks = F.ceil(F.col("size") / BLOCK_WORDS).cast("int")
    blocks = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    blocks = blocks.select("source", block_key(F.col("key"), F.col("block"), seed).alias("k"), F.least(F.lit(BLOCK_WORDS), F.col("size") - F.col("block") * BLOCK_WORDS).alias("words"))
    by_source = F.broadcast(docs.sparkSession.createDataFrame([*bits.items()], "b_source string, bits int"))
    blocks = blocks.join(by_source, F.col("source").eqNullSafe(F.col("b_source")), "left")
    blocks = blocks.select("source", "k", "words", F.expr(f"shiftright(k, {KEY_BITS} - coalesce(bits, 0))").cast("int").alias("bucket"))
    hist: dict = {}
    for r in blocks.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("words")).toLocalIterator():
        hist.setdefault(r.source, []).append((r.bucket, r.n, r.words))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    passes = {s: min(most, int(goal[s] // sizes[s])) if sizes[s] else 0 for s in sources}
    table = {}
    for s in sources:
        rows = np.array(sorted(hist.get(s, ())), np.int64).reshape(-1, 3)
        table[s] = rows[:, 0], np.r_[0, rows[:, 1].cumsum()], np.r_[0, rows[:, 2].cumsum()]

    def looked_up(wanted: dict) -> dict:
        """The blocks of whole (source, bucket) pairs, in order; each bucket holds a small part of its source."""
        pairs = [(s, int(b)) for s, bs in wanted.items() for b in sorted(set(bs))]
        if not pairs:
            return {}
        want = docs.sparkSession.createDataFrame(pairs, "w_source string, w_bucket int")
        rows = blocks.join(F.broadcast(want), F.col("source").eqNullSafe(F.col("w_source")) & (F.col("bucket") == F.col("w_bucket")))
        w = W.partitionBy("source", "bucket").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
        rows = stored(rows.select("source", "bucket", "k", F.count("*").over(w).alias("n"), F.sum("words").over(w).alias("words")), "places")
        return rows

    # The quotas: whole passes, and of the last one the blocks whose words are nearest to what is left of the target.
    rest = {s: goal[s] - passes[s] * sizes[s] for s in sources}
    where = {s: [table[s][0][min(len(table[s][0]) - 1, int(np.searchsorted(table[s][2][1:], rest[s])))]] for s in sources if len(table[s][0]) and rest[s] > 0}
    quota = {s: passes[s] * int(table[s][1][-1]) for s in sources}
    places = looked_up(where)
    if where:
        offsets = docs.sparkSession.createDataFrame([(s, float(rest[s]) - int(table[s][2][i]), int(table[s][1][i]), int(b)) for s, [b] in where.items() for i in [int(np.searchsorted(table[s][0], b))]], "o_source string, need double, before long, o_bucket int")
        near = places.join(F.broadcast(offsets), F.col("source").eqNullSafe(F.col("o_source")))
        best = near.groupBy("source", "need", "before").agg(F.min_by(F.struct("n", "words"), F.struct(F.abs(F.col("words") - F.col("need")), F.col("k"))).alias("x"))
        for r in best.collect():
            nearer_without = r.need <= r.x.words - r.need and r.x.n == 1  # without the bucket's first block
            quota[r.source] += r.before + (0 if nearer_without else r.x.n)
    quotas = split(np.array([quota[s] for s in sources], np.int64), shards, seed) if sources else np.zeros((shards, 0), np.int64)
    # Where each shard ends in its source's draws, by the leaves: draw d is the block of rank d mod n in pass d div n.
    ends: dict = {s: [] for s in sources}
    wanted: dict = {}
    for j, s in enumerate(sources):
        n = int(table[s][1][-1])
        for d in quotas[:, j].cumsum().tolist() if n else [0] * shards:
            p, rank = divmod(d, n) if n else (0, 0)
            if rank:
                i = int(np.searchsorted(table[s][1][1:], rank))
                wanted.setdefault(s, []).append(int(table[s][0][i]))
                ends[s].append((p, rank - int(table[s][1][i]), int(table[s][0][i])))
            else:
                ends[s].append((p, None, -1))
    places = looked_up(wanted)
    key = {}
    if wanted:
        need = sorted({(s, b, n) for s, x in ends.items() for _, n, b in x if n is not None}, key=str)
        ask = docs.sparkSession.createDataFrame(need, "a_source string, a_bucket int, a_n long")
        hits = places.join(F.broadcast(ask), F.col("source").eqNullSafe(F.col("a_source")) & (F.col("bucket") == F.col("a_bucket")) & (F.col("n") == F.col("a_n")))
        key = {(r.source, r.bucket, r.n): r.k for r in hits.collect()}
    return Plan(sizes, goal, {s: [(p << KEY_BITS) + (-1 if n is None else key[s, b, n]) for p, n, b in x] for s, x in ends.items()}, quotas, sources)


def plan_table(df: DataFrame, p: Plan) -> DataFrame:
    """The plan by source, one row each (p_source, p_size, p_target, p_ends): as many rows as sources."""
    rows = [(s, p.sizes[s], p.targets[s], p.ends[s]) for s in p.sources]
    return df.sparkSession.createDataFrame(rows, "p_source string, p_size long, p_target double, p_ends array<long>")


def _with_draws(df: DataFrame, p: Plan, seed: int) -> DataFrame:
    """Joins the plan to rows with source, size and key, and adds `drawn`: (shard, pass, block, words) of each draw of the text's blocks, by block and pass.

    The plan of the BROADCAST_SOURCES largest sources is broadcast, so their rows stay where they are; of more sources the
    others, none of which has more than a part in so many, are joined as a table.
    """
    t = plan_table(df, p)
    same = F.col("source").eqNullSafe(F.col("p_source"))
    if len(p.sources) <= BROADCAST_SOURCES:
        rows = df.join(F.broadcast(t), same, "left")
    else:
        least = sorted(p.sizes.values(), reverse=True)[BROADCAST_SOURCES - 1]
        hot = F.broadcast(t.where(F.col("p_size") > least))
        rest = df.join(hot.select("p_source"), same, "left_anti")
        rows = df.join(hot, same).unionByName(rest.join(t.where(F.col("p_size") <= least), same, "left"))
    n = F.ceil(F.col("size") / BLOCK_WORDS).cast("int")
    last_pass = F.greatest(F.shiftright(F.element_at("p_ends", -1), KEY_BITS), F.lit(0).cast("long"))  # -1 where a source gives nothing

    def draw(block: Column, at: Column) -> Column:
        """As many shards have ended before a draw as is the number of the shard that draws."""
        place = F.shiftleft(at, KEY_BITS) + block_key(F.col("key"), block, seed)
        ended = F.filter("p_ends", lambda end: end < place)
        words_of = F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("size") - block * BLOCK_WORDS)
        return F.struct(F.size(ended).alias("shard"), at.cast("int").alias("pass"), block.alias("block"), words_of.alias("words"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.transform(F.sequence(F.lit(0).cast("long"), last_pass), lambda at: draw(b, at))))
    drawn = F.filter(every, lambda d: d["shard"] < len(p.quotas))
    none = F.array().cast("array<struct<shard:int,pass:int,block:int,words:bigint>>")
    return rows.withColumn("drawn", F.when(F.col("size") > 0, drawn).otherwise(none)).drop("p_source")


def report(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc, size, source_size, target, taken (words that the mix takes, repeats counted) and shards (where to, as shard:words comma-joined) of every document."""
    docs = narrow(df, id_col, source_col, text_col)
    p = plan(docs, seed=seed)
    rows = _with_draws(docs, p, seed)
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, d: a + d["words"])
    to = F.array_sort(F.array_distinct(F.transform("drawn", lambda d: d["shard"])))
    each = F.transform(to, lambda j: F.struct(j.alias("shard"), total(F.filter("drawn", lambda d: d["shard"] == j)).alias("words")))
    rows = rows.withColumn("each", each)
    named = F.array_join(F.transform("each", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return rows.select("doc", "size", F.col("p_size").alias("source_size"), F.col("p_target").alias("target"), total(F.col("each")).alias("taken"), named.alias("shards"))


def _place(df: DataFrame, shards: int) -> DataFrame:
    """Rows moved to their shards: partitions hold shard after shard, each sorted by place (0 to 2^63)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.floor((F.col("shard") + F.col("place") / 2.0**63) * parts / shards).cast("int")
    return df.withColumn("task", F.least(task, F.lit(parts - 1))).repartitionById(parts, "task").drop("task").sortWithinPartitions("shard", "place")


def _pieces(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> tuple[DataFrame, int]:
    """row (df's columns), size, key, drawn, and the text's blocks; the number of shards."""
    p = plan(narrow(df, id_col, source_col, text_col), seed=seed)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), doc_key(id_col, text_col).alias("key"))
    text = F.col("row")[text_col].cast("string")
    parts = F.when(F.col("size") <= BLOCK_WORDS, F.array(text)).otherwise(block_texts(text))
    return _with_draws(rows, p, seed).withColumn("parts", parts), len(p.quotas)


def draws(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix block by block: shard, place, doc, pass, block and the block's text, shard after shard, each shuffled locally (the place is a hash of the draw)."""
    rows, shards = _pieces(df, id_col, source_col, text_col, seed)
    rows = rows.select("key", F.col("row")[id_col].alias("doc"), "parts", F.explode("drawn").alias("d"))
    place = F.shiftrightunsigned(F.xxhash64("key", "d.block", "d.pass", F.lit(seed + 1)), 1)
    out = rows.select("d.shard", place.alias("place"), "doc", "d.pass", "d.block", F.col("parts")[F.col("d.block")].alias("text"))
    return _place(out, shards)


def block_texts(text: str | Column) -> Column:
    """A text cut into its blocks, white space kept with the word before (at the start: with the first)."""
    text = text_of(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(text, F.lit(rf"(?:\A{WHITE}+)?(?:{NOT_WHITE}++{WHITE}*+){{1,{BLOCK_WORDS}}}"), F.lit(0))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed documents with df's columns: for each shard and pass that draws blocks of a document, a row with these blocks in text order.

    A shard that draws all blocks of a text has the text as it is. Shards follow each other, each shuffled locally. A text
    without words has no block: it stays once, in a shard by its hash, if its source has a whole pass or no words at all.
    """
    rows, shards = _pieces(df, id_col, source_col, text_col, seed)
    blocks = F.ceil(F.col("size") / BLOCK_WORDS).cast("int")
    to = F.array_distinct(F.transform("drawn", lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"))))
    kept = F.coalesce((F.element_at("p_ends", -1) >= (1 << KEY_BITS) - 1) | (F.col("p_size") == 0), F.lit(True))
    own_shard = F.array(F.struct(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("pass")))
    to = F.when(F.col("size") > 0, to).when(kept, own_shard).otherwise(F.array().cast("array<struct<shard:int,pass:int>>"))
    rows = rows.select("row", "key", "drawn", "parts", blocks.alias("blocks"), F.explode(to).alias("to"))
    mine = F.filter("drawn", lambda d: (d["shard"] == F.col("to.shard")) & (d["pass"] == F.col("to.pass")))
    text = F.when(F.size(mine) == F.col("blocks"), F.col("row")[text_col]).otherwise(F.array_join(F.transform(mine, lambda d: F.col("parts")[d["block"]]), ""))
    place = F.shiftrightunsigned(F.xxhash64("key", "to", F.lit(seed + 1)), 1)
    out = rows.select("row", text.alias("text"), F.col("to.shard").alias("shard"), place.alias("place"))
    out = _place(out, shards)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))
