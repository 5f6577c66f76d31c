"""Set similarity of papers over shared concepts, always by equi-joins on what they share.

A concept that very many papers have (or a paper with very many concepts) is cut into blocks, and each two blocks are a
key of their own (`pairs_within`): no task gets a whole hot group. Pairs themselves are the result, so their number is
what it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import discard, written


#: Members of a group that meet under one key; larger groups are cut into blocks of about so many.
BLOCK = 1024
#: Rows of concepts, or of hashes of two, that are broadcast (some 64 MB); more are joined by merging.
HELD = 1_500_000
#: Concepts of a wide paper that go into one row.
SEGMENT = 1000


def pairs_within(rows: DataFrame, group: list[str], member: str, carried: list[str] = (), block: int = BLOCK) -> DataFrame:
    """Every two rows of a group with a < b: columns of group, a and b (the members), and carried ones as name_a and name_b.

    A group of n rows has k = ceil(n / block) blocks by a hash of the member. The first of a pair goes to all keys
    (own block, j), the second to all keys (i, own block): they meet under exactly one of k x k keys.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_k")).where("_k > 1")
    own = F.pmod(F.xxhash64(member), F.coalesce("_k", F.lit(1))).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))
    rows = rows.join(sizes, group, "left")
    side = lambda x, i, j: rows.select(*group, F.col(member).alias(x), *(F.col(c).alias(f"{c}_{x}") for c in carried), i.alias("_i"), j.alias("_j"))
    return side("a", own, all_).join(side("b", all_, own), [*group, "_i", "_j"]).where("a < b").drop("_i", "_j")


def frequencies(pairs: DataFrame, n_papers: DataFrame | None = None) -> DataFrame:
    """(concept, df, idf) of distinct (paper, concept): idf = 1 + ln((1 + papers) / (1 + df))."""
    rows = pairs.select("paper", "concept").distinct()
    total = n_papers if n_papers is not None else rows.agg(F.count_distinct("paper").alias("n"))
    df = rows.groupBy("concept").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("concept", "df", (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("idf"))


def paper_similarity(pairs: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, idf_jaccard, weight) of papers that share a concept; weight is the mean of both, to six places.

    Each side's totals come from one aggregation; a union's weight is the sides' sum less what they share, so only
    shared concepts are joined.
    """
    rows = pairs.select("paper", "concept").distinct().join(frequencies(pairs), "concept")
    own = rows.groupBy("paper").agg(F.count("*").alias("n"), F.sum("idf").alias("w"))
    rows = rows.join(own, "paper")
    # A side's totals depend on the side alone: they ride along instead of being joined to every pair.
    ride = [F.max(c).alias(c) for c in ("n_a", "n_b", "w_a", "w_b")]
    both = pairs_within(rows, ["concept"], "paper", ["idf", "n", "w"]).groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("idf_a").alias("common"), *ride)
    plain = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    weighted = F.col("common") / (F.col("w_a") + F.col("w_b") - F.col("common"))
    return both.select("a", "b", "shared", plain.alias("jaccard"), weighted.alias("idf_jaccard"), F.round((plain + weighted) / 2, 6).alias("weight"))


def _held(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= HELD else rows.hint("merge")


def _weight(shared: Column, common: Column, n: Column, w: Column) -> Column:
    """The weight of two papers by what they share, and their concepts and idf summed."""
    return (shared / (n - shared) + common / (w - common)) / 2


def partners(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, partners, shared, weight): `paper_similarity` by a, with its pairs, the sum of what they share and the largest weight; pairs are not shuffled.

    Each concept's papers are gathered in blocks, and what leaves the task is one row a paper: the pairs, and the best
    weight as if they shared that concept alone. It is never above a pair's own weight, so only pairs that share several
    concepts meet once more: under each two concepts that several papers have, or, if one of the papers has more pairs of
    concepts than there are papers beside it (it is wide), under each concept.
    """
    # Dealt by paper first: two lines of a paper are rarely equal, so tasks would only fill their memory with what to drop.
    rows = pairs.select("paper", "concept").repartition("paper").distinct()
    total = pairs.agg(F.count_distinct("paper").alias("n"))
    df = rows.groupBy("concept").agg(F.count("*").alias("df")).join(F.broadcast(total))
    df = written(df.select("concept", "df", (1 + F.log((1 + F.col("n")) / (1 + F.col("df")))).alias("idf")), "df")
    rows = rows.join(_held(df), "concept").where("paper is not null")
    own = W.partitionBy("paper")
    rows = rows.withColumns({"n": F.count("*").over(own), "w": F.sum("idf").over(own), "wide": F.sum(F.col("df") - 1).over(own)})
    rows = rows.withColumn("wide", F.col("n") * (F.col("n") - 1) / 2 > F.col("wide"))
    segment = F.when(F.col("wide"), F.pmod(F.xxhash64("concept"), F.ceil(F.col("n") / SEGMENT))).otherwise(0)
    rows = rows.withColumn("segment", segment).groupBy("paper", "n", "w", "wide", "segment")
    sets = written(rows.agg(F.sort_array(F.collect_list(F.struct("concept", "df", "idf"))).alias("items")), "sets")
    discard(df)
    each = sets.select("paper", "n", "w", "wide", F.explode("items").alias("i")).select("paper", "n", "w", "wide", "i.*")
    most = each.agg(F.max("df").alias("df"), F.max("wide").alias("wide")).first()

    blocks = each.withColumn("k", F.ceil(F.col("df") / block)).withColumn("at", F.pmod(F.xxhash64("paper"), F.col("k")))
    blocks = blocks.repartition("concept", "at").groupBy("concept", "idf", "k", "at").agg(F.collect_list(F.struct("paper", "n", "w")).alias("m"))
    meet = lambda rows, xs, ys: rows.select("idf", ys, F.explode(xs).alias("x")).select("idf", "x", F.explode(ys).alias("y"))
    alone = _weight(F.lit(1), F.col("idf"), F.col("x.n") + F.col("y.n"), F.col("x.w") + F.col("y.w"))
    count = [F.count("*").alias("shared"), F.max(alone).alias("weight")]
    out = meet(blocks.withColumn("others", F.col("m")), "m", "others").where("x.paper < y.paper").groupBy(F.col("x.paper").alias("a")).agg(*count)
    if most.df and most.df > block:
        hot = blocks.where("k > 1")
        later = hot.where("at + 1 < k").select("concept", "idf", F.col("m").alias("xs"), F.explode(F.sequence(F.col("at") + 1, F.col("k") - 1)).alias("at"))
        across = meet(later.join(hot.select("concept", "at", F.col("m").alias("ys")), ["concept", "at"]), "xs", "ys")
        across = across.groupBy(F.least("x.paper", "y.paper").alias("a")).agg(*count)
        out = out.unionByName(across).groupBy("a").agg(F.sum("shared").alias("shared"), F.max("weight").alias("weight"))

    # Of papers that share t concepts, t (t - 1) / 2 pairs of concepts meet, and each concept is in t - 1 of them.
    two = sets.where("not wide").select("paper", "n", "w", "items", F.posexplode("items").alias("p", "u")).select("paper", "n", "w", "u", F.explode(F.slice("items", F.col("p") + 2, F.size("items"))).alias("v"))
    two = two.withColumn("key", F.xxhash64("u.concept", "v.concept"))
    keys = written(two.select("key").repartition("key").groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "keys")
    two = written(two.join(_held(keys), "key", "left_semi").select("paper", "n", "w", F.col("u.concept").alias("c"), F.col("v.concept").alias("d"), (F.col("u.idf") + F.col("v.idf")).alias("idf")), "two")
    discard(keys)
    ride = [F.max(F.col(f"{c}_a") + F.col(f"{c}_b")).alias(c) for c in ("n", "w")]
    several = pairs_within(two, ["c", "d"], "paper", ["n", "w", "idf"], block).groupBy("a", "b").agg(F.count("*").alias("t"), F.sum("idf_a").alias("common"), *ride)
    several = several.withColumn("t", F.round((1 + F.sqrt(1 + 8 * F.col("t"))) / 2).cast("long")).withColumn("common", F.col("common") / (F.col("t") - 1))
    if most.wide:
        x, y = (each.select("concept", "idf", F.struct("paper", "n", "w", "wide").alias(side)) for side in "xy")
        by_wide = x.where("x.wide").join(y.drop("idf"), "concept").where("x.paper <> y.paper and (x.paper < y.paper or not y.wide)")
        by_wide = by_wide.groupBy(F.least("x.paper", "y.paper").alias("a"), F.greatest("x.paper", "y.paper").alias("b"))
        ride = [F.max(F.col(f"x.{c}") + F.col(f"y.{c}")).alias(c) for c in ("n", "w")]
        several = several.unionByName(by_wide.agg(F.count("*").alias("t"), F.sum("idf").alias("common"), *ride).where("t > 1"))
    again = several.groupBy("a").agg(F.sum(F.col("t") - 1).alias("_again"), F.max(_weight(F.col("t"), F.col("common"), F.col("n"), F.col("w"))).alias("_more"))
    out = out.join(again, "a", "left")
    return out.select("a", (F.col("shared") - F.coalesce("_again", F.lit(0))).alias("partners"), "shared", F.round(F.greatest("weight", "_more"), 6).alias("weight"))


def shared_principles(pairs: DataFrame) -> DataFrame:
    """(a, b, weight 1) of papers that share a principle."""
    rows = pairs.select("paper", "concept").distinct()
    return pairs_within(rows, ["concept"], "paper").select("a", "b").distinct().withColumn("weight", F.lit(1.0))


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """(a, b, papers, weight) of concepts in the same papers; weight is the part of all papers."""
    rows = pairs.select("paper", "concept").distinct()
    total = rows.agg(F.greatest(F.count_distinct("paper"), F.lit(1)).alias("n"))
    both = pairs_within(rows, ["paper"], "concept")
    return both.groupBy("a", "b").agg(F.count("*").alias("papers")).join(F.broadcast(total)).select("a", "b", "papers", (F.col("papers") / F.col("n")).alias("weight"))


def review_candidates(sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of sets(paper, s0, s1, s2) that can have a Jaccard of `least` in one of the three: a prefix filter.

    Of n elements the n - ceil(least n) + 1 rarest are the prefix; two sets as alike as that share one of them, and
    neither is larger than the other over `least`. So an element that all reviews have pairs none but small sets.
    """
    parts = [sets.select("paper", F.lit(i).alias("part"), F.size(F.array_compact(f"s{i}")).alias("n"), F.explode(F.array_compact(f"s{i}")).alias("item")) for i in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = rows.groupBy("part", "item").agg(F.count("*").alias("df"))
    order = F.row_number().over(W.partitionBy("paper", "part").orderBy("df", "item"))
    prefix = rows.join(counts, ["part", "item"]).withColumn("k", order).where(F.col("k") <= F.col("n") - F.ceil(least * F.col("n")) + 1)
    met = pairs_within(prefix.select("part", "item", "paper", "n"), ["part", "item"], "paper", ["n"])
    return met.where((F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))).select("a", "b").distinct()


def review_similarity(reviews: DataFrame, least: float = 0.25) -> DataFrame:
    """(a, b, score): mean Jaccard of problem words, method words and key concepts of reviews(paper, core_problem, method_summary, key_concepts).

    The mean reaches `least` only if one of the three does; only such candidates are compared.
    """
    sets = reviews.select("paper", tx.token_set(F.col("core_problem")).alias("s0"), tx.token_set(F.col("method_summary")).alias("s1"), F.array_distinct("key_concepts").alias("s2"))
    near = review_candidates(sets, least - 1e-6)  # scores are rounded to six places
    side = lambda x: sets.select(F.col("paper").alias(x), *(F.col(f"s{i}").alias(f"{x}{i}") for i in range(3)))
    both = near.join(side("a"), "a").join(side("b"), "b")
    jaccard = []
    for i in range(3):
        shared = F.size(F.array_intersect(F.array_compact(f"a{i}"), F.array_compact(f"b{i}")))
        jaccard.append(F.when(shared > 0, shared / (F.size(f"a{i}") + F.size(f"b{i}") - shared)).otherwise(0.0))
    return both.select("a", "b", F.round((jaccard[0] + jaccard[1] + jaccard[2]) / 3, 6).alias("score")).where(F.col("score") >= least)
