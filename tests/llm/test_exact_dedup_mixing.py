"""Exact dedup and mixing against brute force and on odd inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import exact_dedup, mixing

ODD = [(1, "a  b", "x"), (2, "a\tb", "y"), (3, None, "x"), (4, "", None), (5, " a b", "x"), (6, "only", "y"), (6, "only", "y"), (None, "a b", "x"), (None, "lone", None), (7, "w " * 70_000, "z"), (8, "w\n" * 70_000, "z")]
SCHEMA = "doc_id long, text string, source string"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 16, exact_dedup.MAX_BITS])
def test_assign(spark, limit):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"keep": F.lit(1), "sha": F.lit("s")}).repartition(5)
    assert sorted(map(tuple, exact_dedup.assign(df, limit=limit).collect()), key=str) == brute(ODD)


def test_parts_of_the_hash_space(spark):
    """A third of the rows are one text; one filter is far too small, so the rows are taken in parts, and only repeated rows are grouped."""
    rows = [(i, "copy" if i % 3 == 0 else f"text {i // 2 if i < 900 else i}", "s") for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert sorted(map(tuple, exact_dedup.assign(df, limit=1 << 16).collect()), key=str) == brute(rows)
    flagged, n, _ = exact_dedup._flagged(df, "doc_id", "text", 1 << 16)
    repeated = sum(r[2] > 1 for r in brute(rows))
    assert n == len(rows) and repeated <= flagged.where("maybe").count() < repeated + 0.05 * len(rows)
    kept = exact_dedup.keep_first(df, limit=1 << 16)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_one_filter_at_a_time(spark, monkeypatch):
    """Over a hundred parts: each part's filter is gone before the next one is made."""
    live, most = [], []
    member = exact_dedup.member

    def counted(session, packed):
        test = member(session, packed)
        destroy = test.shared.destroy
        test.shared.destroy = lambda *a: (live.remove(test), destroy(*a))
        live.append(test)
        most.append(len(live))
        return test

    monkeypatch.setattr(exact_dedup, "member", counted)
    monkeypatch.setattr(exact_dedup, "BITS_A_ROW", 1 << 11)
    df = spark.range(4096).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 4000).alias("text"), F.lit("s").alias("source"))
    rows = exact_dedup.assign(df.coalesce(2), limit=1 << 16).collect()
    assert len(most) >= 100 and max(most) == 1 and not live
    assert sum(r.kept for r in rows) == 4000 and sum(r.n for r in rows) == 3904 + 4 * 96


def test_keep_first(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"_sha": F.lit("mine"), "_gone": F.lit(0)})
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, norm(r.text)) for r in got.collect()) == sorted({(i is None, i or 0, norm(t)) for i, t, _ in ODD if (i, norm(t)) in {(k, norm(x)) for k, x, _ in ODD if k == next(e[1] for e in brute(ODD) if e[4] == hashlib.sha256(norm(x).encode()).hexdigest())}})


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.assign(df).collect() == [] and exact_dedup.keep_first(df).collect() == []
    assert mixing.report(df).collect() == [] and mixing.mixed(df).collect() == [] and mixing.draws(df).collect() == []


def test_filter_misses_nothing(spark):
    values = spark.range(5000).select(F.xxhash64("id").alias("h"))
    test = exact_dedup.contained(values, 1 << 17)
    assert values.where(test("h")).count() == 5000
    assert spark.range(10_000, 20_000).where(test(F.xxhash64("id"))).count() < 4000


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by bisection on the water level."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    low, high = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * sizes[s], mid * w[s]) for s in order) < total:
            low = mid
        else:
            high = mid
    return {s: min(most * sizes[s], high * w[s]) for s in order}


def test_targets():
    for sizes in ({"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 3}, {"x": 7}, {f"s{i}": 1 + 37 * i % 11 for i in range(20)}):
        got, want = mixing.targets(sizes), water(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def docs(spark, n=400):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i * 7919 % 900)), ("a", "b", None, "c")[i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_mix(spark, df, split=mixing.split):
    """(doc, pass, block) -> shard of every draw: sorts each source's blocks by key and deals them out by the tree's leaves."""
    keyed = mixing.narrow(df, "doc_id", "source", "text").where("size > 0")
    blocks = keyed.select("doc", "source", "size", F.explode(F.expr(f"sequence(0, cast(ceil(size / {mixing.BLOCK_WORDS}) as int) - 1)")).alias("block"), "key")
    order = defaultdict(list)
    for r in blocks.withColumn("k", mixing.block_key(F.col("key"), F.col("block"))).collect():
        order[r.source].append((r.k, r.doc, r.block, min(mixing.BLOCK_WORDS, r["size"] - r.block * mixing.BLOCK_WORDS)))
    sizes = {s: sum(b[3] for b in bs) for s, bs in order.items()}
    goal = water({**sizes, **{r.source: 0 for r in df.select("source").distinct().collect() if r.source not in sizes}})
    sources = sorted(goal, key=lambda s: (s is None, s or ""))
    quota = []
    for s in sources:
        bs = sorted(order[s])
        total, best = 0, (goal[s], 0)
        for d in range(3 * len(bs) if bs else 0):
            total += bs[d % len(bs)][3]
            best = min(best, (round(abs(total - goal[s]), 3), d + 1))
        quota.append(best[1])
    leaves = split(np.array(quota, np.int64), mixing.SHARDS)
    out = {}
    for j, s in enumerate(sources):
        bs, d = sorted(order[s]), 0
        for shard in range(mixing.SHARDS):
            for _ in range(int(leaves[shard, j])):
                k, doc, block, n = bs[d % len(bs)]
                out[doc, d // len(bs), block] = (shard, n)
                d += 1
    return out, goal


def test_mix(spark):
    df, rows = docs(spark)
    report = {r.doc: r for r in mixing.report(df).collect()}
    want, goal = brute_mix(spark, df)
    per = defaultdict(lambda: defaultdict(int))
    for (doc, _, _), (shard, n) in want.items():
        per[doc][shard] += n
    for i, t, s in rows:
        r = report[i]
        assert r["size"] == len(t.split()) and abs(r.target - goal[s]) < 1e-6 * goal[s] and r.taken <= 3 * r["size"]
        assert r.taken == sum(per[i].values()) and r.shards == ",".join(f"{j}:{n}" for j, n in sorted(per[i].items()))
    for s in goal:
        assert abs(sum(r.taken for r in report.values() if rows[r.doc][2] == s) - goal[s]) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, mixing.report(df.repartition(9)).collect())) == sorted(map(tuple, report.values()))
    drawn = mixing.draws(df).collect()
    assert {(r.doc, r["pass"], r.block): r.shard for r in drawn} == {k: v[0] for k, v in want.items()} and len(drawn) == len(want)
    text = {i: t.split() for i, t, _ in rows}
    step = mixing.BLOCK_WORDS
    assert all(r.text.split() == text[r.doc][r.block * step : (r.block + 1) * step] for r in drawn)
    mixed = mixing.mixed(df)
    shown = defaultdict(list)
    for (doc, p, block), (shard, _) in sorted(want.items()):
        shown[shard, doc, p].append(block)
    lines = sorted((doc, [w for b in bs for w in text[doc][b * step : (b + 1) * step]]) for (_, doc, _), bs in shown.items())
    assert sorted((r.doc_id, r.text.split()) for r in mixed.collect() if r.text) == lines
    places = [(r.shard, r.place) for r in drawn]
    assert places == sorted(places)  # shard after shard, each by its places


def test_the_tree_decides(spark, monkeypatch):
    """Other leaves, other draws: what `split` gives each shard is what is taken."""
    df, _ = docs(spark, 60)
    report = sorted(map(tuple, mixing.report(df).collect()))
    first = lambda q, shards, seed=0, node=1: np.stack([q, *[q * 0] * (shards - 1)])
    half = lambda q, shards, seed=0, node=1: np.stack([q // 2, *[q * 0] * (shards - 1)])
    for change in (first, half):
        monkeypatch.setattr(mixing, "split", change)
        got = sorted(map(tuple, mixing.report(df).collect()))
        assert got != report
        want, _ = brute_mix(spark, df, change)
        assert sum(r[4] for r in got) == sum(n for _, n in want.values())
        assert all(set(r[5].split(",")) <= {"", f"0:{r[4]}"} for r in got)


def test_buckets_by_size():
    """Of 65,536 sources one with a third of all words still has its thousands of buckets, and the buckets stay bounded."""
    sizes = {f"s{i}": 10 for i in range(65_535)} | {None: 330_000}
    bits = mixing.bucket_bits(sizes)
    assert bits[None] == mixing.BUCKET_BITS and sum(1 << b for b in bits.values()) <= 1 << mixing.COUNT_BITS
    assert mixing.bucket_bits({"a": 0, "b": 0}) == {} and mixing.bucket_bits({}) == {}


def test_the_mix_does_not_depend_on_buckets_or_broadcasts(spark, monkeypatch):
    """With a hot source, a null one and many small ones."""
    rows = [(i, " ".join(["w"] * (i % 700)), "hot" if i % 3 else None if i % 5 == 0 else f"s{i % 40}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(map(tuple, mixing.report(df).collect()), key=str)
    monkeypatch.setattr(mixing, "COUNT_BITS", 5)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.report(df).collect()), key=str) == want


def test_hypergeometric_beyond_a_billion():
    """The same distribution on both sides of numpy's limit: mean and spread; and its bounds."""
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 7 * 10**9, 5 * 10**9
    x = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(300)], float)
    sd = (n * 0.3 * 0.7 * 0.5) ** 0.5
    assert abs(x.mean() - n * 0.3) < 5 * sd / 300**0.5 and 0.8 < x.std() / sd < 1.2
    assert mixing._hypergeometric(rng, 5, 2 * 10**9, 2 * 10**9 + 3) in range(3, 6) and mixing._hypergeometric(rng, 0, 10**10, 5) == 0


def test_tree():
    quotas = np.array([1000, 7, 0, 333])
    shards = mixing.split(quotas, 16)
    assert (shards.sum(0) == quotas).all() and (shards >= 0).all() and set(shards.sum(1)) <= {83, 84}


def test_odd_mix(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({"passes": F.lit(1), "drawn": F.lit(1), "shard": F.lit(2), "row": F.lit("r")})
    got = mixing.report(df).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    sizes = {"x": 2 + 2, "y": 2 + 1 + 1, "z": 140_000, None: 1}
    sizes["x"] += 2  # the row without an id
    want = water(sizes)
    by_text = {(i, t): s for i, t, s in ODD}
    assert all(abs(r.target - want[s]) < 1 for r in got for s in [by_text[next(k for k in by_text if k[0] == r.doc and len((k[1] or "").split()) == r["size"])]] if r.doc is not None)
    assert all(r.taken == 0 and r["size"] == 0 for r in got if r.doc in (3, 4)) and len({(r.taken, r.shards) for r in got if r.doc == 6}) == 1
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    rows = mixed.collect()
    assert {(r.passes, r.drawn, r.shard, r.row) for r in rows} == {(1, 1, 2, "r")}
    assert sum(len((r.text or "").split()) for r in rows) == sum(r.taken for r in got)
    assert [r.text for r in rows if r.doc_id == 3] in ([None], []) and [r.text for r in rows if r.doc_id == 4] in ([""], [])


def test_blocks_keep_all_text(spark):
    text = "\n  lead " + " ".join(f"w{i}\t" for i in range(300)) + "end \n"
    got = spark.createDataFrame([(text,)], "t string").select(mixing.block_texts("t").alias("b")).first().b
    assert "".join(got) == text and [len(b.split()) for b in got] == [128, 128, 46]
