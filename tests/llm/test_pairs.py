"""Near duplicates by n-grams and by vectors: against brute force, on groups of copies, and on odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docweft.llm import common, jaccard_join, lattice

SCHEMA = "doc_id long, text string"


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def close(links, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    label = close(links, sets)
    n = dict.fromkeys(sets, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {(i, label[i], n[i]) for i in sets}


def near_copies(rng, base, n, most):
    for _ in range(n):
        words = base.split()
        for k in rng.sample(range(len(words)), rng.randint(0, most)):
            words[k] = f"x{rng.randint(0, 9999)}"
        yield " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    texts = [text(rng.randint(1, 200)) for _ in range(150)]
    passage = text(60)
    texts += [f"{text(150)} {passage} {text(150)}" for _ in range(25)]
    for _ in range(12):
        texts += near_copies(rng, text(120), 6, 5)
    texts += near_copies(rng, text(200), 330, 4)  # one large group of near copies, over a bucket's size
    texts += ["the same text of seven words here"] * 40 + ["The same, text of SEVEN words here!"] * 5
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_bands():
    for threshold in (0.5, 0.8, 0.95):
        b, r = jaccard_join.bands(threshold, 0.999)
        assert b * r <= jaccard_join.HASHES and 1 - (1 - threshold**r) ** b >= 0.999


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"class_id": F.lit(0), "grams": F.lit("g")}).repartition(6)
    assert {tuple(r) for r in jaccard_join.classes(df).collect()} == brute(rows)


def test_keep_one(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_gone", F.lit(1))
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == {i for i, c, _ in brute(rows) if i == c}


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "One, two"), (6, "one"), (None, "a b c d e f"), (7, "a b c d e f"), (8, "z " * 50_000 + "end"), (9, "z " * 50_001 + "end"), (10, "k l m n o p"), (10, "k l m n o p"), (11, "q r s t u v"), (11, "1 2 3 4 5 6")]
    got = sorted(((r.doc, r.class_id, r.n_links) for r in jaccard_join.classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (None, 7, 1), (7, 7, 1), (8, 8, 1), (9, 8, 1), (10, 10, 0), (11, 11, 0), (11, 11, 0)], key=str)
    assert jaccard_join.classes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert jaccard_join.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5600)]
    got = {r.id: r["comp"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == close(pairs, {x for p in pairs for x in p})
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_block_pairs_meet_once(spark):
    members = spark.range(700).select(F.lit(1).alias("g"), F.col("id").alias("m"))
    rows = common.block_pairs(members, members.groupBy("g").agg(F.count("*").alias("n")), "g", "m", 100).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.a, r.b), []).append((r.m, r.own))
    met = {}
    for (a, b), ms in tasks.items():
        assert len(ms) < 300
        left, right = [m for m, o in ms if o == a], [m for m, o in ms if o == b]
        for p in combinations(left, 2) if a == b else ((x, y) for x in left for y in right):
            key = tuple(sorted(p))
            met[key] = met.get(key, 0) + 1
    assert len(met) == 700 * 699 // 2 and set(met.values()) == {1}


def vectors(seed=4, dim=64):
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(150, dim)))
    for n, noise in ((5, 0.02), (8, 0.03), (700, 0.012)):  # the last group is larger than a cell and a block
        centre = rng.normal(size=dim)
        out += [(centre + noise * 8 * rng.normal(size=dim) * np.linalg.norm(centre) / 8 / dim**0.5 * 3) * s for s in rng.uniform(0.1, 9, n)]
    return np.array(out)


def test_lattice(spark):
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    alike = unit @ unit.T >= 0.95
    np.fill_diagonal(alike, False)
    label = close([(i, j) for i, j in zip(*np.nonzero(alike), strict=True) if i < j], range(len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cells int").repartition(5)
    got = lattice.near_duplicates(df).collect()
    assert len(got) == len(x)
    links = sum(r.n_links for r in got)
    assert alike.sum() * 0.98 <= links <= alike.sum()
    assert sum(r.component == label[r.id] for r in got) >= 0.98 * len(x) and all(r.kept == (r.id == r.component) for r in got)


def largest_cluster(monkeypatch, module):
    """Notes the largest cluster whose members a run compares with each other."""
    seen, deal = [], module.block_pairs

    def noted(members, sizes, *args):
        seen.append(max((r.n for r in sizes.collect()), default=0))
        return deal(members, sizes, *args)

    monkeypatch.setattr(module, "block_pairs", noted)
    return seen


def test_vectors_of_one_topic(spark, monkeypatch, tmp_path):
    """Many vectors at a mean cosine of 0.64 fill cells far over a block's size: no links but the planted ones, and no large cluster."""
    rng = np.random.default_rng(7)
    n, dim = 50_000, 64
    centre = rng.normal(size=dim)
    centre /= np.linalg.norm(centre)
    z = rng.normal(size=(n, dim))
    z -= (z @ centre)[:, None] * centre
    x = 0.8 * centre + 0.6 * z / np.linalg.norm(z, axis=1)[:, None]
    x[1000:1400] = x[1000] + rng.normal(size=(400, dim)) * 0.01
    x[2000:2600] = x[2000]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(unit[s : s + 2000] @ unit.T >= 0.95).sum(1) - 1 for s in range(0, n, 2000)])
    seen = largest_cluster(monkeypatch, lattice)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet")).repartition(8)
    got = lattice.near_duplicates(df).toPandas().sort_values("id")
    assert seen[0] < 1000
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.98 * want.sum()
    assert set(got.component[2000:2600]) == {2000} and set(got.component[1000:1400]) == {1000}


def test_texts_that_share_boilerplate(spark, monkeypatch):
    """Texts at Jaccard 0.3 by a common passage fill buckets far over a block's size: no links but the planted ones, and no large cluster."""
    rng = random.Random(8)
    common_part = " ".join(f"c{k}" for k in range(45))
    texts = [common_part + " " + " ".join(f"u{i}_{k}" for k in range(52)) for i in range(12_000)]
    texts += near_copies(rng, texts[5], 300, 2)
    sets = [grams(t) for t in texts]
    assert 0.25 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.35
    family = [5, *range(12_000, len(texts))]
    links = {i: sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in family if j != i) for i in family}
    seen = largest_cluster(monkeypatch, jaccard_join)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(8)
    got = {r.doc: (r.class_id, r.n_links) for r in jaccard_join.classes(df).collect()}
    assert seen[0] < 600
    assert all(got[i] == ((5, links[i]) if i in links and links[i] else (i, 0)) for i in range(len(texts)))


def test_large_buckets_link_what_brute_force_links(spark):
    """bucket_links over one hot bucket: the same connections as all pairs, whatever lies outside its largest group."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(0, 0.1, 700), rng.uniform(3, 400, 500), rng.normal(900, 0.1, 150)])
    link = [(i, j) for i, j in combinations(range(len(points)), 2) if abs(points[i] - points[j]) <= 0.05]

    def linker(values, own, a, b, at):
        v, x, y = values.to_numpy(), [], []
        for s, e in zip(at[:-1], at[1:], strict=True):
            near = np.abs(v[s:e, None] - v[None, s:e]) <= 0.05
            ok = (own[s:e, None] == a[s]) & (own[None, s:e] == b[s])
            i, j = np.nonzero(near & ok & ~np.eye(e - s, dtype=bool))
            x.append(i + s)
            y.append(j + s)
        return np.concatenate(x), np.concatenate(y)

    ids = spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "id long, value double")
    buckets = ids.select(F.lit(7).cast("long").alias("bucket"), "id").union(ids.where("id < 40").select(F.lit(8).cast("long").alias("bucket"), "id"))
    edges = common.bucket_links(buckets, ids, linker, 100)
    got = {r.id: r["comp"] for r in common.components(edges).collect()}
    want = close(link, {i for p in link for i in p})
    assert got == want


def test_recall():
    """Pairs at a cosine of 0.95 share a cell often enough whatever the number of rows, and unrelated vectors seldom."""
    rng = np.random.default_rng(5)
    x, z = (rng.normal(size=(1500, 64)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z
    meet = lambda p, q: np.mean([bool(set(u) & set(v)) for u, v in zip(p.tolist(), q.tolist(), strict=True)])
    blocks = []
    for rows in (10, 10**6, 10**7, 10**9):
        tables, b = lattice.shape(rows)
        blocks.append(b)
        one, other = lattice.cells(x, tables, b), lattice.cells(y, tables, b)
        assert meet(one, other) > 0.985 and meet(one, np.roll(one, 1, 0)) < 0.01
    assert blocks == [2, 2, 3, 4]


def test_e8():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 3
    near = lattice.nearest_e8(x)
    whole = (near == np.rint(near)).all(1)
    assert (whole | (near - 0.5 == np.rint(near - 0.5)).all(1)).all() and (near.sum(1) % 2 == 0).all()
    step = lattice._shortest()
    assert len(step) == 240 and np.allclose((step**2).sum(1), 2)
    own = ((x - near) ** 2).sum(1)
    assert all((((x[:, None] - near[:, None] - step[None]) ** 2).sum(2) >= own[:, None] - 1e-9).all(1))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [1e-300, 1e-300]), (9, [1.0, 1.0, 1.0]), (10, []), (None, [1.0, 1.0]), (6, [1.0, 1.0])]
    got = sorted(((r.id, r.n_links, r.component) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 9, 10, None)]
    assert [g for g in got if g[0] in (1, 2, 3, 4, 5, 9, 10, None)] == sorted(alone, key=str)
    assert {g[2] for g in got if g[0] in (6, 7, 8)} == {6}
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []
