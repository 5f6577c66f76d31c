"""Joins that never hold a hot group: pairs in blocks, prefix filters, grid cells, containment by automaton."""

import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from docweft import session
from docweft.operators import evaluate, similarity


def test_pairs_of_a_hot_group(spark):
    """One concept that 600 papers have: all pairs once, and no key with over twice a block's rows a side."""
    rows = spark.range(600).select(F.lit("hot").alias("concept"), F.col("id").alias("paper"), (F.col("id") * 2).alias("w")).union(spark.createDataFrame([("c", 1, 2), ("c", 5, 10), ("d", 7, 14)], "concept string, paper long, w long"))
    got = similarity.pairs_within(rows, ["concept"], "paper", ["w"], block=64)
    assert got.count() == 600 * 599 // 2 + 1 and got.select("concept", "a", "b").distinct().count() == 600 * 599 // 2 + 1
    assert got.where("w_a <> 2 * a or w_b <> 2 * b or a >= b").isEmpty()


def test_similarity_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(2)
    pairs = spark.createDataFrame([(f"p{i}", f"c{rng.randrange(12)}") for i in range(40) for _ in range(4)], "paper string, concept string")
    one = [sorted(map(tuple, f(pairs).collect())) for f in (similarity.paper_similarity, similarity.shared_principles, similarity.cooccurrence)]
    monkeypatch.setattr(similarity.pairs_within, "__defaults__", ((), 5))
    for want, f in zip(one, (similarity.paper_similarity, similarity.shared_principles, similarity.cooccurrence), strict=True):
        got = sorted(map(tuple, f(pairs).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert all(abs(x - y) < 1e-6 for r, s in zip(got, want, strict=True) for x, y in zip(r[2:], s[2:], strict=True))


def test_partners_equal_pairs(spark, monkeypatch):
    """Per paper what its pairs add up to: hot concepts in blocks, papers of many concepts, papers that share several, repeated and null rows."""
    rng = random.Random(3)
    rows = [(f"p{i:02}", f"c{rng.randrange(25)}") for i in range(50) for _ in range(4)] + [(f"p{i:02}", f"c{j}") for i in (3, 30) for j in range(400)]
    rows += [("p07", "only one"), (None, "c1"), ("p08", None), *rows[:9]]
    pairs = spark.createDataFrame(rows, "paper string, concept string")
    by_paper = similarity.paper_similarity(pairs).groupBy("a").agg(F.count("*").alias("partners"), F.sum("shared").alias("shared"), F.max("weight").alias("weight"))
    want = sorted(map(tuple, by_paper.collect()))
    assert max(r[2] - r[1] for r in want) > 25  # two wide papers share all theirs
    for held, block in ((similarity.HELD, similarity.BLOCK), (0, 7)):
        monkeypatch.setattr(similarity, "HELD", held)
        got = sorted(map(tuple, similarity.partners(pairs, block).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want, strict=True))


def test_steps_leave_no_shuffle_files(spark):
    """What a step shuffled is deleted at its end (soon after, by the block manager), and the setting is as before."""
    before = spark.conf.get(session._CLEAN, None)
    files = lambda: {f.toString() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    had = files()
    out = session.written(spark.range(1000).withColumn("k", F.col("id") % 10).repartition(7, "id").groupBy("k").count())
    until = time.time() + 20
    while files() - had and time.time() < until:
        time.sleep(0.2)
    assert not files() - had and out.count() == 10
    assert spark.conf.get(session._CLEAN, None) == before


def test_reviews_by_prefix(spark):
    """The pairs of at least a quarter, against all pairs; a word that all 200 reviews have makes few candidates."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]

    def text():
        return " ".join(["common", *rng.sample(words, 8)])

    rows = [(f"r{i:03}", text(), text(), [f"k{rng.randrange(300)}" for _ in range(5)]) for i in range(200)]
    for i in range(0, 60, 2):  # near copies
        a, b, c, d = rows[i]
        rows[i + 1] = (rows[i + 1][0], " ".join(b.split()[: 9 - i % 6]), c if i % 4 else text(), d[:3])
    rows += [("none", None, "", None), ("short", "common", "common", ["k1"]), ("short2", "common", "common", ["k1"])]
    df = spark.createDataFrame(rows, "paper string, core_problem string, method_summary string, key_concepts array<string>")
    sets = {r[0]: (set((r[1] or "").split()), set((r[2] or "").split()), set(r[3] or ())) for r in rows}
    share = lambda x, y: len(x & y) / len(x | y) if x & y else 0.0
    want = {(a, b): s for a, b in combinations(sorted(sets), 2) if (s := round(sum(map(share, sets[a], sets[b])) / 3, 6)) >= 0.25}
    got = {(r.a, r.b): r.score for r in similarity.review_similarity(df).collect()}
    assert got == want and len(want) > 20
    from docweft.functions import text as tx

    made = df.select("paper", tx.token_set(F.col("core_problem")).alias("s0"), tx.token_set(F.col("method_summary")).alias("s1"), F.array_distinct("key_concepts").alias("s2"))
    assert similarity.review_candidates(made, 0.25).count() < 203 * 202 // 2 // 3


def test_boxes_meet_in_cells(spark):
    """Boxes of any size, at borders, negative, far away and not numbers, against all pairs of a page."""
    rng = random.Random(6)

    def box(big):
        x, y = rng.choice([0.0, 63.0, 64.0, 65.0, -3.0, rng.uniform(0, 900)]), rng.uniform(-50, 900)
        w, h = (rng.choice([2.0, 30.0, 64.0, 300.0, 5e4]), rng.choice([1.0, 62.0, 128.0, 900.0])) if big else (rng.uniform(0, 9), rng.uniform(0, 9))
        return (x - (w if w > 1e4 else 0), y, x + w, y + h)

    nan = float("nan")
    outer = [(i, rng.choice("pq"), rng.randrange(2), box(True)) for i in range(150)] + [(900, "p", 0, (0.0, 0.0, nan, 9.0)), (901, "p", 0, None)]
    inner = [(i, rng.choice("pq"), rng.randrange(2), box(False)) for i in range(200)] + [(1000 + i, p, g, b) for i, p, g, b in outer[:50]] + [(901, "p", 0, None), (902, "p", 0, (nan, 1.0, 2.0, 3.0))]
    schema = "paper string, page int, {0}_box struct<x0:double,y0:double,x1:double,y1:double>"
    a = spark.createDataFrame(outer, "o long, " + schema.format("o"))
    b = spark.createDataFrame(inner, "i long, " + schema.format("i"))
    rows = evaluate.inside_pairs(a, b, ["paper", "page"], "o_box", "i_box").select("o", "i").collect()
    holds = lambda x, y: x and y and x[0] <= y[0] + 1 and x[1] <= y[1] + 1 and x[2] >= y[2] - 1 and x[3] >= y[3] - 1
    want = sorted((o[0], i[0]) for o in outer for i in inner if o[1:3] == i[1:3] and holds(o[3], i[3]))
    assert sorted((r.o, r.i) for r in rows) == want and len(want) > 100


def test_contained_items_of_any_length(spark):
    items = [(1, "two words"), (2, "x"), (3, " two\n words "), (4, ""), (5, None), (6, "a much longer item of several words"), (7, "你好"), (8, "absent"), (None, "x")]
    docs = [("a", "has two   words"), ("b", "xx x"), ("c", "say a much longer item\tof several words!"), ("d", None), ("e", ""), ("f", "说你好吗"), ("a", "two words again")]
    i, d = spark.createDataFrame(items, "item long, text string"), spark.createDataFrame(docs, "doc string, text string")
    want = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (3, "a"), (6, "c"), (7, "f"), (None, "b")]
    key = lambda r: (str(r[0]), r[1])
    for most in (evaluate.AUTOMATON, 12):  # one automaton, and parts
        assert sorted(map(tuple, evaluate.contained_items(i, d, "item", "doc", most=most).collect()), key=key) == sorted(want, key=key)
    assert evaluate.contained_items(i.limit(0), d, "item", "doc").collect() == []
    assert evaluate.contained_items(i, d.limit(0), "item", "doc").collect() == []


def test_gold_items_of_a_hot_page(spark):
    """Items and nodes of few pages, of common, short, empty and null texts and odd boxes, against all pairs; few of which meet."""
    rng = random.Random(8)
    box = lambda *b: dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))
    boxes = [box(0, 0, 30, 30), box(0, 0, 30, 30), box(50, 50, 60, 60), box(0, 0, float("nan"), 30), None]
    nodes = [(f"n{i:03}", rng.choice(["RESULT", "CLAIM", "SECTION"]), rng.choice([f"the  same words and number {i}.", f"x{i % 7}", "", "the same words"]), [f"a{i}", f"b{i}"]) for i in range(300)]
    anchors = [(f"{k}{i}", f"p{i % 2}", rng.randrange(2), rng.choice(boxes)) for i in range(300) for k in "ab"]
    part = lambda t: {"text": t, "bbox": box(1, 1, 20, 20) if rng.random() < 0.9 else rng.choice(boxes)}
    gold = [(f"g{i}", rng.choice(["RESULT", "CLAIM"]), f"p{i % 2}", rng.randrange(2), [part("same words"), part(rng.choice([f"number {i}.", f"ber {i}.", "x3", "", "3", " the\nsame", "absent from all", None]))][: rng.choice([0, 1, 2, 2, 2, 2])]) for i in range(300)]
    b = "struct<x0:double,y0:double,x1:double,y1:double>"
    g = spark.createDataFrame(gold, f"id string, type string, paper_id string, page int, components array<struct<text:string,bbox:{b}>>")
    n, a = spark.createDataFrame(nodes, "id string, type string, text string, provenance array<string>"), spark.createDataFrame(anchors, f"id string, paper_id string, page_number int, bbox {b}")
    flat = lambda t: " ".join(t.split())
    whole = lambda x: x is not None and all(v == v for v in x.values())
    holds = lambda x, y: whole(x) and whole(y) and x["x0"] <= y["x0"] + 1 and x["y0"] <= y["y0"] + 1 and x["x1"] >= y["x1"] - 1 and x["y1"] >= y["y1"] - 1
    at = {i: (p, q, x) for i, p, q, x in anchors}
    want = {}
    for gid, kind, paper, page, parts in gold:
        fits = [(t != kind, i) for i, t, text, own in nodes if t != "SECTION" and parts and all(c["text"] is not None and flat(c["text"]) in flat(text) and any(at[o][:2] == (paper, page) and holds(at[o][2], c["bbox"]) for o in own) for c in parts)]
        want[gid] = min(fits)[1] if fits else None
    assert {r.gold_id: r.node_id for r in evaluate.gold_matches(g, n, a).collect()} == want and len(set(want.values())) > 10
    one = lambda t: spark.createDataFrame([("p", i, t.format(i)) for i in range(2000)], "paper string, i int, text string")
    asked = one("number {}.").select("paper", F.col("i").alias("item"), F.array(F.lit("same words"), F.col("text")).alias("wanted"))
    met = evaluate.holders(asked, one("the same words and number {}."), ["paper"], F.col("wanted"), F.col("text"))
    assert met.where("item = i").count() == 2000 and met.count() < 40_000
