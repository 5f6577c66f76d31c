"""Graph queries, checks, reviews, similarity, order and centrality on literal rows."""

import glob
import os
import random
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft import session
from docweft.operators import catalog, graph, integrity, similarity
from docweft.plans import QUERIES
from docweft.schema import legal_pairs
from docweft.session import written

EDGE = "id string, paper_id string, source_node_id string, target_node_id string, relation_type string, verification_status string, verification_scope string, provenance array<string>, version int"
NODE = "id string, paper_id string, type string, layer string, text string, epistemic_status string, verification_status string, verification_scope string, confidence double, provenance array<string>, version int"
BOX = {"x0": 1.0, "y0": 1.0, "x1": 9.0, "y1": 9.0}


def edges(spark, rows):
    return spark.createDataFrame([(i, "p", s, t, r, v, None, ["a1"], 1) for i, s, t, r, v in rows], EDGE)


def nodes(spark, rows):
    return spark.createDataFrame([(i, "p", t, la, x, "AUTHOR_CLAIM", "CANDIDATE", None, 0.6, ["a1"], 1) for i, t, la, x in rows], NODE)


def tables(spark):
    papers = spark.createDataFrame([("p", "h", 2)], "id string, source_hash string, page_count int")
    pages = spark.createDataFrame([("g", "p", 1, 10.0, 20.0, 0)], "id string, paper_id string, number int, width double, height double, rotation int")
    note = "array<struct<start_char:int,end_char:int,raw:string,display:string,kind:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,basis:string>>"
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    spans = spark.createDataFrame([("s1", "p", "g", 1, "We show a thing. It works.", BOX, [], [])], f"id string, paper_id string, page_id string, page_number int, text string, bbox {box}, notation {note}, section_titles array<string>")
    anchors = spark.createDataFrame([("a1", "p", "s1", 1, 0, 26, BOX, "We show a thing. It works.", "h")], f"id string, paper_id string, span_id string, page_number int, start_char int, end_char int, bbox {box}, text string, source_hash string")
    return papers, pages, spans, anchors


def test_cycles(spark):
    e = edges(spark, [("1", "A", "B", "PREREQUISITE_OF", "CANDIDATE"), ("2", "A", "B", "DEPENDS_ON", "CANDIDATE"), ("3", "B", "C", "PREREQUISITE_OF", "CANDIDATE"), ("4", "C", "B", "PREREQUISITE_OF", "REJECTED"), ("5", "D", "E", "USES", "CANDIDATE")])
    ids = lambda include=None: {r.id for r in graph.cyclic(graph.prerequisites(e, include)).collect()}
    assert ids() == {"1", "2"}
    assert ids("4") == {"1", "2", "3", "4"}
    chain = spark.createDataFrame([(str(i), str(i + 1), f"e{i}") for i in range(40)] + [("40", "0", "back")], "a string, b string, id string")
    assert graph.cyclic(chain).count() == 41


def test_edge_rules(spark):
    n = nodes(spark, [("P", "PAPER", "SOURCE", ""), ("R", "RESULT", "ARGUMENT", "x"), ("S", "ASSUMPTION", "SEMANTIC", "y")])
    e = edges(spark, [("1", "R", "R", "USES", "CANDIDATE"), ("2", "S", "R", "ASSUMES", "CANDIDATE"), ("3", "R", "S", "ASSUMES", "CANDIDATE"), ("4", "R", "S", "CONTAINS", "CANDIDATE"), ("5", "P", "R", "CONTAINS", "CANDIDATE"), ("6", "P", "X", "CONTAINS", "CANDIDATE"), ("7", "S", "R", "EVIDENCE_FOR", "CANDIDATE")])
    bad = {r.id for r in integrity.edge_faults(e, n).where("fault is not null").collect()}
    assert bad == {"1", "2", "4", "6"}
    asked = edges(spark, [("n1", "A", "B", "PREREQUISITE_OF", "CANDIDATE"), ("n2", "A", "B", "DEPENDS_ON", "CANDIDATE"), ("n3", "B", "A", "DEPENDS_ON", "CANDIDATE")])
    more = nodes(spark, [("A", "METHOD", "SEMANTIC", "a"), ("B", "METHOD", "SEMANTIC", "b")])
    stored = asked.where("id = 'n1'")
    reason = lambda i: integrity.validated_edges(asked.where(F.col("id") == i), stored, more).first().reason
    assert reason("n2") and reason("n3") is None
    assert {r.reason is None for r in integrity.validated_edges(asked.where("id <> 'n1'"), stored.limit(0), more).collect()} == {False}


def test_report(spark):
    papers, pages, spans, anchors = tables(spark)
    n = nodes(spark, [("p", "PAPER", "SOURCE", ""), ("n1", "RESULT", "ARGUMENT", "We show a thing."), ("n2", "RESULT", "ARGUMENT", "we  show a Thing."), ("n3", "CLAIM", "SEMANTIC", "It works."), ("n4", "METHOD", "SEMANTIC", "Not in the source.")])
    e = edges(spark, [("e1", "p", "n1", "CONTAINS", "SUPPORTED")])
    evidence = spark.createDataFrame([("v1", "n1", "a1"), ("v2", "n1", "zz")], "id string, supports_object_id string, anchor_id string")
    claims = spark.createDataFrame([("n4",)], "node_id string")
    fields = "id string, object_id string, object_kind string, object_version int, paper_id string, source_hash string, decision string, scope string, reviewer string, reason string, scientific_basis string, evidence_fingerprint string"
    reviews = spark.createDataFrame([("r1", "gone", "node", 1, *[None] * 8)], fields)
    found = integrity.report(papers, pages, spans, anchors, n, e, evidence, {"claims": claims}, reviews)
    codes = {}
    for r in found.collect():
        codes.setdefault(r.code, set()).add(r.object_id)
    assert codes["ORPHAN_NODE"] == {"n2", "n3", "n4"} and codes["DUPLICATE_CANDIDATE"] == {"n2"}
    assert {"n3", "n4", "n1"} <= codes["INVALID_NODE"] and codes["INVALID_EVIDENCE"] == {"v2"}
    assert codes["INVALID_SUBTYPE"] == {"n4"} and codes["INVALID_REVIEW_REFERENCE"] == {"r1"}
    assert not integrity.structurally_valid(found).first()[0]
    assert "INVALID_ANCHOR" not in codes


def test_report_shuffles_little_of_edges(spark):
    """What a report of 20,000 edges with long names leaves in shuffle files: not the joins of the edges' check, nor edges joined with themselves."""
    papers, pages, spans, anchors = tables(spark)
    named = lambda x: F.sha2(F.concat(F.lit("n"), x.cast("string")), 256)
    rows = lambda df: df.select("id", F.lit("p").alias("paper_id"), *(F.lit(v).alias(k) for k, v in (("type", "METHOD"), ("layer", "SEMANTIC"), ("text", ""), ("epistemic_status", "BACKGROUND_KNOWLEDGE"), ("verification_status", "CANDIDATE"), ("version", 1))), F.lit(None).cast("string").alias("verification_scope"), F.array(F.lit("a1")).alias("provenance"))
    n = rows(spark.range(2000).select(named(F.col("id")).alias("id")))
    e = spark.range(20000).select(F.sha2(F.concat(F.lit("e"), F.col("id").cast("string")), 256).alias("id"), named(F.col("id") % 2000).alias("source_node_id"), named((F.col("id") * 7 + 1) % 2003).alias("target_node_id"))
    e = e.withColumns({"paper_id": F.lit("p"), "relation_type": F.lit("USES"), "verification_status": F.lit("SUPPORTED"), "verification_scope": F.lit(None).cast("string"), "provenance": F.array(F.lit("a1")), "version": F.lit(1)})
    e = spark.createDataFrame(e.toArrow())
    files = lambda: {f.toString(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    evidence = spark.createDataFrame([], "id string, supports_object_id string, anchor_id string")
    had = files()
    found = integrity.report(papers, pages, spans, anchors, n, e, evidence).groupBy("code").count().collect()
    left = sum(size for name, size in files().items() if name not in had)
    assert {r.code: r["count"] for r in found}["INVALID_EDGE"] == sum((i * 7 + 1) % 2003 >= 2000 or i % 2000 == (i * 7 + 1) % 2003 for i in range(20000))
    assert left < 20000 * 250, left


def test_structural_validity_keeps_verdicts_only(spark):
    """Of the reports' steps nothing is left when the query is made, but each graph's verdict."""
    steps = lambda: set(glob.glob(f"{session.shared_dir(spark)}/docweft/{spark.sparkContext.applicationId}/*/*"))
    had = steps()
    out = QUERIES["structural_validity"](spark, "/root/testdata/sf0.001")
    assert [os.path.basename(p) for p in steps() - had] == ["verdict"] * 2
    assert {tuple(r) for r in out.collect()} == {("planted", False), ("sound", True)}


@pytest.mark.parametrize(("change", "fault"), [({"source_hash": "old"}, "stale"), ({"end_char": 5}, "range"), ({"page_number": 2}, "ownership"), ({"bbox": {**BOX, "x1": 99.0}}, "coordinates"), ({"paper_id": "q"}, "this paper")])
def test_anchor_faults(spark, change, fault):
    papers, pages, spans, anchors = tables(spark)
    row = {**anchors.first().asDict(True), **change}
    bad = spark.createDataFrame([row], anchors.schema)
    assert fault in integrity.anchor_faults(bad, spans, pages, papers).first().fault


def test_reviews(spark):
    _, _, _, anchors = tables(spark)
    o = spark.createDataFrame([("n1", "node", 2, "VERIFIED", "SOURCE_ATTRIBUTION", "p", "h", "text", ["a1"])], "id string, kind string, version int, verification_status string, verification_scope string, paper_id string, source_hash string, text string, provenance array<string>")
    prints = integrity.fingerprints(o, anchors, ["id", "text"])
    value = prints.first().fingerprint
    review = lambda **k: spark.createDataFrame([{"object_id": "n1", "object_kind": "node", "object_version": 1, "paper_id": "p", "source_hash": "h", "decision": "VERIFIED", "scope": "SOURCE_ATTRIBUTION", "reviewer": "someone", "reason": "because it is so", "scientific_basis": "", "evidence_fingerprint": value} | k])
    ok = lambda r, **k: integrity.reviews_current(o, r, prints, **k).first().current
    assert ok(review())
    assert not ok(review(reason="short")) and not ok(review(evidence_fingerprint="x")) and not ok(review(object_version=2)) and not ok(review(), scientific=True)
    assert not ok(review().unionByName(review()))
    tampered = integrity.fingerprints(o.withColumn("text", F.lit("other")), anchors, ["id", "text"]).first().fingerprint
    assert tampered != value


def test_views_and_paths(spark):
    e = edges(spark, [("1", "A", "B", "USES", "VERIFIED"), ("2", "B", "D", "USES", "VERIFIED"), ("3", "A", "C", "USES", "VERIFIED"), ("4", "C", "D", "USES", "VERIFIED"), ("5", "A", "D", "USES", "REJECTED")])
    assert graph.shortest_path(e, "A", "D").first().asDict() == {"found": True, "hops": 2, "path": "A > B > D"}
    assert not graph.shortest_path(e, "D", "A").first().found
    assert graph.shortest_path(e, "A", "A").first().hops == 0
    near = {r.id: r.hop for r in graph.neighborhood(e, "B", 2, 3).collect()}
    assert near == {"B": 0, "A": 1, "D": 1}
    n = nodes(spark, [("z", "PAPER", "SOURCE", ""), ("a", "CLAIM", "ARGUMENT", ""), ("b", "METHOD", "SEMANTIC", ""), ("c", "FIRST_PRINCIPLE", "LEARNING", "")]).withColumn("created_at", F.lit(0))
    assert [r.id for r in graph.view(n, "argument").orderBy("id").collect()] == ["a", "z"]
    assert [r.id for r in graph.view(n, "learning").collect()] == ["c"]
    assert [(r.id, r.total, r.truncated) for r in graph.top_nodes(n, 2).collect()] == [("z", 4, True), ("a", 4, True)]
    assert graph.preferred(n, None, "b").first().id == "b" and graph.preferred(n, "c", "b").first().id == "c" and graph.preferred(n, None, None).first().id == "a"
    good = nodes(spark, [(x, "METHOD", "SEMANTIC", x) for x in "ABCD"])
    assert integrity.path_edges(e, good).count() == 4
    sure = spark.createDataFrame([("1", True), ("2", False)], "id string, current boolean")
    assert integrity.path_edges(e, good, sure).count() == 0


def test_related(spark):
    e = edges(spark, [("1", "A", "B", "SUPPORTS", "CANDIDATE"), ("2", "C", "A", "SUPPORTED_BY", "CANDIDATE"), ("3", "A", "D", "SUPPORTS", "STALE")])
    row = graph.related(e, {"claims": ("SUPPORTS",)}, {"evidence": ("SUPPORTED_BY",)}).where("id = 'A'").first()
    assert row.claims == ["B"] and row.evidence == ["C"]


def test_similarity_fixture(spark):
    pairs = spark.createDataFrame([("alpha", "base"), ("alpha", "principle"), ("beta", "base"), ("beta", "principle"), ("beta", "other"), ("gamma", "other")], "paper string, concept string")
    assert {r.concept: r.df for r in similarity.frequencies(pairs).collect()} == {"base": 2, "principle": 2, "other": 2}
    assert {(r.a, r.b): r.weight for r in similarity.paper_similarity(pairs).collect()} == {("alpha", "beta"): 0.666667, ("beta", "gamma"): 0.333333}
    assert {(r.a, r.b): round(r.weight, 6) for r in similarity.cooccurrence(pairs).collect()} == {("base", "principle"): 0.666667, ("base", "other"): 0.333333, ("other", "principle"): 0.333333}
    reviews = spark.createDataFrame([("alpha", "one problem", "a method", ["k"]), ("beta", "one problem", "a method", ["k"]), ("gamma", "else", "no", ["z"])], "paper string, core_problem string, method_summary string, key_concepts array<string>")
    assert [(r.a, r.b, r.score) for r in similarity.review_similarity(reviews).collect()] == [("alpha", "beta", 1.0)]


def test_learning_order(spark):
    concepts = spark.createDataFrame([("base", 2), ("principle", 2), ("other", 2), ("x", 1), ("y", 1), ("lost", 0)], "id string, frequency int")
    needs = spark.createDataFrame([("principle", "base"), ("x", "y"), ("y", "x"), ("lost", "nowhere")], "id string, requires string")
    rows = graph.learning_order(concepts, needs).orderBy("wave", F.desc("frequency"), "id").collect()
    assert [r.id for r in rows if not r.blocked] == ["base", "other", "principle"]
    assert {r.id for r in rows if r.blocked} == {"x", "y", "lost"}


def brute_waves(ids, needs):
    wave, k = {}, 1
    while ready := [i for i in ids if i not in wave and all(r in wave for a, r in needs if a == i)]:
        wave |= dict.fromkeys(ready, k)
        k += 1
    return {i: wave.get(i) for i in ids}


def test_learning_order_of_any_graph(spark):
    """Chains, diamonds, cycles with tails, needs of strangers and repeated needs, by random links."""
    for seed in range(4):
        rng = random.Random(seed)
        ids = [*range(40)]
        needs = [(i, rng.randrange(max(0, i - 4), i)) for i in ids[1:25] for _ in range(rng.choice([1, 1, 1, 2]))] + [(i, rng.choice([*range(24, 41)])) for i in range(25, 34)] + [(i, i - 1) for i in range(35, 40)]
        got = graph.learning_order(spark.createDataFrame([(i, 1) for i in ids], "id long, frequency int"), spark.createDataFrame(needs, "id long, requires long")).collect()
        assert {r.id: r.wave for r in got} == brute_waves(ids, needs)
        assert all(r.blocked == (r.wave is None) for r in got)


def test_learning_order_of_a_long_chain(spark, monkeypatch):
    """10,000 concepts one after the other, and a few that need two of them, in fewer than 40 rounds."""
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name="step": rounds.append(name) or written(df, name))
    n = 10_000
    concepts = spark.range(n + 3).select("id", F.lit(1).alias("frequency"))
    needs = spark.range(1, n).select("id", (F.col("id") - 1).alias("requires")).union(spark.createDataFrame([(n, 7), (n, n - 1), (n + 1, n), (n + 2, 3), (n + 2, n + 1)], "id long, requires long"))
    got = graph.learning_order(concepts, needs)
    assert got.where(f"id < {n} and wave = id + 1").count() == n
    assert {r.id: r.wave for r in got.where(f"id >= {n}").collect()} == {n: n + 1, n + 1: n + 2, n + 2: n + 3}
    assert len(rounds) < 40


def brute_betweenness(near):
    score = dict.fromkeys(near, 0.0)
    for s, t in combinations(near, 2):
        paths, best = [[s]], None
        done = []
        while paths and not done:
            done = [p for p in paths if p[-1] == t]
            paths = [[*p, w] for p in paths for w in near[p[-1]] if w not in p]
        for v in near:
            if v not in (s, t) and done:
                score[v] += sum(v in p for p in done) / len(done)
    return score


def test_components_and_betweenness(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(9), 2))) for _ in range(11)} | {(20, 21), (21, 22)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    links = spark.createDataFrame([*pairs], "a long, b long")
    want = brute_betweenness(near)
    got = {r.id: r.score for r in graph.betweenness(links).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = {r.id: r.score for r in graph.betweenness(links.union(links).union(spark.createDataFrame([(1, 1)], "a long, b long")), rows=40).collect()}  # a few sources at a time
    assert few.keys() == want.keys() and all(abs(few[k] - want[k]) < 1e-9 for k in want)
    assert graph.betweenness(links.where("false")).collect() == []
    label = {v: v for v in near}
    for _ in near:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in graph.components(links).collect()} == label
    groups = {}
    for r in graph.numbered_groups(graph.components(links), "similar").collect():
        groups.setdefault(r.group, set()).add(r.id)
    order = sorted(groups, key=lambda g: int(g.split(":")[1]))
    assert order == [f"similar:{n + 1}" for n in range(len(order))] and [min(groups[g]) for g in order] == sorted(map(min, groups.values()))
    assert groups[order[-1]] == {20, 21, 22}


def test_aliases_and_index(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "alias string, id string")
    ends = {r.alias: r.id for r in graph.resolved(aliases).collect()}
    assert (ends["a"], ends["b"], ends["c"]) == ("d", "d", "d") and set(ends) == {"a", "b", "c", "x", "y"}
    pairs = [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("w", "x"), ("p", "q"), ("m", "n"), ("n", "m"), ("k", "k")] + [(f"z{i}", f"z{i + 1}") for i in range(40)]
    to = {a: b for a, b in pairs if a != b}

    def followed(a):
        seen = set()
        while a in to and a not in seen:
            seen.add(a)
            a = to[a]
        return a

    assert {r.alias: r.id for r in graph.resolved(spark.createDataFrame(pairs, "alias string, id string")).collect()} == {a: followed(a) for a in to}
    records = spark.createDataFrame([("d", "p1", "h1"), ("e", "p2", "h2")], "id string, path string, content_hash string")
    links = spark.createDataFrame([("a", "e", "uses", ["x"], 0.5, "auto"), ("a", "zz", "uses", ["x"], 0.5, "auto"), ("d", "e", "similar-x", ["x"], 1.0, "auto"), ("d", "e", "w", ["x"], 2.0, "auto")], "source string, target string, rel string, evidence array<string>, weight double, status string")
    good, bad = catalog.canonical_links(links, aliases, records)
    assert sorted((r.source, r.rel, r.status) for r in good.collect()) == [("d", "similar-x", "candidate"), ("d", "uses", "auto")]
    assert sorted(r.fault for r in bad.collect()) == ["bad weight", "dangling target"]
    asked = spark.createDataFrame([("a", "h1"), ("d", "h9"), ("q", None)], "asked string, expected_hash string")
    assert {r.asked: (r.id, r.fault) for r in catalog.lookup(asked, aliases, records).collect()} == {"a": ("d", None), "d": ("d", "changed"), "q": ("q", "unknown")}
    moved = catalog.moves(records, spark.createDataFrame([("p2", "h2"), ("new", "h1")], "path string, content_hash string")).collect()
    assert [(r.id, r.new_path) for r in moved] == [("d", "new")]


def test_reviews_carry(spark):
    old = spark.createDataFrame([("a", "i", ["e"], 1.0, "verified", "R"), ("b", "i", ["e"], 1.0, "verified", "R")], "k string, inputs string, evidence array<string>, weight double, status string, reviewer string")
    new = old.withColumn("status", F.lit("candidate")).withColumn("weight", F.when(F.col("k") == "b", 0.5).otherwise(F.col("weight"))).drop("reviewer")
    got = {r.k: (r.status, r.lapsed, r.reviewer) for r in catalog.carried_reviews(old, new, ["k"]).collect()}
    assert got == {"a": ("verified", False, "R"), "b": ("candidate", True, "R")}


def test_vocabulary():
    pairs = legal_pairs()
    assert ("CLAIM", "SEMANTIC") not in pairs and ("ASSUMPTION", "ARGUMENT") in pairs and len({t for t, _ in pairs}) == 48


def test_repeats_of_a_large_group(spark):
    """Every node but a group's first has the one before it, and a large group does not land in one task."""
    rows = [(f"{i:05d}", "RESULT", "Same  text" if i % 2 else "same text") for i in range(5000)] + [(f"x{i}", "CLAIM", t) for i, t in enumerate(("a", "b", "A ", None, None))]
    nodes = spark.createDataFrame(rows, "id string, type string, text string").repartition(4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = integrity.repeats(nodes).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(f"{i:05d}", f"{i - 1:05d}") for i in range(1, 5000)} | {("x2", "x0"), ("x4", "x3")}
    assert {(r.id, r.previous) for r in got} == want and len(got) == len(want)
    assert max(Counter(r.task for r in got).values()) < 2500


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=30))
def test_cyclic_by_reachability(spark, pairs):
    reach = {(a, b) for a, b in pairs}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    rows = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    got = graph.cyclic(spark.createDataFrame(rows, "a int, b int, id int"))
    assert {r.id for r in got.collect()} == {i for a, b, i in rows if a == b or (b, a) in reach}


def test_strong_parts_by_joins(spark):
    """The rounds of joins that take over beyond a task's bound give the same parts."""
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100 + i, 100 + (i + 1) % 12) for i in range(12)] + [(105, 200), (200, 201), (201, 200)]
    df = spark.createDataFrame(pairs, "a long, b long")

    def groups(rows):
        out = {}
        for r in rows:
            out.setdefault(r.part, set()).add(r.id)
        return sorted(map(sorted, out.values()))

    assert groups(graph.strong_parts(df, 0).collect()) == groups(graph.strong_parts(df).collect())
    assert groups(graph.strong_parts(df).collect())[-2:] == [list(range(100, 112)), [200, 201]]


def test_names_of_parts_do_not_depend_on_the_order_of_rows(spark):
    """A walk that is run twice may get its rows in another order; its parts must have the same names."""
    pairs = [(a, b) for i in range(0, 300, 3) for a, b in ((i, i + 1), (i + 1, i + 2), (i + 2, i))]
    rows = [pd.DataFrame(x, columns=["a", "b"]) for x in (pairs, pairs[::-1], random.Random(3).sample(pairs, len(pairs)))]
    assert {frozenset(zip(*map(list, graph._walked(r).to_dict("list").values()), strict=True)) for r in rows} == {frozenset((i, i - i % 3) for i in range(300))}
    parts = graph.strong_parts(spark.createDataFrame(pairs, "a long, b long"))
    assert hasattr(parts, "_written_at") and all(r.part == r.id - r.id % 3 for r in parts.collect())


def test_tables_as_large_as_the_graph_are_not_broadcast(spark):
    """However small they look: an exploded table, and names that compress well."""
    e = edges(spark, [("e1", "a", "b", "PREREQUISITE_OF", "VERIFIED"), ("e2", "b", "c", "USES", "VERIFIED")])
    n = nodes(spark, [(i, "METHOD", "SEMANTIC", "t") for i in "abc"]).withColumn("verification_status", F.lit("VERIFIED"))
    current = n.select("id", F.lit(True).alias("current")).unionByName(e.select("id", F.lit(True).alias("current")))
    for df in (integrity.edge_faults(e, n), graph.cyclic(graph.prerequisites(e)), integrity.path_edges(e, n, current)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in integrity.path_edges(e, n, current).orderBy("id").collect()] == ["e1", "e2"]
