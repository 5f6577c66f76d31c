"""Operators that no query covers, on literal rows."""

import http.server
import json
import threading
import urllib.parse

from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import catalog, evaluate, graph, history, integrity, layout, resolve, segments
from docweft.sources import bibliography, store
from docweft.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_glyphs_and_titles(spark):
    glyph = lambda raw, size, y, sup=False, start=1: F.struct(F.lit(start).alias("start"), F.lit(start + 1).alias("end"), F.lit(raw).alias("raw"), F.lit(size).alias("size"), F.lit(y).alias("origin_y"), F.lit(sup).alias("superscript"), F.lit(True).alias("attached"))
    notes = one(spark, layout.glyph_notation(F.array(glyph("2", 6.0, 103.0), glyph("3", 6.0, 95.0), glyph("4", 10.0, 100.0, True), glyph("5", 10.0, 100.0), glyph("6", 6.0, 100.5)), F.lit(10.0), F.lit(100.0))[0])
    assert [(n.display, n.kind) for n in notes] == [("_2", "SUBSCRIPT"), ("^3", "SUPERSCRIPT"), ("^4", "SUPERSCRIPT")]
    line = lambda text, bold, size: F.struct(F.lit(text).alias("text"), F.lit(bold).alias("bold"), F.lit(size).alias("size"))
    lines = F.array(line("2. Results", False, 8.0), line("Bold label", True, 10.0), line("Bold sentence.", True, 10.0), line("Small bold", True, 8.0), line("ARTICLE", True, 12.0), line("plain", False, 10.0))
    assert one(spark, layout.section_titles(lines, F.lit(10.0))) == ["2. Results", "Bold label"]
    for text, top, want in (("Research Article", 5.0, "header"), ("a b 1.5", 50.0, "panel_label"), ("12 13", 50.0, "paragraph"), ("Head", 50.0, "heading")):
        assert one(spark, layout.kind(F.lit(text), F.lit(text == "Head"), F.lit(top), F.lit(100.0))) == want


def test_anchor_notation_and_json(spark):
    note = F.array(F.struct(F.lit(2).alias("start_char"), F.lit(3).alias("end_char")), F.struct(F.lit(8).alias("start_char"), F.lit(9).alias("end_char")))
    assert [tuple(n) for n in one(spark, graph.anchor_notation(note, F.lit(5), F.lit(10)))] == [(3, 4)]
    made = one(spark, tx.canonical_json(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), tx.finite(F.lit(float("inf"))).alias("c")))
    assert json.loads(made) == {"a": 1}


def test_bundles(spark):
    nodes = spark.createDataFrame([("n", ["a1"])], "id string, provenance array<string>")
    evidence = spark.createDataFrame([("n", "a1"), ("n", "a2")], "supports_object_id string, anchor_id string")
    anchors = spark.createDataFrame([("a1", 2, "x"), ("a2", 1, "y")], "id string, page_number int, text string")
    bundle = graph.evidence_bundle(nodes, evidence, anchors).first().anchors
    assert [(b.anchor_id, b.named) for b in bundle] == [("a2", False), ("a1", True)]
    assert [r.node_id for r in graph.anchor_nodes(evidence, "a2").collect()] == ["n"]


def test_review_requests_and_versions(spark):
    objects = spark.createDataFrame([("n", "node", 3, "h", ["a"], "CLAIM", "AUTHOR_CLAIM"), ("e", "edge", 1, "h", ["a"], "USES", "AI_INTERPRETATION"), ("p", "node", 1, "h", ["a"], "PAPER", "UNKNOWN")], "id string, kind string, version int, source_hash string, provenance array<string>, type string, epistemic_status string")
    asked = spark.createDataFrame([("n", "h", 3, "VERIFIED", "SOURCE_ATTRIBUTION"), ("n", "h", 2, "VERIFIED", "SOURCE_ATTRIBUTION"), ("e", "h", 1, "VERIFIED", "SOURCE_ATTRIBUTION"), ("e", "h", 1, "VERIFIED", "SCIENTIFIC_VALIDITY"), ("p", "h", 1, "REJECTED", "SCIENTIFIC_VALIDITY"), ("q", "h", 1, "REJECTED", "SCIENTIFIC_VALIDITY")], "object_id string, source_hash string, expected_version int, decision string, scope string")
    got = {(r.object_id, r.expected_version, r.scope): (r.fault is None, r.new_version) for r in integrity.review_outcomes(asked, objects).collect()}
    assert got["n", 3, "SOURCE_ATTRIBUTION"] == (True, 4) and got["e", 1, "SCIENTIFIC_VALIDITY"] == (True, 2)
    assert not any(got[k][0] for k in (("n", 2, "SOURCE_ATTRIBUTION"), ("e", 1, "SOURCE_ATTRIBUTION"), ("p", 1, "SCIENTIFIC_VALIDITY"), ("q", 1, "SCIENTIFIC_VALIDITY")))
    reviews = spark.createDataFrame([("n", 1), ("n", 2), ("n", 2)], "object_id string, object_version int")
    assert tuple(history.versions(reviews).first()) == ("n", 3, 1)


def test_new_nodes(spark):
    asked = spark.createDataFrame([("1", "p", "CLAIM", "ARGUMENT", "It works.", "AUTHOR_CLAIM", 0.5, ["a"]), ("2", "p", "CLAIM", "SEMANTIC", "It works.", "AUTHOR_CLAIM", 0.5, ["a"]), ("3", "p", "CLAIM", "ARGUMENT", "It fails.", "AUTHOR_CLAIM", 0.5, ["a"]), ("4", "q", "CLAIM", "ARGUMENT", "It works.", "AUTHOR_CLAIM", 0.5, ["a"]), ("5", "p", "CLAIM", "ARGUMENT", "x", "AI_INTERPRETATION", 2.0, ["a"]), ("6", "p", "CLAIM", "ARGUMENT", "x", "AI_INTERPRETATION", 1.0, [])], "id string, paper_id string, type string, layer string, text string, epistemic_status string, confidence double, provenance array<string>")
    anchors = spark.createDataFrame([("a", "p", "We say: It works.")], "id string, paper_id string, text string")
    ok = {r.id for r in integrity.validated_nodes(asked, asked.limit(0), anchors).where("reason is null").collect()}
    assert ok == {"1"}


def test_backfill(spark):
    nodes = spark.createDataFrame([("n1", "p", "CLAIM", ["a"]), ("n2", "p", "CLAIM", []), ("n3", "p", "CLAIM", ["a"]), ("n4", "q", "CLAIM", ["a"]), ("n5", "p", "METHOD", ["a"])], "id string, paper_id string, type string, provenance array<string>")
    anchors = spark.createDataFrame([("a", "p")], "id string, paper_id string")
    got = history.backfill(nodes, anchors, spark.createDataFrame([("n3",)], "node_id string"), ("CLAIM",)).collect()
    assert [tuple(r) for r in got] == [("n1", "a")]


def test_sync_details(spark):
    for key, item, want in (("Doe2001", "K", "Doe2001"), ("a/b", "K1", "zotero-K1"), ("a/b", "x/y", None)):
        got = one(spark, resolve.cite_key(F.lit(key), F.lit(item)))
        assert got == want or want is None and got.startswith("zotero-") and len(got) == 19
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, resolve.union_values(arr("b"), arr("a", "b"))) == ["a", "b"] and one(spark, resolve.union_values(arr("b"), arr("a"), False)) == ["a"]
    records = spark.createDataFrame([("k", ["f1", "f2"])], "item_key string, attachment_paths array<string>")
    assert [r.path for r in resolve.missing_attachments(records, spark.createDataFrame([("f1",)], "path string"), "item_key").collect()] == ["f2"]


def test_catalog_details(spark):
    links = spark.createDataFrame([("a", "b", "uses", "inferred", "e1", 1.0, "auto"), ("a", "b", "uses", "manual", "e2", 0.5, "verified")], "source string, target string, rel string, origin string, evidence string, weight double, status string")
    assert catalog.best_links(links).first().origin == "manual"
    deps = lambda h: spark.createDataFrame([("l1", "p", h), ("l2", "p", "same")], "link string, path string, hash string")
    assert [r.link for r in catalog.lapsed(deps("1"), deps("2"), "link").collect()] == ["l1"]
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    fresh = spark.createDataFrame([("b", None, "z"), ("c", 3, "w")], "id string, n int, t string")
    assert sorted(tuple(r) for r in catalog.upserted(stored, fresh, "id", ["n", "t"]).collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, "w")]
    records = spark.createDataFrame([("a", "p"), ("a", "q")], "id string, path string")
    ends = spark.createDataFrame([("x", "gone")], "alias string, id string")
    bad = spark.createDataFrame([("a", "zz", 2.0, [])], "source string, target string, weight double, evidence array<string>")
    assert sorted(r.fault for r in catalog.index_faults(records, bad, ends).collect()) == ["bad weight", "dangling alias", "dangling target", "no evidence", "repeated id"]
    assert sorted(r.fault for r in catalog.graph_faults(records, bad).collect()) == ["bad weight", "no evidence", "no target", "repeated id"]
    tags = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "tags array<string>")
    assert {r.value: r.n for r in catalog.multi_valued(tags, "tags").collect()} == {"a": 2, "b": 1, "(none)": 1}
    cards = spark.createDataFrame([("c", ["base"], ["r"], [], [], [])], "id string, prerequisites array<string>, related array<string>, contrasts array<string>, extends array<string>, replaces array<string>")
    assert {tuple(r) for r in catalog.card_edges(cards).collect()} == {("concept:base", "concept:c", "prerequisite"), ("concept:c", "concept:r", "related")}
    assert [one(spark, catalog.role_relation(F.lit(r))) for r in ("introduced", "compared", "other")] == ["introduces", "contrasts", "uses"]
    assert catalog.missing_references(stored, "t", fresh, "t").count() == 2


def test_mapped_edges(spark):
    schema = "id string, source_node_id string, target_node_id string, relation_type string"
    old, new = spark.createDataFrame([("e", "a", "b", "USES")], schema), spark.createDataFrame([("f", "A", "B", "USES"), ("g", "B", "A", "USES")], schema)
    pairs = spark.createDataFrame([("A", "a", "PAIRED"), ("B", "b", "PAIRED")], "new_id string, old_id string, state string")
    assert [tuple(r) for r in evaluate.mapped_edges(old, new, pairs).collect()] == [("f", "e")]


def test_sections_and_paths(spark):
    assert one(spark, segments.sections_fit(F.array(F.lit("a"), F.lit("b")), ["a", "b"])) and not one(spark, segments.sections_fit(F.array(F.lit("b"), F.lit("a")), ["a", "b"]))
    assert [one(spark, store.safe_relative(F.lit(p))) for p in ("a/b.md", "../a", "/a", "a/../b", "c:\\a", "a..b")] == [True, False, False, False, False, True]


def test_paged_source(spark):
    items = [{"key": f"k{i}"} for i in range(23)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            start, limit = int(q["start"][0]), int(q["limit"][0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(items[start : start + limit]).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(bibliography.PagedSource)
    df = spark.read.format("paged_rest").option("url", f"http://127.0.0.1:{server.server_port}/?start={{start}}&limit={{limit}}").option("limit", "5").option("pages", "3").load()
    assert sorted(json.loads(r.raw)["key"] for r in df.collect()) == sorted(i["key"] for i in items)
    server.shutdown()


def test_sessions(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:00:00")], "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.events for r in jobs.session_funnel(rows).collect()) == [1, 2]
