"""Segments, histories, bibliography sync, evaluation and sources on literal rows."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft.operators import evaluate, history, resolve, segments
from docweft.sources import bibliography, markdown, store
from docweft.streaming.jobs import fold


def pack(lines, most):
    out, first, size = [], 1, 0
    for n, line in enumerate(lines, 1):
        if size + len(line) + (n > first) > most and n > first:
            out.append((first, n - 1))
            first, size = n, 0
        size += len(line) + (n > first)
    return [*out, (first, len(lines))]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=25))
def test_packing(spark, sizes):
    lines = ["x" * n for n in sizes]
    df = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    got = [(r.first, r["last"]) for r in segments.segments(df, most=12).orderBy("segment").collect()]
    assert got == (pack(lines, 12) if "\n".join(lines) else [])


def test_packing_too_long(spark):
    row = segments.segments(spark.createDataFrame([("d", "abc\n" + "x" * 20)], "doc_id string, text string"), most=12).first()
    assert not row.fits and row.text_hash is None


def test_coverage_and_markers(spark):
    i = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("b", 1, 3), ("b", 5, 6), ("c", 1, 4), ("c", 3, 6)], "k string, first int, last int")
    totals = spark.createDataFrame([("a", 6), ("b", 6), ("c", 6), ("d", 1)], "k string, total int")
    got = {r.k: (r.gaps, r.overlaps, r.complete) for r in segments.coverage(i, totals, "k").collect()}
    assert got == {"a": (0, 0, True), "b": (1, 0, False), "c": (0, 1, False), "d": (0, 0, False)}
    ledger = spark.createDataFrame([("1",), ("2",), ("3",), ("5",)], "segment_id string")
    markers = spark.createDataFrame([("1", "x"), ("2", " "), ("4", "x"), ("5", "a"), ("5", "b")], "segment_id string, body string")
    assert {r.segment_id: r.fault for r in segments.marker_faults(ledger, markers).collect()} == {"2": "empty", "3": "missing", "4": "foreign", "5": "repeated"}


def test_jobs_and_tasks(spark):
    jobs = spark.createDataFrame([("a", "PARSING", 5.0, 1, 20), ("b", "READY", 0.0, 1, 1), ("c", "UPLOADED", 0.0, 0, 10), ("d", "PARSING", 99.0, 1, 2)], "id string, status string, lease_until double, attempt int, updated_at int")
    row = history.claimable(jobs, F.lit(50.0)).first()
    assert (row.id, row.attempt) == ("c", 1)
    events = spark.createDataFrame([("t", 1, "prepared"), ("t", 2, "submitted"), ("t", 3, "accepted"), ("t", 4, "submitted")], "task string, n int, state string")
    assert [r.legal for r in history.transitions(events, "task", ["n"], "state").orderBy("n").collect()] == [True, True, True, False]
    drafts = spark.createDataFrame([("t", 1, "x"), ("t", 2, None), ("t", 3, "y")], "task string, n int, content string")
    assert [r.content for r in history.carried(drafts, ["task"], "n", "content").orderBy("n").collect()] == ["x", "x", "y"]
    outputs = spark.createDataFrame([("t", "p", "h", "1"), ("u", "p", "h", "1"), ("u", "q", None, "2")], "task string, path string, base_hash string, content string")
    stored = spark.createDataFrame([("p", "h"), ("q", "z")], "path string, hash string")
    assert sorted((r.task, r.path, r["apply"]) for r in history.applied(outputs, stored).collect()) == [("t", "p", True), ("u", "p", False), ("u", "q", False)]


def test_stream_fold():
    s = fold(None, [(10, "view"), (5, "signup")], ("done",), 100)
    assert s[:3] == (10, "view", 2)
    s = fold(s, [(500, "done"), (7, "late")], ("done",), 100)
    assert s == (500, "done", 3, 1, 1, True)
    assert fold(s, [(600, "view")], ("done",), 100) == (500, "done", 3, 1, 2, True)


def test_review_algebra(spark):
    fault = lambda d, p, f, i=(), c=(), x=("s",): spark.createDataFrame([(d, ["a", "b"], list(p), list(f), list(i), list(c), list(x))], "d string, k array<string>, p array<string>, f array<string>, i array<string>, c array<string>, x array<string>").select(history.review_fault(*map(F.col, "dkpficx")).alias("r")).first().r
    assert fault("accept", "ab", "") is None
    assert fault("accept", "a", "b") == "accept with open points" and fault("accept", "ab", "", x=()) == "accept with open points"
    assert fault("revise", "a", "b", "b", "b") is None and fault("revise", "a", "b", "b") == "revise without issue and change"
    assert fault("reject", "z", "") == "unknown criterion" and fault("reject", "a", "a") == "passed and failed"


def test_matching(spark):
    records = spark.createDataFrame([("k1", "10.1/a", "t1", 2000), ("k2", "", "t2", 2001), ("k3", "10.1/c", "t3", 2002), ("k4", "10.1/d", "t4", 2003), ("k5", "10.1/d", "t5", 2004), ("k6", "10.1/x", "t6", 2005)], "item_key string, doi_key string, title_key string, year int")
    existing = spark.createDataFrame([("p1", "k1", "", "", 0), ("p2", "q", "10.1/c", "", 0), ("p3", "r", "", "t2", 2001), ("p4", "k6", "", "", 0), ("p5", "s", "10.1/x", "", 0)], "paper string, item_key string, doi_key string, title_key string, year int")
    got = {r.item_key: (r.outcome, r.paper) for r in resolve.matched(records, existing, ["item_key"]).collect()}
    assert got == {"k1": ("matched", "p1"), "k2": ("duplicate", None), "k3": ("matched", "p2"), "k4": ("duplicate", None), "k5": ("duplicate", None), "k6": ("duplicate", None)}


def test_filter_merge_attachments(spark):
    rows = spark.createDataFrame([(["c1"], ["x", "y"], ["f1"]), (["c2"], ["x", "y"], []), (["c1"], ["x"], []), (["c1"], ["x", "y", "no"], [])], "collection_keys array<string>, tags array<string>, attachment_paths array<string>")
    assert rows.where(resolve.wanted(["c1"], ["x", "y"], ["no"])).count() == 1
    merged = spark.createDataFrame([("mine", "base", "new"), ("base", "base", "new"), (None, "base", "new"), ("TODO(user)", None, "new")], "l string, b string, i string")
    assert [r[0] for r in merged.select(resolve.merged(F.col("l"), F.col("b"), F.col("i"))).collect()] == ["mine", "new", "new", "new"]


def test_bibliography(spark, tmp_path):
    items = [
        {"key": "A1", "version": 3, "data": {"itemType": "journalArticle", "title": " One ", "DOI": "https://doi.org/10.1/AB", "date": "May 2001", "creators": [{"firstName": "Ada", "lastName": "L", "creatorType": "author"}, {"name": "E", "creatorType": "editor"}], "tags": [{"tag": "b"}, {"tag": "a", "type": 1}], "collections": ["C"], "extra": "Citation Key: ada2001"}},
        {"key": "X", "data": {"itemType": "attachment", "parentItem": "A1", "path": "f.pdf"}},
        {"itemType": "book", "title": "", "key": "B1"},
        {"type": "book", "title": "Two", "id": "two", "issued": {"date-parts": [["1999", "1"]]}, "author": [{"given": "G", "family": "H"}]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"items": items}))
    records, errors = bibliography.read(spark, str(tmp_path / "a.json"))
    got = {r.item_key: r for r in records.collect()}
    assert set(got) == {"A1", "two"} and errors.count() == 1
    a = got["A1"]
    assert (a.title, a.doi_key, a.year, a.cite_key, a.authors, a.tags, a.collection_keys, a.attachment_paths, a.version) == ("One", "10.1/ab", 2001, "ada2001", ["Ada L"], ["a", "b"], ["C"], ["f.pdf"], 3)
    assert (got["two"].year, got["two"].authors) == (1999, ["G H"])


def test_markdown_and_reports(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.md").write_text('---\nid: "concept:x"\ntags: [a, "b"]\npapers:\n  - p1\n  - p2\n---\n# Body\n')
    (tmp_path / "m/b.md").write_text("no front matter")
    rows = markdown.read(spark, str(tmp_path / "m")).select("valid", "body", markdown.field(F.col("front"), "id").alias("id"), markdown.list_field(F.col("front"), "tags").alias("tags"), markdown.list_field(F.col("front"), "papers").alias("papers")).orderBy(F.desc("valid")).collect()
    assert (rows[0].id, rows[0].tags, rows[0].papers, rows[0].body) == ("concept:x", ["a", "b"], ["p1", "p2"], "# Body\n") and not rows[1].valid
    df = spark.createDataFrame([(1, "a")], "n long, t string")
    assert markdown.write_report(df, str(tmp_path / "r")) and not markdown.write_report(df, str(tmp_path / "r"))


def test_store(spark, tmp_path):
    up = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "position int, content string")
    first = store.unique_uploads(up, spark.createDataFrame([], "source_hash string"))
    assert sorted((r.position, r.deduplicated) for r in first.collect()) == [(1, False), (2, False), (3, True)]
    store.write_store(first.where("not deduplicated"), str(tmp_path / "s"))
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert store.verified(kept).where("not intact").count() == 0
    assert store.unique_uploads(up, kept).where("deduplicated").count() == 3


def test_gold(spark):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v), strict=True))
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    gold = spark.createDataFrame([("g1", "RESULT", "p", 1, [("gain is", box(1, 1, 5, 5)), ("large", box(1, 1, 5, 5))]), ("g3", "RESULT", "q", 1, [("gain is", box(1, 1, 5, 5))]), ("g2", "CLAIM", "p", 1, [("absent", box(1, 1, 5, 5))])], f"id string, type string, paper_id string, page int, components array<struct<text:string,bbox:{kind}>>")
    nodes = spark.createDataFrame([("n1", "CLAIM", "The gain is  large.", ["a"]), ("n2", "RESULT", "the gain is large", ["a"]), ("n3", "RESULT", "gain is large", ["far"])], "id string, type string, text string, provenance array<string>")
    anchors = spark.createDataFrame([("a", "p", 1, box(0, 0, 9, 9)), ("far", "p", 2, box(0, 0, 9, 9))], f"id string, paper_id string, page_number int, bbox {kind}")
    got = {r.gold_id: (r.node_id, r.same_type) for r in evaluate.gold_matches(gold, nodes, anchors).collect()}
    assert got == {"g1": ("n2", True), "g2": (None, None), "g3": (None, None)}
    windows = spark.createDataFrame([("p", 1, box(0, 0, 5, 5)), ("q", 2, box(0, 0, 5, 5))], f"paper_id string, page int, bbox {kind}")
    assert {r.id for r in evaluate.in_windows(nodes, anchors, windows).collect()} == {"n1", "n2"}
    m = evaluate.metrics(nodes.where("false"), precision=F.lit(True)).first()
    assert (m.passed, m.total, m.rate) == (0, 0, None)


def test_versions(spark):
    old = spark.createDataFrame([("o1", "x", "A"), ("o2", "y", "A"), ("o3", "y", "B"), ("o4", "w", "A"), ("o5", "w", "A")], "id string, t string, type string")
    new = spark.createDataFrame([("n1", "x", "B"), ("n2", "y", "B"), ("n3", "w", "A"), ("n4", "q", "A")], "id string, t string, type string")
    got = {r.new_id: (r.old_id, r.state) for r in evaluate.predecessors(old, new, ["t"]).collect()}
    assert got == {"n1": ("o1", "PAIRED"), "n2": ("o3", "PAIRED"), "n3": (None, "AMBIGUOUS"), "n4": (None, "NEW")}
