"""Blocks, candidates and process groups on literal cases."""

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.operators import extract, layout

BLOCK = "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, kind string"


def test_join_fragments(spark):
    rows = [
        ("d", 1, 0, "Fig. 1 A caption", 0.0, 100.0, 100.0, 150.0, 9.0, "paragraph"),
        ("d", 1, 1, "the right hand column of the caption goes on with more than fifty letters", 110.0, 101.0, 210.0, 155.0, 9.0, "paragraph"),
        ("d", 1, 2, "x + y", 40.0, 300.0, 80.0, 312.0, 9.0, "paragraph"),
        ("d", 1, 3, "= z\n(1)", 50.0, 302.0, 200.0, 314.0, 9.0, "paragraph"),
        ("d", 1, 4, "Body text that lies elsewhere on the page.", 0.0, 500.0, 200.0, 540.0, 9.0, "paragraph"),
    ]
    out = layout.join_fragments(spark.createDataFrame(rows, BLOCK)).orderBy("ord").collect()
    assert [r.ord for r in out] == [0, 1, 2]
    assert out[0].text.startswith("Fig. 1 A caption\nthe right") and out[0].x1 == 210.0
    assert out[1].text == "x + y\n= z\n(1)" and (out[1].x0, out[1].y0, out[1].x1, out[1].y1) == (40.0, 300.0, 200.0, 314.0)


def test_titles(spark):
    rows = [("d", 1, 0, "ARTICLE\nA rather long title here", 0.0, 10.0, 9.0, 30.0, 18.0, "heading"), ("d", 1, 1, "and its second line", 0.0, 40.0, 9.0, 60.0, 18.0, "heading"), ("d", 1, 2, "Body.", 0.0, 70.0, 9.0, 90.0, 9.0, "paragraph"), ("d", 1, 3, "Another long heading of that size", 0.0, 95.0, 9.0, 99.0, 18.0, "heading")]
    assert layout.titles(spark.createDataFrame(rows, BLOCK)).first().title == "A rather long title here and its second line"


def test_column_order(spark):
    rows = [("d", 1, 0, "r" * 300, 60.0, 20.0, 95.0, "", 100.0, 100.0), ("d", 1, 1, "l" * 300, 5.0, 50.0, 45.0, "", 100.0, 100.0), ("d", 1, 2, "top", 5.0, 2.0, 90.0, "", 100.0, 100.0), ("d", 2, 0, "b", 60.0, 20.0, 95.0, "", 100.0, 100.0), ("d", 2, 1, "a", 5.0, 10.0, 45.0, "", 100.0, 100.0)]
    df = spark.createDataFrame(rows, "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, kind string, width double, height double")
    got = [(r.page, r.text[:3]) for r in layout.column_order(df).orderBy("page", "ord").collect()]
    assert got == [(1, "top"), (1, "lll"), (1, "rrr"), (2, "b"), (2, "a")]


def test_heading_kind_and_running(spark):
    df = spark.createDataFrame([("Results", 9.0, False, 10.0), ("Chart label", 8.0, True, 10.0), ("A big heading", 16.0, False, 10.0), ("footer text", 16.0, True, 96.0)], "t string, f double, b boolean, y double")
    got = [r.h for r in df.select(layout.heading(F.col("t"), F.col("f"), F.col("b"), F.when(F.col("t") == "Results", F.array("t")).otherwise(F.array().cast("array<string>")), F.col("y"), F.lit(100.0), F.lit(11.0)).alias("h")).collect()]
    assert got == [True, False, True, False]
    rows = [("d", 1, "Journal  Name", 2.0), ("d", 2, "journal name", 2.0), ("d", 2, "Only once", 2.0), ("d", 1, "in the middle", 50.0), ("d", 2, "in the middle", 50.0)]
    marked = layout.mark_running(spark.createDataFrame(rows, "doc_id string, page int, text string, y0 double").withColumn("kind", F.lit("paragraph")), F.col("y0") < 10)
    assert sorted(r.text for r in marked.where("kind = 'header'").collect()) == ["Journal  Name", "journal name"]


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, "<nav><li><a href='/x'>x</a></li></nav><h1>Head <b>line</b></h1><p>One.<p>Two.</p>")], "page_id long, html string")
    assert [(r.kind, r.text) for r in layout.html_blocks(df).orderBy("ord").collect()] == [("header", "x"), ("heading", "Head line"), ("paragraph", "One."), ("paragraph", "Two.")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Although the older device is capable of speed, it suffers from heat in most of its uses.", None),
        ("Our method suffers from a major limitation when the temperature is raised to a high value.", "LIMITATION"),
        ("We further extracted the barrier height as a function of the gate voltage in this range.", "RELATIONSHIP_ANALYSIS"),
        ("We employed a calibrated instrument for all of the measurements that are reported here.", "METHOD"),
        ("We show that the gain is larger than that of every earlier design of the same kind.", "RESULT"),
        ("We assume that the field is uniform, and we show that the current then is linear.", "ASSUMPTION"),
        ("Too short to count.", None),
    ],
)
def test_cascade(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract.classify(tx.searchable(F.col("t")), F.lit(False), F.lit(False)).alias("x")).first().x == expected


def blocks(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "doc_id string, page int, ord int, kind string, text string, section_titles array<string>")


def test_dispatch(spark):
    df = blocks(spark, [(1, 0, "paragraph", "Fig. 2 The efficiency is defined as the ratio of both of the powers here.", []), (1, 1, "paragraph", "Table 1: x", []), (1, 2, "paragraph", "E = mc\n(3)", []), (1, 3, "heading", "Article\nResults", []), (1, 4, "header", "We show that nothing here is ever read by the extraction.", []), (1, 5, "paragraph", "plane (0112) of the crystal = sapphire in the figure", [])]).withColumn("methods", F.lit(False))
    got = [(r.ord, r.type) for r in extract.candidates(df).orderBy("ord", "n").collect()]
    assert got == [(0, "FIGURE"), (0, "DEFINITION"), (1, "TABLE"), (2, "EQUATION"), (3, "SECTION")]
    nodes, evidence, edges = extract.materialise(extract.candidates(df))
    assert nodes.count() == evidence.count() == edges.count() == 5
    assert {r.verification_status for r in nodes.collect()} == {"CANDIDATE"}


def test_processes(spark):
    df = blocks(
        spark,
        [
            (1, 0, "heading", "Methods", []),
            (1, 1, "paragraph", "The gold film was deposited in vacuum at a low rate of growth. The whole substrate was cleaned in acetone before any use.", []),
            (1, 2, "paragraph", "Contact formation", []),
            (1, 3, "paragraph", "The metal contacts were patterned by means of optical lithography. The spectra were acquired at room temperature with a green laser.", []),
            (1, 4, "paragraph", "The flakes were transferred onto the silicon chips with a stamp. The optical response was measured under the laser light.", []),
            (1, 5, "heading", "References", []),
            (1, 6, "paragraph", "The other film was deposited by another group in a former work.", []),
        ],
    )
    got = extract.processes(extract.section_state(df)).where(F.col("purpose") == extract.FABRICATION).collect()
    assert sorted(tuple(r["keys"]) for r in got) == [("1:1",), ("1:3", "1:4")]


def test_continuation(spark):
    df = blocks(spark, [(1, 0, "heading", "Methods", []), (1, 1, "paragraph", "First the gold film was deposited in vacuum. Then the whole of the wafer was etched in a bath of", []), (1, 2, "paragraph", "warm acid for one hour. Nothing else was done.", [])])
    got = extract.processes(extract.section_state(df)).collect()
    assert [tuple(r["keys"]) for r in got] == [("1:1", "1:2")] and "warm acid for one hour." in got[0].text


def test_boxes(spark):
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (1, 2, 3, 4), strict=True)))
    row = spark.range(1).select(*(layout.displayed_box(box, F.lit(10.0), F.lit(20.0), F.lit(r)).alias(f"r{r}") for r in (0, 90, 180, 270))).first()
    assert tuple(row.r0) == (1, 2, 3, 4) and tuple(row.r90) == (16, 1, 18, 3) and tuple(row.r180) == (7, 16, 9, 18) and tuple(row.r270) == (2, 7, 4, 9)


def test_a_sentence_is_normalised_once(spark):
    """However many cues ask for it: the plan splits and normalises a sentence in one place, and none in a filter."""
    blocks = spark.createDataFrame([("d", 1, 0, "We argue it. Other words.", "paragraph", [], False), ("d", 1, 1, None, "paragraph", None, False)], "doc_id string, page int, ord int, text string, kind string, section_titles array<string>, methods boolean")
    found = extract.candidates(blocks, unicode=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]|[a-z]") == 1 and plan.count("[-‐]") == 1
    assert all("regexp" not in line and "rlike" not in line.lower() for line in plan.splitlines() if "Filter" in line)
    assert [r.text for r in found.collect()] == []
