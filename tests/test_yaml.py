"""YAML by path, against a YAML library where one is there."""

import json
import random

import pytest

from docweft.functions import yaml

TEXT = """---
title: "A: b" # c
n: 12
none: ~
empty:
list:
- one
- two: 2
  three:
    - a
    - {k: v, l: [1, 'q''s']}
nested:
  - - 1
    - 2
  - key: |
      text
        more

      end
    other: >-
      folded
      line

      para
'quoted key': 'it''s'
map: {}
"""


@pytest.mark.parametrize(
    ("path", "want"),
    [("title", "A: b"), ("list[1].three[1].l[1]", "q's"), ("nested[0][1]", 2), ("nested[1].key", "text\n  more\n\nend\n"), ("nested[1].other", "folded line\npara"), ("map", {}), ("none", None), ("empty", None), ("list[1].three[1]", {"k": "v", "l": [1, "q's"]})],
)
def test_paths(path, want):
    assert yaml.at(yaml.loaded(TEXT), path) == want


@pytest.mark.parametrize("path", ["list[9]", "list.two", "title.x", "n[0]", "no", "", "a..b", "[0]"])
def test_missing_paths(path):
    with pytest.raises(yaml.Fault):
        yaml.at(yaml.loaded(TEXT), path)


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !t 1", "a: [1", "\tb: 1", "a: 1\n  b: 2", "- a\nb: 1", 'a: "x', "a: b: c", "a:\n - x\n- y", "- x\n-y", "a: {b 1}", "a: |9x\n b", "a: 'x' y"])
def test_faults(text):
    with pytest.raises(yaml.Fault, match="line"):
        yaml.loaded(text)


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", None), ("---\n", None), ("# c\n", None), ("x", "x"), ("a:\n  word", {"a": "word"}), ("a: yes\nb: 'yes'\nc: 010\nd: 1e3\ne: -.5", {"a": True, "b": "yes", "c": "010", "d": "1e3", "e": -0.5}), ("a: 1\na: 2", {"a": 2}), ("a: 1\n---\nb: 2", {"a": 1}), ("a:\r\n- b\r\n", {"a": ["b"]})])
def test_small(text, want):
    assert yaml.loaded(text) == want


def test_any_dump():
    other = pytest.importorskip("yaml")
    rng = random.Random(3)
    words = ["a", "b c", "it's", 'q "x"', "1", "true", "null", "-", "- x", "a: b", "#c", " lead", "x #y", "", "[z]", "{k}", "é你", "1.5", "~", "a,b", "http://x.y/z", "100%", "@at", "*s", "&a", "!t", "? q", "| p", "> p", "1e3", ": c", "c :", "no"]

    def value(depth):
        k = rng.random()
        if depth > 3 or k < 0.5:
            return rng.choice([*words, 1, -2, 1.5, True, False, None, [], {}])
        if k < 0.75:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "c d", "k-1", "x.y", "true x", "q'"]): value(depth + 1) for _ in range(rng.randrange(4))}

    for _ in range(1500):
        made = {"r": value(0), "s": value(0)}
        for how in ({"default_flow_style": False}, {"default_flow_style": None}, {"indent": 4, "default_flow_style": False}):
            text = other.safe_dump(made, allow_unicode=True, width=10**6, **how)
            assert json.dumps(yaml.loaded(text), sort_keys=True) == json.dumps(made, sort_keys=True), text


def test_columns(spark):
    df = spark.createDataFrame([(TEXT, "list[1].two"), (TEXT, "map"), (TEXT, "gone"), (TEXT, None), (None, "a"), ("a: [", "a"), (TEXT, "none")], "text string, path string")
    assert [tuple(r.f) for r in df.select(yaml.found(df.text, df.path).alias("f")).collect()] == [("2", None), ("{}", None), (None, "missing gone"), (None, "no path"), (None, "missing a"), (None, "line 1: missing ]"), (None, None)]
    rows = spark.createDataFrame([("a:\n  b: [1, {c: x}]\n  d: ''\n",), (None,), ("a: [",)], "text string")
    assert [[(p.path, p.value) for p in r.p] if r.p is not None else None for r in rows.select(yaml.paths(rows.text).alias("p")).collect()] == [[("a.b[0]", "1"), ("a.b[1].c", "x"), ("a.d", "")], [], None]
