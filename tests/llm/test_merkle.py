"""The manifest against trees in plain lists, with few levels a pass so that several passes run."""

import random
import zlib
from hashlib import sha256

import pytest
from oracle import SF, connect, rows_of, rows_of_sql
from pyspark.sql import functions as F

from docweft.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([leaf(r) for r in trees[x]]) for x in langs}
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, row in enumerate(trees[x]):
            way, at = [], i
            for tree, at in ((built[x], i), (top, k)):
                for nodes in tree[:-1]:
                    way.append((at & 1, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""))
                    at //= 2
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            folded = leaf((*row[:3], row[3] + 1, row[4])) if changed else leaf(row)
            for right, other in way:
                folded = h(other + folded if right else folded + other)
            out.append((row[0], leaf(row), built[x][-1][0], top[-1][0], h("".join(o for _, o in way)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def verified(df):
    changes, where = {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.verify(df, FIELDS, "lang", "doc_id", changes, where)
    return sorted(map(tuple, out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("strip", [1, 2, 3, 10])
def test_trees(spark, monkeypatch, strip):
    """Trees of 1 to 300 leaves, most of them one language's, with nulls, equal ids and equal rows."""
    monkeypatch.setattr(merkle, "STRIP", strip)
    rng = random.Random(7)
    sizes = {"en": 300, None: 5, "": 1, "de": 17, "é": 2, "ﬁ": 16, "z": 33, "😀": 3}
    rows = [(rng.randrange(10**6), rng.choice(["a", None, ""]), lang, rng.choice([None, 5, -1]), rng.choice(["", None, "text é", "x" * 3000])) for lang, n in sizes.items() for _ in range(n)]
    rows += [(None, None, None, None, None), (None, None, "en", 3, "y"), rows[0], rows[0], (rows[1][0], "other", "en", 1, "t")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as tree", "2 as level", "'w' as hash", "1 as place", "0 as run")
    assert verified(df.repartition(3)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_small(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "STRIP", 2)
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert verified(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_trees(spark, monkeypatch):
    """As many trees as rows: the tree above is the large one."""
    monkeypatch.setattr(merkle, "STRIP", 3)
    rows = [(i, "s", f"l{i}", 1, "t") for i in range(90)]
    assert verified(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    assert verified(spark.createDataFrame([], SCHEMA)) == []


def test_store(spark, monkeypatch):
    """All nodes of all levels are in the store, by level, and a leaf's way leads to the root."""
    monkeypatch.setattr(merkle, "STRIP", 2)
    rows = [(i, "s", "en", 1, "t") for i in range(21)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, "lang", "doc_id")
    want = levels([leaf(r) for r in rows])
    got = sorted((r.level, r.place, r.hash) for s in made.store.strips for r in s.collect())
    assert got == [(k, i, x) for k, nodes in enumerate(want) if k for i, x in enumerate(nodes)]
    assert made.root == want[-1][0]
    assert all(merkle.fold(r.hash, r.steps) == made.root for r in made.ways.collect())
    assert merkle.fold("0" * 64, made.ways.first().steps) != made.root


def test_sql(spark):
    name = "op13_merkle"
    assert rows_of(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(), queries.ORACLES[name])
