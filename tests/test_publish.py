"""Files that appear all or none: failures, second runs, deletions, a driver that died."""

import json
import os

import pytest

from docweft.sources import publish


def tree(root):
    """What is published; a killed task may leave staged files."""
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file() and publish.STAGING not in p.parts}


def put(spark, root, files, **options):
    publish.publish(spark.createDataFrame([*files.items()], "path string, content string").repartition(3), f"file://{root}", **options)


OLD = {"INDEX.md": "old index", "cards/a.md": "a", "cards/b.md": "b"}
NEW = {"INDEX.md": "new index é", "cards/a.md": "a", "cards/c.md": "c", "map/knowledge-map.md": "map", "cards/b.md": None}


def test_all_or_none(spark, tmp_path):
    root = tmp_path / "out"
    put(spark, root, OLD)
    assert tree(root) == OLD
    for name in ("INDEX.md", "cards/c.md", "cards/b.md", "map/knowledge-map.md"):  # wherever the commit breaks off
        with pytest.raises(Exception, match="cannot move"):
            put(spark, root, NEW, fail_at=name)
        assert tree(root) == OLD
    times = os.stat(root / "cards/a.md").st_mtime_ns
    put(spark, root, NEW)
    want = {k: v for k, v in NEW.items() if v is not None}
    assert tree(root) == want
    assert os.stat(root / "cards/a.md").st_mtime_ns == times
    before = {p: os.stat(root / p).st_mtime_ns for p in want}
    put(spark, root, NEW)  # a second run writes nothing
    assert {p: os.stat(root / p).st_mtime_ns for p in want} == before and tree(root) == want


def test_faults_leave_the_old_tree(spark, tmp_path):
    root = tmp_path / "out"
    put(spark, root, OLD)
    for rows in ([("x", "1"), ("x", "2")], [("../x", "1")], [("/x", "1")], [(None, "1")], [(".staging/x", "1")]):
        with pytest.raises(Exception, match="two contents|inside the folder"):
            publish.publish(spark.createDataFrame([*rows, ("cards/a.md", "new")], "path string, content string").repartition(4), f"file://{root}")
        assert tree(root) == OLD
    publish.publish(spark.createDataFrame([], "path string, content string"), f"file://{root}")
    assert tree(root) == OLD


def test_a_driver_that_died_within_its_commit(spark, tmp_path):
    """The journal tells what had been moved: a replaced, a new and a not yet moved file."""
    root = tmp_path / "out"
    put(spark, root, OLD)
    batch = root / publish.STAGING / "dead"
    batch.mkdir(parents=True)
    (root / "cards/a.md").rename(batch / "old-0")
    (root / "cards/a.md").write_text("half")
    (root / "cards/new.md").write_text("half")
    (batch / "s2").write_text("never moved")
    (batch / "journal").write_text(json.dumps([["cards/a.md", str(batch / "s0"), True], ["cards/new.md", str(batch / "s1"), False], ["cards/b.md", str(batch / "s2"), True]]))
    publish.recover(str(root))
    assert tree(root) == OLD
