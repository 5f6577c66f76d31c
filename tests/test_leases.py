"""Leases by timers: silence, renewal, arrival out of order, late events, state that goes."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from docweft.streaming import leases

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key string, ts timestamp, kind string"


def run(spark, tmp_path, batches, delay="10 minutes", lease=60, keep=10**6):
    """The lapses as (key, seconds after START, beats), from a stream that reads a file a batch."""
    at = tmp_path / "in"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(key, None if s is None else START + timedelta(seconds=s), kind) for key, s, kind in rows], SCHEMA)
        df.coalesce(1).write.parquet(f"{at}/n={k}")
    files = sorted(at.glob("n=*"), key=lambda p: int(p.name[2:]))
    import os

    for k, p in enumerate(files):  # a stream reads older files first
        for f in p.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(at))
    rows = leases.lapses(raw, F.col("kind") == "done", delay, lease, keep)
    out = leases.drained(spark, rows, f"file://{tmp_path}/stream").collect()
    first = int(START.timestamp() * 1000)
    return sorted((r.key, (r.deadline_ms - first) // 1000, r.beats) for r in out)


def test_silence_lapses_by_timer(spark, tmp_path):
    """a falls silent and never comes again, b renews in time, c is ended, d's last deadline lies beyond the watermark; arrival within a batch is unordered."""
    rows = [("a", 30, "x"), ("a", 0, "x"), *(("b", s, "x") for s in range(0, 3000, 60)), ("c", 0, "x"), ("c", 10, "done"), ("d", 2990, "x"), (None, 5, "x"), ("e", None, "x"), ("clock", 3000, "done")]
    assert run(spark, tmp_path, [rows]) == [("a", 90, 2)]


def test_batches_equal_one_table(spark, tmp_path):
    """Events that come in a later batch but within the delay fill the gap; taken anew, a key lapses again; what is behind the watermark is dropped."""
    batches = [
        [("a", 0, "x"), ("a", 120, "x"), ("clock", 400, "done")],
        [("a", 50, "x"), ("a", 100, "x"), ("b", 390, "x"), ("clock", 1500, "done")],  # within ten minutes of 400
        [("b", 2000, "x"), ("clock", 5000, "done")],
        [("a", 60, "x"), ("clock", 9000, "done")],  # 60 lies behind the watermark
        [("clock", 9000, "done")],
    ]
    got = run(spark, tmp_path, batches)
    assert got == [("a", 180, 4), ("b", 450, 1), ("b", 2060, 1)]
    rows = [(k, START + timedelta(seconds=s), kind) for b in batches for k, s, kind in b if (k, s) != ("a", 60)]
    mark = F.lit(int(START.timestamp() * 1000) + 8_400_000)
    table = leases.batch_lapses(spark.createDataFrame(rows, SCHEMA), F.col("kind") == "done", mark, 60).collect()
    assert sorted((r.key, (r.deadline_ms - int(START.timestamp() * 1000)) // 1000, r.beats) for r in table) == got


def test_kept_state_goes(spark, tmp_path):
    """What comes within `keep` of a terminal event is swallowed; after that the key is new."""
    batches = [[("a", 0, "done"), ("clock", 700, "x")], [("a", 150, "x"), ("clock", 2000, "done")], [("a", 1500, "x"), ("clock", 5000, "x")], [("clock", 5000, "x")]]
    assert [x for x in run(spark, tmp_path, batches, keep=300) if x[0] == "a"] == [("a", 1560, 1)]


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, [[]]) == []
