"""Every registered query of the engine: against its SQL twin where it has one, else that it runs."""

import pytest
from oracle import SF, connect, rows_of, rows_of_sql

from docweft.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, name):
    cols, rows = rows_of(QUERIES[name](spark, SF))
    if name in ORACLES:
        want_cols, want = rows_of_sql(connect(), ORACLES[name])
        assert cols == want_cols
        assert rows == want
    else:
        assert rows


def test_stream_equals_batch(spark):
    _, stream = rows_of(QUERIES["stream_job_states"](spark, SF))
    _, batch = rows_of(QUERIES["job_states"](spark, SF))
    assert stream == batch


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
