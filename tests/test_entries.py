"""Every registered query on the smallest tables, each within a time limit. It takes a while, so it
runs where QUARRY_SMOKE=1 is set."""

import os
import signal

import pytest

import __spark_entry__ as E

LIMIT = 240  # seconds for one query


@pytest.mark.skipif(os.environ.get("QUARRY_SMOKE") != "1", reason="set QUARRY_SMOKE=1")
@pytest.mark.parametrize("name", sorted(E.queries()))
def test_entry_runs(spark, sf, name):
    def late(*_):
        raise TimeoutError(f"{name} took over {LIMIT} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LIMIT)
    try:
        df = E.queries()[name](spark, sf)
        assert df.columns and len(set(df.columns)) == len(df.columns)
        df.write.format("noop").mode("overwrite").save()
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
