"""The store's queries put every event into their library, whatever part of it they return."""

import pytest
from conftest import SF

from tidemark.queries import QUERIES
from tidemark.sources.library import Library

STORED = sorted(n for n in QUERIES if n.startswith("store_") or n == "stream_staging")


@pytest.mark.parametrize("name", STORED)
def test_every_event_is_stored(spark, monkeypatch, name):
    seen = set()
    for verb in ("write", "append", "stage", "merge", "write_partitioned"):

        def put(self, symbol, data, *a, _verb=getattr(Library, verb), **k):
            seen.update(int(r[0]) for r in data.select("event_id").collect())
            return _verb(self, symbol, data, *a, **k)

        monkeypatch.setattr(Library, verb, put)
    QUERIES[name](spark, SF).collect()
    assert seen == {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
