"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import os
from functools import partial

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from millrace.queries import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Queries of the training-data operators may have none.
WITHOUT_SQL = set(entry.LLM_QUERIES) - set(ORACLES)

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason=f"{SF_DIR} is not there")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


@needs_data
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["route_id", "batch_id", "flush_at", "reason", "n_entries", "payload"]
    assert not rows.isEmpty()


@needs_data
def test_a_batch_in_parts_is_one_batch(spark, duck, monkeypatch):
    parts = []

    class Parted(registry.TableBuffer):
        def poll(self, *args):
            batches = super().poll(*args)
            if batches is not None:
                parts.extend(row["part"] for row in batches.select("part").collect())
            return batches

    monkeypatch.setattr(registry, "TableBuffer", partial(Parted, max_part_lines=40, slice_span=16))
    name = "stream_table_buffer"
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == []
    assert max(parts) > 0
