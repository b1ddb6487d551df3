"""Queries against their SQL on tables of an odd shape: reads that are all too short for a window, reads of few samples."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from oracle import compare, duck
from sigspark.functions.signal import np_despike

SOURCE = "/root/testdata/sf0.001"


def _tables(folder, name: str, rows: str) -> str:
    """The test tables with one of them replaced by what ``rows`` selects."""
    for file in os.listdir(SOURCE):
        if file != f"{name}.parquet":
            os.symlink(f"{SOURCE}/{file}", folder / file)
    duckdb.sql(f"COPY ({rows}) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def few_samples(tmp_path_factory):
    """Reads of 1 to 9 samples, some of equal ones; none is eligible for the profiles of the queries."""
    return _tables(tmp_path_factory.mktemp("few"), "events", f"""
      WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM '{SOURCE}/events.parquet' LIMIT 900)
      SELECT r * 1000 AS event_id, ts, r % 90 AS user_id, event_type, CASE WHEN r % 7 = 0 THEN 900 ELSE value END AS value, props
      FROM e WHERE r // 90 <= r % 9""")


def _difference(spark, folder: str, name: str) -> str | None:
    import __spark_entry__ as entry

    return compare(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name])


def test_chunk_store_without_an_eligible_read(spark, few_samples):
    assert _difference(spark, few_samples, "chunk_store") == "both are empty"


def test_embed_store_without_an_eligible_read(spark, few_samples):
    assert _difference(spark, few_samples, "embed_store") == "both are empty"


def test_stream_classify_without_an_eligible_read(spark, few_samples):
    assert _difference(spark, few_samples, "stream_classify") == "both are empty"


def test_stream_resume_without_an_eligible_read(spark, few_samples):
    assert _difference(spark, few_samples, "stream_resume") == "both are empty"


def test_stream_counters_limited_to_no_read(spark, few_samples):
    assert _difference(spark, few_samples, "stream_counters") == "both are empty"


def test_central_mad_of_few_samples(spark, few_samples):
    assert _difference(spark, few_samples, "central_mad") is None


def test_despike_of_few_samples(spark, few_samples):
    assert _difference(spark, few_samples, "despike") is None


def test_despike_keeps_a_single_sample():
    assert np_despike(np.array([7.0]), 8, 3.0).tolist() == [7.0]


def test_profile_sclamp_of_few_samples(spark, few_samples):
    assert _difference(spark, few_samples, "profile_sclamp") is None
