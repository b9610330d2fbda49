"""Registered queries against their SQL on the smallest tables."""

import glob
import importlib.util
import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "url_split", "normalize_url_canonical", "normalize_url_browser", "url_features_modern", "validate_nav_event", "classify_navigation",
    "assign_alerts", "cache_replay", "verdict_cache_asof", "guarded_lookup", "classify_disabled", "quota_guard", "dedup_anchored", "selection_counts", "registration_features", "lookup_projection",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def entry_points():
    spec = importlib.util.spec_from_file_location("entry_points", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, entry_points, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    ours = Counter(tuple(row[c] for c in columns) for row in df.collect())
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert ours == theirs


#: Queries that SQL can't express, and what tests them instead.
WITHOUT_SQL = {"train_url_model": "fits a model; tests/test_models_streams.py checks its facts"}


def test_every_query_has_sql_or_reason(entry_points):
    """The corpus operators name their own reasons, in their own tests."""
    own = set(entry_points.queries()) - set(entry_points.LLM)
    assert own - set(entry_points.oracle_sql()) == set(WITHOUT_SQL)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
