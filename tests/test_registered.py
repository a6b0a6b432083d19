"""Every registered query against its DuckDB SQL at the smallest scale, in two session zones."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from check_oracles import compare, connect
from edgelog.plans.oracles import ORACLES
from edgelog.plans.workload import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["metrics_timeseries", "display_labels", "log_roundtrip", "entity_lookup"])
def test_session_zone_plays_no_part(spark, con, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        test_query(spark, con, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entry(spark):
    assert registered.entry(spark).count() == 1
