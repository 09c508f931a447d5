import os

import pytest

import __spark_entry__ as entry
import check

SMALL = "/root/testdata/sf0.001"
QUICK = ("ensemble_msd", "fit_anomalous", "mobility_summary", "turning_angles", "welch_t", "circular_stats", "link_candidates", "dbscan",
         "roi_polygon_filter", "wavelet_w2", "normalise_units", "stream_live_counts")


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
@pytest.mark.parametrize("name", QUICK)
def test_quick_queries(spark, name):
    ok, msg = check.compare(entry.queries()[name](spark, SMALL), check.connect(SMALL), entry.oracle_sql()[name])
    assert ok, msg


@pytest.mark.slow
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_all_queries(spark, name):
    ok, msg = check.compare(entry.queries()[name](spark, SMALL), check.connect(SMALL), entry.oracle_sql()[name])
    assert ok, msg
