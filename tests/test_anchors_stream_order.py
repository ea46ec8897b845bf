"""FIXTURES anchors on the driver tables, and the stateful stream fed out of order."""

import os

import pytest
from pyspark.sql import functions as F

from support_signals.config import TEST_CONFIG
from support_signals.operators import trend
from support_signals.sources import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_fixture_anchors_sf0001(spark):
    t = views.tickets(spark, SF)
    r = trend.trend_batch(t, TEST_CONFIG).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_potential_trend").alias("flagged"),
        F.sum("similar_count").alias("pairs"), F.max("similar_count").alias("mx")).collect()[0]
    assert (r.n, r.flagged, r.pairs, r.mx) == (500, 49, 547, 6)


def test_interval_join_stream_out_of_order(spark):
    """Drops arrive newest first; with a watermark delay longer than the data
    span the stateful join still finds every batch match."""
    from support_signals.streaming.incoming import TICKET_COLUMNS, arrive, run_matches, scratch_root, time_slices
    t = views.tickets(spark, SF)
    root = scratch_root(spark, "test-unordered")
    src = root + "/source"
    sliced = time_slices(t, 3)
    q = None
    for i in (2, 0, 1):
        arrive(sliced, src, i)
        if q is None:
            q, out = run_matches(spark, src, t.select(*TICKET_COLUMNS).schema, TEST_CONFIG, root,
                                 delay="40 days", continuous=True)
        q.processAllAvailable()
    q.stop()
    got = {(r.trigger_id, r.similar_id) for r in spark.read.parquet(out).collect()}
    want = {(r.trigger_id, r.similar_id) for r in trend.trend_detail(t, TEST_CONFIG).collect()}
    assert got == want and len(want) == 547


def test_interval_join_stream_salted(spark):
    from support_signals.streaming.incoming import TICKET_COLUMNS, arrive, run_matches, scratch_root, time_slices
    t = views.tickets(spark, SF)
    cfg = TEST_CONFIG.with_(stream_salts=3)
    root = scratch_root(spark, "test-salted")
    src = root + "/source"
    sliced = time_slices(t, 2)
    arrive(sliced, src, 0)
    q, out = run_matches(spark, src, t.select(*TICKET_COLUMNS).schema, cfg, root, continuous=True)
    q.processAllAvailable()
    arrive(sliced, src, 1)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == 547
