"""The derived log shows whole replies, and its text comparison is that of whole replies."""

import pytest

from checks.bindings import RUN_LOG, bind
from checks.queries import QUERIES
from tests.test_pairwise import similarity

SF_DIR = "/root/testdata/sf0.001"


def test_replies_are_whole(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr("event_id AS pos", "props").distinct()
    rows = bind(spark, SF_DIR, RUN_LOG).where("success and response <> 'plain text'").join(events, "pos").collect()
    assert rows and all(r.props in r.response for r in rows)


def test_consistency_of_whole_replies(spark):
    rows = bind(spark, SF_DIR, RUN_LOG).select("model", "pos", "response").collect()
    want = similarity([tuple(r) for r in rows])
    assert {r.model: r.format_consistency for r in QUERIES["format_consistency_log"](spark, SF_DIR).collect()} == pytest.approx(want, abs=1e-6)
