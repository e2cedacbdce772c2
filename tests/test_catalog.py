"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import compare, connect  # noqa: E402

from cueweave.catalog import QUERIES  # noqa: E402
from cueweave.catalog_sql import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "parse_srt parse_ass render_srt overlap_candidates time_align merge_preserved number_anchors robust_offset "
    "timeline_segments anti_jitter sync_report pick_dialogue stream_dedup stream_sessions"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]).startswith("ok")


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
