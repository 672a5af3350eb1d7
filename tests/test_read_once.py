"""What several steps of a query stand on is read and shuffled once."""

from __future__ import annotations

import os

import pytest

from corroborate.plans import registry
from corroborate.plans.metric_plans import cohort

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def lines_read(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey#")


def test_a_cohort_reads_its_observations_once(spark):
    assert lines_read(cohort(spark, SF)) == 1


@pytest.mark.parametrize("name, times", [("DIF13", 2), ("DIF09", 0), ("DIF14", 0), ("JON24", 0), ("EVL04", 0)])
def test_shared_steps_are_made_once(spark, name, times):
    """Two releases for DIF13; the others read what they wrote before."""
    assert lines_read(registry.queries()[name](spark, SF)) == times
