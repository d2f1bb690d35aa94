"""Queries give the same result however many range partitions cut their keys, and building them starts no job."""
import pytest

from check import QUERIES as ALL
from check import compare
from crestline.operators import folds
from crestline.operators.ranged import release

CUT = ["segments", "segments_min", "delta_encode", "thin_greedy", "merge_stronger", "state_funnel", "section_timeline",
       "section_grid", "cyclic_assign", "split_snap", "head_tail_continuity", "novelty_bounds", "nest_unnest"]
LAZY = CUT + ["vector_harmonicity", "provenance", "largest_remainder", "select_supporting", "diversity_topk", "second_moment",
              "lineage_documents", "downsample_bins", "feedback_attribution"]


@pytest.mark.parametrize("name", CUT)
def test_cut_keys_change_nothing(spark, duck, sf, name, monkeypatch):
    """As many partitions as most keys have rows, and folds cut every key of more than three rows."""
    monkeypatch.setattr(folds, "MAX_ROWS", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert compare(spark, duck, sf, name).startswith("ok")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        release()


@pytest.mark.parametrize("name", LAZY)
def test_building_starts_no_job(spark, sf, name):
    context, group = spark.sparkContext, f"build-{name}"
    context.setJobGroup(group, "")
    ALL[name](spark, sf)
    context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = [[tracker.getStageInfo(s) for s in tracker.getJobInfo(j).stageIds] for j in tracker.getJobIdsForGroup(group)]
    # opening a table reads one footer for its schema: a job of one stage with one task
    assert not [job for job in stages if len(job) > 1 or any(s and s.numTasks > 1 for s in job)]
