"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from captionforge.operators import buckets as B, positions as P
from captionforge.registry.inputs import bucketed, captioned
from captionforge.plans import training_set

PURE_COLUMNS = [
    "strip_openings_all", "strip_openings_fold", "caption_reject", "clean_text", "prompt_template", "phase_row", "quality_report",
    "join_recaption", "bucket_index", "bucket_batches", "train_test_split_stratified", "interleave_prob", "text_search",
    "ema_series", "noise_mix", "cond_dropout", "training_rows_per_bucket", "training_feed",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE_COLUMNS)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(queries()[name](spark, sf_dir))
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_index_reads_only_the_columns_it_needs(spark, sf_dir):
    plan = plan_of(bucketed(spark, sf_dir))
    assert "o_totalprice" not in plan and "o_custkey" not in plan


def test_shape_filter_reaches_the_scan_side_of_caption_cleaning(spark, sf_dir):
    plan = plan_of(training_set.build(captioned(spark, sf_dir), "h", "w"))
    # the resolution filter runs below the caption rewrite
    assert plan.index("Generate") < plan.rindex("Filter")


def test_numbering_has_no_window_over_rows(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert "Window" not in plan_of(P.with_group_index(df, ["g"], ["id"]))
    assert "Window" not in plan_of(P.with_row_index(df, ["id"]))
    assert "Window" not in plan_of(B.bucket_index(df, "id", "g"))


def test_top_k_is_trimmed_before_the_shuffle(spark, sf_dir):
    assert plan_of(queries()["text_search"](spark, sf_dir)).count("WindowGroupLimit") == 2

