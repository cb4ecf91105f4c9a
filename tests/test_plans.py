"""The shape of the plans: what would not survive a thousand times the data must not appear."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from masteria import fixtures as fx
from masteria.operators import leaderboard as lb
from masteria.operators import population as po
from masteria.plans.joins import lookup_join

FOLDER = "/root/testdata/sf0.001"


def plan(frame, mode="formatted"):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def main_tree(frame):
    """The physical tree without its subqueries."""
    return plan(frame).split("===== Subqueries =====")[0]


# Rows that reach a single task: a limit, a scalar, or one row per task, skill or benchmark.
WHOLE_WINDOWS = {
    "benchmark_order", "skills_per_benchmark",  # one row per benchmark
    "grid_order", "group_starts", "sector_runs", "sector_runs_by_id",  # one row per skill
    "leaderboard_sort", "leaderboard_sort_index", "leaderboard_sort_name", "leaderboard_sort_acc",
    "leaderboard_sort_acc_asc", "leaderboard_sort_skill", "display_rank", "leaderboard_grid",  # one row per range
    "facet_ranks", "facet_page",  # one row per 32,768 models
    "top_models", "matrix_slice",  # after a limit
}
SCALARS = {"check_shape", "check_binary", "check_alignment", "catalogue_counts", "skill_match_total", "filter_counts", "facet_counts",
           "accuracy_summary", "compare_suggestion", "unmatched_responses",
           "check_shape_dense", "check_binary_dense", "check_alignment_dense"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.TEXT_QUERIES)))
def test_no_harmful_node(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    text = plan(frame)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in text, node
    if name != "skill_pca_map":
        assert "InPandas" not in text and "MapInArrow" not in text
    tree = main_tree(frame)
    if "SinglePartition" in tree:
        assert name in WHOLE_WINDOWS | SCALARS
    if name in SCALARS:  # aggregated in each task before anything is brought together
        assert re.search(r"partial_|Keys: \[\]", tree)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "models")
    fx.models(spark, FOLDER).write.parquet(path)
    models = spark.read.parquet(path)
    text = plan(lb.filter_models(models, families=["Phi"], tiers=["Small"]))
    assert re.search(r"PushedFilters: \[.*In\(family|PushedFilters: \[.*EqualTo\(family", text)
    assert "LessThanOrEqual(params,13.0)" in plan(lb.small_models(models))
    assert "theta" not in re.search(r"ReadSchema: .*", plan(lb.model_catalogue(models))).group()


def test_per_model_work_has_no_shuffle(spark):
    models, skills = fx.models(spark, FOLDER), fx.skills(spark, FOLDER)
    for frame in (lb.model_mean_theta(models), lb.profile_sparkline(models), lb.ranked_skills(models, skills)):
        assert "Exchange" not in main_tree(frame)


def test_cells_are_aggregated_before_the_shuffle(spark):
    models, skills = fx.models(spark, FOLDER), fx.skills(spark, FOLDER)
    for frame in (po.skill_means(models, skills), po.theta_variance(models, skills), po.skill_histograms(models, skills)):
        tree = main_tree(frame)
        assert tree.count("Exchange") <= 3 and "partial_" in tree and "SortAggregate" not in tree


def test_top_k_is_limited_in_each_task(spark):
    models, skills = fx.models(spark, FOLDER), fx.skills(spark, FOLDER)
    assert plan(po.top_models_per_skill(models, skills)).count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(lb.top_models(models))


def test_theta_is_computed_once_per_model(spark):
    """The conversion of theta must stay below the generator and out of other lambdas."""
    models, skills = fx.models(spark, FOLDER), fx.skills(spark, FOLDER)
    for frame in (lb.ranked_skills(models, skills), po.skill_means(models, skills), lb.profile_sparkline(models)):
        assert main_tree(frame).count("transform(embedding") <= 2  # named once per list in the formatted plan


def test_beyond_a_broadcast_the_join_is_split(spark):
    facts = spark.range(0, 10_000, 1, 4).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    frame = lookup_join(facts, dim, "k", rows=0)
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000
    joined = frame.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r.n > 4 for r in joined.collect())  # each of the three keys reaches most of the 8 partitions
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_stored_tables_are_dropped_unless_they_are_read(spark):
    from masteria.plans.storage import drop, recorded, stored

    with recorded() as tables:
        one, two = stored(spark.range(3), "one"), stored(spark.range(4), "two")
    assert stored(spark.range(1), "other").count() == 1 and len(tables) == 2
    assert drop(spark, tables, one.where("id > 0")) == tables[:1] and one.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(tables[1]).count()
    assert drop(spark, tables[:1], spark.range(1)) == []


def test_sets_as_bitmaps(spark):
    from masteria.plans import bitmaps

    numbers = {-70_000, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 10**12}
    frame = spark.createDataFrame([(n,) for n in numbers] + [(7,), (None,)], "n long")
    asked = sorted(numbers | {n + 1 for n in numbers} | {n - 1 for n in numbers})
    flags = bitmaps.flags(frame, "n")
    got = (spark.createDataFrame([(n,) for n in asked], "m long").join(flags, bitmaps.bucket(F.col("m")) == F.col("_bucket"), "left")
           .select("m", bitmaps.contains(F.col("_bits"), F.col("m"))).collect())
    assert {r[0] for r in got if r[1]} == numbers and len(got) == len(asked)
    sets = frame.groupBy(bitmaps.bucket(F.col("n")).alias("b")).agg(bitmaps.collected("n").alias("all"), bitmaps.collected("n", "n % 2 = 0").alias("even"))
    common = bitmaps.count_common(bitmaps.words(F.col("all")), bitmaps.words(F.col("even")))
    assert sets.agg(F.sum(common)).first()[0] == sum(n % 2 == 0 for n in numbers)


def test_responses_meet_bits_of_models_only(spark):
    """No row per response or item is shuffled for the share of items that small models win."""
    from masteria.queries import QUERIES

    plan = QUERIES["weak_beats_strong"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "theta" not in plan
