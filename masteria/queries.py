"""Every operator as a query over the given tables: name -> f(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from masteria import fixtures as fx
from masteria.functions import theta as th
from masteria.operators import catalogue as cat
from masteria.operators import cells as ce
from masteria.operators import compare as co
from masteria.operators import diagnostic as di
from masteria.operators import facets as fa
from masteria.operators import leaderboard as lb
from masteria.operators import population as po
from masteria.operators import responses as re
from masteria.operators import skillmap as sm
from masteria.operators import taxonomy as ta
from masteria.plans.storage import new_path
from masteria.sources import readers as rd
from masteria.sources.writers import write_models

Query = Callable[[SparkSession, str], DataFrame]

SEARCH = "  MODEL_1 "
FAMILIES = ("Llama", "Mistral", "Other", "Falcon")
TIERS = ("Small", "Mid", "Other")
SKILL_SEARCH = " Er The"
SORT_SKILL = 7


def _round(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


# Sources and sinks ---------------------------------------------------------------------------

def read_models(spark, folder):
    path = new_path(spark, "models")
    write_models(fx.models(spark, folder), path, "json")
    return _seen(rd.read_models(spark, path))


def _seen(models):
    return models.select("id", "name", "hf_id", "family", "tier", "params", th.mean(F.col("theta")).alias("mean_theta"))


def _as_array(frame, path, wrapper=None):
    """Write a table that is in the order of ``id`` as one JSON array: an element per line, in as many compressed files as there are tasks."""
    json = F.to_json(F.struct(*frame.columns))
    first = frame.agg(F.when(F.count_if(F.col("id").isNull()) == 0, F.min("id")).alias("id")).scalar()
    lines = frame.select(F.concat(F.when(F.col("id").eqNullSafe(first), "").otherwise(","), json).alias("value"))
    opening, closing = (frame.sparkSession.createDataFrame([(end,)], "value string").coalesce(1)
                        for end in (f'{{"{wrapper}": [' if wrapper else "[", "]}" if wrapper else "]"))
    # The partitions of a union follow each other, and so do its files.
    opening.union(lines).union(closing).write.option("compression", "gzip").text(path)


def read_models_array(spark, folder):
    path = new_path(spark, "models")
    _as_array(fx.models(spark, folder).orderBy("id"), path)
    return _seen(rd.read_models(spark, path))


def read_models_wrapped(spark, folder):
    path = new_path(spark, "models")
    _as_array(fx.models(spark, folder).orderBy("id"), path, "models")
    return _seen(rd.read_models(spark, path))


def read_models_parquet(spark, folder):
    path = new_path(spark, "models")
    write_models(fx.models(spark, folder), path)
    return _seen(rd.read_models(spark, path))


def read_cells(spark, folder):
    path = new_path(spark, "cells")
    ce.theta_cells(fx.models(spark, folder)).write.parquet(path)
    return rd.read_cells(spark, path)


def read_skills_array(spark, folder):
    path = new_path(spark, "skills")
    # Sorted before each text is repeated several times.
    documents = fx.table(spark, folder, "documents").orderBy("doc_id")
    _as_array(fx.catalogue_with_examples(spark, folder, documents), path)
    return _listed(rd.read_skills(spark, path))


def read_skills(spark, folder):
    path = new_path(spark, "skills")
    fx.catalogue_with_examples(spark, folder).write.json(path)
    return _listed(rd.read_skills(spark, path))


def _listed(skills):
    return skills.select(
        "id", "label", "label_english", "language", "primary_benchmark", "n_items",
        F.size("example_items").cast("bigint").alias("n_examples"))


def read_skill_map(spark, folder):
    path = new_path(spark, "map")
    fx.map_points(spark, folder).write.json(path)
    return _round(rd.read_skill_map(spark, path), 6, "x", "y")


def read_responses(spark, folder):
    path = new_path(spark, "responses")
    fx.answer_matrix(spark, folder).write.parquet(path)
    return rd.read_responses(spark, path).withColumn("correct", F.col("correct").cast("bigint"))


def read_items(spark, folder):
    return rd.read_items(fx.catalogue_with_examples(spark, folder)).select(
        "skill_id", "slot", "item_id", "benchmark", "text")


def write_models_query(spark, folder):
    path = new_path(spark, "scored")
    write_models(fx.scored_models(spark, folder), path)
    return spark.read.parquet(path).select("id", "name", "hf_id", "accuracy")


# Checks --------------------------------------------------------------------------------------

def check_shape(spark, folder):
    return re.check_shape(fx.responses(spark, folder), fx.respondents(spark, folder), fx.models(spark, folder))


def check_binary(spark, folder):
    return re.check_binary(fx.responses(spark, folder))


def check_alignment(spark, folder):
    return re.check_alignment(fx.respondents(spark, folder), fx.models(spark, folder))


def check_shape_dense(spark, folder):
    return re.check_shape(fx.dense_responses(spark, folder), fx.placed_respondents(spark, folder), fx.placed_models(spark, folder))


def check_binary_dense(spark, folder):
    return re.check_binary(fx.dense_responses(spark, folder))


def check_alignment_dense(spark, folder):
    return re.check_alignment(fx.placed_respondents(spark, folder), fx.placed_models(spark, folder))


def enrich_models(spark, folder):
    path = new_path(spark, "enriched")
    re.enrich_models(fx.placed_models(spark, folder), fx.dense_responses(spark, folder),
                     fx.placed_respondents(spark, folder), path)
    return spark.read.parquet(path).select("id", "name", "hf_id", "accuracy")


def responses_by_model(spark, folder):
    return re.by_model(fx.dense_responses(spark, folder), fx.placed_models(spark, folder)).select(
        "model_id", "item_id", F.col("correct").cast("bigint").alias("correct"))


# Cells ---------------------------------------------------------------------------------------

def theta_cells(spark, folder):
    return ce.theta_cells(fx.models(spark, folder))


def missing_cells(spark, folder):
    return ce.missing_cells(fx.models(spark, folder), fx.skills(spark, folder))


def relative_cells(spark, folder):
    return ce.relative_cells(fx.models(spark, folder), fx.skills(spark, folder))


def described_cells(spark, folder):
    return ce.described_cells(fx.models(spark, folder), fx.skills(spark, folder))


# Catalogues ----------------------------------------------------------------------------------

def skill_catalogue(spark, folder):
    return cat.skill_catalogue(fx.catalogue(spark, folder))


def catalogue_quality(spark, folder):
    return cat.catalogue_quality(fx.catalogue(spark, folder))


def model_catalogue(spark, folder):
    return lb.model_catalogue(fx.models(spark, folder))


def catalogue_counts(spark, folder):
    return ta.catalogue_counts(fx.models(spark, folder), fx.catalogue(spark, folder), fx.items(spark, folder))


def benchmark_order(spark, folder):
    return ta.benchmark_order(fx.catalogue(spark, folder))


def skills_per_benchmark(spark, folder):
    return ta.skills_per_benchmark(fx.catalogue(spark, folder))


def filter_skills(spark, folder):
    return ta.filter_skills(fx.catalogue(spark, folder), SKILL_SEARCH).select("id", "label", "label_english")


def skill_match_total(spark, folder):
    return ta.skill_match_total(fx.catalogue(spark, folder), SKILL_SEARCH)


def grid_order(spark, folder):
    return ta.grid_order(fx.skills(spark, folder))


def group_starts(spark, folder):
    return ta.group_starts(fx.skills(spark, folder))


def sector_runs(spark, folder):
    return ta.sector_runs(ta.grid_order(fx.skills(spark, folder)))


def sector_runs_by_id(spark, folder):
    ordered = fx.skills(spark, folder).select(F.col("id").alias("pos"), F.col("primary_benchmark").alias("benchmark"))
    return ta.sector_runs(ordered)


def skills_by_size(spark, folder):
    return ta.skills_by_size(fx.skills(spark, folder))


def items_per_skill(spark, folder):
    return ta.items_per_skill(fx.items(spark, folder), fx.theta_skills(spark, folder))


def alpha_mean(spark, folder):
    return _round(ta.alpha_mean(fx.items(spark, folder)), 9, "alpha_mean")


def skill_statistics(spark, folder):
    return _round(ta.skill_statistics(fx.items(spark, folder)), 9, "alpha_mean")


def primary_benchmark(spark, folder):
    return ta.primary_benchmark(fx.items(spark, folder))


def example_items(spark, folder):
    return ta.example_items(fx.catalogue_with_examples(spark, folder))


# Models --------------------------------------------------------------------------------------

MODEL_COLUMNS = ("id", "name", "hf_id", "family", "tier", "params")


def filter_models(spark, folder):
    return lb.filter_models(fx.models(spark, folder), SEARCH, FAMILIES, TIERS).select(*MODEL_COLUMNS)


def small_models(spark, folder):
    return lb.small_models(fx.models(spark, folder)).select(*MODEL_COLUMNS)


def filter_counts(spark, folder):
    return lb.filter_counts(fx.models(spark, folder), SEARCH, FAMILIES, TIERS)


def model_mean_theta(spark, folder):
    return lb.model_mean_theta(fx.models(spark, folder))


def model_mean_theta_skip(spark, folder):
    return lb.model_mean_theta(fx.models(spark, folder), nulls="skip")


def profile_sparkline(spark, folder):
    return lb.profile_sparkline(fx.models(spark, folder))


def ranked_skills(spark, folder):
    return lb.ranked_skills(fx.models(spark, folder), fx.skills(spark, folder))


def ranked_skills_grid(spark, folder):
    grid = ta.grid_order(fx.skills(spark, folder)).select(F.col("skill_id").alias("id"), F.col("pos").alias("ord"))
    return lb.ranked_skills(fx.models(spark, folder), grid)


def _leaderboard(key: str, dir: str | None = None, skill_id: int | None = None) -> Query:
    def query(spark, folder):
        return lb.leaderboard_sort(fx.scored_models(spark, folder), key, dir, skill_id)
    return query


def display_rank(spark, folder):
    return lb.display_rank(fx.models(spark, folder), search="model", families=FAMILIES, tiers=TIERS)


ORDERS = fa.FIVE_KEYS | {"acc_up": fa.SortKey("acc", "asc"), "name_down": fa.SortKey("name", "desc"),
                         "skill": fa.SortKey("skill", skill_id=SORT_SKILL)}
FILTERS = {"all": fa.Facets(), "picked": fa.Facets(SEARCH, FAMILIES, TIERS), "families": fa.Facets(families=FAMILIES),
           "searched": fa.Facets(search="9"), "none": fa.Facets(search="no such model")}


def leaderboard_ranks(spark, folder):
    return fa.leaderboard_ranks(fx.scored_models(spark, folder), ORDERS)


def facet_ranks(spark, folder):
    index = fa.facet_index(fx.scored_models(spark, folder), {n: ORDERS[n] for n in ("mean", "acc")})
    ranks = [fa.visible_ranks(index, sort, FILTERS).withColumn("sort", F.lit(sort)) for sort in ("mean", "acc")]
    return ranks[0].unionByName(ranks[1])


def facet_counts(spark, folder):
    index = fa.facet_index(fx.models(spark, folder), {"mean": ORDERS["mean"]})
    return fa.visible_counts(index, "mean", FILTERS)


def facet_page(spark, folder):
    index = fa.facet_index(fx.models(spark, folder), {"name": ORDERS["name"]})
    return fa.visible_page(index, "name", 13, 24, FILTERS)


def top_models(spark, folder):
    best = lb.top_models(fx.models(spark, folder), carry=["hf_id"])
    scored = re.attach_accuracy(best, fx.responses(spark, folder), fx.respondents(spark, folder), few=True)
    return scored.drop("hf_id")


def leaderboard_grid(spark, folder):
    skills = fx.skills(spark, folder)
    columns = [r.skill_id for r in ta.grid_order(skills).orderBy("pos").collect()]  # one per skill
    return lb.leaderboard_grid(fx.scored_models(spark, folder), columns, key="acc")


def matrix_slice(spark, folder):
    return lb.matrix_slice(fx.models(spark, folder))


def attach_accuracy(spark, folder):
    return fx.scored_models(spark, folder).select("id", "name", "hf_id", "accuracy")


# Populations ---------------------------------------------------------------------------------

def skill_means(spark, folder):
    return po.skill_means(fx.models(spark, folder), fx.skills(spark, folder))


def skill_means_skip(spark, folder):
    return po.skill_means(fx.models(spark, folder), fx.skills(spark, folder), nulls="skip")


def skill_histograms(spark, folder):
    return po.skill_histograms(fx.models(spark, folder), fx.skills(spark, folder))


def theta_variance(spark, folder):
    return _round(po.theta_variance(fx.models(spark, folder), fx.skills(spark, folder)), 9, "variance")


def best_model_per_skill(spark, folder):
    return po.best_model_per_skill(fx.models(spark, folder), fx.skills(spark, folder))


def top_models_per_skill(spark, folder):
    return po.top_models_per_skill(fx.models(spark, folder), fx.skills(spark, folder))


# Responses -----------------------------------------------------------------------------------

def model_accuracy(spark, folder):
    return re.model_accuracy(fx.responses(spark, folder))


def accuracy_summary(spark, folder):
    return _round(re.accuracy_summary(fx.responses(spark, folder)), 9, "min", "max", "mean")


# Comparisons ---------------------------------------------------------------------------------

def _selections(spark, folder):
    return co.resolve_selections(fx.requests(spark, folder), fx.models(spark, folder))


def resolve_selections(spark, folder):
    return _selections(spark, folder)


def skill_spread(spark, folder):
    return co.skill_spread(_selections(spark, folder), fx.models(spark, folder), fx.skills(spark, folder))


def skill_spread_many(spark, folder):
    models = fx.models(spark, folder)
    selections = co.resolve_selections(fx.requests(spark, folder), models, at_most=10)
    return co.skill_spread(selections, models, fx.skills(spark, folder))


def divergent_skills(spark, folder):
    return co.divergent_skills(_selections(spark, folder), fx.models(spark, folder), fx.skills(spark, folder))


def lead_counts(spark, folder):
    return co.lead_counts(_selections(spark, folder), fx.models(spark, folder), fx.skills(spark, folder))


def compare_suggestion(spark, folder):
    return co.compare_suggestion(fx.models(spark, folder))


# Predictions ---------------------------------------------------------------------------------

def heldout_split(spark, folder):
    return di.heldout_split(fx.responses(spark, folder))


def _predicted(spark, folder):
    return di.irt_probability(di.heldout_split(fx.responses(spark, folder)), fx.items(spark, folder),
                              fx.models(spark, folder), "benchmark", "heldout")


def irt_probability(spark, folder):
    return _round(_predicted(spark, folder).select("model_id", "item_id", "correct", "p"), 6, "p")


def unmatched_responses(spark, folder):
    return di.unmatched_responses(fx.responses(spark, folder), fx.items(spark, folder), fx.models(spark, folder))


def benchmark_prediction(spark, folder):
    return _round(di.benchmark_prediction(_predicted(spark, folder), "heldout"), 6, "predicted", "actual")


def prediction_quality(spark, folder):
    predictions = di.benchmark_prediction(_predicted(spark, folder), "heldout")
    return _round(di.prediction_quality(predictions, "heldout"), 6, "mae", "rmse", "corr")


def _stored_responses(spark, folder):
    return di.stored_responses(di.heldout_split(fx.responses(spark, folder)), fx.items(spark, folder), fx.models(spark, folder))


def stored_probability(spark, folder):
    return _round(di.stored_probability(_stored_responses(spark, folder)), 6, "p")


def stored_prediction(spark, folder):
    return _round(di.stored_prediction(_stored_responses(spark, folder), "heldout"), 6, "predicted", "actual")


def weak_beats_strong(spark, folder):
    split = di.heldout_split(fx.responses(spark, folder))
    return _round(di.weak_beats_strong(split, fx.models(spark, folder), "heldout"), 9, "share")


def weak_beats_strong_by_mean(spark, folder):
    split = di.heldout_split(fx.responses(spark, folder))
    return _round(di.weak_beats_strong(split, fx.models(spark, folder), "heldout", strength="mean_theta"), 9, "share")


def weak_beats_strong_by_skill(spark, folder):
    split = di.heldout_split(fx.responses(spark, folder))
    return _round(di.weak_beats_strong_by_skill(
        split, fx.models(spark, folder), fx.items(spark, folder), "heldout"), 9, "share")


# Map -----------------------------------------------------------------------------------------

def skill_pca_map(spark, folder):
    return _round(sm.skill_pca_map(fx.models(spark, folder), fx.skills(spark, folder)), 6, "x", "y")


def skill_products(spark, folder):
    return sm.skill_products(fx.models(spark, folder), fx.skills(spark, folder))


def described_map(spark, folder):
    return _round(sm.described_map(fx.map_points(spark, folder), fx.skills(spark, folder), fx.models(spark, folder)), 6, "x", "y")


QUERIES: dict[str, Query] = {
    "read_models": read_models,
    "read_models_array": read_models_array,
    "read_models_wrapped": read_models_wrapped,
    "read_models_parquet": read_models_parquet,
    "read_cells": read_cells,
    "read_skills_array": read_skills_array,
    "read_skills": read_skills,
    "read_skill_map": read_skill_map,
    "read_responses": read_responses,
    "read_items": read_items,
    "write_models": write_models_query,
    "check_shape": check_shape,
    "check_binary": check_binary,
    "check_alignment": check_alignment,
    "check_alignment_dense": check_alignment_dense,
    "check_binary_dense": check_binary_dense,
    "check_shape_dense": check_shape_dense,
    "theta_cells": theta_cells,
    "missing_cells": missing_cells,
    "relative_cells": relative_cells,
    "described_cells": described_cells,
    "skill_catalogue": skill_catalogue,
    "catalogue_quality": catalogue_quality,
    "model_catalogue": model_catalogue,
    "catalogue_counts": catalogue_counts,
    "benchmark_order": benchmark_order,
    "skills_per_benchmark": skills_per_benchmark,
    "filter_skills": filter_skills,
    "skill_match_total": skill_match_total,
    "grid_order": grid_order,
    "group_starts": group_starts,
    "sector_runs": sector_runs,
    "sector_runs_by_id": sector_runs_by_id,
    "skills_by_size": skills_by_size,
    "items_per_skill": items_per_skill,
    "alpha_mean": alpha_mean,
    "primary_benchmark": primary_benchmark,
    "skill_statistics": skill_statistics,
    "example_items": example_items,
    "filter_models": filter_models,
    "small_models": small_models,
    "filter_counts": filter_counts,
    "model_mean_theta": model_mean_theta,
    "model_mean_theta_skip": model_mean_theta_skip,
    "profile_sparkline": profile_sparkline,
    "ranked_skills": ranked_skills,
    "ranked_skills_grid": ranked_skills_grid,
    "leaderboard_sort": _leaderboard("mean"),
    "leaderboard_sort_index": _leaderboard("index"),
    "leaderboard_sort_name": _leaderboard("name"),
    "leaderboard_sort_acc": _leaderboard("acc"),
    "leaderboard_sort_acc_asc": _leaderboard("acc", "asc"),
    "leaderboard_sort_skill": _leaderboard("skill", skill_id=SORT_SKILL),
    "display_rank": display_rank,
    "leaderboard_ranks": leaderboard_ranks,
    "facet_ranks": facet_ranks,
    "facet_counts": facet_counts,
    "facet_page": facet_page,
    "top_models": top_models,
    "leaderboard_grid": leaderboard_grid,
    "matrix_slice": matrix_slice,
    "attach_accuracy": attach_accuracy,
    "responses_by_model": responses_by_model,
    "enrich_models": enrich_models,
    "skill_means": skill_means,
    "skill_means_skip": skill_means_skip,
    "skill_histograms": skill_histograms,
    "theta_variance": theta_variance,
    "best_model_per_skill": best_model_per_skill,
    "top_models_per_skill": top_models_per_skill,
    "model_accuracy": model_accuracy,
    "accuracy_summary": accuracy_summary,
    "resolve_selections": resolve_selections,
    "skill_spread": skill_spread,
    "skill_spread_many": skill_spread_many,
    "divergent_skills": divergent_skills,
    "lead_counts": lead_counts,
    "compare_suggestion": compare_suggestion,
    "heldout_split": heldout_split,
    "irt_probability": irt_probability,
    "unmatched_responses": unmatched_responses,
    "benchmark_prediction": benchmark_prediction,
    "prediction_quality": prediction_quality,
    "stored_probability": stored_probability,
    "stored_prediction": stored_prediction,
    "weak_beats_strong": weak_beats_strong,
    "weak_beats_strong_by_mean": weak_beats_strong_by_mean,
    "weak_beats_strong_by_skill": weak_beats_strong_by_skill,
    "skill_pca_map": skill_pca_map,
    "skill_products": skill_products,
    "described_map": described_map,
}
