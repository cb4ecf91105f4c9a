"""Responses and theta in common buckets: the same predictions, and no response is moved for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from masteria.operators import diagnostic as di
from masteria.plans.joins import PARTS, stored_together
from masteria.plans.storage import recorded
from tables import items, models, responses, rows


@pytest.fixture(scope="module")
def inputs(spark):
    """One model with a third of the responses, unknown models and items, responses of no model, missing values."""
    rng = random.Random(3)
    skills = [(i, i % 4, ["MATH", "BBH", None][i % 3], "", i % 5 / 4 + 0.5, i % 3 / 2) for i in range(90)]
    people = [{"id": m, "theta": [None, 0.25, m % 8 / 8][:m % 4]} for m in range(40)]
    answers = [(7 if rng.random() < 0.33 else rng.choice([None, *range(45)]), rng.randrange(95), rng.choice([0, 1, None])) for _ in range(6_000)]
    return responses(spark, *answers).repartition(5), items(spark, *skills), models(spark, *people)


@pytest.fixture(scope="module")
def tables(inputs):
    return di.stored_responses(*inputs, buckets=6)


@pytest.mark.parametrize("nulls", ["zero", "skip"])
def test_same_predictions(inputs, tables, nulls):
    columns = ("model_id", "item_id", "correct", "p")
    want = di.irt_probability(*inputs, "benchmark", nulls=nulls)
    assert rows(di.stored_probability(tables, nulls=nulls), *columns) == rows(want, *columns)

    def rounded(frame):
        return rows(frame.select("model_id", "benchmark", F.round("predicted", 9), F.round("actual", 9), "n"))

    assert rounded(di.stored_prediction(tables, nulls=nulls)) == rounded(di.benchmark_prediction(want))


def test_responses_stay_where_they_are(spark, tables):
    def plan(frame):
        return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")

    text = plan(di.stored_probability(tables))
    assert "ShuffledHashJoin" in text and "Exchange" not in text and "Sort " not in text
    assert len(re.findall(r"Bucketed: true", text)) == 2
    text = plan(di.stored_prediction(tables))
    assert text.count("Exchange hashpartitioning") <= 2  # in the tree and in its details, of sums
    assert re.search(r"Exchange\n.*\n?Input \[\d+\]: \[model_id#\d+L?, benchmark", text)


def test_hot_models_fill_several_buckets(spark, inputs):
    with recorded() as written:
        tables = stored_together(inputs[0], inputs[2].select(F.col("id").alias("model_id"), "theta"), "model_id", buckets=6)
    hot = tables.facts.where("model_id = 7")
    sizes = [r["count"] for r in hot.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    files = spark.read.parquet(written[-2]).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 6 and sum(r["count"] for r in files) == inputs[0].count()  # rows without a model are kept
    pieces = tables.dim.where("model_id = 7").count()
    assert PARTS / 4 < pieces < PARTS / 2 and pieces == hot.agg(F.max("_piece")).first()[0] + 1
    assert tables.joined().count() == inputs[0].where("model_id < 40").count()


def test_nothing_stored(inputs):
    tables = di.stored_responses(inputs[0].where("false"), *inputs[1:], buckets=2)
    assert rows(di.stored_probability(tables)) == rows(di.stored_prediction(tables)) == []
