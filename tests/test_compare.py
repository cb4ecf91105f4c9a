import pytest
from pyspark.sql import functions as F

from masteria.operators import compare as co
from masteria.operators import diagnostic as di
from masteria.operators import responses as re
from masteria.plans.joins import is_small, lookup_join
from tables import items, models, responses, rows, skills


@pytest.fixture(scope="module")
def table(spark):
    return models(
        spark,
        {"id": 7, "theta": [0.2, 0.5, 0.9], "params": 70.0},
        {"id": 1, "theta": [0.2, 0.75], "params": 13.0},
        {"id": 12, "theta": [0.4, 0.5, None], "params": None},
        {"id": 2, "theta": [0.1, 0.1, 0.1], "params": 3.0},
    )


@pytest.fixture(scope="module")
def axis(spark):
    return skills(spark, {"id": 0}, {"id": 1, "primary_benchmark": "ZZZ"}, {"id": 2})


@pytest.mark.parametrize("m, want", [
    (None, []), ("", []), ("7", [7]), ("7,7", [7, 7]), ("12abc,x,,7", [12, 7]), ("1,2,7,12", [1, 2, 7]),
    ("99,1,2,7", [1, 2]), (" +7, \t12,-1", [7, 12]), ("1e3", [1]), ("0x7,7", [7]),
    ("99999999999999999999999,1,2,7", [1, 2]),
])
def test_resolve(spark, table, m, want):
    asked = spark.createDataFrame([(1, m)], "request_id long, m string")
    assert rows(co.resolve_selections(asked, table)) == [(1, i, model) for i, model in enumerate(want)]


def _selections(spark, *requests):
    return spark.createDataFrame([(r, s, m) for r, ms in enumerate(requests) for s, m in enumerate(ms)],
                                 "request_id long, slot long, model_id long")


def test_spread_and_lead(spark, table, axis):
    chosen = _selections(spark, [7, 1, 12], [1, 7], [2], [7, 7])
    spread = rows(co.skill_spread(chosen, table, axis))
    assert [s for s in spread if s[0] == 0] == [
        (0, 0, 0.2, 0.4, 0.2), (0, 1, 0.5, 0.75, 0.25), (0, 2, 0.0, 0.9, 0.9)]
    assert {s[0] for s in spread} == {0, 1, 3}  # a single model is not compared
    assert {s[4] for s in spread if s[0] == 3} == {0.0}
    assert rows(co.lead_counts(chosen, table, axis)) == [(0, 1, 1, 3), (1, 1, 1, 3), (3, 0, 0, 3)]


def test_divergent(spark, table, axis):
    got = rows(co.divergent_skills(_selections(spark, [7, 1, 12], [7, 7]), table, axis, k=2))
    assert got == [(0, 1, 2, 0.9), (0, 2, 1, 0.25), (1, 1, 0, 0.0), (1, 2, 2, 0.0)]  # skill 2 precedes 1 in the grid


def test_suggestion(spark, table):
    assert rows(co.compare_suggestion(table)) == [(7, 1)]
    assert rows(co.compare_suggestion(table, max_params=100)) == []
    assert rows(co.compare_suggestion(table, max_params=1)) == []
    tied = models(spark, {"id": 5, "theta": [0.5]}, {"id": 3, "theta": [0.5], "params": 1.0})
    assert rows(co.compare_suggestion(tied)) == [(5, 3)]


# Joins -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    facts = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"))
    dim = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    want = rows(facts.join(dim, "k", how))
    assert rows(lookup_join(facts, dim, "k", how)) == want
    assert rows(lookup_join(facts, dim, "k", how, rows=0)) == want


def test_broadcasts_are_measured(spark):
    dim = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert is_small(dim) and not is_small(dim, rows=99) and not is_small(dim, size=50_000)
    assert not is_small(dim.withColumn("m", F.create_map("id", "text")))
    with pytest.raises(ValueError):
        lookup_join(dim, dim, "id", "full")


# Responses -------------------------------------------------------------------------------------

def _answers(spark):
    return responses(spark, (0, 0, 1), (0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def test_accuracy(spark):
    assert rows(re.model_accuracy(_answers(spark))) == [(0, 0.6667), (1, 0.3333), (2, 0.5)]
    assert rows(re.accuracy_summary(_answers(spark))) == [(3, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5)]


def _listed(spark, *ids):
    return spark.createDataFrame(list(enumerate(ids)), "pos long, hf_id string")


def test_attach_accuracy(spark):
    table = models(spark, {"id": 10, "hf_id": "b"}, {"id": 11, "hf_id": None}, {"id": 12, "hf_id": "a"}, {"id": 13, "hf_id": "x"})
    got = re.attach_accuracy(table, _answers(spark), _listed(spark, "a", "b", None))
    assert rows(got, "id", "accuracy") == [(10, 0.3333), (11, None), (12, 0.6667), (13, None)]
    few = re.attach_accuracy(table.where("id < 12"), _answers(spark), _listed(spark, "a", "b", None), few=True)
    assert rows(few, "id", "accuracy") == [(10, 0.3333), (11, None)]


def test_checks(spark):
    three = models(spark, {"id": 0, "hf_id": "a"}, {"id": 1, "hf_id": "b"}, {"id": 2, "hf_id": "c"})
    listed = _listed(spark, "a", "b", "c")
    good = [re.check_shape(_answers(spark), listed, three), re.check_binary(_answers(spark)),
            re.check_alignment(listed, three)]
    assert [r for c in good for r in rows(c, "violations", "ok")] == [(0, True)] * 3
    re.require(*good)
    two = _listed(spark, "a", "b")
    shape = re.check_shape(_answers(spark), two, three)
    assert rows(shape, "violations", "ok") == [(2, False)]
    with pytest.raises(ValueError, match="3 responding, 2 listed, 3 models"):
        re.require(shape)
    odd = responses(spark, (0, 0, 2), (0, 1, None), (0, 2, 1))
    with pytest.raises(ValueError, match="2 responses"):
        re.require(re.check_binary(odd))
    shifted = models(spark, {"id": 0, "hf_id": "b"}, {"id": 1, "hf_id": None}, {"id": 2, "hf_id": "c"})
    with pytest.raises(ValueError, match="2 positions"):
        re.require(re.check_alignment(listed, shifted))
    assert rows(re.check_alignment(two, three), "violations") == [(1,)]


# Predictions -----------------------------------------------------------------------------------

def _world(spark, n_models=12, n_items=40):
    table = models(spark, *[{"id": m, "theta": [(m * 5 % 16) / 16, None if m == 3 else (m % 8) / 8],
                             "params": [None, 3.0, 13.0, 40.0][m % 4]} for m in range(n_models)])
    questions = items(spark, *[(i, i % 3, ["MATH", "BBH"][i % 2], "t", 0.5 + i % 4, (i % 5) / 4) for i in range(n_items)])
    # Model 0 answers everything, the others few items: it owns most of the responses.
    answers = [(m, i, (m * 7 + i * 3) % 5 % 2) for m in range(n_models) for i in range(n_items) if m == 0 or i % 9 == m % 9]
    return table, questions, answers


def test_predictions_equal_brute_force(spark):
    import math
    table, questions, answers = _world(spark)
    thetas = {r.id: r.theta for r in table.collect()}
    parts = {r.item_id: r for r in questions.collect()}

    def p(m, i):
        item = parts[i]
        theta = (thetas[m][item.skill_id] or 0.0) if item.skill_id < 2 else 0.0
        return 1 / (1 + math.exp(-item.alpha * (theta - item.beta)))

    want = sorted((m, i, c, pytest.approx(p(m, i))) for m, i, c in answers)
    given = responses(spark, *answers)
    assert rows(di.irt_probability(given, questions, table)) == want
    assert rows(di.irt_probability(given, questions, table, rows=0)) == want  # hot models stay, the rest is shuffled
    groups = {}
    for m, i, c in answers:
        groups.setdefault((m, parts[i].benchmark), []).append((p(m, i), c))
    predicted = di.benchmark_prediction(di.irt_probability(given, questions, table, "benchmark"))
    assert rows(predicted) == sorted(
        (m, b, pytest.approx(sum(x for x, _ in v) / len(v)), pytest.approx(sum(c for _, c in v) / len(v)), len(v))
        for (m, b), v in groups.items())
    quality = {r.benchmark: r for r in di.prediction_quality(predicted).collect()}
    for b in ("MATH", "BBH"):
        pairs = [(r.predicted, r.actual) for r in predicted.collect() if r.benchmark == b]
        errors = [x - y for x, y in pairs]
        assert quality[b].mae == pytest.approx(sum(map(abs, errors)) / len(errors))
        assert quality[b].rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / len(errors)))


@pytest.mark.parametrize("strength", ["accuracy", "mean_theta"])
def test_weak_beats_strong(spark, strength):
    table, questions, answers = _world(spark)
    by_model = {}
    for m, _, c in answers:
        by_model.setdefault(m, []).append(c)
    if strength == "accuracy":
        best = min(by_model, key=lambda m: (-sum(by_model[m]) / len(by_model[m]), m))
    else:
        best = min(table.collect(), key=lambda r: (-sum(t or 0.0 for t in r.theta) / 2, r.ord)).id
    small = {r.id for r in table.collect() if r.params is not None and r.params <= 13}
    seen = {i for _, i, _ in answers}
    fails = {i for m, i, c in answers if m == best and c == 0}
    passes = {i for m, i, c in answers if m in small and c == 1}
    wins = fails & passes
    got = rows(di.weak_beats_strong(responses(spark, *answers), table, strength=strength))
    assert got == [(len(seen), len(wins), pytest.approx(len(wins) / len(seen)))]
    shares = {s: (sum(i % 3 == s for i in wins) / sum(i % 3 == s for i in seen)) for s in range(3)}
    want = sorted(shares, key=lambda s: (-shares[s], s))[:2]
    ranked = rows(di.weak_beats_strong_by_skill(responses(spark, *answers), table, questions, k=2, strength=strength),
                  "rank", "skill_id")
    assert ranked == [(1, want[0]), (2, want[1])]


def test_split(spark):
    split = di.heldout_split(_answers(spark), mod=2)
    assert {(r.item_id, r.heldout) for r in split.collect()} == {(0, True), (1, False), (2, True)}


def test_spread_of_many_models(spark):
    """All models of a selection count, however many there are."""
    table = models(spark, *[{"id": k, "theta": [v, 0.5]} for k, v in enumerate((0.3, 0.0, 0.4, 0.8, None))])
    axis = skills(spark, {"id": 0}, {"id": 1})
    selections = spark.createDataFrame([(7, s, s) for s in range(5)], "request_id long, slot long, model_id long")
    assert rows(co.skill_spread(selections, table, axis)) == [(7, 0, 0.0, 0.8, 0.8), (7, 1, 0.5, 0.5, 0.0)]
    assert rows(co.divergent_skills(selections, table, axis, k=1)) == [(7, 1, 0, 0.8)]
    assert rows(co.lead_counts(selections, table, axis)) == [(7, 1, 0, 2)]


def test_divergent_skills_are_ranked_in_the_row(spark):
    frame = co.divergent_skills(
        spark.createDataFrame([], "request_id long, slot long, model_id long"),
        models(spark, {"id": 0, "theta": [0.5]}), skills(spark, {"id": 0}))
    tree = frame._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Window" not in tree


def test_the_whole_accuracy_job(spark, tmp_path):
    table = models(spark, {"id": 10, "hf_id": "a"}, {"id": 11, "hf_id": "b"}, {"id": 12, "hf_id": None})
    listed = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "pos long, hf_id string")
    answers = responses(spark, (0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0))
    path = str(tmp_path / "out")
    summary = re.enrich_models(table, answers, listed, path)
    assert rows(spark.read.parquet(path), "id", "accuracy") == [(10, 0.5), (11, 1.0), (12, 0.0)]
    assert rows(summary) == [(3, 0.0, 1.0, 0.5)]
    assert rows(re.by_model(answers, table), "model_id", "item_id", "correct")[:2] == [(10, 0, 1), (10, 1, 0)]
    for bad in ((responses(spark, (0, 0, 5), (1, 0, 1), (2, 0, 1)), listed), (answers, listed.where("pos < 2")),
                (answers, spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "pos long, hf_id string"))):
        with pytest.raises(ValueError):
            re.enrich_models(table, bad[0], bad[1], str(tmp_path / "refused"))
    assert not (tmp_path / "refused").exists()


def test_repeated_hub_ids_are_refused(spark):
    table = models(spark, {"id": 1, "hf_id": "a"}, {"id": 2, "hf_id": "a"})
    once = spark.createDataFrame([(0, "a")], "pos long, hf_id string")
    answers = responses(spark, (0, 0, 1), (1, 0, 0))
    assert rows(re.attach_accuracy(table, answers, once), "id", "accuracy") == [(1, 1.0), (2, 1.0)]
    twice = spark.createDataFrame([(0, "a"), (1, "a")], "pos long, hf_id string")
    with pytest.raises(Exception, match="two respondents"):
        re.attach_accuracy(table, answers, twice).collect()


def test_unmatched_responses(spark):
    table = models(spark, {"id": 1, "theta": [0.5]})
    known = items(spark, (1, 0, "MATH", "a", 1.0, 0.0))
    answers = responses(spark, (1, 1, 1), (1, 9, 1), (8, 1, 0))
    assert rows(di.unmatched_responses(answers, known, table)) == [(3, 1, 1)]
    assert di.irt_probability(answers, known, table).count() == 1
