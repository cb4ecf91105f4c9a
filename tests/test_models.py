import pytest
from pyspark.sql import functions as F

from masteria.operators import cells as ce
from masteria.operators import leaderboard as lb
from masteria.operators import population as po
from tables import models, rows, skills


@pytest.fixture(scope="module")
def edge(spark):
    return models(
        spark,
        {"id": 1, "theta": [0.0, 1.0, 0.5]},
        {"id": 2, "theta": [None, 1.2, -0.1]},
        {"id": 3, "theta": [0.25]},
        {"id": 4, "theta": []},
    )


@pytest.fixture(scope="module")
def axis(spark):
    return skills(spark, {"id": 0}, {"id": 1}, {"id": 2})


def test_mean(edge):
    assert rows(lb.model_mean_theta(edge)) == [(1, 0.5), (2, pytest.approx(1.1 / 3)), (3, 0.25), (4, 0.0)]
    assert rows(lb.model_mean_theta(edge, nulls="skip"))[1] == (2, pytest.approx(0.55))
    with pytest.raises(ValueError):
        lb.model_mean_theta(edge, nulls="drop")


def test_cells_and_missing(edge, axis):
    assert len(rows(ce.theta_cells(edge))) == 7
    assert rows(ce.missing_cells(edge, axis)) == [(2, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2)]


def test_entries_without_a_skill_are_left_out(spark, edge):
    one = skills(spark, {"id": 1, "n_items": 7})
    assert rows(ce.described_cells(edge, one), "model_id", "theta", "n_items") == [
        (1, 1.0, 7), (2, 1.2, 7), (3, None, 7), (4, None, 7)]


def test_wide_is_the_inverse_of_long(spark, edge):
    cells = ce.theta_cells(edge).where(F.col("theta").isNotNull()).repartition(5)
    assert rows(ce.theta_wide(cells, cells.sparkSession.createDataFrame([(2,), (9,)], "id long"))) == [(2, [None, 1.2, -0.1]), (9, [])]
    assert rows(ce.theta_wide(cells)) == [(1, [0.0, 1.0, 0.5]), (2, [None, 1.2, -0.1]), (3, [0.25])]


def test_skill_means(edge, axis):
    assert rows(po.skill_means(edge, axis)) == [(0, 0.0625), (1, pytest.approx(0.55)), (2, pytest.approx(0.1))]
    assert rows(po.skill_means(edge, axis, nulls="skip")) == [(0, 0.125), (1, pytest.approx(1.1)), (2, pytest.approx(0.2))]


def test_relative(edge, axis):
    got = {(m, s): (d, mag, above) for m, s, _, d, mag, above in rows(ce.relative_cells(edge, axis))}
    assert got[1, 0] == (-0.0625, 0.125, False)
    assert got[2, 0] == (None, None, None)
    assert got[2, 1] == (pytest.approx(0.65), 1.0, True)


def test_histogram(edge, axis):
    got = rows(po.skill_histograms(edge, axis))
    assert len(got) == 48
    counts = {(s, b): (n, h) for s, b, n, h in got}
    assert counts[0, 0] == (3, 1.0) and counts[0, 4] == (1, 1 / 3)
    assert counts[1, 15] == (2, 1.0) and counts[1, 0] == (2, 1.0)
    assert counts[2, 0] == (2, 1.0) and counts[2, 8] == (1, 0.5)
    assert sum(n for (s, _), (n, _) in counts.items() if s == 2) == 3  # the negative value is in no bin


def test_variance(edge, axis):
    got = dict(rows(po.theta_variance(edge, axis)))
    assert got[0] == pytest.approx(0.01171875)
    assert dict(rows(po.theta_variance(edge, axis, ddof=1)))[0] == pytest.approx(0.015625)


def test_best_and_top_take_the_first_in_input_order(spark, axis):
    tied = models(spark, {"id": 9, "theta": [0.5, None]}, {"id": 3, "theta": [0.5, 0.2]},
                  {"id": 7, "theta": [0.5, 0.2]}, {"id": 1, "theta": [0.1, 0.0]})
    assert rows(po.best_model_per_skill(tied, axis)) == [(0, 9, "m9", 0.5), (1, 3, "m3", 0.2), (2, 9, "m9", 0.0)]
    top = rows(po.top_models_per_skill(tied, axis, k=3), "skill_id", "rank", "model_id")
    assert [m for s, _, m in top if s == 0] == [9, 3, 7]
    assert [m for s, _, m in top if s == 1] == [3, 7, 9]
    assert [m for s, _, m in top if s == 2] == [9, 3, 7]
    only = rows(po.top_models_per_skill(tied, axis, k=9, nulls="skip"), "skill_id", "rank", "model_id")
    assert [m for s, _, m in only if s == 1] == [3, 7, 1]
    assert not [m for s, _, m in only if s == 2]
    assert rows(po.best_model_per_skill(tied, axis, nulls="skip"), "skill_id", "model_id") == [(0, 9), (1, 3)]


def test_ranked_skills(spark):
    one = models(spark, {"id": 1, "theta": [0.3, 0.9, None, 0.3]})
    axis = skills(spark, {"id": 0}, {"id": 1}, {"id": 2}, {"id": 3}, {"id": 5})
    ranked = lb.ranked_skills(one, axis)
    assert [s for _, s, _, _ in sorted(ranked.collect(), key=lambda r: r.rank)] == [1, 0, 3, 2, 5]
    assert dict(rows(ranked, "skill_id", "theta"))[5] == 0.0
    turned = axis.withColumn("ord", -F.col("id"))
    assert [r.skill_id for r in sorted(lb.ranked_skills(one, turned).collect(), key=lambda r: r.rank)] == [1, 3, 0, 5, 2]
    skipped = lb.ranked_skills(one, axis, nulls="skip")
    assert [r.skill_id for r in sorted(skipped.collect(), key=lambda r: r.rank)] == [1, 0, 3]


@pytest.mark.parametrize("n", [0, 10, 25, 64, 100])
def test_sparkline(spark, n):
    values = [((i * 37) % 64) / 64 for i in range(n)]
    got = rows(lb.profile_sparkline(models(spark, {"id": 1, "theta": values})))
    per = max(1, n // 25)
    ordered = sorted(values, reverse=True)
    want = []
    for b in range(25):
        part = ordered[b * per:(b + 1) * per]
        want.append((1, b, sum(part) / len(part) if part else 0.0))
    assert got == [(m, b, pytest.approx(v)) for m, b, v in want]


@pytest.fixture(scope="module")
def board(spark):
    return models(
        spark,
        {"id": 5, "name": "beta", "accuracy": 0.5, "theta": [0.5, 0.1], "params": 13.0, "tier": "Mid"},
        {"id": 2, "name": "Alpha%", "accuracy": None, "theta": [0.3, 0.3], "params": 13.5, "family": "Qwen"},
        {"id": 8, "name": "ALPHA_x", "accuracy": 0.7, "theta": [None, 0.6], "params": None, "family": "Falcon"},
        {"id": 1, "name": "beta", "accuracy": 0.5, "theta": [0.6], "params": 0.5},
        {"id": 4, "name": "axb", "accuracy": None, "theta": [], "params": 70.0},
    )


@pytest.mark.parametrize("key, direction, want", [
    ("mean", None, [1, 5, 2, 8, 4]),
    ("mean", "asc", [4, 5, 2, 8, 1]),
    ("index", None, [8, 5, 4, 2, 1]),
    ("index", "asc", [1, 2, 4, 5, 8]),
    ("name", None, [2, 8, 4, 5, 1]),
    ("name", "desc", [5, 1, 4, 8, 2]),
    ("acc", None, [8, 5, 1, 2, 4]),
    ("acc", "asc", [2, 4, 5, 1, 8]),
    ("skill", None, [1, 5, 2, 8, 4]),
    ("skill", "asc", [8, 4, 2, 5, 1]),
])
def test_leaderboard_sort(board, key, direction, want):
    got = lb.leaderboard_sort(board.repartition(4), key, direction, skill_id=0)
    assert [r.model_id for r in sorted(got.collect(), key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got.collect()) == [1, 2, 3, 4, 5]


def test_sort_arguments(board):
    for bad in ({"key": "size"}, {"dir": "up"}, {"key": "skill"}):
        with pytest.raises(ValueError):
            lb.leaderboard_sort(board, **bad)


def test_filters_are_literal(board):
    def ids(**facets):
        return [r.id for r in lb.filter_models(board, **facets).collect()]
    assert ids(search="%") == [2]
    assert ids(search=" A_ ") == [8]
    assert ids(search="  ") == ids() == [5, 2, 8, 1, 4]
    assert ids(search="alpha", families=["Qwen"]) == [2]
    assert ids(tiers=["Mid", "Large"]) == [5]
    assert rows(lb.filter_counts(board, search="alpha")) == [(2, 5)]
    assert sorted(r.id for r in lb.small_models(board).collect()) == [1, 5]


def test_rank_is_taken_after_the_filter(board):
    assert rows(lb.display_rank(board, search="b")) == [(1, 1), (4, 3), (5, 2)]


def test_grid_keeps_missing_cells(board):
    grid = lb.leaderboard_grid(board, [1, 0], key="index", dir="asc")
    assert grid.columns == ["rank", "model_id", "name", "accuracy", "mean_theta", "s1", "s0"]
    assert rows(grid, "rank", "model_id", "s0", "s1") == [
        (1, 1, 0.6, None), (2, 2, 0.3, 0.3), (3, 4, None, None), (4, 5, 0.5, 0.1), (5, 8, None, 0.6)]


def test_top_models_and_slice(board):
    assert rows(lb.top_models(board, 2), "rank", "id") == [(1, 1), (2, 5)]
    assert rows(lb.matrix_slice(board, rows=2, start=1, stride=2, cols=2)) == [
        (1, 1, 1, 0.0), (1, 1, 3, 0.0), (2, 5, 1, 0.1), (2, 5, 3, 0.0)]


def test_model_catalogue(spark):
    got = lb.model_catalogue(models(
        spark, {"id": 1, "hf_id": "org__a__b", "family": "Falcon"}, {"id": 2, "hf_id": "plain", "family": "Phi"},
        {"id": 3, "hf_id": None}))
    assert rows(got, "id", "family", "hub_repo") == [(1, "Other", "org/a__b"), (2, "Phi", "plain"), (3, "Llama", None)]


def test_results_do_not_depend_on_partitions(spark, edge, axis):
    many = models(spark, *[{"id": i, "theta": [(i * 7 % 16) / 16, None, (i * 3 % 4) / 4]} for i in range(200)])
    want = None
    for parts in (1, 7, 64):
        shuffled = many.repartition(parts, F.col("id") * 31 % 17)
        got = (rows(po.top_models_per_skill(shuffled, axis)), rows(lb.leaderboard_sort(shuffled)),
               rows(po.best_model_per_skill(shuffled, axis)))
        assert want is None or got == want
        want = got
    hist = rows(po.skill_histograms(many, axis))
    assert {s: sum(n for t, _, n, _ in hist if t == s) for s in range(3)} == {0: 200, 1: 200, 2: 200}


def test_long_axis(spark):
    """No limit on the number of skills, wherever they are used."""
    from masteria.operators import taxonomy as ta

    n = 100_001
    many = spark.range(n).select("id", F.concat(F.lit("b"), F.col("id") % 3).alias("primary_benchmark"), (F.col("id") % 10).alias("n_items"))
    assert ta.skills_by_size(many).count() == n
    order = ta.grid_order(many)
    assert order.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first() == (n, 0, n - 1)
    assert order.where("skill_id = 4").first().pos == (n + 2) // 3 + 1
    assert [r.share for r in ta.sector_runs(order).orderBy("run").collect()] == [33334 / n, 33334 / n, 33333 / n]
    wide = spark.range(2).select("id", F.array_repeat(F.lit(0.5), n).alias("theta"))
    assert po.skill_means(wide, many).agg(F.count("*"), F.sum("mean_theta")).first() == (n, n / 2)


def test_nan_never_wins(spark):
    table = models(spark, {"id": 10, "name": "nan", "theta": [float("nan"), 0.1], "params": 1.0},
                   {"id": 11, "name": "best", "theta": [0.5, 0.2], "params": 1.0})
    axis = skills(spark, {"id": 0}, {"id": 1})
    assert rows(po.best_model_per_skill(table, axis)) == [(0, 11, "best", 0.5), (1, 11, "best", 0.2)]
    assert rows(po.skill_means(table, axis, nulls="skip")) == [(0, 0.5), (1, 0.15000000000000002)]


def test_repeated_positions_do_not_multiply(spark):
    """``ord`` may repeat where files were read apart; a skill still has one best model."""
    table = models(spark, {"id": 1, "name": "a", "theta": [0.5]}, {"id": 2, "name": "b", "theta": [0.1]}).withColumn("ord", F.lit(0))
    assert rows(po.best_model_per_skill(table, skills(spark, {"id": 0}))) == [(0, 1, "a", 0.5)]
