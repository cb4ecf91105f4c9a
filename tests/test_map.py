import numpy as np
import pytest

from masteria.operators.skillmap import described_map, principal_axes, skill_pca_map
from tables import models, rows, skills


def test_equals_a_direct_decomposition(spark):
    rng = np.random.default_rng(3)
    centre = rng.random((5, 4))
    values = np.clip(rng.random((60, 4)) @ centre.T / 2 + rng.random((60, 5)) / 9, 0, 1)
    table = models(spark, *[{"id": i, "theta": v.tolist()} for i, v in enumerate(values)])
    axis = skills(spark, *[{"id": i} for i in range(5)])
    got = np.array([(x, y) for _, x, y in rows(skill_pca_map(table.repartition(6), axis))])
    by_skill = values.T - values.T.mean(axis=0)  # skills x models, centred per model
    u, s, _ = np.linalg.svd(by_skill, full_matrices=False)
    for axis_no in (0, 1):
        score = u[:, axis_no] * s[axis_no]
        score = score * np.sign(score[np.argmax(np.abs(score))])
        assert got[:, axis_no] == pytest.approx((score - score.min()) / np.ptp(score), abs=1e-9)


def test_missing_values_count_as_zero(spark):
    axis = skills(spark, *[{"id": i} for i in range(3)])
    full = models(spark, {"id": 0, "theta": [0.0, 0.5, 0.0]}, {"id": 1, "theta": [1.0, 0.0, 0.0]}, {"id": 2, "theta": [0.2, 0.1, 0.9]})
    short = models(spark, {"id": 0, "theta": [None, 0.5]}, {"id": 1, "theta": [1.0]}, {"id": 2, "theta": [0.2, 0.1, 0.9]})
    assert rows(skill_pca_map(full, axis)) == rows(skill_pca_map(short, axis))
    with pytest.raises(ValueError):
        skill_pca_map(full, axis, nulls="skip")


def test_described_map(spark):
    points = spark.createDataFrame([(0, 0.0, 1.0), (9, 0.5, 0.5)], "id long, x double, y double")
    got = described_map(points, skills(spark, {"id": 0}, {"id": 1}), models(spark, {"id": 4, "theta": [0.5]}))
    assert rows(got) == [(0, 0.0, 1.0, "MATH", 5, "m4", 0.5)]


@pytest.mark.parametrize("n", [1, 2, 40, 130, 700])
def test_axes_equal_a_direct_decomposition(n):
    """With one pass for all skills, and with many passes of a few vectors."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((300, n)) + 2 * np.outer(rng.standard_normal(300), rng.standard_normal(n)) + np.outer(rng.standard_normal(300), rng.standard_normal(n))
    matrix = x.T @ x
    values, vectors = np.linalg.eigh(matrix)
    got = principal_axes(lambda block: matrix @ block, n)
    for k in range(min(n, 2)):
        want = vectors[:, -1 - k] * np.sqrt(values[-1 - k])
        assert min(np.abs(got[k] - want).max(), np.abs(got[k] + want).max()) < 1e-8 * np.sqrt(values[-1])
    assert len(got) == 2


def test_axes_of_close_and_of_missing_components():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    sizes = np.linspace(1, 2, 200)[::-1]
    got = principal_axes(lambda block: q @ (sizes[:, None] * (q.T @ block)), 200)
    assert all(min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6 for g, w in zip(got, (q[:, 0] * np.sqrt(2), q[:, 1] * np.sqrt(sizes[1]))))
    one = np.outer(q[:, 0], q[:, 0])
    first, second = principal_axes(lambda block: one @ block, 200)
    assert np.abs(np.abs(first) - np.abs(q[:, 0])).max() < 1e-9 and np.abs(second).max() < 1e-6
    assert all((a == 0).all() for a in principal_axes(lambda block: 0 * block, 90))


def test_many_skills(spark):
    """No task and no row holds a matrix of skills by skills."""
    n = 20_000
    rng = np.random.default_rng(1)
    base = rng.random((2, n))
    values = np.clip(0.4 + np.outer(rng.standard_normal(30), base[0] - 0.5) * 0.5 + np.outer(rng.standard_normal(30), base[1] - 0.5) * 0.2, 0, 1)
    table = models(spark, *[{"id": i, "theta": v.tolist()} for i, v in enumerate(values)])
    got = np.array([(x, y) for _, x, y in rows(skill_pca_map(table, spark.range(n)))])
    by_skill = (values - values.mean(axis=1, keepdims=True)).T
    u = np.linalg.svd(by_skill, full_matrices=False)[0]
    for k in (0, 1):
        score = u[:, k] * np.sign(u[np.argmax(np.abs(u[:, k])), k])
        assert got[:, k] == pytest.approx((score - score.min()) / np.ptp(score), abs=1e-8)
