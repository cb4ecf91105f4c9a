"""Orders, bitmaps of facets and runs against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from masteria.operators import facets as fa
from masteria.operators import leaderboard as lb
from masteria.operators import taxonomy as ta
from masteria.plans import bitmaps as bm
from masteria.plans.ranking import add_rank
from masteria.plans.storage import recorded
from tables import models, rows

N = 70_000  # three stretches of 32,768
FAMILIES = ["Llama", "Qwen", None, "Phi"]


@pytest.fixture(scope="module")
def population(spark):
    """Families in blocks and one by one, many ties, names and accuracies that are missing or no number."""
    i = F.col("id")
    return spark.range(N).select(
        (i * 3).alias("id"), (N - i).alias("ord"), F.when(i % 11 != 0, F.concat(F.lit("M_"), (i % 500).cast("string"))).alias("name"),
        F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.when(i < 33_000, F.lit(0)).otherwise(i % 4).cast("int")).alias("family"),
        F.when(i % 2 == 0, "Small").otherwise("Large").alias("tier"),
        F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 5 != 0, (i % 20) / 20).alias("accuracy"),
        F.array(F.when(i % 3 != 0, (i % 4) / 4), F.lit(0.5)).alias("theta"))


@pytest.fixture(scope="module")
def index(population):
    return fa.facet_index(population, {"mean": fa.SortKey("mean"), "acc": fa.SortKey("acc", "asc")})


FILTERS = {"all": fa.Facets(), "searched": fa.Facets(search=" m_49"), "two": fa.Facets(families=["Qwen", "Phi"], tiers=["Small"]),
           "everything": fa.Facets("9", ["Llama"], ["Large", "Small"]), "absent": fa.Facets(tiers=["Huge"])}


@pytest.mark.parametrize("sort", ["mean", "acc"])
def test_ranks_from_bitmaps_equal_a_sort_per_filter(population, index, sort):
    key, direction = ("mean", None) if sort == "mean" else ("acc", "asc")
    got = fa.visible_ranks(index, sort, FILTERS).toPandas()
    for name, f in FILTERS.items():
        want = lb.display_rank(population, key, direction, search=f.search, families=f.families, tiers=f.tiers).toPandas()
        mine = got[got["filter"] == name]
        assert dict(zip(mine["model_id"], mine["rank"])) == dict(zip(want["model_id"], want["rank"])), name
        assert len(mine) == len(want)


def test_counts_from_bitmaps(population, index):
    for name, visible, total in fa.visible_counts(index, "acc", FILTERS).collect():
        f = FILTERS[name]
        assert rows(lb.filter_counts(population, f.search, f.families, f.tiers)) == [(visible, total)]


def test_pages(index):
    all_ = {(r["filter"], r["rank"]): r.model_id for r in fa.visible_ranks(index, "mean", FILTERS).collect()}
    for first, n in ((1, 10), (32_760, 20), (N - 2, 50), (5, 0)):
        got = {(r["filter"], r["rank"]): r.model_id for r in fa.visible_page(index, "mean", first, n, FILTERS).collect()}
        assert got == {k: v for k, v in all_.items() if first <= k[1] < first + n}
    with pytest.raises(ValueError):
        fa.visible_page(index, "mean", 0, 5, FILTERS)


def test_filters_sort_nothing(index):
    def plan(frame):
        return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")

    text = plan(fa.visible_ranks(index, "mean", FILTERS))
    assert "rangepartitioning" not in text
    counts = plan(fa.visible_counts(index, "mean", {"two": FILTERS["two"]}))
    assert "name" not in counts and "model_id" not in counts  # the sets alone are read


def test_five_keys_in_one_sort(population):
    orders = {"up": fa.SortKey("acc", "asc"), "down": fa.SortKey("acc"), "name": fa.SortKey("name"), "eman": fa.SortKey("name", "desc"),
              "index": fa.SortKey("index"), "mean": fa.SortKey(), "first": fa.SortKey("skill", skill_id=0), "past": fa.SortKey("skill", "asc", 9)}
    few = population.where("id % 29 = 0")
    got = {r.model_id: r for r in fa.leaderboard_ranks(few.repartition(5), orders).collect()}
    for name, (key, direction, skill) in orders.items():
        for r in lb.leaderboard_sort(few, key, direction, skill).collect():
            assert got[r.model_id][f"rank_{name}"] == r["rank"], (name, r)
    skipped = fa.leaderboard_ranks(few, {"s": fa.SortKey("skill", skill_id=0)}, nulls="skip")
    want = rows(lb.leaderboard_sort(few, "skill", skill_id=0, nulls="skip"), "model_id", "rank")
    assert rows(skipped, "model_id", "rank_s") == want
    for bad in (fa.SortKey("size"), fa.SortKey("mean", "up"), fa.SortKey("skill")):
        with pytest.raises(ValueError):
            fa.model_orders(few, {"bad": bad})


def test_no_models(spark):
    index = fa.facet_index(models(spark, {"id": 1, "theta": [0.5]}).where("false"), {"mean": fa.SortKey()})
    assert rows(fa.visible_counts(index, "mean", {"a": fa.Facets(), "b": fa.Facets(search="x")})) == [("a", 0, 0), ("b", 0, 0)]
    assert rows(fa.visible_ranks(index, "mean", FILTERS)) == rows(fa.visible_page(index, "mean", 1, 5, FILTERS)) == []


def test_bits_of_a_stretch(spark):
    rng = random.Random(5)
    members = sorted(rng.sample(range(1, 32_769), 3_000) + [1, 64, 65, 32_768])
    members = sorted(set(members))
    sets = spark.createDataFrame([(m,) for m in members], "n long").groupBy(bm.bucket(F.col("n")).alias("b")).agg(bm.collected("n").alias("bits"))
    ready = sets.select("b", bm.words(F.col("bits")).alias("w")).withColumn("e", bm.counts_before(F.col("w")))
    asked = spark.range(1, 32_769).join(ready, bm.bucket(F.col("id")) == F.col("b"))
    got = asked.select("id", bm.is_set(F.col("w"), F.col("id")), bm.bits_before(F.col("w"), F.col("e"), F.col("id"))).collect()
    held, before = set(members), 0
    for n, is_set, count in sorted(got):
        assert (is_set, count) == (n in held, before)
        before += n in held
    assert len(got) == 32_768


def test_positions_begin_anew(spark):
    """One value with most of the rows, a null value, values between ranges."""
    values = [None] * 50 + ["hot"] * 4_000 + [f"v{i % 40}" for i in range(400)]
    table = spark.createDataFrame([(v, i * 7919 % 4450) for i, v in enumerate(values)], "v string, i long").repartition(9)
    got = add_rank(table, [F.col("v").asc(), F.col("i").desc()], within="v")
    want = []
    for v in set(values):
        own = sorted((i * 7919 % 4450 for i, w in enumerate(values) if w == v), reverse=True)
        want += [(v, i, place + 1) for place, i in enumerate(own)]
    assert rows(got, "v", "i", "rank") == sorted(want, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_a_hot_benchmark_is_spread(spark):
    """Sizes of tasks: the sort is by ranges of the whole key, so no task holds the benchmark that owns most skills."""
    many = spark.range(100_000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("primary_benchmark"),
                                       (F.col("id") % 3).alias("n_items"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for operator in (ta.skills_by_size, ta.grid_order):
            with recorded() as tables:
                operator(many)
            sorted_rows = spark.read.parquet(tables[-1]).where("benchmark = 'hot'")
            sizes = [r["count"] for r in sorted_rows.groupBy(F.input_file_name()).count().collect()]
            assert len(sizes) >= 6 and max(sizes) < 20_000 and sum(sizes) == 90_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("stretch", [1, 2, 5, 1 << 16])
def test_runs_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(ta, "STRETCH", stretch)
    rng = random.Random(stretch)
    for gap in (1, 7):
        names = [n for _ in range(40) for n in [rng.choice(["A", "B", None])] * rng.choice([1, 1, 2, 9])]
        places = [i * gap + rng.randrange(gap) for i in range(len(names))]
        ordered = spark.createDataFrame(list(zip(places, names)), "pos long, benchmark string").repartition(3)
        want, at = [], 0
        for run, (name, group) in enumerate(groupby(names), 1):
            n = len(list(group))
            want.append((run, name, places[at], places[at + n - 1], n / len(names)))
            at += n
        assert sorted(map(tuple, ta.sector_runs(ordered).collect())) == want


def test_ten_million_runs(spark):
    ordered = spark.range(10_000_000).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("string").alias("benchmark"))
    got = ta.sector_runs(ordered).agg(F.count("*"), F.count_if(F.col("run") == F.col("start_pos") + 1), F.count_if(F.col("start_pos") == F.col("end_pos")),
                                      F.count_if(F.col("share") == 1e-7)).first()
    assert tuple(got) == (10_000_000,) * 4
