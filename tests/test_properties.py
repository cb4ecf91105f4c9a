"""Random inputs against plain Python."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from masteria.functions import text as tx
from masteria.functions.fixed import ASCII_SPACE, WIDE_SPACE
from masteria.operators import cells as ce
from masteria.operators import compare as co
from masteria.operators import population as po
from masteria.plans import storage
from masteria.plans.ranking import add_rank
from tables import models, rows, skills

SPACES = ASCII_SPACE + " " + WIDE_SPACE


def _strings(seed, alphabet, n=400, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_requested_ids(spark):
    given = _strings(1, "0123456789,,,  \t+-ax.", longest=24)

    def ids(csv):
        found = []
        for part in csv.split(","):
            match = re.match(r"[+-]?[0-9]+", part.lstrip(SPACES))
            if match:
                found.append(int(match.group()))
        return [n if -2**63 <= n < 2**63 else None for n in found[:3]]

    frame = spark.createDataFrame(list(enumerate(given)), "i long, m string").select("i", tx.requested_ids(F.col("m")).alias("got"))
    assert dict(rows(frame)) == {i: ids(m) for i, m in enumerate(given)}


def test_normalized(spark):
    given = _strings(2, SPACES + "   \n\tabcABCÉé….")
    blank = re.compile(f"[{re.escape(SPACES)}]+")
    frame = spark.createDataFrame(list(enumerate(given)), "i long, t string").select("i", tx.normalized(F.col("t")).alias("got"))
    assert dict(rows(frame)) == {i: blank.sub(" ", t.strip(SPACES).lower()) for i, t in enumerate(given)}


def test_displayed(spark):
    rng = random.Random(3)
    given = ["".join(rng.choice("ab😀") for _ in range(rng.randrange(20, 56))) + rng.choice(["", ".", "!", "…", ")"])
             for _ in range(300)]

    def shown(label):
        units = len(label.encode("utf-16-le")) // 2
        return label + "…" if units >= 50 and label[-1] not in ".!?)…" else label

    frame = spark.createDataFrame(list(enumerate(given)), "i long, t string").select("i", tx.displayed(F.col("t")).alias("got"))
    assert dict(rows(frame)) == {i: shown(t) for i, t in enumerate(given)}


def test_rank_with_one_value_on_most_rows(spark):
    rng = random.Random(4)
    given = [(i, None if rng.random() < 0.3 else rng.choice([0.5, 0.5, 0.5, rng.random()])) for i in range(5000)]
    frame = spark.createDataFrame(given, "i long, v double").repartition(16)
    ranked = add_rank(frame, [F.desc_nulls_last("v"), F.asc("i")])
    want = sorted(given, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert rows(ranked, "rank", "i") == [(n + 1, i) for n, (i, _) in enumerate(want)]
    assert rows(add_rank(frame.where("i < 0"), [F.asc("i")])) == []


def _random_models(spark, seed, n=60, missing=0.0):
    rng = random.Random(seed)
    return models(spark, *[{"id": i, "theta": [None if rng.random() < missing else rng.randrange(65) / 64 for _ in range(8)]}
                           for i in range(n)])


def test_relative_cells_balance(spark):
    axis = skills(spark, *[{"id": i} for i in range(8)])
    sums = ce.relative_cells(_random_models(spark, 5), axis).groupBy("skill_id").agg(F.sum("delta").alias("s"))
    assert all(abs(s) < 1e-9 for _, s in rows(sums))


def test_histogram_counts_every_model(spark):
    axis = skills(spark, *[{"id": i} for i in range(9)])
    counts = po.skill_histograms(_random_models(spark, 6, missing=0.2), axis).groupBy("skill_id").agg(F.sum("n"), F.max("height"))
    assert rows(counts) == [(i, 60, 1.0) for i in range(9)]


def test_top_models_equal_a_full_sort(spark):
    axis = skills(spark, *[{"id": i} for i in range(9)])
    for seed, n, k in ((7, 60, 5), (8, 3, 5), (9, 60, 70)):
        table = _random_models(spark, seed, n, missing=0.3)
        by_id = {r.id: r.theta for r in table.collect()}
        facets = {r.id: (r.family, r.tier, r.params) for r in table.collect()}
        want = []
        for s in range(9):
            values = {m: (t[s] if s < 8 and t[s] is not None else 0.0) for m, t in by_id.items()}
            first = sorted(values, key=lambda m: (-values[m], m))[:k]
            want += [(s, i + 1, m, f"m{m}", *facets[m], values[m]) for i, m in enumerate(first)]
        assert rows(po.top_models_per_skill(table.repartition(5), axis, k)) == want
        assert rows(po.best_model_per_skill(table, axis)) == [(s, m, name, v) for s, r, m, name, *_, v in want if r == 1]


def test_leads_and_ties_add_up(spark):
    axis = skills(spark, *[{"id": i} for i in range(8)])
    table = _random_models(spark, 10, n=6)
    by_id = {r.id: r.theta for r in table.collect()}
    pairs = [(a * 6 + b, f"{a},{b}") for a in range(6) for b in range(6)]
    chosen = co.resolve_selections(spark.createDataFrame(pairs, "request_id long, m string"), table)
    want = [(a * 6 + b, sum(x > y for x, y in zip(by_id[a], by_id[b])), sum(y > x for x, y in zip(by_id[a], by_id[b])), 8)
            for a in range(6) for b in range(6)]
    assert rows(co.lead_counts(chosen, table, axis)) == want


class _Context:
    """Stands in for the context of a session whose settings cannot be changed while it runs."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"{folder}/id"


def test_shared_folder():
    def session(setting, context):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)

    assert storage.shared_folder(session("hdfs://x/y/", _Context("yarn"))) == "hdfs://x/y"
    assert storage.shared_folder(session(None, _Context("yarn", "hdfs://x/z"))) == "hdfs://x/z"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(session(None, _Context("yarn")))
    context = _Context("local[8]")
    made = storage.shared_folder(session(None, context))
    assert made.startswith("/tmp/spark-") and storage.shared_folder(session(None, context)) == made


def test_stored_tables_read_back(spark):
    assert rows(storage.stored(spark.range(10), "t")) == [(i,) for i in range(10)]
