import json
import random

import pytest
from pyspark.sql import functions as F

from masteria.operators.leaderboard import model_mean_theta
from masteria.sources import arrays
from masteria.sources import readers as rd
from masteria.sources.writers import write_models
from tables import models, rows

MODELS = [
    {"id": 3, "name": "b", "family": "Phi", "tier": "Small", "params": 7, "theta": [0, 1]},
    {"id": 1, "name": "a", "hf_id": "o__a", "family": "Phi", "tier": "Mid", "params": None, "theta": [0.5, None], "accuracy": 0.25},
]


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def _write(folder, name, text):
    path = f"{folder}/{name}.json"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_models_in_every_layout(spark, folder):
    columns = ("id", "name", "hf_id", "family", "tier", "params", "theta", "accuracy")
    bare = rd.read_models(spark, _write(folder, "bare", json.dumps(MODELS, indent=1)))
    wrapped = rd.read_models(spark, _write(folder, "wrapped", json.dumps({"models": MODELS})))
    lines = rd.read_models(spark, _write(folder, "lines", "\n".join(map(json.dumps, MODELS))))
    want = [(1, "a", "o__a", "Phi", "Mid", None, [0.5, None], 0.25), (3, "b", None, "Phi", "Small", 7.0, [0.0, 1.0], None)]
    assert rows(bare, *columns) == rows(wrapped, *columns) == rows(lines, *columns) == want
    assert rows(bare, "ord", "id") == rows(wrapped, "ord", "id") == [(0, 3), (1, 1)]


def test_empty_and_broken_files(spark, folder):
    assert rd.read_models(spark, _write(folder, "none", "[]")).count() == 0
    assert rd.read_models(spark, _write(folder, "nothing", '{"models": []}')).count() == 0
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        rd.read_models(spark, _write(folder, "broken", '[{"id": 1,')).collect()


def test_nothing_is_lost(spark, folder):
    """Lines read without naming the form, several files, wrong roots and text after the root."""
    table = spark.range(5).select(F.col("id"), F.lit("n").alias("name"), F.array(F.lit(0.5)).alias("theta")).repartition(3)
    write_models(table, f"{folder}/lines", "json")
    assert rows(rd.read_models(spark, f"{folder}/lines"), "id") == [(k,) for k in range(5)]
    write_models(table, f"{folder}/parquet")
    assert rows(rd.read_models(spark, f"{folder}/parquet"), "id") == [(k,) for k in range(5)]
    for k in range(2):
        (spark.createDataFrame([(json.dumps(MODELS),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/several"))
    for path in (f"{folder}/several", _write(folder, "after", "[]\n[]"), _write(folder, "more", '[{"id": 1}] x'),
                 _write(folder, "two", '[{"id": 1}], [{"id": 2}]')):
        with pytest.raises(Exception, match="one array|MALFORMED|malformed"):
            rd.read_models(spark, path).collect()
    for text in ('{"models": null}', '{"error": "x"}'):
        with pytest.raises(Exception, match="no array|MALFORMED|malformed"):
            rd.read_models(spark, _write(folder, "root", text), form="wrapped").collect()
    assert rd.read_models(spark, _write(folder, "pretty", json.dumps({"models": MODELS}, indent=2))).count() == 2
    assert rd.read_models(spark, _write(folder, "blank", "")).count() == 0


def test_cells(spark, folder):
    (spark.createDataFrame([(1, 2, float("nan")), (1, 3, 0.5), (2, 2, None)], "model_id long, skill_id long, theta double")
     .write.parquet(f"{folder}/cells"))
    assert rows(rd.read_cells(spark, f"{folder}/cells")) == [(1, 2, None), (1, 3, 0.5), (2, 2, None)]


def test_nan_is_missing(spark, folder):
    path = _write(folder, "nan", '[{"id": 1, "theta": [NaN, 0.5]}]')
    assert rows(rd.read_models(spark, path), "theta") == [([None, 0.5],)]
    assert rows(model_mean_theta(rd.read_models(spark, path))) == [(1, 0.25)]


def test_skills_and_items(spark, folder):
    skills = [{"id": 0, "label": "x", "n_items": 2, "example_items": [
        {"item_idx": 4, "benchmark": "MATH", "text": "q"}, {"item_idx": 2, "benchmark": "BBH", "text": "r", "subtask": "s"}]},
        {"id": 1, "label": "y", "n_items": 1}]
    for text in (json.dumps(skills), json.dumps({"skills": skills})):
        table = rd.read_skills(spark, _write(folder, "skills", text))
        assert rows(table, "id", "label", "n_items") == [(0, "x", 2), (1, "y", 1)]
        assert rows(rd.read_items(table), "skill_id", "slot", "item_id", "benchmark", "subtask", "text") == [
            (0, 1, 4, "MATH", None, "q"), (0, 2, 2, "BBH", "s", "r")]


def test_skill_map(spark, folder):
    path = _write(folder, "map", '[{"id": 1, "x": 0, "y": 1}, {"id": 0, "x": 0.25, "y": 0.5}]')
    assert rows(rd.read_skill_map(spark, path)) == [(0, 0.25, 0.5), (1, 0.0, 1.0)]
    absent = rd.read_skill_map(spark, f"{folder}/absent.json")
    assert absent.columns == ["id", "x", "y"] and absent.count() == 0


def test_responses(spark, folder):
    spark.createDataFrame([(0, "a", [1, 0]), (1, "b", [None, 1])], "pos long, hf_id string, answers array<int>").write.parquet(f"{folder}/r")
    assert rows(rd.read_responses(spark, f"{folder}/r")) == [(0, 0, 1), (0, 1, 0), (1, 0, None), (1, 1, 1)]


def test_write_models(spark, folder):
    table = models(spark, {"id": 1, "theta": [0.5, None], "accuracy": 0.5}).drop("ord")
    write_models(table, f"{folder}/m", "json")
    assert rows(rd.read_models(spark, f"{folder}/m")) == rows(table)
    write_models(table, f"{folder}/p")
    with pytest.raises(ValueError, match="read from it"):
        write_models(spark.read.parquet(f"{folder}/p").withColumn("accuracy", F.lit(0.1)), f"{folder}/p")
    assert rows(spark.read.parquet(f"{folder}/p")) == rows(table)
    with pytest.raises(ValueError):
        write_models(table, f"{folder}/x", "csv")


TREES = ["a}{][,b", 'quo"te \\ back', '"models": [', "é日🙂}", "\n\t", "", '\\"}]', "[{"]


def _tree(k):
    return {"id": k, "label": TREES[k % len(TREES)] * (1 + k % 3), "example_items": [
        {"item_idx": j, "text": TREES[(k + j) % len(TREES)], "benchmark": "}]"[j % 2:]} for j in range(k % 4)]}


@pytest.mark.parametrize("wrapper, indent, n", [(None, None, 90), (None, 1, 40), ("skills", None, 60), ("skills", 2, 0), (None, None, 0), ("mixed", None, 30)])
def test_arrays_are_split(spark, folder, wrapper, indent, n):
    """Files are cut anywhere, inside strings and characters too; rows and their places stay."""
    trees = [_tree(k) for k in range(n)]
    root = {"meta": {"a": [{"b": {}}]}, "skills": trees, "more": [{"id": 5}]} if wrapper == "mixed" else {"skills": trees} if wrapper else trees
    path = _write(folder, "tree", json.dumps(root, indent=indent, ensure_ascii=n % 20 == 10))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1001")
        read = rd.read_skills(spark, path)
        got = {r["ord"]: (r["id"], r["label"], [(i["item_idx"], i["text"], i["benchmark"]) for i in r["example_items"] or []]) for r in read.collect()}
        texts = arrays.elements(spark, path, "skills" if wrapper else None)
        if n > 20:
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 3
            assert texts.agg(F.max(F.length("text"))).first()[0] < 1200
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {k: (t["id"], t["label"], [(i["item_idx"], i["text"], i["benchmark"]) for i in t["example_items"]]) for k, t in enumerate(trees)}


def test_array_over_several_files(spark, folder):
    lines = ["[", *((", " if k else "") + json.dumps(_tree(k)) for k in range(20)), "]"]
    spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, value string").orderBy("k").select("value").write.text(f"{folder}/parts")
    assert rows(rd.read_skills(spark, f"{folder}/parts"), "ord", "id") == [(k, k) for k in range(20)]
    large = [" ", "[", json.dumps(_tree(0)), *("," + json.dumps(_tree(k)) for k in range(1, 300)), "]"]
    for k, part in enumerate(("".join(large[:2]), large[2], "".join(large[3:]))):  # the largest file is read first
        with open(f"{folder}/large {k}.json", "w") as f:
            f.write(part)
    assert rows(rd.read_skills(spark, f"{folder}/large*.json"), "ord", "id") == [(k, k) for k in range(300)]


@pytest.mark.parametrize("text", ['[{"id": 1}, 5, {"id": 2}]', '[{"id": 1} {"id": 2}]', '[1]', '[{"id": 1}', '[{"id": "x]', '{"models": [{"id": 1}]} {}',
                                  '{"other": {"models": [{"id": 1}]}}'])
def test_other_texts_are_refused(spark, folder, text):
    with pytest.raises(Exception, match="one array|no array|MALFORMED|malformed"):
        rd.read_models(spark, _write(folder, "odd", text), form="array" if text[0] == "[" else "wrapped").collect()


def test_effects_need_no_patterns(spark):
    """Sides and depths of odd texts equal those of a plain scanner, by literal replacements only."""
    rng = random.Random(8)
    texts = ["".join(rng.choice('\\\\\\""[]{n ,é') for _ in range(rng.randrange(14))) for _ in range(3000)] + [""]

    def scan(text, inside):
        depth, at, start = 0, 0, inside
        while at < len(text):
            if text[at] == "\\":
                at += 1
            elif text[at] == '"':
                inside = not inside
            elif not inside:
                depth += (text[at] in "[{") - (text[at] in "]}")
            at += 1
        return depth, int(inside != start)

    rows = arrays._with_effects(spark.createDataFrame([(t,) for t in texts], "value string"), "value", "")
    assert "regexp" not in rows._jdf.queryExecution().executedPlan().toString().lower()
    for r in rows.collect():
        assert (r["outside"], r["turns"]) == scan(r["value"], False) and r["inside"] == scan(r["value"], True)[0]


def test_effects_of_bytes():
    """Escapes, sides and depths of odd texts, as a plain scanner has them; the braces that end chunks are counted."""
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice('\\\\\\""[]{}n ,é') for _ in range(rng.randrange(16)))
        want = []
        for inside in (False, True):
            depth, at, side = 0, 0, inside
            while at < len(text):
                if text[at] == "\\" and text[at + 1:at + 2] != "}":
                    at += 1
                elif text[at] == '"':
                    side = not side
                elif not side:
                    depth += (text[at] in "[{") - (text[at] in "]}")
                at += 1
            want += [depth, int(side != inside)]
        assert arrays.effects(text.encode()) == (want[1], want[0], want[2])


@pytest.mark.parametrize("stretch", [1, 40, 700, 1 << 22])
@pytest.mark.parametrize("wrapper", [None, "skills"])
def test_elements_over_many_stretches(spark, folder, monkeypatch, stretch, wrapper):
    """Wherever rows of chunks end, elements are whole and numbered; compressed files may end anywhere, with a brace or not."""
    import gzip
    import os

    monkeypatch.setattr(arrays, "STRETCH", stretch)
    trees = [_tree(k) for k in range(40)]
    text = json.dumps({"meta": [{"skills": 1}], "skills": trees} if wrapper else trees, ensure_ascii=False).encode()
    os.mkdir(f"{folder}/packed")
    ends = [0, text.index(b"[{") + 1, text.index(b"}", 900) + 1, text.index(b"}", 1500) + 3, text.rindex(b"}", 0, 3000), len(text)]
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        with gzip.open(f"{folder}/packed/{k}.json.gz", "wb") as f:
            f.write(text[a:b])
    read = rd.read_skills(spark, f"{folder}/packed", form="wrapped" if wrapper else "array")
    assert {r["ord"]: (r["id"], r["label"], len(r["example_items"])) for r in read.collect()} == {
        k: (t["id"], t["label"], len(t["example_items"])) for k, t in enumerate(trees)}


def test_arrays_take_little_disk(spark):
    """What is written and stored for an array is less than its text, and texts are not shuffled again by the reader."""
    import os

    from masteria import queries
    from masteria.plans import storage

    folder, seen = "/root/testdata/sf0.01", storage._folder(spark).removeprefix("file:")
    before = set(os.listdir(seen)) if os.path.isdir(seen) else set()
    read = queries.read_skills_array(spark, folder)
    assert read.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    size = sum(os.path.getsize(f"{top}/{name}") for one in set(os.listdir(seen)) - before for top, _, names in os.walk(f"{seen}/{one}") for name in names)
    text = queries.fx.catalogue_with_examples(spark, folder).select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first().n
    assert size < text / 2
