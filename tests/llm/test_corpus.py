"""Operators over the whole corpus: near copies, outliers, prefix trees, fixity, and the pipeline."""

import random

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from masteria.llm import chat, fixity, graph, near_copies, robust_quality, simhash

FOLDER = "/root/testdata/sf0.001"

BYTES = public.path("byte_bpe_50k.json")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


# Near copies --------------------------------------------------------------------------------------

def test_near_duplicates(spark, given, odd_rows):
    near = [(2000 + k, given[k][1] + " more words at the end") for k in range(0, 40, 4)]
    rows = [(i, t) for i, t in odd_rows if len(t or "") < 1000] + [(i + 1000, t) for i, t in given[:150]] + near
    got = simhash.near_duplicates(_docs(spark, rows).repartition(3)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == brute.near_components(rows)
    assert len(got) == len(rows)


def _balls(seed, n):
    """Fingerprints in dense groups, with chains between some, and far ones."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n):
            p = centre
            for _ in range(rng.randrange(6)):
                p ^= 1 << rng.randrange(64)
            out.add(p)
        chain = centre
        for _ in range(12):
            for b in rng.sample(range(64), 4):
                chain ^= 1 << b
            out.add(chain)
    return sorted(out | {rng.getrandbits(64) for _ in range(100)})


@pytest.mark.parametrize(("bucket", "mean", "chunk"), [(1 << 14, 16, 1 << 18), (24, 16, 1 << 18), (1 << 14, 0, 50)])
def test_links_lose_nothing(spark, bucket, mean, chunk):
    """Whatever the bounds of buckets and chunks are, components are those of comparing all pairs."""
    prints = _balls(3, 40)
    frame = spark.createDataFrame([(_signed(p),) for p in prints], "fp long")
    found = simhash.links(frame, within=4, bucket=bucket, mean=mean)
    pairs = [tuple(r) for r in found.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in graph.stars(found, chunk).collect()}
    got = [roots.get(_signed(p), _signed(p)) for p in prints]
    array = np.array(prints, dtype=np.uint64)
    label = list(range(len(prints)))
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    for _ in prints:
        new = [min(np.array(label)[row]) for row in near]
        if new == label:
            break
        label = new
    smallest = {}
    for p, k in zip(prints, label):
        smallest[k] = min(_signed(p), smallest.get(k, _signed(p)))
    assert got == [smallest[k] for k in label]


def test_one_bucket_gives_few_links():
    """A dense group of n fingerprints gives fewer than n links."""
    prints = np.array(sorted({(1 << a) ^ (1 << b) for a in range(40) for b in range(40)}), dtype=np.uint64)
    links = list(simhash.spanning_links(prints, 4))
    assert sum(len(a) for a, _ in links) == len(prints) - 1


def test_every_mask_set_covers():
    for n in (10, 10**4, 10**6, 10**8, 10**12):
        masks = simhash.block_masks(n, 4)
        rng = random.Random(n)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)


def test_stars_on_long_paths(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000) for k in range(1, 200)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)}
    for chunk in (1 << 18, 40):
        assert {r["node"]: r["root"] for r in graph.stars(frame, chunk).collect()} == want


def test_near_odd(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    empty = {(r["doc_id"], r["component_id"]) for r in got.where("fingerprint = '0000000000000000'").collect()}
    assert empty == {(0, 0), (1, 0), (2, 0), (None, 0)}
    assert simhash.near_duplicates(no_docs).count() == 0
    left = simhash.without_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == got.select("component_id").distinct().count()
    assert simhash.without_near_copies(no_docs).count() == 0


def _set(text):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def _similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("chunk, chunk_bytes", [(512, None), (4, 8 << 20), (512, 3000)])
def test_near_copies_by_shingles(spark, given, odd_rows, chunk, chunk_bytes):
    """The stage keeps one row of all that a Jaccard similarity of 0.8 on five-word shingles joins, and nothing less."""
    rng = random.Random(4)
    rows = [(i, t) for i, t in odd_rows if len(t or "") < 1000] + [(i + 1000, t) for i, t in given[:60]]
    for k in range(12):  # a changed word takes away five of 200 shingles and brings as many
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(204)]
        for c in range(6):
            other = list(words)
            for at in rng.sample(range(0, 200, 6), rng.randrange(9)):
                other[at] = "changed"
            rows.append((2000 + 10 * k + c, " ".join(other)))
    sets = [_set(t) for _, t in rows]
    label = brute.components(sets, _similar)
    smallest = {}
    for (i, _), k in zip(rows, label):
        smallest[k] = min(i, smallest.get(k, i))
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    assert any(_similar(sets[i], sets[j]) and (prints[i] ^ prints[j]).bit_count() > 4 for i in range(len(rows)) for j in range(i))
    docs = _docs(spark, rows).repartition(3)
    if chunk_bytes is None:
        left = corpus_pipeline.near_copies(spark, docs, FOLDER)
    else:
        left = near_copies.without_near_copies(docs, chunk=chunk, chunk_bytes=chunk_bytes)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(smallest.values())


def test_sketches_meet():
    """Sets with the least similarity share a band, and agree on more values than the bound."""
    rng = np.random.default_rng(5)
    for _ in range(2000):
        values = rng.integers(0, 1 << 64, 222, dtype=np.uint64)
        a, b = near_copies.sketch(values[:200]), near_copies.sketch(values[22:222])
        same = a == b
        assert same.sum() >= near_copies.AGREE and same.reshape(near_copies.BANDS, near_copies.BAND).all(axis=1).any()


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 8])
def test_near_copies_meet_by_simhash(spark, bucket):
    """Links of candidates come from fingerprints that agree on a band, or from common smallest values of few shingles."""
    rng = np.random.default_rng(6)
    rows, sizes = [], [1, 2, 4, 5, 9, 14, 16, 17, 20, 21, 40, 200]
    for k in range(12 * len(sizes)):
        n = sizes[k % len(sizes)]
        for c in range(3):  # similar sets: at least four fifths in common
            words = [f"k{k}x{i}" for i in range(n + 4 + (c if n >= 8 else 0) * (n // 8) // 2)]
            rows.append((10 * k + c, " ".join(words)))
    rows += [(5000 + k, " ".join(f"hot{i}" for i in range(60)) + f" end{k}") for k in range(40)]
    sketches = [r for r in near_copies._sketches((i, i, t) for i, t in rows)]
    same = spark.createDataFrame([(r[0], r[4], r[5], r[6]) for r in sketches], "node long, least array<long>, banded boolean, bits binary").repartition(3)
    links = {(r["a"], r["b"]) for r in near_copies.candidates(same, bucket).collect()}
    bits = {r[0]: np.unpackbits(np.frombuffer(r[6], dtype=np.uint8)) for r in sketches}
    assert all((bits[a][:256] != bits[b][:256]).sum() <= near_copies.WITHIN for a, b in links)
    sets = {i: _set(t) for i, t in rows}
    nodes = sorted(sets)
    label = {i: i for i in nodes}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[max(top(a), top(b))] = min(top(a), top(b))
    for i in nodes:
        for j in nodes:
            if i < j and _similar(sets[i], sets[j]):
                assert top(i) == top(j)


def test_near_copies_that_fingerprints_miss(spark):
    """Two texts at exactly 0.8 whose fingerprints have no band in common are joined all the same."""
    words = [f"m31747x{k}" for k in range(29)]
    texts = [" ".join(words[:24]), " ".join(words)]
    a, b = (near_copies.sketch(near_copies.shingles(t)) for t in texts)
    assert _similar(*map(_set, texts)) and not (a == b).reshape(near_copies.BANDS, near_copies.BAND).all(axis=1).any()
    left = corpus_pipeline.near_copies(spark, _docs(spark, list(enumerate(texts))), FOLDER)
    assert [r["doc_id"] for r in left.collect()] == [0]


@pytest.mark.parametrize("blind", ["no candidates", "every other candidate"])
def test_missed_near_copies_are_found_without_chance(spark, given, odd_rows, monkeypatch, blind):
    """Whatever fingerprints miss, the stage joins what all pairs join, among texts with common passages too."""
    rng = random.Random(11)
    rows = [(i, t) for i, t in odd_rows if len(t or "") < 1000] + [(i + 1000, t) for i, t in given[:60]]
    passages = [" ".join(f"p{k}x{j}" for j in range(12)) for k in range(3)]
    for k in range(14):
        words = [f"q{k}x{j}" for j in range(rng.choice((9, 14, 24, 90)))]
        for c in range(5):
            other = list(words)
            if c:  # a changed word takes away up to five shingles
                other[rng.choice((0, -1)) if len(other) < 90 else rng.randrange(90)] = f"other{c}"
            rows.append((3000 + 10 * k + c, " ".join([*passages[:k % 3], *other, *[f"end{j}" for j in range(c % 3)]])))
    found = near_copies.candidates
    monkeypatch.setattr(near_copies, "candidates", lambda same, bucket: found(same, bucket).where(F.lit(False) if blind[0] == "n" else F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0))
    smallest = brute.jaccard_components([(i, t or "") for i, t in rows if i is not None])
    left = near_copies.without_near_copies(_docs(spark, [r for r in rows if r[0] is not None]).repartition(3), chunk=near_copies.CHUNK if blind[0] == "n" else 3)
    assert len(set(smallest.values())) < len(smallest) - 20
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(smallest.values()))


def test_keys_that_occur_again():
    """Rows whose key occurs again are given out once, wherever batches end."""
    import pyarrow as pa

    keys = np.repeat(np.arange(9), [1, 5, 1, 1, 2, 7, 1, 2, 1])
    nodes = np.arange(len(keys)) + 100
    want = [(int(k), int(n)) for k, n in zip(keys, nodes) if (keys == k).sum() > 1]
    for size in (1, 2, 3, 5, 50):
        batches = [pa.record_batch({"key": keys[k:k + size], "node": nodes[k:k + size], "n": nodes[k:k + size]}) for k in range(0, len(keys), size)]
        got = [(r["key"], r["node"]) for b in near_copies._shared(iter(batches)) for r in b.to_pylist()]
        assert got == want


@pytest.mark.parametrize("size", [2, 40, near_copies.SHIFTED, 300])
def test_buckets_give_fewer_links_than_rows(size):
    """Copies that meet in many buckets are joined by a forest, as comparing all pairs joins them."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-(1 << 63), 1 << 63, (4, near_copies.COMPARED), dtype=np.int64)
    words = centres[rng.integers(0, 4, size)] ^ (rng.integers(0, 1 << 63, (size, near_copies.COMPARED)) & rng.integers(0, 1 << 63, (size, near_copies.COMPARED))
                                                 & rng.integers(0, 1 << 63, (size, near_copies.COMPARED)))
    rows = [(key, 10 * k, *words[k].tolist()) for key in range(20) for k in rng.permutation(size).tolist()]
    batch = near_copies.pa.RecordBatch.from_arrays([near_copies.pa.array(c) for c in zip(*rows)], schema=near_copies._KEYED)
    out = [b for b in near_copies._meet(near_copies.BUCKET)(iter([batch.slice(0, 7), batch.slice(7)]))]
    links = [(a // 10, b // 10) for o in out for a, b in zip(o.column("a").to_pylist(), o.column("b").to_pylist())]
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    near = lambda a, b: (bits[a] != bits[b]).sum() <= near_copies.WITHIN
    label = brute.components(list(range(size)), near)
    assert len(links) == size - len(set(label)) and all(near(a, b) for a, b in links)
    assert brute.components(list(range(size)), lambda a, b: (a, b) in links or (b, a) in links) == label


def test_large_buckets_are_not_searched_by_all_pairs_of_chunks(spark, monkeypatch):
    """Rows that are searched grow with the copies, not with their square; no copy is lost, nor a row that no chunk joins."""
    meet, read = near_copies._meet, []

    def counting(bound):
        run, total = meet(bound), spark.sparkContext.accumulator(0)
        read.append(total)

        def counted(batches):
            def each():
                for batch in batches:
                    total.add(batch.num_rows)
                    yield batch

            return run(each())

        return counted

    monkeypatch.setattr(near_copies, "_meet", counting)
    rng, searched = np.random.default_rng(8), {}
    # A copy differs from the centre in 10 to 19 bits; six strangers share its first band only.
    centre = rng.integers(0, 2, near_copies.BANDS * near_copies.BAND, dtype=np.uint8)
    for n in (150, 600):
        rows = []
        for k in range(n + 6):
            bits = rng.integers(0, 2, len(centre), dtype=np.uint8) if k >= n else centre.copy()
            if k < n:
                bits[rng.choice(np.arange(12, 256), rng.integers(10, 20), replace=False)] ^= 1
            bits[:12] = centre[:12]
            rows.append((k, [], True, np.packbits(bits).tobytes()))
        same = spark.createDataFrame(rows, "node long, least array<long>, banded boolean, bits binary").repartition(3)
        read.clear()
        links = near_copies.candidates(same, 64).distinct().collect()
        searched[n] = sum(total.value for total in read[1:])
        roots = {r["node"]: r["root"] for r in graph.stars(spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")).collect()}
        assert {k for k, root in roots.items() if root == 0} | {0} == set(range(n)) and not set(roots) & set(range(n, n + 6))
    assert 0 < searched[600] < 6 * searched[150]


def test_large_buckets_join_what_all_pairs_join(spark):
    """Several components in one large bucket, among them chains that only neighbours link."""
    rng = np.random.default_rng(9)
    rows = []
    for length in (60, 40, 25, 1, 1, 1, 9):
        bits = rng.integers(0, 2, near_copies.BANDS * near_copies.BAND, dtype=np.uint8)
        for _ in range(length):
            bits[rng.choice(np.arange(12, 256), 50, replace=False)] ^= 1
            bits[:12], bits[256:] = 0, rng.integers(0, 2, len(bits) - 256)
            rows.append((len(rows), [], True, np.packbits(bits).tobytes()))
    words = np.stack([np.frombuffer(r[3], dtype=np.uint8)[:32] for r in rows])
    label = brute.components(list(range(len(rows))), lambda a, b: np.bitwise_count(words[a] ^ words[b]).sum() <= near_copies.WITHIN)
    assert 7 <= len(set(label)) < 20
    same = spark.createDataFrame(rows, "node long, least array<long>, banded boolean, bits binary").repartition(3)
    for bucket in (8, 40, near_copies.BUCKET):
        roots = {r["node"]: r["root"] for r in graph.stars(near_copies.candidates(same, bucket)).collect()}
        assert [roots.get(k, k) for k in range(len(rows))] == [label.index(x) for x in label]


# Quality --------------------------------------------------------------------------------------------

def test_base_statistics(spark, given, odd_rows):
    rows = odd_rows + [(i + 1000, t) for i, t in given]
    rows += [(3000, "a b c d e f g h " * 30), (3001, "x y z " * 9 + "one " * 20), (3002, " ".join(map(str, range(30))) + " 0 1 2 3 4 5 6 7")]
    docs = _docs(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = robust_quality.robust_quality(docs).collect()
    assert len(got) == len(rows)
    want = {i: brute.quality(t or "") for i, t in rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


def test_labelled_documents(spark):
    """Documents labelled as clean stay, those labelled as bad go."""
    folder = "/root/testdata/sf0.1"
    got = robust_quality.robust_quality(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = (got.where("n_words >= 20").join(labels, "doc_id").groupBy("quality")
            .agg(F.avg(F.col("kept").cast("double")), F.count("*")).collect())
    kept = {r[0]: r[1] for r in rows}
    assert kept[1] > 0.995 and kept[0] < 0.05, rows


def test_kept_against_a_plain_search(spark):
    """Every language and source by itself, and pooled ones, against the same search over arrays."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for least, folder in ((30, FOLDER), (50, "/root/testdata/sf0.01"), (8, FOLDER)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        stats = [r.asDict() for r in robust_quality.text_statistics(docs).collect()]
        groups = {(r["lang"], r["source"]): r["group"] for r in robust_quality.groups_of(spark.createDataFrame(stats), least).collect()}
        good = lambda r: not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        vector = lambda r: [r[c] / robust_quality.UNIT for c in robust_quality.X]
        n, share = robust_quality.P, 0.75
        factor = share / robust_quality.chi_square(robust_quality.chi_square_quantile(share, n), n + 2)
        edge, want = robust_quality.chi_square_quantile(0.99999, n), {}
        for name in set(groups.values()):
            mine = [r for r in stats if groups[r["lang"], r["source"]] == name]
            x = np.array([vector(r) for r in mine if good(r)])
            if not len(x):
                want |= {r["doc_id"]: False for r in mine}
                continue
            centre, scatter = brute.concentrated(x, share, robust_quality.LEAST_DEVIATION, factor)
            inverse = np.linalg.inv(scatter)
            for r in mine:
                off = np.array(vector(r)) - centre
                want[r["doc_id"]] = bool(good(r) and off @ inverse @ off <= edge)
        got = {r["doc_id"]: r["kept"] for r in robust_quality.robust_quality(docs, least=least).collect()}
        assert got == want


def test_the_bound_of_a_task_does_not_change_estimates(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(2.0, 0.5, (900, robust_quality.P)), rng.normal(3.0, 0.2, (300, robust_quality.P)), np.full((400, robust_quality.P), 2.5)])
    rows = [(f"g{k % 3}", *map(int, np.round(v * robust_quality.UNIT))) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "group string, " + ", ".join(f"{c} long" for c in robust_quality.X)).repartition(4)
    want = sorted(robust_quality.estimates(frame).collect())
    for gather, few in ((1, 20_000), (40, 0)):
        assert sorted(robust_quality.estimates(frame, gather=gather, few=few).collect()) == want


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(2)
    unit = robust_quality.UNIT
    clean = rng.normal(2.0, 0.3, (4000, robust_quality.P))
    clean[:, 1] += 0.8 * (clean[:, 0] - 2)
    bad = rng.normal(9.0, 0.1, (1200, robust_quality.P))
    rows = [("g", *map(int, np.round(x * unit))) for x in np.concatenate([clean, bad])]
    frame = spark.createDataFrame(rows, "group string, " + ", ".join(f"{c} long" for c in robust_quality.X)).repartition(4)
    model = robust_quality.estimates(frame).first()
    assert np.abs(np.array(model["centre"]) - clean.mean(axis=0)).max() < 0.05
    inverse = np.zeros((robust_quality.P,) * 2)
    for (i, j), v in zip(robust_quality.PAIRS, model["precision"]):
        inverse[i, j] = inverse[j, i] = v
    scatter = np.linalg.inv(inverse) - np.diag(np.square(robust_quality.LEAST_DEVIATION))
    # A little large, as the wanted share holds nearly all clean rows; the plain covariance has 9 on its diagonal.
    assert np.abs(scatter - np.cov(clean.T)).max() < 0.05


def test_estimates_do_not_depend_on_other_groups(spark):
    """Concentration steps go on until every group has settled, however many others have."""
    rng = np.random.default_rng(3)
    slow = np.concatenate([rng.normal(2.0, 0.5, (700, robust_quality.P)), rng.normal(3.5, 0.5, (500, robust_quality.P))])
    quick = rng.normal(2.0, 0.01, (40, robust_quality.P))
    rows = [("slow", *map(int, np.round(x * robust_quality.UNIT))) for x in slow]
    others = [(f"q{k}", *map(int, np.round(x * robust_quality.UNIT))) for k in range(100) for x in quick]
    schema = "group string, " + ", ".join(f"{c} long" for c in robust_quality.X)
    one, many = (robust_quality.estimates(spark.createDataFrame(r, schema).repartition(4)).where("group = 'slow'").first()
                 for r in (rows, rows + others))
    assert one == many


def test_chi_square():
    assert abs(robust_quality.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3
    assert abs(robust_quality.chi_square_quantile(0.99, 5) - 15.0863) < 1e-3


def test_small_groups_are_joined(spark):
    rows = [("en", "a", 100)] * 30 + [("en", "b", 100)] * 5 + [("en", "c", 100)] * 6 + [("de", "a", 100)] * 3 + [("fr", "a", 1)] * 50
    stats = spark.createDataFrame([(a, b, n, 0) for a, b, n in rows], "lang string, source string, n_words long, n_repeat_words long")
    got = {(r["lang"], r["source"]): r["group"] for r in robust_quality.groups_of(stats, 10).collect()}
    assert got == {("en", "a"): '["en","a"]', ("en", "b"): '["en"]', ("en", "c"): '["en"]', ("de", "a"): "[]", ("fr", "a"): "[]"}


def test_quality_odd(spark, odd_docs, no_docs):
    got = robust_quality.robust_quality(odd_docs)
    assert got.count() == odd_docs.count()
    assert robust_quality.robust_quality(no_docs).count() == 0
    left = robust_quality.without_outliers(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == got.where("kept").count()
    assert robust_quality.without_outliers(no_docs).count() == 0


# Conversations --------------------------------------------------------------------------------------

CONTROL = [r"</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\\", "\\n", "<\\/s>", "<<SYS>><</SYS>>", "[INST", "<|end|", "\\<s>\\\\", ""]


def test_turns_are_read_back():
    for role in (*CONTROL, "user", "a\nb"):
        for text in CONTROL:
            segment, start, end = chat.segment_of(role, text)
            assert chat.parse(segment) == (role, text) and start == end
            assert sum(segment.count(c) for c in chat.CONTROLS) == 2
    segment, start, end = chat.segment_of("assistant", "x </s>")
    assert chat.unescape(segment[start:end]) == "x </s>"


def _chats():
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        shared = rng.randrange(4)
        turns = [("user", f"hello {k % 2}") for k in range(shared)] + [
            (rng.choice(["user", "assistant", "system", None]), rng.choice([*CONTROL, None, f"own {conv}", "é🙂"])) for _ in range(rng.randrange(1, 5))]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, k, r, t) for c, k, r, t in rows if c == 7] + [(None, 1, "user", "nobody"), (None, None, "assistant", "first"),
                                                               (101, 0, "assistant", "b"), (101, 0, "assistant", "a"), (101, 0, "assistant", "a")]
    return rows


@pytest.mark.parametrize("limit, tokenizer", [(1, None), (300, None), (1 << 20, None), (1, BYTES), (150, BYTES), (1 << 20, BYTES)])
def test_prefix_trees(spark, limit, tokenizer):
    rows = _chats()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pack", F.lit(1))
    packs = chat.prefix_packs(frame.repartition(3), limit, tokenizer)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(packs, tokenizer).collect()}
    assert got == brute.conversations(rows)
    unit = "ids" if tokenizer else "segment"
    placed = [r.asDict() for r in packs.collect()]
    for r in placed:
        r["segment"] = r[unit] if r[unit] is None else tuple(r[unit])
    assert len(placed) == len(rows)
    own = {(r["pack"], r["start"]): r for r in placed if r["segment"] is not None}
    if tokenizer:
        library = Tokenizer.from_file(tokenizer)
        for r in own.values():
            text = library.decode(list(r["segment"]), skip_special_tokens=False)
            head, body, tail = r["segment"][:r["loss_start"]], r["segment"][r["loss_start"]:r["loss_end"]], r["segment"][r["loss_end"]:]
            assert text.startswith(chat.TURN) and text.endswith(chat.END)
            assert "".join(library.decode(list(p), skip_special_tokens=False) for p in (head, body, tail)) == text
    by_conv = {}
    for r in placed:
        by_conv.setdefault(r["conv"], []).append(r)
    for pack in {p for p, _ in own}:
        at = 0
        for (_, start), r in sorted(x for x in own.items() if x[0][0] == pack):
            assert start == at and r["end"] - start == len(r["segment"])  # no gaps
            at = r["end"]
    for turns in by_conv.values():
        position, seen = 0, []
        for r in sorted(turns, key=lambda r: r["idx"]):
            node = own[r["pack"], r["start"]]
            assert r["position"] == position
            allowed = [k for a in node["attends"] for k in range(a["start"], a["end"])]
            assert allowed == seen  # exactly the ancestors
            seen = seen + list(range(r["start"], r["end"]))
            position += r["end"] - r["start"]
    if limit > 1000:
        segments = [(r["pack"], tuple(x["segment"] for x in [own[y["pack"], y["start"]] for y in sorted(by_conv[r["conv"]], key=lambda y: y["idx"])][:r["idx"] + 1]))
                    for r in own.values()]
        assert len(set(segments)) == len(segments)  # a prefix once per pack


def test_a_conversation_of_many_turns(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows = rows.unionByName(rows.where("turn < 99990").withColumn("conv_id", F.lit(2).cast("long")))
    packs = chat.prefix_packs(rows, 1 << 24)
    assert packs.where("segment IS NOT NULL").count() == n
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(packs).collect()} == {1: n, 2: 99_990}


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.prefix_packs(frame)).count() == 0


# Fixity ----------------------------------------------------------------------------------------------

def _records(spark, rows):
    return spark.createDataFrame(rows, "archive string, offset long, length long, record_id long, sha256 string")


@pytest.mark.parametrize(("span", "fan_out"), [(10, 2), (64, 4), (1 << 18, 16)])
def test_audit(spark, span, fan_out):
    ours = [(a, k * 7, 7, k, f"h{k}") for a in ("a", "b", "c") for k in range(100)] + [("only", 0, 7, 0, "x")]
    theirs = [r for r in ours if r[0] != "only" and (r[0], r[3]) != ("a", 50)]
    theirs = [(*r[:4], "rot") if (r[0], r[3]) in (("a", 3), ("c", 99)) else r for r in theirs] + [("c", 10_000, 7, 500, "more")]
    got = {tuple(r) for r in fixity.audit(_records(spark, ours), _records(spark, theirs), span, fan_out).collect()}
    assert got == {("a", 21, 3, "h3", "rot", "corrupt"), ("c", 693, 99, "h99", "rot", "corrupt"), ("a", 350, 50, "h50", None, "missing"),
                   ("only", 0, 0, "x", None, "missing"), ("c", 10_000, 500, None, "more", "extra")}
    assert fixity.audit(_records(spark, ours), _records(spark, ours), span, fan_out).count() == 0
    assert fixity.audit(_records(spark, []), _records(spark, []), span, fan_out).count() == 0
    assert fixity.audit(_records(spark, ours[:5]), _records(spark, []), span, fan_out).count() == 5


def test_records_odd(spark):
    rows = [(1, "u", "é"), (1, "u", "é"), (None, None, None), (None, "u", ""), (2000, "v", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    got = fixity.record_hashes(pages, F.col("html")).collect()
    assert len(got) == 5
    named = sorted((r["archive"], r["offset"], r["length"]) for r in got if r["archive"].startswith("pages"))
    assert [n[:2] for n in named] == [("pages-0", 0), ("pages-0", named[0][2]), ("pages-1", 0)]


# The pipeline ------------------------------------------------------------------------------------------

def test_pipeline(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    verdict = {r["doc_id"]: r["kept"] for r in robust_quality.robust_quality(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    rows = [r for r in rows if verdict[r[0]]]
    last = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        last[brute.lower(t)] = i
    rows = [r for r in rows if last[brute.lower(r[1])] == r[0]]
    near = brute.jaccard_components([r[:2] for r in rows])
    rows = [r for r in rows if near[r[0]] == r[0]]
    owners = {}
    for i, t, lang, source in rows:
        for kind, a, b in brute.secrets(t) + brute.mixed(t):
            owners.setdefault(_value(kind, t[a:b]), set()).add(source)
    tokenizer, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), {}
    for i, t, *_ in rows:
        at, out = 0, ""
        for kind, a, b in sorted(brute.secrets(t) + brute.mixed(t), key=lambda s: s[1:]):
            if len(owners[_value(kind, t[a:b])]) < 3 and b > at:
                out, at = (out + t[at:a] + "[SECRET]", b) if a >= at else (out, b)
        want[i] = len(tokenizer.encode(out + t[at:], add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r["doc_id"]: r["doc_tokens"] for r in got.collect()} == want
    assert got.agg(F.sum("length")).first()[0] == sum(want.values())


def _value(kind, found):
    import re

    return re.split(r"""["']?\x20*[:=]\x20*["']?""", found, maxsplit=1)[1] if kind == "assign" else found


def test_stages_keep_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, FOLDER).select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()


def test_odd_rows_through_all_stages(spark, odd_docs):
    """Columns with clashing names go through every stage; what a stage has stored goes when the next has its input."""
    docs = odd_docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" some more words that fill the text") , F.lit(" and others that come after them") , F.lit(" so that rules see enough of it all to keep the row")))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)  # not written in between: tables that are still read are kept
    kept = docs.select("doc_id").distinct().count()
    assert 1 < kept <= odd_docs.count()


def test_large_buckets_over_many_batches(monkeypatch):
    """Wherever batches and search blocks end, a bucket above the bound is handed on whole, and once."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "ROWS", 50)
    sizes = [3, 200, 1, 24, 25, 2, 120, 30]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 62, len(keys))
    prints[0:3] = [1, 3, 7]
    for size in (7, 50, 1000):
        batches = [pa.record_batch({"key": keys[k:k + size], "fp": prints[k:k + size]}) for k in range(0, len(keys), size)]
        out = [r for b in simhash._search(4, 24)(iter(batches)) for r in b.to_pylist()]
        left = sorted((r["key"], r["a"]) for r in out if r["key"] is not None)
        assert left == sorted((int(k), int(p)) for k, p in zip(keys, prints) if sizes[k] > 24)
        found = {(r["a"], r["b"]) for r in out if r["key"] is None}
        assert {(3, 1), (7, 3)} <= found or {(3, 1), (7, 1)} <= found
