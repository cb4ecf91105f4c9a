"""Runs, fingerprints and token alignment against brute force."""

import hashlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from masteria.llm import alignment, fingerprints, packing, periodic_runs
from masteria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


# Runs --------------------------------------------------------------------------------------------------

def _found(words, least):
    return periodic_runs.find_runs(np.array(words, dtype=np.int64), least)


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.integers(0, 2), max_size=30), st.integers(1, 6), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 5),
       st.sampled_from([3, 5, 9, 24]))
def test_runs_inside_runs(block, times, tail, again, least):
    words = (block * times + tail) * again + block
    assert _found(words, least) == brute.runs(words, least)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 12, 13, 40, 97, 333])
def test_runs_of_every_scale(period):
    rng = np.random.default_rng(period)
    block = rng.integers(0, 50, period).tolist()
    for extra in (0, 1, period - 1):
        words = [900, 901] + block * 4 + (block * 2)[:extra] + [902]
        assert _found(words, 24) == brute.runs(words, 24)
        short = [900] + (block * 3)[:3 * period - 1] + [901]
        assert _found(short, 24) == brute.runs(short, 24)


def test_runs_of_words_that_recur_without_one_period():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a  # the Fibonacci word has runs of up to 3.6 periods on every scale
    assert _found(b, 24) == brute.runs(b, 24) != []
    thue = [bin(i).count("1") % 2 for i in range(3000)]  # no three equal neighbours on any scale
    assert _found(thue, 3) == []


def test_a_very_long_run():
    words = np.tile(np.arange(70_000), 4)
    assert periodic_runs.find_runs(words) == [(0, 280_000, 70_000)]
    assert periodic_runs.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def test_query_on_runs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = [brute.runs_row(i, brute.with_planted_run(i, brute.WORD.findall(t or ""))) for i, t in docs]
    assert sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()) == sorted(want)
    assert sum(w[1] for w in want) > 10


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count() and periodic_runs.periodic_runs(no_docs).count() == 0
    for r in rows:
        if r["n_words"] == 0:
            assert r["runs"] == [] and r["collapsed"] == ""
    line = spark.createDataFrame([(None, "x  y " * 20), (1, "x y " * 20 + "z"), (1, "x y " * 20 + "z")], "doc_id long, text string")
    got = periodic_runs.periodic_runs(line).collect()
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(0, 40, 2)]] * 3
    assert sorted(r["collapsed"] for r in got) == ["x y", "x y z", "x y z"]


# Fingerprints ------------------------------------------------------------------------------------------

def _trees(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("tree", fingerprints.tree(F.col("text")))


def test_trees_give_back_texts_and_tell_them_apart(spark, odd_rows):
    texts = [t or "" for _, t in odd_rows] + ["a b", "a b ", "a b\n", " a b", "a\nb", "a\n\nb", "a\n \nb"]
    rows = _trees(spark, texts).withColumn("fp", fingerprints.fingerprint(F.col("tree"))).collect()
    for r in rows:
        n = [p["n"] for s in r["tree"]["sections"] for p in s["paragraphs"]]
        assert sum(n) == len(r["text"])
        if max((len(w) for w in r["text"].split()), default=0) < 60_000:
            assert sum(int(x[11:], 16) for s in r["tree"]["sections"] for p in s["paragraphs"] for x in p["pieces"]) == len(r["text"])
    for key in ("fp", None):
        prints = {}
        for r in rows:
            prints.setdefault(r["fp"] if key else r["tree"]["root"], set()).add(r["text"])
        assert all(len(texts) == 1 for texts in prints.values()) and len(prints) == len(set(texts))


def test_pieces_are_read_back_from_fingerprints(spark, odd_rows):
    frame = _trees(spark, [t for _, t in odd_rows]).select(
        fingerprints.pieces(F.col("tree")).alias("a"), fingerprints.pieces_of(fingerprints.fingerprint(F.col("tree"))).alias("b"))
    assert all(r["a"] == r["b"] for r in frame.collect())


def test_edits_are_in_their_branch_only(spark):
    lines = [" ".join(f"w{(7 * i + j * j) % 500}" for j in range(30)) + "\n" for i in range(200)]
    changed = lines[:120] + ["something else entirely\n"] + lines[121:]
    frame = _trees(spark, ["".join(lines)]).withColumnRenamed("tree", "a").join(
        _trees(spark, ["".join(changed)]).select("k", F.col("tree").alias("b")), "k")
    row = frame.select("a", fingerprints.edits(F.col("a"), F.col("b")).alias("ab"), fingerprints.edits(F.col("a"), F.col("a")).alias("aa"),
                       fingerprints.likeness(fingerprints.pieces(F.col("a")), fingerprints.pieces(F.col("b"))).alias("near")).first()
    assert row["aa"] == [] and len(row["ab"]) == 1
    sections = row["a"]["sections"]
    assert len(sections) > 3
    where = row["ab"][0]
    assert sum(len(s["paragraphs"]) for s in sections[:where["section"]]) + where["paragraph"] == 120
    assert where["n"] == len(lines[120]) and 0.98 < row["near"] < 1


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    """Against the same by hand: which row is next, the edited text, and likeness by sets of pieces."""
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])), reverse=True)
    want = []
    for k, (i, t) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(t)
        want.append((str(i), n, digest(t[:n - n // 3] + following[:n // 3])))
    for copies in (4096, 1):
        got = fingerprints.edited_fingerprints(odd_docs, copies=copies).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        assert all(r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"] for r in got if r["n_chars"] < 3)
    assert fingerprints.edited_fingerprints(no_docs).count() == 0
    alone = fingerprints.edited_fingerprints(odd_docs.where("doc_id = 9")).collect()
    assert [r["near_next"] for r in alone] == [1.0]


def test_fingerprints_run_no_python(spark):
    plan = QUERIES["op12_merkle_fingerprints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "MapPartitions"))


# Alignment ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    """Brute force on the libraries' own tokens."""
    of_a, of_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    of_a.encode_special_tokens = True
    entry, to_byte = {i: t for t, i in of_a.get_vocab().items()}, packing.byte_characters()

    def align(text):
        a, b = of_a.encode(" " + (text or ""), add_special_tokens=False).ids, of_b.encode(text or "")
        pieces = [(i, of_b.id_to_piece(i)) for i in b]
        return (len(a), len(b)), *brute.alignment(
            text, a, b, [bytes(to_byte[c] for c in entry[i]) for i in a],
            [bytes([int(p[3:5], 16)]) if of_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces])

    return align


def _links(rows):
    out = {}
    for number, _, n_a, n_b, n_groups, n_links, groups, found, times in rows:
        if n_a is not None:
            out[number] = (n_a, n_b, n_groups, n_links, groups, {})
        for code, n in zip(np.asarray(found).tolist(), np.asarray(times).tolist()):
            pair = code >> alignment.IDS, code & (1 << alignment.IDS) - 1
            assert pair not in out[number][5]
            out[number][5][pair] = n
    return out


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.lists(st.sampled_from(["a", "the ", "▁", "\n", "  ", "🙂", "日本", "é", "\0", "<|endoftext|>", "</s>", "[INST]", "ing", " un",
                                          "123", "́", "\x85", "'s"]), max_size=30).map("".join), min_size=1, max_size=4),
       st.sampled_from([3, 20, 1 << 20]), st.sampled_from([1, 4, 160]))
def test_alignment_of_odd_texts(plain, texts, most, every):
    pair = alignment._pair(A, B)
    saved = alignment.pairs_of.__defaults__, alignment.merge.__defaults__
    alignment.pairs_of.__defaults__, alignment.merge.__defaults__ = (most,), (every,)
    try:
        got = _links(alignment._align(pair, [(k, k, t) for k, t in enumerate(texts)], False, True))
    finally:
        alignment.pairs_of.__defaults__, alignment.merge.__defaults__ = saved
    for k, text in enumerate(texts):
        sizes, groups, links = plain(text)
        n_a, n_b = sizes if groups else (0, 0)
        assert got[k] == (n_a, n_b, len(groups), sum(links.values()), ";".join(groups), dict(links))


def test_words_give_the_tokens_of_whole_texts(given):
    pair, of_b = alignment.Pair(A, B), sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [t or "" for _, t in given[:80]] + ["a\nb", "a\n\nb", "\na", "a \nb", "a\n b", "a  b", " a", "a ", "\t a\n", "x\r\ny", "a\n", "▁ a", "a ▁b", "🙂\n🙂"]
    for text, ids in zip(texts, pair.ids_b(texts)):
        whole = of_b.encode(text)
        back = b"".join(map(pair.bytes_b.__getitem__, whole)) == b" " + text.encode()
        assert ids == (whole if text and back else None)


def test_query_on_alignment(spark, plain):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {i: plain(t) for i, t in docs}
    count = Counter(p for _, _, links in want.values() for p in links)
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    rows = []
    for i, (sizes, groups, links) in want.items():
        written = ";".join(groups)
        rows.append((i, *(sizes if groups else (0, 0)), len(groups), sum(links.values()),
                     sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()),
                     hashlib.sha256(written.encode()).hexdigest() if written else ""))
    assert sorted(tuple(r) for r in QUERIES["op13_token_alignment"](spark, FOLDER).collect()) == sorted(rows)
    dealt = alignment.token_links(spark.read.parquet(f"{FOLDER}/documents.parquet"), A, B, rows=0)
    assert sorted(tuple(r) for r in dealt.collect()) == sorted(rows)


def test_alignment_of_odd_rows(spark, odd_docs, no_docs):
    got = alignment.token_links(odd_docs, A, B).collect()
    assert len(got) == odd_docs.count() and alignment.token_links(no_docs, A, B).count() == 0
    for r, written in zip(sorted(got, key=str), sorted(alignment.aligned(odd_docs, A, B).collect(), key=str)):
        assert (r["n_a"], r["n_links"]) == (written["n_a"], written["n_links"])
        assert r["groups_sha256"] == (hashlib.sha256(written["groups"].encode()).hexdigest() if written["groups"] else "")
    none = [r for r in got if r["n_a"] == 0]
    assert none and all((r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (0,) * 5 + ("",) for r in none)
