"""Cross-tokenizer alignment: the tokens of a text by two tokenizers, linked where their bytes fall into one group.

Both tokenizers cut the same bytes, a space and the text. Where a token of A and one of B end at the same byte, the
text is cut; the tokens between two cuts form a group, and every A token of a group is linked to every B token of it.

A batch of documents is merged in lockstep: one state vector holds, for each document, the places in its A and
B tokens. A step compares the two ends of all documents at once, advances the pointer with the smaller end, both where they
are equal, and emits the groups and their links that this closes; documents that are finished leave the vector. A
long document takes part as several stretches that start at cuts, so that few steps serve a whole batch.

How often an identifier pair is linked is counted in documents over the whole corpus: every document gives each of its
pairs once, counts are added up in each task before they are shuffled, and come back to the documents by a look-up join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.llm.packing import TextIds, byte_characters
from masteria.llm.rows import as_batches, columns_of, ddl, in_small_batches, texts_of
from masteria.plans.joins import lookup_join
from masteria.plans.storage import stored

SPACE = "▁"
#: Identifiers are below this; a pair is one number.
IDS = 24
#: A batch is closed at this many bytes of text; stretches are tried every so many A tokens.
BATCH_BYTES, STRETCH = 1 << 20, 160
#: Links that are laid out at a time, and words that are remembered.
LINKS, WORDS = 1 << 21, 500_000

_DOC = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_CODECS: dict[tuple[str, str], Pair] = {}


class Pair:
    """Both tokenizers: identifiers of a text, the bytes of each identifier."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = TextIds(a).encoding
        with open(a, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_characters()
        special = {t["content"] for t in spec["added_tokens"]}
        entries = {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8")
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.length_a, self.length_b = (np.array([len(t) for t in of], dtype=np.int64) for of in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(i) for i in range(len(of))] for of in (self.bytes_a, self.bytes_b))

        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        #: No piece goes on over the start of a word, nor over a line end: texts can then be encoded word by word.
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.words: dict[str, list[int] | None] = {}
        self.start = self.b.piece_to_id(SPACE)

    def _given_back(self, ids: list[int], whole: bytes) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, ids)) == whole

    def _learn(self, words: set[str]) -> None:
        """Remember the identifiers of words; nothing for a word whose bytes they do not give back."""
        if len(self.words) > WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for word, ids in zip(new, self.b.encode(new, num_threads=1) if new else ()):
            self.words[word] = ids if self._given_back(ids, b" " + word.encode("utf-8")) else None
            if word[0] == "\n" and ids[0] == self.start and self.words[word] is not None:
                self.words[word] = ids[1:]  # a later line: the space belongs to no line but the first

    def _words(self, text: str) -> list[str] | None:
        """A text cut before spaces and line ends; nothing if there is more than one space in a row, or an empty first line of a word."""
        if not self.by_words or not text or text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text:
            return None
        return text.replace("\n", " \n").split(" ")

    def ids_b(self, texts: list[str]) -> list[list[int] | None]:
        """The identifiers of B of every text, nothing where they do not give a space and the text."""
        cut = [self._words(text) for text in texts]
        self._learn(set().union(*(words for words in cut if words)))
        whole = iter(self.b.encode([t for t, words in zip(texts, cut) if not words], num_threads=1))
        out: list[list[int] | None] = []
        for text, words in zip(texts, cut):
            if not words:
                ids = next(whole)
                out.append(ids if text and self._given_back(ids, b" " + text.encode("utf-8")) else None)
            else:
                found = list(map(self.words.__getitem__, words))
                out.append(None if None in found else list(chain.from_iterable(found)))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The identifiers of A and B of every text; both empty where one of them does not cut a space and the text."""
        out = []
        for text, b in zip(texts, self.ids_b(texts)):
            if b is not None:
                a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
                if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == b" " + text.encode("utf-8"):
                    out.append((a, np.array(b, dtype=np.int64)))
                    continue
            out.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
        return out


def _pair(a: str, b: str) -> Pair:
    if (a, b) not in _CODECS:
        _CODECS[a, b] = Pair(a, b)
    return _CODECS[a, b]


class Groups(NamedTuple):
    """Groups in order: the A tokens ``a[k]:a_end[k]`` and the B tokens ``b[k]:b_end[k]`` of a batch."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray


def stretches(ends_a: np.ndarray, ends_b: np.ndarray, lengths: np.ndarray, every: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of A and of B tokens before each stretch, and all of them: every document, long ones cut at common ends."""
    tries = np.union1d(np.arange(every - 1, len(ends_a), every), np.cumsum(lengths[lengths > 0]) - 1)
    at = np.searchsorted(ends_b, ends_a[tries])
    common = ends_b[at] == ends_a[tries]
    return np.concatenate(([0], tries[common] + 1)), np.concatenate(([0], at[common] + 1))


def merge(ends_a: np.ndarray, ends_b: np.ndarray, lengths: np.ndarray, every: int = STRETCH) -> Groups:
    """The groups of a batch whose documents, one after the other, have tokens that end at these bytes.

    ``lengths``: A tokens of each document. The last ends of both tokenizers are equal in every document.
    """
    if not len(ends_a):
        return Groups(*(np.zeros(0, dtype=np.int64) for _ in range(4)))
    of_a, of_b = stretches(ends_a, ends_b, lengths, every)
    a, b, last = of_a[:-1].copy(), of_b[:-1].copy(), of_a[1:]
    first_a, first_b, closed = a.copy(), b.copy(), []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        a += end_a <= end_b
        b += end_b <= end_a
        cut = np.flatnonzero(end_a == end_b)
        closed.append((first_a[cut], a[cut], first_b[cut], b[cut]))
        first_a[cut], first_b[cut] = a[cut], b[cut]
        going = a < last
        if not going.all():
            a, b, last, first_a, first_b = (x[going] for x in (a, b, last, first_a, first_b))
    groups = [np.concatenate(parts) for parts in zip(*closed)]
    order = np.argsort(groups[0], kind="stable")
    return Groups(*(g[order] for g in groups))


def _laid_out(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every link of groups of these sizes: its group, and the places of its two tokens in it."""
    sizes = n_a * n_b
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return group, place // n_b[group], place % n_b[group]


def _counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(codes, return_counts=True)
    found, at = np.unique(codes, return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, weights)
    return found, total


def pairs_of(groups: Groups, a: np.ndarray, b: np.ndarray, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Identifier pairs ``a << IDS | b`` of one document and how often each is linked; no pair comes twice.

    More than ``most`` links are not laid out at once: equal identifiers of a group are joined first, and the
    pairs are made for a range of A identifiers at a time.
    """
    n_a, n_b = groups.a_end - groups.a, groups.b_end - groups.b
    if int((n_a * n_b).sum()) <= most:
        group, i, j = _laid_out(n_a, n_b)
        yield _counted(a[groups.a[group] + i] << IDS | b[groups.b[group] + j])
        return
    one = np.ones_like(n_a)
    of_a, of_b = (_counted(g << IDS | ids[start[g] + i]) for g, i, start, ids in (
        (*_laid_out(n, one)[:2], start, ids) for n, start, ids in ((n_a, groups.a, a), (n_b, groups.b, b))))
    mask = (1 << IDS) - 1
    b_first = np.searchsorted(of_b[0] >> IDS, np.arange(len(n_a)))
    b_size = np.diff(np.append(b_first, len(of_b[0])))
    order = np.argsort(of_a[0] & mask, kind="stable")
    keys, times = of_a[0][order], of_a[1][order]
    group, ids = keys >> IDS, keys & mask
    upto = np.cumsum(b_size[group])
    start = 0
    while start < len(keys):
        done = upto[start - 1] if start else 0
        end = max(int(np.searchsorted(upto, done + most, side="right")), start + 1)
        # All of an identifier's groups come together: up to its first row, or, if it fills the range, to its last.
        cut = int(np.searchsorted(ids, ids[end], side="left")) if end < len(keys) else end
        end = cut if cut > start else int(np.searchsorted(ids, ids[start], side="right"))
        row, _, j = _laid_out(np.ones(end - start, dtype=np.int64), b_size[group[start:end]])
        other = b_first[group[start:end]][row] + j
        yield _counted(ids[start:end][row] << IDS | of_b[0][other] & mask, times[start:end][row] * of_b[1][other])
        start = end


def _written(groups: Groups, a: list[str], b: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the identifiers of the groups."""
    return ";".join([
        f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(a[i:j])}|{','.join(b[k:m])}"
        for i, j, k, m in zip(*(g.tolist() for g in groups))])


def _batches(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size or len(held) >= 1000:
            yield held
            held, n = [], 0
    if held:
        yield held


def _align(pair: Pair, rows: list[tuple], digest: bool, links: bool) -> Iterator[tuple]:
    """Rows of ``_DOC`` of a batch; a document with very many pairs has more rows, with pairs only."""
    encoded = pair.encode([text for *_, text in rows])
    lengths = [np.array([len(e[k]) for e in encoded]) for k in (0, 1)]
    a, b = (np.concatenate([e[k] for e in encoded]) for k in (0, 1))
    groups = merge(np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b]), lengths[0])
    text_a, text_b = list(map(pair.text_a.__getitem__, a.tolist())), list(map(pair.text_b.__getitem__, b.tolist()))
    ends = np.searchsorted(groups.a, np.cumsum(lengths[0]))
    sizes = (groups.a_end - groups.a) * (groups.b_end - groups.b)
    start = 0
    for (number, doc_id, _), n_a, n_b, end in zip(rows, lengths[0].tolist(), lengths[1].tolist(), ends.tolist()):
        mine = Groups(*(g[start:end] for g in groups))
        written = _written(mine, text_a, text_b)
        if digest:
            written = hashlib.sha256(written.encode()).hexdigest() if written else ""
        parts = pairs_of(mine, a, b) if links else iter(())
        found, times = next(parts, ((), ()))
        yield number, doc_id, n_a, n_b, end - start, int(sizes[start:end].sum()), written, found, times
        for found, times in parts:
            yield number, None, None, None, None, None, None, found, times
        start = end


def _aligned(docs: DataFrame, a: str, b: str, doc_id: str, text: str, digest: bool, links: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = _pair(a, b), TaskContext.get().partitionId() << 33
        rows = ((first + k, *row) for k, row in enumerate(row for batch in batches for row in columns_of(batch)))
        return as_batches((out for held in _batches(rows, BATCH_BYTES) for out in _align(pair, held, digest, links)), _DOC, 200)

    return in_small_batches(texts_of(docs, doc_id, text)).mapInArrow(run, ddl(_DOC))


def aligned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups of every text, written out: ``doc_id, n_a, n_b, n_groups, n_links, groups``. See ``token_links``."""
    return _aligned(docs, a, b, doc_id, text, digest=False, links=False).drop("row", "pairs", "times")


def pair_counts(found: DataFrame) -> DataFrame:
    """``code, n, best`` of identifier pairs: the rows they are linked in, and whether no pair of their A has more.

    Pairs of one row that are not best are left out: that is what a pair without a row here is.
    """
    counts = stored(found.select(F.explode("pairs").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "pairs")
    of_a = F.shiftright("code", IDS)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", of_a).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    return stored(judged.where("n > 1 OR best"), "counts")


def token_links(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", rows: int = 2_000_000) -> DataFrame:
    """How the tokens of every text are linked, and how often its linked pairs are linked in the corpus.

    One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. ``a`` is the path of a
    byte-level BPE file, ``b`` that of a sentencepiece model. A null or empty text, and one whose bytes a tokenizer
    does not give back, has no tokens: zeros and an empty string. Texts are taken whole; one of any length is held by one
    task, but its links only in parts. Repeated rows count as often as they occur, null ids stay null, an empty table gives no
    rows; other columns are not read. The counts are broadcast up to ``rows`` pairs, else joined by shuffling.
    """
    found = stored(_aligned(docs, a, b, doc_id, text, digest=True, links=True), "links")
    counts = pair_counts(found)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("of")).select("row", F.col("of.pairs").alias("code"), "of.times")
    n = F.coalesce("n", F.lit(1))
    sums = (lookup_join(each, counts, "code", "left", rows)
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                F.sum(F.col("times") * n).alias("count_sum")))
    main = found.where(F.col("n_a").isNotNull()).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    return main.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), F.col("groups").alias("groups_sha256"))
