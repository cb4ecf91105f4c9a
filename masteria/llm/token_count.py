"""Token counts by byte-pair merging, without making identifiers.

A word starts as a linked list of its characters. A heap holds the adjacent pairs that the
vocabulary can join, by rank and then position; the lowest is popped and joined until none is
left. Every join removes one symbol, so a word has as many tokens as it had symbols less its
joins. A character that the vocabulary lacks counts as one symbol for each of its UTF-8 bytes.
Two characters that stand together in no piece are never joined, so a word is cut between them first.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from masteria.llm.rows import map_rows, texts_of
from masteria.llm.words import Unsplittable, Words

SPACE = "▁"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                    ("over_limit", pa.bool_())])
_COUNTERS: dict[str, PieceCounter] = {}


def count_merged(word: str, rank: dict[str, float], alone: set[str]) -> int:
    """Tokens of one word. ``rank``: pieces to their order, lowest first; ``alone``: known characters."""
    symbols = n = len(word)
    if not alone.issuperset(word):
        symbols = sum(1 if c in alone else len(c.encode("utf-8", "surrogatepass")) for c in word)
    size, before, after = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    ranked = rank.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranked(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, left, length = heappop(heap)
        right = after[left]
        if not size[left] or right >= n or size[left] + size[right] != length:
            continue  # one of the two has been joined since
        symbols -= 1
        size[left], size[right] = length, 0
        after[left] = following = after[right]
        if following < n:
            before[following] = left
            end = following + size[following]
            if (r := ranked(word[left:end])) is not None:
                heappush(heap, (r, left, end - left))
        if (first := before[left]) >= 0 and (r := ranked(word[first:left + length])) is not None:
            heappush(heap, (r, first, left + length - first))
    return symbols


class PieceCounter:
    """Counts tokens as the library of a sentencepiece BPE model does.

    No piece has the space mark after another character, so joins never cross the start of a run of
    marks, and each run with what follows it can be counted by itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model crosses words")
        self.alone = {p for p in pieces if len(p) == 1}
        self.rank = {p: r for p, r in pieces.items() if len(p) > 1}
        self.joined = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.parts = Words(lambda part: count_merged(part, self.rank, self.alone), lambda part: False)
        self.words = Words(lambda word: self._word(SPACE + word), lambda word: not word or word[-1] == SPACE)

    def _word(self, word: str) -> int:
        """The sum over the parts between characters that no piece joins."""
        total = start = 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.joined:
                total += self.parts[word[start:i]]
                start = i
        return total + self.parts[word[start:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        try:
            return sum(map(self.words.__getitem__, text.split(" ")))
        except Unsplittable:
            return sum(self._run(run) for run in self._runs(SPACE + text.replace(" ", SPACE)))

    def _run(self, run: str) -> int:
        if run[1:2] in ("", SPACE):
            return self._word(run)
        return self.words[run[1:]]

    @staticmethod
    def _runs(text: str) -> Iterator[str]:
        """Each run of space marks with the characters up to the next run."""
        start = 0
        while start < len(text):
            end = start
            while end < len(text) and text[end] == SPACE:
                end += 1
            end = text.find(SPACE, end)
            end = len(text) if end < 0 else end
            yield text[start:end]
            start = end


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    One row per input row, in one pass without a shuffle. A null or empty text has 0 of both. A null id stays
    null, repeated ids give repeated rows, an empty table gives none; other columns are not read.
    ``model``: path of the sentencepiece model on the executors.
    """
    def run(rows):
        counter = _counter(model)
        for row_id, words in rows:
            n = counter.count(words)
            yield row_id, len(words.encode("utf-8")), n, n > limit

    return map_rows(texts_of(docs, doc_id, text), run, SCHEMA)
