"""Cost-balanced packing of tokenized documents into sequences of bounded length.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n * n``: layers that are
linear in the tokens plus attention inside the piece. A document is first cut at multiples of the
capacity; full pieces fill sequences by themselves. The rest of the documents is packed in windows:
enough sequences are opened to hold the window's tokens, and the pieces, longest first, go to the
sequence of lowest cost that still has room. A piece that fits nowhere is cut over the sequences of
lowest cost that have any room. What does not fill a whole sequence goes to sequences whose
capacities are the powers of two that sum up to it, so no sequence needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from masteria.llm.rows import map_rows, texts_of

#: Sequence numbers of one task start at its number times this.
PER_TASK = 1 << 40
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("capacity", pa.int64()), ("sequence_cost", pa.float64())])
_TOKENIZERS: dict[str, TextIds] = {}


#: Fixed pattern by which byte-level BPE splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextIds:
    """The identifiers of a text by a byte-level BPE tokenizer file.

    The file's vocabulary is loaded into tiktoken, which makes the same merges several times faster. That holds
    for files whose merges make the tokens in the order of their identifiers, which is checked.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if (spec["normalizer"], split["type"], split["add_prefix_space"], split.get("use_regex", True), model["type"]) != (
                None, "ByteLevel", False, True, "BPE") or made != sorted(made):
            raise ValueError(f"{path}: not a byte-level BPE in the order of its merges")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_characters()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def of(self, text: str) -> bytes:
        """As little-endian unsigned 32-bit integers; added tokens in the text are recognised."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, tokens: int) -> tuple[Piece, Piece]:
        return (self._replace(ids=self.ids[:4 * tokens]),
                self._replace(start=self.start + tokens, ids=self.ids[4 * tokens:]))


def capacities(tokens: int, capacity: int) -> list[int]:
    """Whole sequences, then the powers of two that the remainder is made of."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Parts of pieces by sequence, and the capacities: each part is (piece, tokens), in the piece's order.

    ``lengths`` are positive. All sequences are filled.
    """
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    sizes, cost = room.tolist(), np.zeros(len(room))
    parts: list[list[tuple[int, int]]] = [[] for _ in sizes]

    def put(piece: int, n: int, at: int) -> None:
        parts[at].append((piece, n))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    too_long = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        open_cost = np.where(room >= lengths[piece], cost, np.inf)
        at = int(open_cost.argmin())
        if np.isinf(open_cost[at]):
            too_long.append(piece)
        else:
            put(piece, lengths[piece], at)
    for piece in too_long:
        left = lengths[piece]
        while left:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[at]))
            put(piece, n, at)
            left -= n
    return parts, sizes


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0,
         quadratic: float = 1 / 1024, window: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize every text, append ``end_id``, and pack the tokens into sequences.

    One row per piece: where it lies in its document (``start``, ``length``), where it is put
    (``sequence_id``, ``offset``), the checksum of its identifiers, the sequence's capacity (all
    sequences are full) and its cost. Each task packs its own rows in windows of ``window`` pieces, in
    one pass without a shuffle, so memory and costs do not depend on the size of the input; numbers
    of sequences follow from the task and the order inside it, and a repeated task repeats them.

    A null or empty text is the end id alone. Null and repeated ids are packed like others, each row a document
    of its own. An empty table gives no rows; other columns are not read. ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(rows) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() * PER_TASK
        ids_of = text_ids(tokenizer).of

        def filled(parts: list[Piece], size: int) -> Iterator[tuple]:
            nonlocal number
            offset, lengths = 0, [len(p.ids) // 4 for p in parts]
            cost = sum(linear * n + quadratic * n * n for n in lengths)
            for part, n in zip(parts, lengths):
                yield (part.doc_id, part.start, n, zlib.crc32(part.ids), part.doc_tokens, number, offset, size, cost)
                offset += n
            number += 1

        def packed(held: list[Piece]) -> Iterator[tuple]:
            by_sequence, sizes = assign([len(p.ids) // 4 for p in held], capacity, linear, quadratic)
            # A cut piece is given out from its start, in the order of the sequences.
            for parts, size in zip(by_sequence, sizes):
                taken = []
                for piece, n in parts:
                    part, held[piece] = held[piece].cut(n)
                    taken.append(part)
                yield from filled(taken, size)

        held: list[Piece] = []
        for row_id, words in rows:
            ids = ids_of(words) + end
            piece = Piece(row_id, 0, ids, len(ids) // 4)
            whole = len(ids) // 4 // capacity
            for k in range(whole):
                part = piece._replace(start=k * capacity, ids=ids[4 * k * capacity:4 * (k + 1) * capacity])
                yield from filled([part], capacity)
            if rest := ids[4 * whole * capacity:]:
                held.append(piece._replace(start=whole * capacity, ids=rest))
            if len(held) >= window:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    return map_rows(texts_of(docs, doc_id, text), run, SCHEMA)


def text_ids(path: str) -> TextIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextIds(path)
    return _TOKENIZERS[path]
