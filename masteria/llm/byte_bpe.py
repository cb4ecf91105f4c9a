"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each byte b is mapped to the character U+0100+b, each token of the rank file to a piece of such
characters with the score -rank; nothing is normalised. The library's BPE joins the pair with the
highest score, leftmost first, which is the lowest rank. Pre-tokens are encoded one by one and
identifiers are decoded by looking up the bytes of their pieces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from masteria.llm.rows import map_rows, texts_of
from masteria.llm.words import Unsplittable, Words, chunks, ends_open, lines_of

SHIFT = 0x100
TO_PIECE = {b: SHIFT + b for b in range(256)}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])
_CODECS: dict[tuple[str, str], ByteBpe] = {}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line the token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The protocol-buffer form of a BPE model whose identifiers are the ranks.

    The ranks must be 0, 1, 2, ...; the unknown piece that the library asks for comes after them.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_piece(t.decode("latin-1").translate(TO_PIECE), -float(ranks[t]), normal) for t in tokens]
    pieces.append(_piece("<unk>", 0.0, unknown))
    trainer = (_number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
               + b"".join(_number(absent, -1) for absent in (41, 42, 43)))
    normaliser = _bytes(1, b"identity") + _bytes(2, b"") + b"".join(_number(off, 0) for off in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


#: A pattern's classes, and a character that every library puts into this class.
CLASSES = {r"\p{L}": "ж", r"\p{N}": "٣", r"\s": "\u2003"}
OTHER = "§"
_STAND_INS: list[dict[int, str]] = []


def stand_ins() -> dict[int, str]:
    """Characters that the splitter of tiktoken puts into another class than that of ``regex``, as the two know different
    versions of Unicode, each with a character of the class in which tiktoken has it."""
    import regex
    import tiktoken

    if not _STAND_INS:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        of: dict[str, tuple[set[str], set[str]]] = {}
        for name in CLASSES:
            theirs = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            of[name] = set(bytes(theirs.encode_ordinary(every)).decode("utf-8")), set(regex.findall(name, every))
        differ = set().union(*(a ^ b for a, b in of.values()))
        _STAND_INS.append({ord(c): next((CLASSES[n] for n in CLASSES if c in of[n][0]), OTHER) for c in differ})
    return _STAND_INS[0]


class ByteBpe:
    """Encodes and decodes whole texts; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        self.pattern = regex.compile(pattern)
        self.stand_ins = stand_ins()
        self.strange = frozenset(map(chr, self.stand_ins))
        self.bytes_of = sorted(self.ranks, key=self.ranks.__getitem__)
        self.pretokens = Words(self.encode_pretoken, lambda pretoken: False)
        self.words = Words(self._word, ends_open)
        self.starts = Words(self._encode, lambda word: False)
        self.line_end = self._encode("\n")

    def encode_pretoken(self, pretoken: str) -> list[int]:
        raw = pretoken.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return self.model.encode(raw.decode("latin-1").translate(TO_PIECE))

    def _encode(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, self.cut(chunk))))

    def cut(self, chunk: str) -> list[str]:
        """The pre-tokens of a text."""
        if chunk.isascii() or self.strange.isdisjoint(chunk):
            return self.pattern.findall(chunk)
        return [chunk[m.start():m.end()] for m in self.pattern.finditer(chunk.translate(self.stand_ins))]

    def _word(self, word: str) -> tuple[int, ...]:
        if parts := lines_of(word):
            return sum((self.line_end + self.starts[p] for p in parts[1:]), self.words[parts[0]])
        return self._encode(" " + word)

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        ids: list[int] = []
        try:
            if not rest or ends_open(first):
                raise Unsplittable
            ids.extend(self._encode(first))
            ids.extend(chain.from_iterable(map(self.words.__getitem__, rest[:-1])))
            # What follows the last space may end in white space: nothing comes after it to be cut off.
            ids.extend(self.words[rest[-1]] if not ends_open(rest[-1]) else self._encode(" " + rest[-1]))
        except Unsplittable:
            ids = [i for chunk in chunks(text) for i in self._encode(chunk)]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(path, pattern)
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The identifiers of every text: ``doc_id``, ``ids``. Treats odd rows as ``round_trip`` does."""
    def run(rows):
        codec = _codec(ranks, pattern)
        for row_id, words in rows:
            yield row_id, codec.encode(words)

    return map_rows(texts_of(docs, doc_id, text), run,
                    pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The text of every row of identifiers: ``doc_id``, ``text`` (bytes that are no UTF-8 are replaced)."""
    def run(rows):
        codec = _codec(ranks, pattern)
        for row_id, ids in rows:
            yield row_id, codec.decode(ids or []).decode("utf-8", "replace")

    return map_rows(tokens.select("doc_id", "ids"), run, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the identifiers again and return digests of both.

    One row per input row, in one pass without a shuffle; texts are taken whole. A null or empty text has no identifiers. A null id
    stays null, repeated ids give repeated rows, an empty table gives none; other columns are not read.
    """
    def run(rows):
        codec = _codec(ranks, pattern)
        for row_id, words in rows:
            ids = codec.encode(words)
            yield (row_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(codec.decode(ids)).hexdigest())

    return map_rows(texts_of(docs, doc_id, text), run, SCHEMA)
