"""Conversations as prefix trees: turns that conversations share from the start are formatted once.

A turn becomes ``<|turn|>role`` + line end + text + ``<|end|>`` + line end. Control strings inside roles and
texts get a backslash after their first character, backslashes are doubled, so the template can be read back.

Conversations are ordered by the hashes of their prefixes, which puts those with the same initial
turns side by side. Walking in that order is a depth-first walk of the tree: of each conversation
only the turns after those it shares with the one before are put out. Output goes to packs of bounded length;
a prefix is repeated only where a new pack begins, since no position can attend to another pack. Every
segment has its place in the pack, the position of its first token in its conversation, and the
intervals of the pack that its ancestors take up, which are all it may attend to besides itself. With a tokenizer a
segment is its tokens and they are the unit of all lengths, else the code point. Head, text and end of a turn are encoded one
by one, so what is learnt begins and ends with a token.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masteria.llm.packing import text_ids
from masteria.llm.rows import map_rows
from masteria.plans.storage import stored

TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that must not occur inside a formatted text.
CONTROLS = ("<|turn|>", "<|end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEARNT = "assistant"
#: Units after which a pack is closed at the end of a conversation.
PACK = 1 << 20

_TURNS = pa.schema([("conv", pa.string()), ("conv_id", pa.int64()), ("idx", pa.int64()), ("node", pa.string()),
                    ("segment", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
                    ("path", pa.list_(pa.string()))])
_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PACKED = pa.schema([("pack", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()),
                     ("attends", pa.list_(_INTERVAL)), ("segment", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_start", pa.int64()),
                     ("loss_end", pa.int64()), ("conv", pa.string()), ("conv_id", pa.int64()), ("idx", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def segment_of(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the part of it that is learnt."""
    head = TURN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    learnt = len(body) if role == LEARNT else 0
    return head + body + END, len(head), len(head) + learnt


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(TURN):len(segment) - len(END)].partition("\n")
    return unescape(role), unescape(body)


def tokens_of(segment: str, start: int, end: int, encode) -> tuple[list[int], int, int]:
    """The tokens of a formatted turn whose text begins at ``start`` and is learnt up to ``end``, and those that are learnt."""
    head, body, tail = encode(segment[:start]), encode(segment[start:len(segment) - len(END)]), encode(END)
    return head + body + tail, len(head), len(head) + (len(body) if end > start else 0)


def _turns(tokenizer: str | None):
    def turns(rows) -> Iterator[tuple]:
        """Segments of conversations in order; the last of each carries the hashes of all its prefixes."""
        encode = text_ids(tokenizer).encoding.encode_ordinary if tokenizer else None
        held, path = None, []
        for conv, conv_id, role, text in rows:
            if held is not None and held[0] != conv:
                yield (*held, path)
                held, path = None, []
            if held is not None:
                yield (*held, None)
            segment, start, end = segment_of(role, text)
            before = path[-1] if path else ""
            path.append(hashlib.blake2b((before + segment).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            ids = None
            if encode:
                ids, start, end = tokens_of(segment, start, end, encode)
                segment = None
            held = (conv, conv_id, len(path) - 1, path[-1], segment, ids, start, end)
        if held is not None:
            yield (*held, path)

    return turns


def _walk(limit: int):
    def walk(rows) -> Iterator[tuple]:
        """Depth-first output of conversations that come in the order of their paths."""
        number, length = TaskContext.get().partitionId() << 33, 0
        #: Of the conversation before: hash, start, end, position and the merged intervals up to each turn.
        stack: list[tuple] = []
        current, shared = None, True
        for order, conv, conv_id, idx, node, segment, ids, loss_start, loss_end in rows:
            if order != current:
                current, shared = order, True
                if length >= limit:
                    number, length, stack = number + 1, 0, []
            if shared and idx < len(stack) and stack[idx][0] == node:
                _, start, end, position, _ = stack[idx]
                yield number, start, end, position, None, None, None, None, None, conv, conv_id, idx
                continue
            if shared:
                shared = False
                del stack[idx:]
            parent = stack[-1] if stack else None
            attends = parent[4] if parent else ()
            position = parent[3] + parent[2] - parent[1] if parent else 0
            start, end = length, length + len(segment if ids is None else ids)
            if attends and attends[-1][1] == start:
                merged = (*attends[:-1], (attends[-1][0], end))
            else:
                merged = (*attends, (start, end))
            stack.append((node, start, end, position, merged))
            length = end
            yield (number, start, end, position, [{"start": a, "end": b} for a, b in attends], segment, ids, loss_start,
                   loss_end, conv, conv_id, idx)

    return walk


def _digests(tokenizer: str | None):
    def digests(rows) -> Iterator[tuple]:
        """What was read back of each conversation."""
        decode = text_ids(tokenizer).encoding.decode_bytes if tokenizer else None
        current, state = None, None
        for conv, conv_id, segment, ids, loss_start, loss_end in rows:
            if state is None or conv != current:
                if state is not None:
                    yield _digest(state)
                current, state = conv, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if decode:
                segment, learnt = decode(ids).decode("utf-8"), decode(ids[loss_start:loss_end]).decode("utf-8")
            else:
                learnt = segment[loss_start:loss_end]
            role, text = parse(segment)
            learnt = unescape(learnt)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[3] += len(learnt)
            state[4].update(learnt.encode("utf-8", "surrogatepass"))
            state[5] += len(segment)
        if state is not None:
            yield _digest(state)

    return digests


def _digest(state: list) -> tuple:
    conv_id, turns, of_turns, chars, of_loss, formatted = state
    return conv_id, turns, of_turns.hexdigest(), chars, of_loss.hexdigest(), formatted


def prefix_packs(conversations: DataFrame, limit: int = PACK, tokenizer: str | None = None) -> DataFrame:
    """Format conversations (``conv_id, turn, role, text``, one row per turn) as packs of prefix trees.

    One row per turn of every conversation, with its place: ``pack, start, end``, the ``position`` of its first unit
    in the conversation, and ``conv_id, idx`` (from 0). Units are code points, or, with the path of a byte-level BPE file as
    ``tokenizer``, tokens. The first row with a place also has the
    ``segment``, or its tokens ``ids``, the part of it that is learnt (``loss_start`` to ``loss_end``, only texts of the assistant), and
    the intervals it ``attends`` to.

    Null roles and texts are empty; turns that are null come first, and rows of one turn are ordered by role and text.
    Rows without ``conv_id`` form one conversation. Equal conversations share all their segments. An
    empty table gives no rows; other columns are not read. A conversation is walked by one task, row by row; of all
    its turns only the hashes and intervals are held at once.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    rows = conversations.select(conv.alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    turns = stored(map_rows(sorted_rows.select("conv", "conv_id", "role", "text"), _turns(tokenizer), _TURNS), "turns")
    # The order of conversations; numbers grow with it, and ties are settled by the conversation.
    order = stored(turns.where(F.col("path").isNotNull()).orderBy("path", "conv")
                   .select("conv", F.monotonically_increasing_id().alias("order")), "order")
    walked = (turns.drop("path").join(order, "conv").repartitionByRange("order").sortWithinPartitions("order", "idx")
              .select("order", "conv", "conv_id", "idx", "node", "segment", "ids", "loss_start", "loss_end"))
    return stored(map_rows(walked, _walk(limit), _PACKED), "packs")


def read_back(packs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Conversations read from packs: turns, their digest, and the digest of all that is learnt. ``tokenizer``: that of the packs.

    Every shared turn is looked up at its place; a place has at most as many rows as its pack has conversations.
    """
    place = ["pack", "start"]
    columns = ["conv", "conv_id", "idx", "segment", "ids", "loss_start", "loss_end"]
    emitted = F.col("loss_start").isNotNull()
    own = packs.where(emitted)
    shared = packs.where(~emitted).select(*place, "conv", "conv_id", "idx")
    found = shared.join(own.select(*place, "segment", "ids", "loss_start", "loss_end"), place)
    rows = own.select(*columns).unionByName(found.select(*columns))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "idx")
    return map_rows(ordered.select("conv", "conv_id", "segment", "ids", "loss_start", "loss_end"), _digests(tokenizer), _DIGEST)
