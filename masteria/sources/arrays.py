"""A JSON array of objects, bare or inside a wrapping object, read by many tasks.

The text is read in chunks that end at a closing brace. No matter where a file is split, a chunk starts
and ends at such a brace, so it never cuts a character, and it is no longer than one element. Successive chunks of a split are kept
together in one compressed row, a stretch: the text is read once and stored once, and no text is shuffled but where an element
crosses the border of two stretches. What a stretch does to
the state of a scanner depends only on whether it starts inside a string: for either case it is known how it changes the nesting depth, and
whether it changes sides. These effects are added up inside each split of a file, for both cases, then over the
splits, which are few, and so every stretch learns its own side and depth. An element ends where a chunk ends outside strings
at the depth of the array, and the next begins there; elements are numbered by counting those before them. No task and no row holds
more than one split's states, one stretch or one element's text.

Several files are read as one text in the order of their names; they may be compressed. Anything else than one array of objects is
refused when it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from masteria.plans.joins import is_small
from masteria.plans.storage import stored

END = "}"
#: Chunks that are looked at to tell the form of the data.
PEEK = 200
#: Bytes of text after which a stretch ends with its chunk.
STRETCH = 4 << 20
_AT = ("path", "block", "seq")
#: Names of files whose size is not that of their text.
_PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz)$"
_SOLID = re.compile(rb"[^ \t\n\x0b\f\r]")
_QUOTE, _OPEN, _CLOSE, _ESCAPE = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b'"[{]}\\')] = _QUOTE, _OPEN, _OPEN, _CLOSE, _CLOSE, _ESCAPE

_STRETCH = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
                      ("turns", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("data", pa.binary())])
_EVENT = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("depth", pa.int64()),
                    ("in_string", pa.bool_()), ("end_depth", pa.int64()), ("end_in_string", pa.bool_()), ("brace", pa.bool_()), ("solid", pa.bool_()),
                    ("opens", pa.bool_()), ("before", pa.binary()), ("first", pa.string()), ("bare", pa.bool_()), ("lead", pa.string()), ("only", pa.bool_())])
_WHOLE = pa.schema([("ord", pa.int64()), ("text", pa.binary())])
_PART = pa.schema([("ord", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("text", pa.binary())])
_KINDS = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_KINDS[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", END).text(path)


def first_line(spark: SparkSession, path: str) -> tuple[str | None, bool]:
    """The beginning of the first line that is not blank, and whether it is cut: it holds at most ``PEEK`` closing braces."""
    for file in sorted(_text(spark, path).inputFiles()):
        rows = [r.value for r in _text(spark, unquote(file)).limit(PEEK).collect()]
        line, *more = END.join(rows).lstrip().split("\n", 1)
        if line:
            return line, not more and len(rows) == PEEK
    return None, False


def _depth(text: Column) -> Column:
    """How many more brackets are opened than closed."""
    left = {c: F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in "[{]}"}
    return left["]"] + left["}"] - left["["] - left["{"]


def _with_effects(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Whether a text changes sides, and its depth if it starts outside or inside a string.

    Literal replacements, each over the bytes once: patterns over whole texts took most of the time of a read. Of a row of
    backslashes pairs go first, so what is left of it escapes the next character.
    """
    plain = F.col(text)
    for escaped in ("\\\\", '\\"', "\\[", "\\]", "\\{"):
        plain = F.replace(plain, F.lit(escaped), F.lit(""))
    rows = rows.withColumn("plain", plain).withColumn("parts", F.split("plain", '"'))
    # Mostly the texts lie on one side, and the other is short: only that which lies outside is put together.
    outside = F.array_join(F.filter("parts", lambda _, i: i % 2 == 0), "")
    rows = rows.withColumns({f"{name}turns": (F.size("parts") - 1) % 2, "all": _depth(F.col("plain")), "even": outside})
    rows = rows.withColumn(f"{name}outside", _depth(F.col("even")))
    return rows.withColumn(f"{name}inside", F.col("all") - F.col(f"{name}outside")).drop("plain", "parts", "all", "even")


def _tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places of quotes and brackets that are not escaped, and their kinds. Braces that end a chunk always count."""
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = _KIND[data]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slashes = at[kinds == _ESCAPE]
    if not len(slashes):
        return at, kinds
    starts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)  # of rows of backslashes
    ends = np.append(starts[1:], len(slashes)) - 1
    escaped = slashes[ends[(ends - starts) % 2 == 0]] + 1
    kept = kinds != _ESCAPE
    where = np.searchsorted(at, escaped)
    where = where[np.append(at, -1)[where] == escaped]
    kept[where[data[at[where]] != ord(END)]] = False
    return at[kept], kinds[kept]


def _sides(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before each token, and at the end: whether it lies on the other side than the start. Then what each token adds to the depth."""
    quotes = np.cumsum(kinds == _QUOTE)
    return np.append(0, quotes) % 2, (kinds == _OPEN).astype(np.int64) - (kinds == _CLOSE)


def effects(text: bytes) -> tuple[int, int, int]:
    """Whether a text changes sides, and its depth if it starts outside or inside a string."""
    _, kinds = _tokens(text)
    side, step = _sides(kinds)
    inside = int(step[side[:-1] == 1].sum())
    return int(side[-1]), int(step.sum()) - inside, inside


def _gather(stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of the chunks ``value, path, block, size``, with their effects but for the brace that follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        split, size, seq, held, n = None, 0, 0, [], 0

        def done() -> pa.RecordBatch:
            text = b"}".join(held)
            return _batch([(*split, seq, size, len(text), *effects(text), codec.compress(text, asbytes=True))], _STRETCH)

        for batch in batches:
            value, path, block, sizes = batch.columns
            new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if split != (key := (path[a].as_py(), block[a].as_py())):
                    if held:
                        yield done()
                    split, size, seq, held, n = key, sizes[a].as_py(), 0, [], 0
                for chunk in value[a:b].to_pylist():
                    if n >= stretch:
                        yield done()
                        seq, held, n = seq + 1, [], 0
                    held.append(chunk)
                    n += len(chunk) + 1
        if held:
            yield done()

    return run


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """The stretches with their places, effects and texts."""
    rows = _text(spark, path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"))
    return stored(rows.mapInArrow(_gather(STRETCH), _ddl(_STRETCH)), "stretches")


def _ends(spark: SparkSession, path: str, stretches: DataFrame) -> DataFrame:
    """Of every file its last stretch, and whether it ends with a brace, after which there is no chunk."""
    files = stretches.groupBy("path").agg(F.max(F.struct("block", "seq")).alias("last"), F.sum(F.col("bytes") + 1).alias("all"), F.max("size").alias("size"))
    missing = F.col("all") - F.col("size")
    told = ~F.col("path").rlike(_PACKED) & missing.isin(0, 1)
    files = stored(files.select("path", "last", "all", F.when(told, missing == 0).alias("ends")), "files")
    if not files.where("ends IS NULL").take(1):
        return files.drop("all")
    # The size of the text is not known: read with another end of lines, a file that ends with neither has as many bytes.
    other = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("path"), F.octet_length("value").cast("long").alias("n"))
    other = other.groupBy("path").agg(F.sum(F.col("n") + 1).alias("other"))
    # A brace at the end: read by braces the text has no byte more, read by commas one.
    return stored(files.join(other, "path", "left").select("path", "last", F.coalesce("ends", F.col("all") < F.col("other")).alias("ends")), "files")


def _placed(stretches: DataFrame, known: DataFrame) -> DataFrame:
    """Every stretch with its side and depth before and after."""
    # A brace follows every stretch but the last of a file that does not end with one.
    rows = stretches.drop("data", "size").join(F.broadcast(known), "path").withColumn(
        "brace", (F.struct("block", "seq") != F.col("last")) | F.col("ends"))
    inside = Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    side = F.coalesce(F.sum("turns").over(inside), F.lit(0)) % 2
    rows = rows.withColumn("side", side)

    def step(start: Column) -> Column:
        after = (start + F.col("turns")) % 2
        return F.when(start == 0, F.col("outside")).otherwise(F.col("inside")) - F.when(F.col("brace") & (after == 0), 1).otherwise(0)

    rows = rows.withColumns({"step0": step(F.col("side")), "step1": step(1 - F.col("side"))})
    rows = stored(rows.withColumns({f"depth{k}": F.coalesce(F.sum(f"step{k}").over(inside), F.lit(0)) for k in (0, 1)}), "steps")
    # One row per split of a file.
    along = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "block").agg(F.sum("turns").alias("turns"), F.sum("step0").alias("d0"), F.sum("step1").alias("d1"))
    splits = splits.withColumn("start", F.coalesce(F.sum("turns").over(along), F.lit(0)) % 2)
    own = F.when(F.col("start") == 0, F.col("d0")).otherwise(F.col("d1"))
    splits = splits.withColumn("base", F.coalesce(F.sum(own).over(along), F.lit(0))).select("path", "block", "start", "base")
    own_step, own_depth = (F.when(F.col("start") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("step", "depth"))
    rows = rows.join(splits, ["path", "block"]).withColumns({
        "depth": F.col("base") + own_depth, "in_string": (F.col("side") + F.col("start")) % 2 == 1,
        "end_depth": F.col("base") + own_depth + own_step, "end_in_string": (F.col("side") + F.col("start") + F.col("turns")) % 2 == 1})
    return rows.select(*_AT, "brace", "depth", "in_string", "end_depth", "end_in_string")


def _events(text: bytes, depth: int, in_string: bool, brace: bool, base: int, wrapper: str | None) -> list[tuple]:
    """The chunks of a stretch that may matter: those at the depth of the array, that may open it or end the root, and the first and last."""
    at, kinds = _tokens(text)
    side, step = _sides(kinds)
    side = side ^ int(in_string)
    along = depth + np.append(0, np.cumsum(np.where(side[:-1] == 0, step, 0)))
    stops = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == ord(END))
    starts, stops = np.append(0, stops + 1), np.append(stops, len(text))
    before = np.searchsorted(at, starts)
    sides, depths = side[before], along[before]
    last = len(starts) - 1
    end_sides, end_depths = np.append(sides[1:], side[-1]), np.append(depths[1:], along[-1] - int(brace and side[-1] == 0))

    def place(k: int) -> int | None:
        """Where the first character is that is not blank."""
        found = _SOLID.search(text, starts[k], stops[k])
        return found.start() if found else None

    def solid(k: int) -> bool:
        return place(k) is not None or bool((k < last or brace) and sides[k] == 0)

    def next_solid(ks) -> list[int]:
        return [next(k for k in ks if solid(k))] if any(solid(k) for k in ks) else []

    opened = {}
    if wrapper:
        key = b'"' + wrapper.encode() + b'"'
        opening = re.compile(re.escape(key) + rb"\s*:\s*\[")
        for found in re.finditer(re.escape(key), text):
            k = int(np.searchsorted(starts, found.start(), "right")) - 1
            if k not in opened and (match := opening.search(text, starts[k], stops[k])):
                opened[k] = (match.start(), match.end())
    else:
        for k in np.flatnonzero((sides == 0) & (depths == base - 1)).tolist():
            if (where := place(k)) is not None and text[where:where + 1] == b"[":
                opened[k] = (starts[k], where + 1)
    tops = [k for k in np.flatnonzero((sides == 0) & (depths == base)).tolist() if solid(k)]
    roots = np.flatnonzero((end_sides == 0) & (end_depths == 0)).tolist()
    chosen = {*tops, *roots, *opened, *next_solid(range(last + 1)), *next_solid(range(last, -1, -1))}
    for k in opened:
        chosen.update(next_solid(range(k + 1, last + 1)))
    rows = []
    for k in sorted(chosen):
        where, first, lead, bare, bracket = place(k), "", "", False, None
        if k in opened:
            found = _SOLID.search(text, opened[k][1], stops[k])
            bare = found is None
            if found and found.group() in b"{]":
                first = found.group().decode()
                bracket = found.start() if first == "]" else None
        if where is not None:
            if (one := text[where:where + 1]) in (b"]", b"{"):
                lead = one.decode()
                bracket = where if lead == "]" else bracket
            elif one == b"," and (follows := _SOLID.search(text, where + 1, stops[k])) and follows.group() == b"{":
                lead = ","
        only = bracket is not None and _SOLID.search(text, bracket + 1, stops[k]) is None
        head = text[starts[k]:opened[k][0]] if k in opened else b""
        rows.append((int(starts[k]), int(depths[k]), bool(sides[k]), int(end_depths[k]), bool(end_sides[k]), k < last or brace, solid(k),
                     k in opened, head, first, bare, lead, only))
    return rows


def _found(base: int, wrapper: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            place = tuple(row[c] for c in _AT)
            events = _events(row["text"], row["depth"], row["in_string"], row["brace"], base, wrapper)
            if events:
                yield _batch([(*place, *event) for event in events], _EVENT)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of stretches, one at a time, with their texts."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            row["text"] = codec.decompress(row.pop("data"), row["bytes"], asbytes=True)
            yield row


def _cleaned(text: bytes, opening: re.Pattern | None) -> bytes:
    """An element's text without what comes before its brace."""
    text = (opening.sub(b"", text, count=1) if opening else text).lstrip()
    return text[1:].lstrip() if text[:1] == b"," else text


def _pieces(row: dict, opening: str) -> Iterator[tuple[int, bool, bytes]]:
    """The elements of a stretch, with their numbers, and whether they lie in it as a whole."""
    text, cuts, stop = row["text"] + (b"}" if row["brace"] else b""), row["cuts"], row["stop"]
    closed, stop = stop is not None, len(row["text"]) + 1 if stop is None else stop
    borders = [*cuts, stop]
    if row["earlier"] and borders[0] > 0:
        yield row["earlier"] - 1, False, text[:borders[0]]
    for k, (a, b) in enumerate(zip(borders, borders[1:])):
        head = re.compile(opening.encode(), re.S) if a == row["head"] else None
        yield row["earlier"] + k, closed or k + 1 < len(cuts), _cleaned(text[a:b], head)


def _cut(opening: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            place = () if whole else tuple(row[c] for c in _AT)
            found = [(number, *place, text) for number, is_whole, text in _pieces(row, opening) if is_whole == whole]
            if found:
                yield _batch(found, _WHOLE if whole else _PART)

    return run


def elements(spark: SparkSession, path: str, wrapper: str | None) -> DataFrame:
    """The texts of the elements: ``ord, text``."""
    base = 2 if wrapper else 1
    opening = rf'^.*?"{re.escape(wrapper)}"\s*:\s*\[\s*' if wrapper else r"\A\s*\[\s*"
    stretches = _stretches(spark, path)
    states = stored(_placed(stretches, _ends(spark, path, stretches)), "states")

    def with_texts(rows: DataFrame) -> DataFrame:
        return stretches.select(*_AT, "data", "bytes").join(F.broadcast(rows) if is_small(states) else rows, list(_AT))

    events = with_texts(states.select(*_AT, "depth", "in_string", "brace")).mapInArrow(_found(base, wrapper), _ddl(_EVENT))
    places = (*_AT, "offset")
    rows = stored(_with_effects(events.withColumns({"before": F.col("before").cast("string"), "at": F.struct(*places)}), "before", "before_"), "events")

    def literal(place) -> Column:
        return F.struct(*(F.lit(v).alias(n) for n, v in zip(places, place)))

    opens = F.col("opens") & ~F.col("in_string") & (F.col("before_turns") == 0) & (F.col("depth") + F.col("before_outside") == base - 1)
    solid = F.col("solid")
    start, first = rows.agg(F.min(F.when(opens, F.col("at"))), F.min(F.when(solid, F.col("at")))).first()
    if first is None:
        return spark.createDataFrame([], "ord bigint, text string")
    if start is None or (not wrapper and start != first):
        raise ValueError(f"{path}: malformed JSON, there is no array" + (f" under {wrapper!r}" if wrapper else ""))
    here = literal(start)
    between = ~F.col("in_string") & (F.col("depth") == base) & (F.col("at") > here) & solid
    closes = (between & (F.col("lead") == "]")) | ((F.col("at") == here) & (F.col("first") == "]"))
    # A file may end right after the bracket that opens the array; the first element then begins a later file.
    late = (F.col("at") == here) & F.col("bare") & ~F.col("brace")
    close, is_late, following = rows.agg(F.min(F.when(closes, F.col("at"))), F.bool_or(late), F.min(F.when(solid & (F.col("at") > here), F.col("at")))).first()
    last = states.agg(F.max_by(F.struct("end_depth", "end_in_string"), F.struct(*_AT))).first()[0]
    if close is None or last.end_in_string or last.end_depth != 0:
        raise ValueError(f"{path}: malformed JSON, one array that is closed is read")
    there = literal(close)
    first_late = F.col("at") == literal(following) if is_late else F.lit(False)
    begins = ((F.col("at") == here) & (F.col("first") == "{")) | (
        between & (F.col("at") < there) & (F.col("lead") == F.when(first_late, "{").otherwise(",")))
    strange = ((F.col("at") == here) & (F.col("first") == "") & ~late) | (between & (F.col("at") < there) & ~begins)
    # The root ends with the array, or with the first brace after which the depth is 0.
    over = F.col("at") > there
    if wrapper:
        end = rows.where(F.col("brace") & ~F.col("end_in_string") & (F.col("end_depth") == 0)).agg(F.min("at")).first()[0]
        over = F.col("at") > literal(end) if end else F.lit(False)
    wrong, after, only = rows.agg(F.count_if(strange), F.count_if(over & solid), F.bool_or((F.col("at") == there) & F.col("only"))).first()
    if wrong:
        raise ValueError(f"{path}: malformed JSON, the array holds other things than objects")
    if after or (not wrapper and not only):
        raise ValueError(f"{path}: one array is read, and nothing after it")
    cuts = (rows.where(begins if close != start else F.lit(False)).groupBy(*_AT)
            .agg(F.array_sort(F.collect_list("offset")).alias("cuts")))
    at = F.struct(*_AT)
    from_, to = (F.struct(*(F.lit(v).alias(n) for n, v in zip(_AT, place))) for place in (start, close))
    held = states.where((at >= from_) & (at <= to) if close != start else F.lit(False)).join(cuts, list(_AT), "left")
    held = held.select(*_AT, "brace", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"), F.when(at == from_, start.offset).alias("head"),
                       F.when(at == to, close.offset).alias("stop")).withColumn("n", F.size("cuts").cast("bigint"))
    inside = Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))), "held")
    along = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = held.groupBy("path", "block").agg(F.sum("n").alias("all"))
    splits = splits.select("path", "block", F.coalesce(F.sum("all").over(along), F.lit(0)).alias("earlier"))
    numbered = stored(held.join(splits, ["path", "block"]).select(
        *_AT, "brace", "cuts", "head", "stop", (F.col("earlier") + F.col("within")).alias("earlier")), "splits")
    whole, parts = (with_texts(numbered).mapInArrow(_cut(opening, k), _ddl(s)) for k, s in ((True, _WHOLE), (False, _PART)))
    piece = F.struct(*_AT, F.col("text").cast("string").alias("text"))
    joined = parts.groupBy("ord").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return (whole.select("ord", F.col("text").cast("string").alias("text"))
            .unionByName(joined.select("ord", F.array_join(F.col("pieces.text"), "").alias("text"))))
