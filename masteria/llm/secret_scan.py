"""Secrets in texts, and how widely each candidate is owned over the whole corpus.

Three fixed kinds of candidates are searched for, and a broader one, long mixed runs of characters.
The value of every candidate is hashed; a hash is counted by distinct repositories and owners. A value
found with many owners is a widely copied example; one that a single owner has, in however many repositories, looks live. The
scan reports candidates of the broad kind unless they are examples; what is redacted are candidates of all kinds that are no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masteria.llm.rows import fresh, map_rows
from masteria.plans.joins import lookup_join
from masteria.plans.storage import stored

KINDS = ("assign", "access", "hex", "mixed")
BASE_KINDS = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
#: A run that is too short holds no longer one, so the length can be part of these patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED_LEAST = 20
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MIXED_PARTS = (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))
#: Owners from which a value counts as an example.
WIDELY = 3

_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])
_SCAN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string()),
                   ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("base_sha256", pa.string()), ("found", pa.list_(_FOUND))])


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``kind, start, end, value`` of all candidates of a text by start, then kind; positions are code points."""
    out = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(word in folded for word in ASSIGN_WORDS):
        out += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    if long := [word for word in text.split() if len(word) >= MIXED_LEAST]:
        joined = " ".join(long)
        if HEX.search(joined):
            out += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
        if MIXED_PARTS[0].search(joined):
            taken = [(start, end) for _, start, end, _ in out]
            for m in MIXED.finditer(text):
                if (all(part.search(m[0]) for part in MIXED_PARTS)
                        and not any(m.start() < end and start < m.end() for start, end in taken)):
                    out.append((3, *m.span(), m[0]))
    return sorted(out, key=lambda c: (c[1], c[0]))


def _scan(rows) -> Iterator[tuple]:
    number = TaskContext.get().partitionId() << 33
    for row, doc_id, text, repository, owner in rows:
        found = candidates(text)
        base = [c for c in found if c[0] < BASE_KINDS]
        spans = ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end, _ in base)
        of = [sum(c[0] == k for c in base) for k in range(BASE_KINDS)]
        yield (number if row is None else row, doc_id, repository, owner, *of, hashlib.sha256(spans.encode()).hexdigest(),
               [{"kind": k, "start": start, "end": end, "hash": hashlib.sha256(value.encode()).hexdigest()}
                for k, start, end, value in found])
        number += 1


def scanned(docs: DataFrame, repository: Column, owner: Column, doc_id: str = "doc_id", text: str = "text",
            row: str | None = None) -> DataFrame:
    """The candidates of every row, written to the shared folder; rows get a number of their own if they have none."""
    word = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return stored(map_rows(docs.select(F.lit(None).cast("long").alias("row") if row is None else F.col(row).alias("row"),
                                       F.col(doc_id).cast("long").alias("doc_id"), word.alias("text"),
                                       F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
                                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner")), _scan, _SCAN), "scan")


def ownership(scan: DataFrame, widely: int = WIDELY) -> DataFrame:
    """Every candidate hash of the corpus: its repositories and owners, whether it is an example or looks live."""
    where = (scan.select("repository", "owner", F.explode("found.hash").alias("hash"))
             .groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n")))
    by_owner = where.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    return (by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("n_repositories").alias("n_repositories"),
                                         F.count(F.lit(1)).alias("n_owners"))
            .withColumns({"example": F.col("n_owners") >= widely, "live": F.col("n_owners") == 1}))


def judged(scan: DataFrame, owners: DataFrame) -> DataFrame:
    """Every candidate of every row with the verdict on its hash. A value that a third of all rows share is dealt to many tasks."""
    return lookup_join(scan.select("row", F.explode("found").alias("c")).select("row", "c.*"), owners, "hash")


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, widely: int = WIDELY, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The secrets of every text, and how many of them are widely copied or look live.

    One row per input row: the numbers of the fixed kinds, the digest of their spans, all spans as text,
    ``n_mixed``, ``n_examples``, ``n_live``, and over how many repositories and owners the most widely found of its values is
    spread (``most_repositories``, ``most_owners``; 0 without secrets). A null text has none; a null repository or owner counts as one without
    a name. Repeated rows and null ids are kept apart. An empty table gives no rows; other columns are not read.
    """
    scan = scanned(docs, repository, owner, doc_id, text)
    verdicts = judged(scan, stored(ownership(scan, widely), "owners")).where((F.col("kind") < BASE_KINDS) | ~F.col("example"))
    names = F.array(*(F.lit(k) for k in KINDS))
    counts = ("n_mixed", "n_examples", "n_live", "most_repositories", "most_owners")
    per_row = (verdicts.groupBy("row")
               .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
                    F.sum(F.when(F.col("kind") >= BASE_KINDS, 1).otherwise(0)).alias("n_mixed"),
                    F.sum(F.col("example").cast("long")).alias("n_examples"), F.sum(F.col("live").cast("long")).alias("n_live"),
                    F.max("n_repositories").alias("most_repositories"), F.max("n_owners").alias("most_owners"))
               .select("row", F.concat_ws(",", F.transform("all", lambda c: F.concat_ws(
                   ":", names[c["kind"]], c["start"].cast("string"), c["end"].cast("string")))).alias("spans"),
                       *counts))
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *counts]
    with_some = (scan.where(F.size("found") > 0).join(per_row, "row", "left")
                 .fillna({"spans": "", **{c: 0 for c in counts}}).select(*columns))
    without = scan.where(F.size("found") == 0).withColumns({"spans": F.lit(""), **{c: F.lit(0).cast("long") for c in counts}})
    return without.select(*columns).unionByName(with_some)


REDACTED = "[SECRET]"
_SPANS = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _merged(rows) -> Iterator[tuple]:
    """Spans of a row without overlaps."""
    for row, spans in rows:
        out: list[dict] = []
        for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
            if out and span["start"] < out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], span["end"])
            else:
                out.append(dict(span))
        yield row, out


def _end_before(spans: Column, i: Column) -> Column:
    return F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"])


def redacted(docs: DataFrame, repository: Column, owner: Column, widely: int = WIDELY, text: str = "text",
             length: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with secrets in texts replaced by ``REDACTED``.

    Values that are widely copied examples stay. ``length`` names a column with the text's code points; it follows
    the new text. A null text stays null; a null repository or owner counts as one without a name. Texts are searched whole.
    Repeated rows stay, each redacted, and count once as owners. An empty table gives no rows.
    """
    row, spans = fresh("row", docs), fresh("secret_spans", docs)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    scan = scanned(rows, repository, owner, row, text, row)
    secret = judged(scan, stored(ownership(scan, widely), "owners")).where(~F.col("example"))
    found = secret.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = stored(map_rows(found, _merged, _SPANS).select(F.col("row").alias(row), F.col("spans").alias(spans)), "spans")
    joined = rows.join(found, row, "left")
    s, word = F.col(spans), F.col(text)
    before = F.transform(s, lambda x, i: F.concat(
        F.substring(word, (_end_before(s, i) + 1).cast("int"), (x["start"] - _end_before(s, i)).cast("int")),
        F.lit(REDACTED)))
    rest = F.substring(word, (F.element_at(s, -1)["end"] + 1).cast("int"), F.char_length(word))
    changed = {text: F.when(s.isNull(), word).otherwise(F.concat(F.array_join(before, ""), rest))}
    if length in docs.columns:
        kind = dict(docs.dtypes)[length]
        changed[length] = F.when(s.isNull(), F.col(length)).otherwise(F.char_length(changed[text]).cast(kind))
    return joined.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns))
