"""Document fingerprints: Merkle trees over pieces, paragraphs and sections, built by column functions alone.

A paragraph is a line with its line end, a section a stretch of paragraphs up to a blank one or one whose hash starts
with the digit 0, and a piece a stretch of words of a paragraph, with the white space after them, up to a word whose MD5 is in
the first three sixteenths. All borders follow from the text around them, so an edit moves only those near it. A piece has the SHA-256
of its text, every other node that of its children's hashes in their order, and the text is the concatenation of its
pieces; texts are thus equal if and only if their roots are.

Two trees are compared from the root down: equal roots end the comparison, equal sections are passed over, and
only paragraphs of differing sections are looked at (``edits``). ``likeness`` is the share of code points in pieces that
both texts have, each piece counted once.

As text a fingerprint is ``root;section,paragraph=pieces,paragraph=pieces;section,...``: the root in full, 16 digits of sections and
paragraphs, and of each piece 11 digits of its hash and 4 of its length (at most ``LONGEST``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from masteria.functions.theta import let
from masteria.llm.rows import texts_of
from masteria.plans.ranking import add_rank
from masteria.plans.storage import stored

PARAGRAPH = r"[^\n]*\n|[^\n]+"
WORD = r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"
BLANK = r"^[\x20\x09-\x0D]*$"
#: Digits of a piece: of its hash, then of its length.
HASH, LENGTH = 11, 4
LONGEST = 16 ** LENGTH - 1
SHORT = 16
#: Equal rows that one task may put out.
COPIES = 4096


def _borders(items: Column, closes) -> Column:
    """The numbers, from 1, of the items at which a stretch ends: where ``closes`` says so, and the last."""
    return F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: (i == F.size(items)) | closes(F.get(items, i - 1)))


def _stretches(items: Column, closes, node) -> Column:
    """``node`` of each stretch of items."""
    def of(ends: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return F.transform(ends, lambda end, k: let(F.slice(items, before(k) + 1, end - before(k)), node))

    return let(_borders(items, closes), of)


def _hash_of(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _piece(words: Column) -> Column:
    return let(F.array_join(words, ""), lambda text: F.struct(F.sha2(text, 256).alias("hash"), F.char_length(text).alias("n")))


def _paragraph(text: Column) -> Column:
    pieces = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                 lambda words: _stretches(words, lambda word: F.md5(word) < "3", _piece))
    return let(pieces, lambda p: F.struct(
        _hash_of(p["hash"]).alias("hash"), F.char_length(text).alias("n"), text.rlike(BLANK).alias("blank"),
        F.transform(p, lambda x: F.concat(F.substring(x["hash"], 1, HASH), F.lpad(
            F.lower(F.hex(F.least(x["n"], F.lit(LONGEST)).cast("long"))), LENGTH, "0"))).alias("pieces")))


def _section(paragraphs: Column) -> Column:
    return F.struct(_hash_of(paragraphs["hash"]).alias("hash"), paragraphs.alias("paragraphs"))


def tree(text: Column) -> Column:
    """The tree of a text: ``struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, n, blank, pieces>>>>>``.

    A null text is empty; an empty text has no sections.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    sections = let(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), _paragraph),
                   lambda p: F.when(F.size(p) > 0, _stretches(p, lambda x: x["blank"] | x["hash"].startswith("0"), _section))
                   .otherwise(F.array()))
    return let(sections, lambda s: F.struct(_hash_of(s["hash"]).alias("root"), s.alias("sections")))


def fingerprint(tree: Column) -> Column:
    """The tree as text."""
    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["hash"], 1, SHORT), F.lit("="), F.array_join(p["pieces"], ""))

    return F.concat_ws(";", tree["root"], F.array_join(F.transform(tree["sections"], lambda s: F.concat_ws(
        ",", F.substring(s["hash"], 1, SHORT), F.array_join(F.transform(s["paragraphs"], paragraph), ","))), ";"))


def pieces(tree: Column) -> Column:
    """All pieces of a tree as whole numbers: hash and length."""
    return F.transform(F.flatten(F.flatten(F.transform(tree["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["pieces"])))),
                       _number)


def _number(piece: Column) -> Column:
    return F.conv(piece, 16, 10).cast("long")


def pieces_of(fingerprint: Column) -> Column:
    """``pieces`` from the text of a fingerprint."""
    digits = F.lit(f"[0-9a-f]{{{HASH + LENGTH}}}")
    parts = F.regexp_extract_all(fingerprint, F.lit("=([0-9a-f]*)"), F.lit(1))
    return F.transform(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, digits, F.lit(0)))), _number)


def likeness(ours: Column, theirs: Column) -> Column:
    """Twice the code points of the pieces in both, divided by those in each: 1 for equal texts, 0 if they share none.

    Both columns are ``pieces``. Two texts without pieces are alike.
    """
    def weight(found: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda sum_, piece: sum_ + piece.bitwiseAND(F.lit(LONGEST).cast("long")))

    both, each = weight(F.array_intersect(ours, theirs)), weight(F.array_distinct(ours)) + weight(F.array_distinct(theirs))
    return F.when((F.size(ours) == 0) & (F.size(theirs) == 0), 1.0).otherwise(2.0 * both / each)


def edits(ours: Column, theirs: Column) -> Column:
    """The paragraphs of one tree that the other lacks: ``array<struct<section, paragraph, n>>``, numbers from 0 and code points.

    Both columns are ``tree``. Equal roots have none; sections that the other tree has are passed over.
    """
    def hashes(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: s["paragraphs"]["hash"]))

    def descend(differing: Column) -> Column:
        own = hashes(F.filter(ours["sections"], lambda s: F.array_contains(differing, s["hash"])))
        return let(F.array_except(own, hashes(theirs["sections"])), lambda absent: F.flatten(F.transform(
            ours["sections"], lambda s, i: F.when(F.array_contains(differing, s["hash"]), lacking(s, i, absent)).otherwise(F.array()))))

    def lacking(section: Column, i: Column, absent: Column) -> Column:
        numbered = F.transform(section["paragraphs"], lambda p, k: F.struct(
            i.alias("section"), k.alias("paragraph"), p["n"].alias("n"), p["hash"].alias("hash")))
        found = F.filter(numbered, lambda p: F.array_contains(absent, p["hash"]))
        return F.transform(found, lambda p: F.struct(*(p[c].alias(c) for c in ("section", "paragraph", "n"))))

    differing = F.when(ours["root"] == theirs["root"], F.array().cast("array<string>")).otherwise(
        F.array_except(ours["sections"]["hash"], theirs["sections"]["hash"]))
    return let(differing, descend)


def _in_order(keyed: DataFrame) -> DataFrame:
    """Every different row and the one that follows it by falling id, then key; the first follows the last."""
    groups = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranked = add_rank(groups, [F.col("doc_id").desc_nulls_last(), F.col("key").desc()])
    ranked = stored(ranked.select("key", "n_chars", "copies", "rank"), "order")
    following = ranked.select("key", "rank")
    return (ranked.select(F.col("key").alias("before"), F.col("n_chars").alias("wanted"), "copies",
                          (F.col("rank") % F.lit(ranked.count()) + 1).alias("rank"))
            .join(following, "rank").drop("rank"))


def order_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of rows in their order, see ``with_next``."""
    return stored(_in_order(_keyed(docs, doc_id, text)), "links")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts_of(docs, doc_id, text).withColumns({
        "key": F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), "n_chars": F.char_length("text").cast("long")})


def with_next(docs: DataFrame, links: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with the third of its length from the start of the next, and the pieces of the next:
    ``doc_id, text, n_chars, cut, head, next_pieces, times``. Rows are next to each other by falling id, ids that are
    null last, then by falling hash of the text; the first row comes after the last. ``times`` equal rows are one.

    Texts are shuffled once, by their row's key; what a row takes from the next is sent by key as well.
    """
    # One struct and the count of copies in both uses, so that both read the same shuffle.
    rows = (_keyed(docs, doc_id, text).groupBy("key").agg(F.first(F.struct("doc_id", "text", "n_chars")).alias("one"), F.count(F.lit(1)).alias("copies"))
            .select("key", "one.*", "copies"))
    sent = (rows.where("copies > 0").join(links.select("key", "before", "wanted"), "key")
            .select(F.col("before").alias("key"), F.left("text", (F.col("wanted") / 3).cast("int")).alias("head"),
                    pieces(tree(F.col("text"))).alias("next_pieces")))
    joined = rows.join(sent, "key").withColumn("cut", (F.col("n_chars") / 3).cast("int"))
    # Of equal rows all but the last come before one like themselves.
    last = F.struct(F.lit(1).cast("long").alias("times"), "head", "next_pieces")
    others = F.struct((F.col("copies") - 1).alias("times"), F.left("text", F.col("cut")).alias("head"),
                      pieces(tree(F.col("text"))).alias("next_pieces"))
    split = joined.select("doc_id", "text", "n_chars", "cut", F.explode(
        F.when(F.col("copies") == 1, F.array(last)).otherwise(F.array(last, others))).alias("of"))
    return split.select("doc_id", "text", "n_chars", "cut", "of.*")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: int = COPIES) -> DataFrame:
    """Fingerprints of every text, and of it with its last third replaced by the start of the next text (``with_next``).

    One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    A null text is empty; its tree has no sections. Texts of any length are taken whole. Rows with the same id are
    ordered by the hash of their text; equal rows give equal results but for the last, whose next row is another
    one. A null id counts as the lowest. A single row is its own next one. An empty table gives no rows; other
    columns are not read. More than ``copies`` equal rows are put out by several tasks.
    """
    links = order_of(docs, doc_id, text)
    base = with_next(docs, links, doc_id, text)
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("cut")), F.col("head"))
    trees = base.select("doc_id", "n_chars", "times", "next_pieces", tree(F.col("text")).alias("tree"), edited.alias("edited"))
    both = trees.select("*", pieces(F.col("tree")).alias("pieces"), tree(F.col("edited")).alias("edited_tree"))
    both = both.select("*", pieces(F.col("edited_tree")).alias("edited_pieces"))
    ours = F.col("pieces")
    result = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(ours, F.col("edited_pieces")).alias("near_edited"), likeness(ours, F.col("next_pieces")).alias("near_next"), "times")
    if not links.where(F.col("copies") > copies).isEmpty():
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / copies)))
        whole = stored(result.where("times > 0"), "fingerprints").withColumn("part", parts)
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size = F.least(F.lit(copies).cast("long"), F.col("times") - F.col("part") * copies)
        result = whole.withColumn("times", size).drop("part").repartition(n)
    return (result.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .drop("times", "copy"))
