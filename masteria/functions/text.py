"""Labels, searches and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from masteria.functions.fixed import ASCII_SPACE, LABEL_CUT, LABEL_ENDINGS, MAX_COMPARED, WHITE_SPACE, WIDE_SPACE
from masteria.functions.theta import let


def normalized(text: Column) -> Column:
    """Trimmed, lower case, every run of white space one blank.

    White space is turned into blanks by plain replacements, the rarer kinds only in texts that
    are not ASCII throughout. Few texts then need the regular expression, which is the slow part.
    """
    def single(blanks: Column) -> Column:
        return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, "  +", " ")).otherwise(blanks)

    ascii_only = F.octet_length(text) == F.length(text)
    blanks = F.when(ascii_only, text).otherwise(F.translate(text, WIDE_SPACE, " " * len(WIDE_SPACE)))
    for space in ASCII_SPACE:
        blanks = F.replace(blanks, F.lit(space), F.lit(" "))
    return F.lower(F.trim(let(blanks, single)))


def heading(label: Column, label_english: Column) -> Column:
    return F.coalesce(label_english, label)


def displayed(label: Column) -> Column:
    """A label that was cut upstream gets an ellipsis."""
    return F.when(is_cut(label), F.concat(label, F.lit("…"))).otherwise(label)


def is_cut(label: Column) -> Column:
    """Whether the label has the length at which labels were cut, and no closing mark. The cut
    counted UTF-16 units, of which some characters take two."""
    units = F.octet_length(F.encode(label, "UTF-16BE")) / 2
    long = (F.length(label) >= LABEL_CUT) | ((F.length(label) >= LABEL_CUT // 2) & (units >= LABEL_CUT))
    return long & ~F.right(label, F.lit(1)).isin(*LABEL_ENDINGS)


def contains(text: Column, search: str | None) -> Column:
    """Literal, case-blind substring test; a blank search keeps every row."""
    wanted = clean_search(search)
    return F.lower(text).contains(wanted) if wanted else F.lit(True)


def clean_search(search: str | None) -> str:
    return (search or "").strip(WHITE_SPACE).lower()


def hub_repository(hf_id: Column) -> Column:
    """Owner and name are joined by the first double underscore only."""
    return F.regexp_replace(hf_id, "(?s)^(.*?)__", "$1/")


def requested_ids(csv: Column, at_most: int = MAX_COMPARED) -> Column:
    """The leading integers of a comma-separated list, the first ``at_most`` of them.

    Parts without a leading integer are passed over. An integer too large to be an id stays as
    null: it takes its place in the list and matches no model.
    """
    pattern = f"^[{WHITE_SPACE}]*([+-]?[0-9]+)"
    numbers = F.transform(F.split(F.coalesce(csv, F.lit("")), ","),
                          lambda part: F.regexp_extract(part, pattern, 1))
    kept = F.slice(F.filter(numbers, lambda n: n != ""), 1, at_most)
    return F.transform(kept, lambda n: n.try_cast("bigint"))
