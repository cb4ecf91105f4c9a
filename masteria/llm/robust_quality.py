"""Quality rules: statistics of every text, and robust multivariate outliers among them.

Each text gives a vector of transformed statistics. For every language and source the location and
scatter of its texts are estimated by the minimum covariance determinant: the share ``support`` of
the texts whose scatter has the smallest determinant. The search starts from coordinate-wise
medians and deviations and repeats concentration steps: distances from the current estimate, then
the estimate of the nearest texts, exactly the wanted number of them. Least deviations are added to every scatter in the same
way, so a step never makes the determinant larger; a group has settled when a step does not make it smaller. A text is
rejected if its Mahalanobis distance from the estimate of its group is beyond a quantile of the chi-square distribution.

A step puts the texts of a group in order, by distance, then by a hash of the vector. In a group that is too large for one task
the sums are first taken by classes of distance, which tells the class in which the wanted number is reached. Only that class
is looked at again, by finer classes, until it is small enough. Groups with few
texts use the texts of their language, and these all texts, in the same way.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from masteria.llm.rows import as_batches, columns_of, ddl, fresh, in_small_batches, with_few
from masteria.plans.storage import stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Fixed limits of the base rule.
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Words by which ratios are drawn towards typical values, so that short texts do not scatter more than long ones.
PRIOR_WORDS = 60.0
#: Names of the coordinates, a typical value of each (before words are seen) and the least deviation that counts.
COORDINATES = ("word_length", "symbols", "punctuation", "upper_case", "duplicate_lines", "repeated_words")
PRIORS = (5.0, 0.02, 0.2, 0.1, 0.0, 0.0)
LEAST_DEVIATION = (0.05, 0.05, 0.06, 0.05, 0.08, 0.08)
#: Coordinates are whole numbers of this unit, so that sums do not depend on the order of the rows.
UNIT = 4096
#: Classes of distance are this many to a doubling; texts of a group that is estimated by itself.
CLASSES = 16
LEAST_TEXTS = 50
#: Different vectors of a group, or of one of its classes, that are put in order by one task.
GATHER = 4096
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], dtype=np.uint64)

_STATS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_words", pa.int64()),
                    ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                    ("n_repeat_words", pa.int64()),
                    *((f"x{k}", pa.int64()) for k in range(len(COORDINATES)))])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of consecutive words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums += codes[k:n + k] * _MULTIPLIERS[k]
    order = np.sort(sums)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(sums, twice)).tolist()  # equal windows have equal sums; now compare the words
    windows = [tuple(words[i:i + window]) for i in starts]
    found = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(starts, windows):
        if found[w] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int, list[float]]:
    """Words, their characters, symbols, repeated lines, repeated words, and the vector of coordinates."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes split at exactly \\x20, \\x09-\\x0D
    n = len(words)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    blanks = int(of[32] + of[9:14].sum())
    chars = len(raw) - int(of[0x80:0xC0].sum()) - blanks
    symbols = int(sum(of[ord(c)] for c in SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    again = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    punctuation = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum()) - symbols
    prior = PRIOR_WORDS
    letters = upper + lower + prior * PRIORS[0]
    x = [math.log((chars + prior * PRIORS[0]) / (n + prior)),
         math.sqrt((symbols + prior * PRIORS[1]) / (n + prior)),
         math.sqrt((punctuation + prior * PRIORS[2]) / (n + prior)),
         math.sqrt((upper + prior * PRIORS[0] * PRIORS[3]) / letters),
         again / (len(lines) + 10.0),
         repeats / (n + prior)]
    return n, chars, symbols, again, repeats, [round(v * UNIT) for v in x]


def base_failed(n_words, n_repeat_words):
    """The base rule, on numbers or columns."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def chi_square(x: float, dof: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = dof / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi_square_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dof) < share else (low, middle)
    return high


# Estimates ------------------------------------------------------------------------------------

P = len(COORDINATES)
X = [f"x{k}" for k in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_MODEL = "`group` string, centre array<double>, precision array<double>, log_det double"


def _model(group: str, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(scatter)
    return pd.DataFrame({"group": [group], "centre": [centre], "precision": [[inverse[i, j] for i, j in PAIRS]],
                         "log_det": [np.linalg.slogdet(scatter)[1]]})


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def _start(key: tuple, classes: pd.DataFrame) -> pd.DataFrame:
    """Medians and median deviations of one group, from the counts of values by coordinate."""
    centre, deviation = np.zeros(P), np.array(LEAST_DEVIATION)
    for k, one in classes.groupby("coordinate"):
        values, counts = one["value"].to_numpy(float) / UNIT, one["n"].to_numpy()
        centre[k] = _middle(values, counts)
        deviation[k] = max(deviation[k], 1.4826 * _middle(np.abs(values - centre[k]), counts))
    return _model(key[0], centre, np.diag(deviation ** 2))


#: What is added up of a set of texts.
SUMS = ["n", *X, *(f"p{i}_{j}" for i, j in PAIRS)]
_CUT = "`group` string, `class` long, need long, vectors long, below array<long>"
#: Digits of the two keys by which texts are ordered: the first, signed, from this bit on, the others of so many bits.
_FIRST, _BITS = 48, 12
_LEVELS = 1 + _FIRST // _BITS


def _boundary(key: tuple, classes: pd.DataFrame) -> pd.DataFrame:
    """The class of one group in which the wanted number of texts is reached, and the sums of those below it."""
    classes = classes.sort_values("class")
    upto = classes["n"].cumsum().to_numpy()
    need, before = int(classes["need"].iloc[0]), classes["below"].iloc[0]
    at = int(np.searchsorted(upto, need))
    below = [int(classes[c].iloc[:at].sum()) + int(before[k]) for k, c in enumerate(SUMS)]
    return pd.DataFrame({"group": [key[0]], "class": [int(classes["class"].iloc[at])], "need": [need - int(upto[at - 1] if at else 0)],
                         "vectors": [int(classes["vectors"].iloc[at])], "below": [below]})


def _estimate(support: float):
    factor = support / chi_square(chi_square_quantile(support, P), P + 2)

    def estimate(key: tuple, rows: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        """The estimate of the nearest texts of one group: those below its boundary class and the first of that class."""
        rows = rows.sort_values(["near", "hash", *X])
        before = rows["n"].cumsum() - rows["n"]
        n = np.minimum(rows["n"], int(cut["need"].iloc[0]) - before).clip(lower=0).to_numpy()
        x = [rows[c].to_numpy() for c in X]
        inside = [n.sum(), *((n * v).sum() for v in x), *((n * x[i] * x[j]).sum() for i, j in PAIRS)]
        of = dict(zip(SUMS, (int(a) + int(b) for a, b in zip(cut["below"].iloc[0], inside))))
        centre = np.array([of[c] for c in X]) / of["n"] / UNIT
        scatter = np.zeros((P, P))
        for i, j in PAIRS:
            scatter[i, j] = scatter[j, i] = of[f"p{i}_{j}"] / of["n"] / UNIT ** 2 - centre[i] * centre[j]
        return _model(key[0], centre, factor * scatter + np.diag(np.square(LEAST_DEVIATION)))

    return estimate


def distance(x: Callable[[str], Column] = F.col, centre: str = "centre", precision: str = "precision") -> Column:
    """The squared Mahalanobis distance of ``x0, x1, ...`` by the columns of a model."""
    off = [x(c) / F.lit(float(UNIT)) - F.col(centre)[k] for k, c in enumerate(X)]
    return sum((F.col(precision)[at] * off[i] * off[j] * (1.0 if i == j else 2.0)
                for at, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def text_statistics(docs: DataFrame, doc_id: str | None = "doc_id", text: str = "text", lang: str = "lang",
                    source: str = "source") -> DataFrame:
    """Statistics and coordinates of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in columns_of(batch))
        return as_batches(((i, a, b, *(s := statistics(t))[:5], *s[5]) for i, t, a, b in rows), _STATS)

    word = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (in_small_batches(docs).select((F.lit(None) if doc_id is None else F.col(doc_id)).cast("long").alias("doc_id"), word.alias("text"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))))
            .mapInArrow(run, ddl(_STATS)))


def groups_of(stats: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """``lang, source, group``: groups with few texts are joined by language, and these, where still few, to one."""
    counts = stats.groupBy("lang", "source").agg(F.sum(F.when(~base_failed(F.col("n_words"), F.col("n_repeat_words")), 1)
                                                       .otherwise(0)).alias("n"))
    few = F.col("n") < least
    by_lang = counts.groupBy("lang").agg(F.sum(F.when(few, F.col("n")).otherwise(0)).alias("few_n"))
    return (counts.join(by_lang, "lang")
            .select("lang", "source", F.when(~few, F.to_json(F.array("lang", "source")))
                    .when(F.col("few_n") >= least, F.to_json(F.array("lang"))).otherwise(F.lit("[]")).alias("group")))


def _digit(level: int) -> Column:
    key, place = F.col("near" if level < _LEVELS else "hash"), level % _LEVELS
    digits = F.shiftright(key, _FIRST - _BITS * place)
    return digits if place == 0 else digits.bitwiseAND(F.lit((1 << _BITS) - 1))


def _join(frame: DataFrame, groups: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    return frame.join(F.broadcast(groups) if few else groups, "group", how)


def _step(vectors: DataFrame, model: DataFrame, wholes: DataFrame, few: bool, large: bool, gather: int, support: float) -> DataFrame:
    """The estimates of the texts nearest to those of ``model``; ``wholes`` has what is wanted of each group."""
    near = F.floor(F.log2(distance() + 1e-6) * (CLASSES * float(1 << _FIRST)))
    rows = (_join(vectors, model.select("group", "centre", "precision"), few)
            .select("group", *X, "n", near.alias("near"), F.xxhash64(*X).alias("hash")))
    n = F.col("n")
    sums = [F.sum(n).alias("n"), *(F.sum(n * F.col(c)).alias(c) for c in X),
            *(F.sum(n * F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in PAIRS), F.count(F.lit(1)).alias("vectors")]
    cut = _join(wholes, model.select("group"), few, "left_semi")
    for level in range(2 * _LEVELS if large else 0):
        wide = cut.where(F.col("vectors") > gather)
        classes = _join(rows, wide.select("group"), few, "left_semi").groupBy("group", _digit(level).alias("class")).agg(*sums)
        classes = _join(classes, wide.select("group", "need", "below"), few)
        finer = stored(classes.groupBy("group").applyInPandas(_boundary, _CUT), "cut")
        if (widest := finer.agg(F.max("vectors")).first()[0]) is None:
            break
        rows = (_join(rows, finer.select("group", "class"), few, "left")
                .where(F.col("class").isNull() | (_digit(level) == F.col("class"))).drop("class"))
        cut = cut.where(F.col("vectors") <= gather).unionByName(finer)
        if widest <= gather:
            break
    return rows.groupBy("group").cogroup(cut.groupBy("group")).applyInPandas(_estimate(support), _MODEL)


def estimates(grouped: DataFrame, support: float = 0.75, gather: int = GATHER, few: int = 20_000) -> DataFrame:
    """Centre and precision of every ``group`` of ``grouped``, which has the coordinates of texts that count.

    ``gather``: different vectors of one group that are put in order by one task. The result does not depend on it.
    ``few``: groups whose estimates are sent to all tasks; more are dealt by group.
    """
    vectors = stored(grouped.groupBy("group", *X).agg(F.count(F.lit(1)).alias("n")), "vectors")
    nothing = F.array_repeat(F.lit(0).cast("long"), len(SUMS))
    wholes = stored(vectors.groupBy("group").agg(
        F.lit(None).cast("long").alias("class"), F.ceil(F.sum("n") * support).alias("need"),
        F.count(F.lit(1)).alias("vectors")).withColumn("below", nothing), "wholes")
    groups, widest = wholes.agg(F.count(F.lit(1)), F.max("vectors")).first()
    values = vectors.select("group", "n", F.posexplode(F.array(*X)).alias("coordinate", "value"))
    counts = values.groupBy("group", "coordinate", "value").agg(F.sum("n").alias("n"))
    model = counts.groupBy("group").applyInPandas(_start, _MODEL)
    model = stored(model.withColumns({"log_det": F.lit(float("inf")), "moved": F.lit(True)}), "start")
    while not model.where("moved").isEmpty():
        new = _step(vectors, model.where("moved"), wholes, groups <= few, (widest or 0) > gather, gather, support)
        new = new.select("group", *(F.col(c).alias(f"new_{c}") for c in ("centre", "precision", "log_det")))
        smaller = F.coalesce(F.col("new_log_det") < F.col("log_det"), F.lit(False))
        model = stored(model.join(new, "group", "left").select(
            "group", *(F.when(smaller, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "precision", "log_det")),
            smaller.alias("moved")), "model")
    return model.drop("moved")


def model_of(stats: DataFrame, support: float, least: int) -> DataFrame:
    """Centre and precision for every ``lang, source``; null where no text of its group counts."""
    groups = stored(groups_of(stats, least), "groups")
    counting = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("lang", "source", *X)
    grouped = stored(with_few(counting, groups, ["lang", "source"]).select("group", *X), "grouped")
    return stored(with_few(groups, estimates(grouped, support), "group", "left")
                  .select("lang", "source", "centre", "precision"), "models")


def robust_quality(docs: DataFrame, support: float = 0.75, accepted: float = 0.99999, doc_id: str = "doc_id",
                   text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_TEXTS) -> DataFrame:
    """Statistics of every text, ``base_failed``, and ``kept``: whether it also is no outlier of its group.

    One row per input row. A null text has no words, so the base rule rejects it; a null language or source
    counts as an empty name. Repeated rows count as often as they occur. Null ids stay null. With an empty table, or
    one whose texts all fail the base rule, nothing is estimated and nothing is kept. Other columns are not read.
    ``accepted``: the share of normally distributed texts that would be kept; ``least``: texts of a group that
    is estimated by itself.
    """
    stats = stored(text_statistics(docs, doc_id, text, lang, source), "stats")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (with_few(stats, model_of(stats, support, least), ["lang", "source"])
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & _near(distance(), accepted)).alias("kept"),
                    distance().alias("distance")))


def _near(squared: Column, accepted: float) -> Column:
    return F.coalesce(squared <= chi_square_quantile(accepted, P), F.lit(False))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_repeat_words", *X)]))
def _of_texts(texts: pa.Array) -> pa.Array:
    rows = [(s[0], s[4], *s[5]) for s in map(statistics, texts.to_pylist())]
    columns = zip(*rows) if rows else [[] for _ in range(2 + P)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_repeat_words", *X])


def without_outliers(docs: DataFrame, support: float = 0.75, accepted: float = 0.99999, text: str = "text",
                     lang: str = "lang", source: str = "source", least: int = LEAST_TEXTS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``robust_quality`` keeps, and it says what becomes of odd rows.

    The rows are written once with the statistics of their texts; verdicts are then read from there, without a shuffle of texts.
    """
    names = {c: fresh(f"model_{c}", docs) for c in ("lang", "source", "centre", "precision", "stats")}
    keyed = in_small_batches(docs).withColumns({
        names[k]: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in (("lang", lang), ("source", source))})
    rows = stored(keyed.withColumn(names["stats"], _of_texts(F.coalesce(F.col(text).cast("string"), F.lit("")))), "judged")
    of = F.col(names["stats"])
    models = model_of(rows.select(F.col(names["lang"]).alias("lang"), F.col(names["source"]).alias("source"),
                                  *(of[c].alias(c) for c in ("n_words", "n_repeat_words", *X))), support, least)
    models = stored(models.select(*(F.col(c).alias(names[c]) for c in models.columns)), "models")
    failed = base_failed(of["n_words"], of["n_repeat_words"])
    near = _near(distance(lambda c: of[c], names["centre"], names["precision"]), accepted)
    return (with_few(rows, models, [names["lang"], names["source"]])
            .where(~failed & near).select(*(F.col(f"`{c}`") for c in docs.columns)))
