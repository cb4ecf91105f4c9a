"""Skills grouped by benchmark, and the items behind each skill.

Skills are numbered by a sort by ranges, so that a benchmark with most of the skills is spread over tasks; what is brought
together in one task has one row per benchmark, or one per many skills. Items are never brought together: they are counted
or limited per skill before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masteria.functions.fixed import GRID_BENCHMARKS
from masteria.functions.text import contains, heading
from masteria.plans.axis import ord_of
from masteria.plans.ranking import add_rank


def canonical_place(benchmark: Column) -> Column:
    """1-based place among the known benchmarks, one past the end for any other."""
    place = F.array_position(F.array(*[F.lit(b) for b in GRID_BENCHMARKS]), benchmark)
    return F.when(place > 0, place).otherwise(F.lit(len(GRID_BENCHMARKS) + 1)).cast("bigint")


def benchmark_order(skills: DataFrame) -> DataFrame:
    """Benchmarks that occur, the known ones first, the others by first appearance."""
    groups = _groups(skills)
    return groups.select("primary_benchmark", "ord")


def _groups(skills: DataFrame) -> DataFrame:
    """One row per benchmark: its position and its number of skills."""
    groups = skills.groupBy("primary_benchmark").agg(
        F.min(ord_of(skills)).alias("_first"), F.count(F.lit(1)).alias("n_skills"))
    order = Window.orderBy(canonical_place(F.col("primary_benchmark")), "_first")
    return groups.select(
        "primary_benchmark", F.row_number().over(order).cast("bigint").alias("ord"), "n_skills")


def skills_per_benchmark(skills: DataFrame) -> DataFrame:
    return _groups(skills).select(F.col("primary_benchmark").alias("benchmark"), "ord", "n_skills")


def grid_order(skills: DataFrame) -> DataFrame:
    """0-based position of each skill: by benchmark, then in input order."""
    groups = _groups(skills).select(F.col("primary_benchmark").alias("_own"), F.col("ord").alias("_group"))
    rows = skills.select(F.col("id").cast("bigint").alias("skill_id"), ord_of(skills).alias("ord"),
                         F.col("primary_benchmark").alias("benchmark"))
    # One row per benchmark on the right side; its size is known when it has been counted, and decides how they meet.
    grouped = rows.join(groups, F.col("benchmark").eqNullSafe(F.col("_own"))).drop("_own")
    placed = add_rank(grouped, [F.col("_group").asc(), F.col("ord").asc()])
    return placed.select("skill_id", (F.col("rank") - 1).alias("pos"), "benchmark")


def group_starts(skills: DataFrame) -> DataFrame:
    return grid_order(skills).groupBy("benchmark").agg(
        F.min("pos").alias("start_pos"), F.min_by("skill_id", "pos").alias("first_skill_id"))


STRETCH = 1 << 16


def sector_runs(ordered: DataFrame) -> DataFrame:
    """Runs of one benchmark along ``pos``, which must leave no ties: both ends and the share of the whole circle.

    A run is numbered by the borders before it. What a stretch of ``pos`` does to the count is summed up in one row (its first
    and last benchmark, its borders, its rows), and such rows are summed up again for as many stretches; so no task sees
    more than a stretch of rows or of sums, or one row per 2**32 positions, whatever the number of runs.
    """
    rows = ordered.select(F.expr(f"pos div {STRETCH}").alias("stretch"), "pos", F.col("pos").alias("_at"),
                          F.col("benchmark").alias("_first"), F.col("benchmark").alias("_last"), F.lit(0).cast("bigint").alias("_inner"))
    inside = _counted(rows, "stretch", "_at")
    sums = _summed(inside, "stretch").withColumn("wide", F.expr(f"stretch div {STRETCH}"))
    middle = _counted(sums, "wide", "stretch")
    top = _counted(_summed(middle, "wide").withColumn("all", F.lit(0)), "all", "wide")
    starts = middle.select("stretch", "wide", "_before").join(
        top.select("wide", F.col("_before").alias("_wider")), "wide").select("stretch", (F.col("_before") + F.col("_wider")).alias("_start"))
    total = sums.agg(F.sum("_n").alias("n")).scalar()
    # Each stretch sends a row per run, so a run over many stretches is short by then.
    numbered = inside.join(starts, "stretch").groupBy((F.col("_start") + F.col("_before") + 1).alias("run"), F.col("_last").alias("benchmark"))
    runs = numbered.agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("_n"))
    return runs.select("run", "benchmark", "start_pos", "end_pos", (F.col("_n") / total).alias("share"))


def _counted(parts: DataFrame, inside: str, along: str) -> DataFrame:
    """Add ``_before``: the borders up to the start of each part, counted inside its stretch, that at its own start included; the
    very first part of a stretch has none there, for what precedes it lies in another stretch."""
    order = Window.partitionBy(inside).orderBy(along)
    starts = F.lag(along).over(order).isNotNull() & ~F.lag("_last").over(order).eqNullSafe(F.col("_first"))
    return (parts.withColumn("_step", starts.cast("bigint"))
            .withColumn("_before", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                        + F.coalesce(F.sum("_inner").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))


def _summed(parts: DataFrame, inside: str) -> DataFrame:
    """One row per stretch: the first and the last benchmark, the borders inside, the number of rows."""
    along = "_at" if "_at" in parts.columns else "stretch"
    n = F.sum("_n") if "_n" in parts.columns else F.count(F.lit(1))
    return parts.groupBy(inside).agg(
        F.min_by("_first", along).alias("_first"), F.max_by("_last", along).alias("_last"),
        (F.sum("_step") + F.sum("_inner")).alias("_inner"), n.alias("_n"))


def skills_by_size(skills: DataFrame) -> DataFrame:
    """Skills of each benchmark, most items first, equal sizes in input order."""
    rows = skills.select(
        F.col("primary_benchmark").alias("benchmark"), F.col("id").cast("bigint").alias("skill_id"),
        ord_of(skills).alias("ord"), "n_items")
    order = [F.col("benchmark").asc(), F.desc("n_items"), F.col("ord").asc()]
    return add_rank(rows, order, within="benchmark").select("benchmark", "rank", "skill_id", "n_items")


def filter_skills(skills: DataFrame, search: str | None) -> DataFrame:
    return skills.where(contains(heading(F.col("label"), F.col("label_english")), search))


def skill_match_total(skills: DataFrame, search: str | None) -> DataFrame:
    return filter_skills(skills, search).agg(F.count(F.lit(1)).alias("n"))


def items_per_skill(items: DataFrame, skills: DataFrame) -> DataFrame:
    counts = items.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (skills.select(F.col("id").cast("bigint").alias("skill_id")).join(counts, "skill_id", "left")
            .select("skill_id", F.coalesce("n_items", F.lit(0)).alias("n_items")))


def alpha_mean(items: DataFrame) -> DataFrame:
    return items.groupBy("skill_id").agg(F.avg("alpha").alias("alpha_mean"))


def _first_benchmark(n: str) -> Column:
    """Of counts per benchmark: the largest; ties go to the earlier one in the grid, then by name."""
    benchmark = F.col("benchmark")
    return F.min_by(benchmark, F.struct((-F.col(n)).alias("n"), canonical_place(benchmark).alias("place"), benchmark))


def primary_benchmark(items: DataFrame) -> DataFrame:
    """The benchmark most of a skill's items come from."""
    counts = items.groupBy("skill_id", "benchmark").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("skill_id").agg(_first_benchmark("n").alias("benchmark"))


def skill_statistics(items: DataFrame) -> DataFrame:
    """A skill table from the items: size, primary benchmark and mean discrimination, in one pass."""
    counts = items.groupBy("skill_id", "benchmark").agg(
        F.count(F.lit(1)).alias("n"), F.sum("alpha").alias("alpha"))
    return counts.groupBy(F.col("skill_id").alias("id")).agg(
        _first_benchmark("n").alias("primary_benchmark"), F.sum("n").alias("n_items"),
        (F.sum("alpha") / F.sum("n")).alias("alpha_mean"))


def example_items(skills: DataFrame, items: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The first ``k`` example items of each skill in the order of its list, with how many are shown of
    the skill's ``n_items``; a skill without any has one row that shows none.

    Without ``items`` they are the skill's own ``example_items``, and only ``k`` of them leave its row: no shuffle. Otherwise ``items``
    are those of ``read_items``.
    """
    known = skills.select(F.col("id").cast("bigint").alias("skill_id"), "n_items", *(["example_items"] if items is None else []))
    if items is not None:
        first = items.where(F.col("slot") <= k).select("skill_id", "slot", "item_id", "text")
        shown = F.count("slot").over(Window.partitionBy("skill_id"))
        return known.join(first, "skill_id", "left").select("skill_id", "slot", "item_id", "text", shown.alias("shown"), "n_items")
    first = F.slice(F.coalesce("example_items", F.array()), 1, k)
    rows = known.select("skill_id", "n_items", F.size(first).cast("bigint").alias("shown"), F.posexplode_outer(first).alias("slot", "item"))
    return rows.select("skill_id", (F.col("slot") + 1).cast("bigint").alias("slot"), F.col("item.item_idx").alias("item_id"),
                       "item.text", "shown", "n_items")


def catalogue_counts(models: DataFrame, skills: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes of the collection in one row."""
    def size(frame: DataFrame) -> Column:
        return frame.agg(F.count(F.lit(1)).alias("n")).scalar()

    benchmarks = skills.agg(F.count_distinct("primary_benchmark").alias("n")).scalar()
    return items.agg(F.count(F.lit(1)).alias("n_items")).select(
        size(models).alias("n_models"), size(skills).alias("n_skills"), "n_items",
        benchmarks.alias("n_benchmarks"))
