"""Operators over ordered rows: budgets, sessions, nearest neighbours in order, spans, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(by: list[str], order: list[Column | str]):
    """Window from the first row of the key up to this one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def within_budget(rows: DataFrame, by: list[str], order: list[Column | str], cost: Column, budget: int, first_always: bool = False) -> DataFrame:
    """The leading rows of each key whose costs fit the budget together; on request the first one in any case."""
    rows = rows.withColumns({"_used": F.sum(cost).over(running(by, order)), "_rn": F.row_number().over(Window.partitionBy(*by).orderBy(*order))})
    fits = F.col("_used") <= budget
    return rows.where(fits | (F.col("_rn") == 1) if first_always else fits).drop("_used", "_rn")


def priority_budget(rows: DataFrame, by: list[str], is_key: Column, order: list[str], max_rows: int, max_chars: int, text: str) -> DataFrame:
    """Excerpts: rows with a keyword first, then others, at most max_rows, while their characters fit.

    The first row always stays, cut to the budget.
    """
    first = Window.partitionBy(*by).orderBy(is_key.desc(), *order)
    ranked = rows.withColumn("rn", F.row_number().over(first).cast("long")).where(F.col("rn") <= max_rows)
    used = F.sum(F.length(text) + 1).over(running(by, ["rn"]))
    kept = ranked.withColumn("_used", used).where((F.col("_used") <= max_chars) | (F.col("rn") == 1))
    return kept.withColumn("excerpt", F.substring(text, 1, max_chars)).drop("_used")


def sessions(rows: DataFrame, by: list[str], order: list[str], opens: Column, name: str = "session_id") -> DataFrame:
    """Numbers the sections that rows with `opens` begin; rows before the first are in section 0."""
    return rows.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(running(by, order)))


def nearest(rows: DataFrame, by: list[str], order: list[str], value: Column, before: str, after: str) -> DataFrame:
    """The last value at or before each row and the first one after it; null values are passed over."""
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({before: F.last(value, True).over(running(by, order)), after: F.first(value, True).over(ahead)})


def islands(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching spans: (by, island_start, island_end, n_spans)."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col(start) > F.coalesce(F.max(end).over(before), F.col(start) - F.lit(1))
    numbered = sessions(spans, by, [start, end], opens, "_island")
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count(F.lit(1)).alias("n_spans")).drop("_island")


def top(rows: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def overall_rank(rows: DataFrame, first: Column, order: list[Column | str], width: int = 4096, rank: str = "rank") -> DataFrame:
    """Rows with their place among all rows; first is the whole number that the order begins with.

    Ranges of `width` numbers are ranked each for itself, and the rows of the ranges before are added: only
    the ranges' counts meet in one task.
    """
    ranged = rows.withColumn("_range", F.floor(first / width))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    placed = ranged.withColumn("_place", place).join(offsets, F.col("_range").eqNullSafe(F.col("_at")))
    return placed.withColumn(rank, F.col("_place") + F.col("_before")).drop("_range", "_at", "_place", "_before")


def placed_within(rows: DataFrame, by: list[str], first: Column, order: list[str], value: Column, width: int = 4096, rank: str = "rank", before: str = "before", after: str = "after") -> DataFrame:
    """Rows with their place within the key, and the value of the row before and after.

    As overall_rank, for keys that may hold a large part of all rows: ranges of `width` numbers of a key are
    ordered each for itself; only one row for each range meets those of the key's other ranges.
    """
    ranged = rows.withColumns({"_range": F.floor(first / width), "_value": value})
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    edges = ranged.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("_value", F.struct(*order)).alias("_head"), F.max_by("_value", F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*by).orderBy("_range")
    edges = edges.select(
        *[F.col(c).alias(f"_at_{c}") for c in (*by, "_range")], F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum"),
        F.lag("_tail").over(across).alias("_prev"), F.lead("_head").over(across).alias("_next"))
    placed = ranged.withColumns({"_place": F.row_number().over(inside).cast("long"), "_lag": F.lag("_value").over(inside), "_lead": F.lead("_value").over(inside)})
    same = F.lit(True)
    for c in (*by, "_range"):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    joined = placed.join(edges, same).withColumns({rank: F.col("_place") + F.col("_sum"), before: F.coalesce("_lag", "_prev"), after: F.coalesce("_lead", "_next")})
    return joined.select(*rows.columns, rank, before, after)
