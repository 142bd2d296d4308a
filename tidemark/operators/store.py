"""Keyed merges: what a store's upserts are over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: Column | str) -> DataFrame:
    """The last version of each key; columns that one side lacks are null.

    An aggregate, summed before the shuffle, so that a key with very many versions is no task of its own.
    """
    rows = old.unionByName(new, allowMissingColumns=True)
    v = F.col(version) if isinstance(version, str) else version
    rest = [c for c in rows.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(v.isNotNull(), v)).alias("_row"))
    return latest.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in rows.columns])


def upsert_keeping(old: DataFrame, new: DataFrame, key: list[str], kept: str, now: Column) -> DataFrame:
    """New rows win, but a key that was there keeps its old value of one column; new keys get `now`."""
    before = old.select(*key, F.col(kept).alias("_before"))
    fresh = new.drop(kept).join(before, key, "left").withColumn(kept, F.coalesce("_before", now)).drop("_before")
    return old.join(new.select(*key), key, "left_anti").unionByName(fresh.select(old.columns))


def count_usage(stored: DataFrame, used: DataFrame, key: str, counter: str) -> DataFrame:
    """The counter of each stored key raised by its uses."""
    uses = used.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    return stored.join(uses, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_uses", F.lit(0))).drop("_uses")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A sink of Parquet files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
