"""Positions in a total order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenekiln.session import materialize

#: Dictionaries of at most so many entries are broadcast.
MAX_DICTIONARY = 1_000_000


def ranked(df: DataFrame, order: list[Column], flag: Column | None = None) -> DataFrame:
    """`df` with `index`, each row's place from 0, and `rank`, its place from 1 among the rows where `flag` holds.

    Rows are range-partitioned and numbered within each range; a range's start is the sum of the counts before it, one
    row a partition. The ranges are written once, as a second evaluation might draw other borders.
    """
    flagged = df.withColumn("__flag", F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(True))
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = flagged.withColumns(dict(zip(keys, order)))
    parts = materialize(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"), F.count_if("__flag").alias("m")).collect()
    starts, n, m = {}, 0, 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        starts[row["__part"]] = (n, m)
        n, m = n + row.n, m + row.m
    many = 1 + max(starts, default=0)
    first = [F.get(F.lit([starts.get(i, (0, 0))[k] for i in range(many)]), F.col("__part")).cast("long") for k in (0, 1)]
    within = Window.partitionBy("__part").orderBy(*keys)
    return (
        parts.withColumn("index", first[0] + F.row_number().over(within) - 1)
        .withColumn("rank", F.when(F.col("__flag"), first[1] + F.count_if("__flag").over(within.rowsBetween(Window.unboundedPreceding, 0))))
        .drop("__flag", "__part", *keys)
    )


def shard_slots(df: DataFrame, size: int) -> DataFrame:
    """`shard` and `slot` of ranked rows, `size` to a shard; null where there is no rank."""
    if size < 1:
        raise ValueError("a shard holds one record at least")
    at = F.col("rank") - 1
    return df.withColumns({"shard": F.floor(at / size).cast("long"), "slot": F.pmod(at, F.lit(size)).cast("long")})


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, id): distinct values with ids from 0 in code-point order. The window goes over distinct values only."""
    names = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return names.withColumn("id", F.row_number().over(Window.orderBy(column)) - 1)


def listed(names: DataFrame, column: str) -> DataFrame:
    """One row, text: a dictionary's names in the order of their ids, one a line."""
    rows = F.array_sort(F.collect_list(F.struct("id", column)))
    return names.agg(F.array_join(F.transform(rows, lambda r: F.concat(r[column], F.lit("\n"))), "").alias("text"))


def encoded(df: DataFrame, names: DataFrame, column: str | list[str]) -> DataFrame:
    """Inner join with a dictionary: unknown names go. Broadcast only if the dictionary is small."""
    few = names.count() <= MAX_DICTIONARY
    return df.join(F.broadcast(names) if few else names, column)
