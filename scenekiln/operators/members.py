"""Shard members as rows (shard, ord, key, ext, payload): samples, pivots, indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.functions.text import READ, stripped
from scenekiln.session import materialize, shared_path

#: Entries of a page of a class index.
PAGE = 4096


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, with the task's part, the run within its group so far, and whether the group is the part's
    first. Group and key are told by the hashes in the last two columns."""
    part = TaskContext.get().partitionId()
    group = key = None
    run, first = 0, True
    for batch in batches:
        if not len(batch):
            continue
        groups, keys = (np.asarray(batch.column(batch.num_columns - i)) for i in (2, 1))
        opens = np.r_[group is None or groups[0] != group, groups[1:] != groups[:-1]]
        new = ~opens & np.r_[key is not None and keys[0] != key, keys[1:] != keys[:-1]]
        total = np.cumsum(new)
        # runs count from 0 where a group opens, and go on from the batch before where none has
        base = np.maximum.accumulate(np.where(opens, total, -1))
        runs = np.where(base < 0, run + total, total - base)
        firsts = np.cumsum(opens) == (1 if group is None else 0) if first else np.zeros(len(batch), bool)
        group, key, run, first = groups[-1], keys[-1], int(runs[-1]), bool(firsts[-1])
        out = batch.columns[:-2] + [pa.array(np.full(len(batch), part, np.int32)), pa.array(runs), pa.array(firsts)]
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-2], "__part", "run", "__first"])


def runs(members: DataFrame, partition: list[str], order: list[str], key: str = "key") -> DataFrame:
    """`members` with `run`: a new one wherever the key differs from the row before, so a key may have several.

    A segmented scan: rows are range-partitioned by `partition` and `order` (ties by key), so one group of most rows is
    numbered in many tasks; each numbers what it has, and a group that goes on from one range to the next starts from
    the runs before, which take one row a range. Neighbours are compared by 64-bit hashes.
    """
    told = [F.xxhash64(*[F.col(f"`{c}`") for c in cols]) for cols in (partition, [key])]
    at = [F.col(f"`{c}`") for c in (*partition, *order)]
    dealt = members.repartitionByRange(*at).sortWithinPartitions(*at, F.col(f"`{key}`")).select("*", told[0].alias("__group"), told[1].alias("__key"))
    schema = T.StructType([*members.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("__first", T.BooleanType())])
    parts = materialize(dealt.mapInArrow(_changes, schema), "runs")
    ends = F.struct(*[c.alias(f"k{i}") for i, c in enumerate((*at, F.col(f"`{key}`")))], told[0].alias("g"), told[1].alias("k"), F.col("run"))
    edges = parts.groupBy("__part").agg(F.min(ends).alias("a"), F.max(ends).alias("z")).collect()  # a row a range
    start, carried = {}, None  # carried: group, key and run of the last row before
    for row in sorted(edges, key=lambda r: r["__part"]):
        goes_on = carried is not None and carried[0] == row.a.g
        start[row["__part"]] = (carried[2] + (carried[1] != row.a.k)) if goes_on else 0
        whole = row.a.g == row.z.g  # one group fills the range
        carried = (row.z.g, row.z.k, row.z.run + (start[row["__part"]] if whole else 0))
    starts = F.lit([start.get(i, 0) for i in range(1 + max(start, default=0))]).cast("array<bigint>")
    return parts.withColumn("run", F.col("run") + F.when(F.col("__first"), F.get(starts, F.col("__part"))).otherwise(0)).drop("__part", "__first")


def samples(members: DataFrame, exts: list[str], by: list[str], order: str = "ord") -> DataFrame:
    """One row a sample with a column for each ext: its last payload."""
    return members.groupBy(*by).agg(*[F.max_by("payload", F.when(F.col("ext") == e, F.col(order))).alias(e) for e in exts])


def first_images(members: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """The first member of each sample that is an image; samples without one go."""
    return members.filter(F.col("ext").isin(*READ)).groupBy(*by).agg(F.min_by("payload", order).alias("payload"))


def class_index(members: DataFrame) -> DataFrame:
    """(name, shard, key) of every sample with a class: of several class members of a key the last one counts."""
    cls = members.filter(F.col("ext") == "cls").groupBy("shard", "key").agg(F.max_by("payload", "ord").alias("payload"))
    return cls.select(stripped(F.col("payload").cast("string")).alias("name"), "shard", "key")


class PagedIndex:
    """A class index in pages: of `pages` each has the entries of one class from page * PAGE on, in the order of shards and
    keys, at most PAGE of them; `directory` has each class's number (by name, from 0) and how many entries it has.

    Entries are numbered within class and shard, and shards by sums of their counts, so nothing is sorted as a whole and
    no row grows with a class. Pages are written by class, so that a draw reads those that are asked for.
    """

    #: Pages that are named in a plan one by one; more are joined.
    FEW = 256

    def __init__(self, index: DataFrame):
        rows = index.filter("name IS NOT NULL").select("name", "shard", "key")
        counts = materialize(rows.groupBy("name", "shard").agg(F.count("*").alias("c")), "class-shards")
        before = Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
        names = counts.groupBy("name").agg(F.sum("c").alias("n"))
        self.directory = materialize(names.withColumn("class_rank", F.row_number().over(Window.orderBy("name")) - 1), "classes")  # one row a class
        own = F.row_number().over(Window.partitionBy("name", "shard").orderBy("key")) - 1
        numbered = rows.withColumn("i", own).join(starts.hint("merge"), ["name", "shard"]).join(self.directory.select("name", "class_rank"), "name")
        entry = F.col("start") + F.col("i")
        placed = numbered.select("class_rank", "name", F.floor(entry / PAGE).alias("page"), F.struct(entry.alias("entry"), "shard", "key").alias("e"))
        pages = placed.groupBy("class_rank", "name", "page").agg(F.array_sort(F.collect_list("e")).alias("entries"))
        folder = shared_path(index.sparkSession, "pages")
        pages.repartitionByRange("class_rank", "page").sortWithinPartitions("class_rank", "page").write.partitionBy("class_rank").parquet(folder)
        schema = "name string, page bigint, entries array<struct<entry:bigint,shard:{0},key:{1}>>, class_rank int".format(*(dict(rows.dtypes)[c] for c in ("shard", "key")))
        self.pages = index.sparkSession.read.schema(schema).parquet(folder)

    def asked(self, draws: DataFrame) -> DataFrame:
        """The pages that hold the draws' entries (class_rank, entry)."""
        wanted = draws.select("class_rank", F.floor(F.col("entry") / PAGE).alias("page")).distinct()
        few = wanted.limit(self.FEW + 1).collect()
        if len(few) > self.FEW:
            return self.pages.join(wanted, ["class_rank", "page"], "left_semi")
        some = F.lit(False)
        for rank in sorted({r.class_rank for r in few}):
            some = some | ((F.col("class_rank") == rank) & F.col("page").isin([r.page for r in few if r.class_rank == rank]))
        return self.pages.filter(some)

    def drawn(self, draws: DataFrame) -> DataFrame:
        """`draws` with the name, shard and key of their entries; draws of no entry go."""
        entries = self.asked(draws).select("class_rank", "page", "name", "entries")
        paged = draws.withColumn("page", F.floor(F.col("entry") / PAGE))
        found = paged.join(entries, ["class_rank", "page"]).withColumn("e", F.get("entries", F.pmod(F.col("entry"), F.lit(PAGE)).cast("int")))
        return found.filter("e IS NOT NULL").select(*[F.col(f"`{c}`") for c in draws.columns], "name", "e.shard", "e.key")


def load_samples(index: DataFrame, members: DataFrame, roles: list[str]) -> DataFrame:
    """Index entries with their payloads by role: an error where a role is missing."""
    found = samples(members.join(index.select("shard", "key").distinct(), ["shard", "key"], "left_semi"), roles, ["shard", "key"])
    out = index.join(found, ["shard", "key"], "left")
    fail = F.raise_error(F.lit("a sample lacks a member"))
    return out.withColumns({r: F.coalesce(F.col(f"`{r}`"), fail.cast(dict(out.dtypes)[r])) for r in roles})
