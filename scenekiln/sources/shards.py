"""Tar shards and image folders as DataFrames.

Shards are read by the `tar_members` source: what an index needs is headers, and payloads are fetched as byte ranges for
the members that a plan has come to, spread by ranges of a shard. Folders of images are listed by the `folder_files`
source, sub-folders side by side, and decoded by Spark's image source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.functions import pixels
from scenekiln.functions.text import READ, is_image, stripped
from scenekiln.session import materialize, qualified, shared_path, united
from scenekiln.sources import png, tar
from scenekiln.sources.files import write_files
from scenekiln.sources.walk import WalkSource

MEMBERS = ("shard", "ord", "key", "ext", "payload")
PUSHED = "spark.sql.python.filterPushdown.enabled"


def _read(spark: SparkSession, folder: str, exts: list[str] | None, payload: bool) -> DataFrame:
    spark.dataSource.register(tar.MembersSource)
    options = {"payload": str(payload).lower(), "push": spark.conf.get(PUSHED, "false")}
    if exts is not None:
        options["exts"] = json.dumps(list(exts))
    return spark.read.format("tar_members").options(**options).load(qualified(spark, folder))


def read_members(spark: SparkSession, folder: str, exts: list[str] | None = None, payload: bool = True) -> DataFrame:
    """MEMBERS of every `*.tar` in `folder`, or of one shard: regular files whose name has a dot. Payloads are read only of
    the members that `exts` and, where the session pushes them, filters on shard, ext and key admit."""
    return _read(spark, folder, exts, payload).select(*MEMBERS)


def member_index(spark: SparkSession, folder: str, exts: list[str] | None = None) -> DataFrame:
    """shard, ord, key, ext, offset and size of members: where their payloads lie. Offsets are null in compressed shards."""
    return _read(spark, folder, exts, payload=False).drop("payload")


def with_payloads(rows: DataFrame, into: str = "payload") -> DataFrame:
    """Rows of an index, with other columns if they have any, and the payloads of their members in column `into`.

    Rows are dealt by shard and range of bytes, so that one shard that is asked for most is read by many tasks; each
    payload is one read of its range.
    """
    part = F.floor(F.col("offset") / F.lit(tar.RANGE_BYTES // 8))
    dealt = rows.repartition(F.col("shard"), part).sortWithinPartitions("shard", "offset", "ord")
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.BinaryType())])
    return dealt.mapInArrow(lambda batches: tar.fetched(batches, into), schema)


def members_of(shards: DataFrame, exts: list[str] | None = None, payload: bool = True) -> DataFrame:
    """MEMBERS of shard files (path), as they are listed at once or as a stream."""
    asked = tar.Asked(None if exts is None else frozenset(exts))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with tar.Ranged(path) as file:
                    yield from tar.batches(tar.members(file, path, asked, payload))

    return shards.select("path").mapInArrow(parse, tar.SCHEMA).select(*MEMBERS)


def load_samples(spark: SparkSession, folder: str, wanted: DataFrame, roles: list[str]) -> DataFrame:
    """`wanted` (shard, key and more) with a payload column for each role, `png` for an image of any kind: the sample's last
    member of it. Only headers and the payloads of wanted samples are read; a sample that lacks a role is an error."""
    exts = [e for r in roles for e in (READ if r == "png" else (r,))]
    role = F.when(F.col("ext").isin(*READ), "png").otherwise(F.col("ext")).alias("role")
    index = member_index(spark, folder, exts).join(wanted.select("shard", "key").distinct(), ["shard", "key"], "left_semi")
    last = index.groupBy("shard", "key", role).agg(F.max(F.struct("ord", "ext", "offset", "size")).alias("m")).select("shard", "key", "role", "m.*")
    found = as_png(materialize(last, "members")).groupBy("shard", "key").agg(*[F.first(F.when(F.col("role") == r, F.col("payload")), ignorenulls=True).alias(r) for r in roles])
    out = wanted.join(found, ["shard", "key"], "left")
    fail = F.raise_error(F.lit("a sample lacks a member")).cast("binary")
    return out.withColumns({r: F.coalesce(F.col(f"`{r}`"), fail) for r in roles})


def as_png(index: DataFrame) -> DataFrame:
    """Rows of an index with their payloads, images of any kind as PNG.

    JPEG members are decoded by Spark's image source, by way of files in the shared folder. One that does not decode is an
    error, and so is WebP, which nothing here decodes.
    """
    bad = lambda said: F.raise_error(F.lit(said)).cast("binary")
    jpeg = F.col("ext").isin("jpg", "jpeg")
    plain = with_payloads(index.filter(~jpeg))
    plain = plain.withColumn("payload", F.when(F.col("ext") == "webp", bad("WebP images are not decoded")).otherwise(F.col("payload")))
    some = index.filter(jpeg)
    if some.isEmpty():
        return plain
    file = F.concat(F.sha2(F.concat_ws("/", "shard", "ord"), 256), F.lit(".jpg"))
    decoded = decoded_files(with_payloads(some.select("shard", "ord", "offset", "size").distinct()).select(file.alias("file"), "payload"))
    out = some.withColumn("file", file).join(decoded, "file", "left").drop("file")
    return united(plain, out.withColumn("payload", F.coalesce("payload", bad("a JPEG image does not decode"))).select(*plain.columns))


def decoded_files(files: DataFrame) -> DataFrame:
    """Rows (file, payload) of image files of any kind that Spark's image source decodes, the payload as PNG; others go."""
    spark = files.sparkSession
    folder = shared_path(spark, "images")
    write_files(files.select("file", F.lit(None).cast("string").alias("name"), "payload"), folder, [])
    image = spark.read.format("image").load(folder).filter("image.height > 0")

    def recode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "payload": [png.encode_png(pixels.from_image(i)) for i in batch["image"]]})

    return image.select(F.substring_index("image.origin", "/", -1).alias("file"), "image").mapInPandas(recode, "file string, payload binary")


def walk_images(spark: SparkSession, root: str, decode: bool = False) -> DataFrame:
    """Every image file under `root`, those whose name begins with a dot as well: path and size and, with `decode`, Spark's
    image struct, which is null where a file does not decode, and the reason for that.

    Files are listed side by side by sub-folder. The image source passes over names that begin with a dot or underscore,
    or lie below such a folder; those are read as bytes and decoded under other names.
    """
    spark.dataSource.register(WalkSource)
    own = qualified(spark, root)
    files = spark.read.format("folder_files").load(own).filter(is_image(F.col("path")))
    if not decode:
        return files
    files = materialize(files, "walk")
    parts = F.split(relative(F.col("path"), own), "/")
    hidden = F.exists(parts, lambda p: F.substring(p, 1, 1).isin(".", "_"))
    read = spark.read.format("image").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(own)
    image = read.select(F.regexp_replace("image.origin", "^file:/+", "file:///").alias("path"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"))
    some = files.filter(hidden & F.col("reason").isNull())
    if not some.isEmpty():
        copies = some.select("path", F.concat(F.sha2("path", 256), F.lit("."), F.lower(F.substring_index("path", ".", -1))).alias("file"))
        folder = shared_path(spark, "hidden-images")
        write_files(with_contents(copies).select("file", F.lit(None).cast("string").alias("name"), F.col("content").alias("payload")), folder, [])
        again = spark.read.format("image").option("ignoreCorruptFiles", "true").load(folder).filter("image.height > 0")
        again = copies.join(again.select(F.substring_index("image.origin", "/", -1).alias("file"), "image"), "file")
        image = united(image.filter("image IS NOT NULL"), again.select("path", "image"))
    why = F.when(F.lower(F.col("path")).endswith(".webp"), "WebP images are not decoded").otherwise("it does not decode")
    out = files.join(image, "path", "left")
    return out.withColumn("reason", F.when(F.col("image").isNull(), F.coalesce("reason", why)))


def with_contents(files: DataFrame) -> DataFrame:
    """Rows with a path, and the bytes of the files in column content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("path")
            for i in range(len(batch)):
                with tar.Ranged(batch.column(at)[i].as_py()) as file:
                    yield batch.slice(i, 1).append_column("content", pa.array([file.readall()], pa.binary()))

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def relative(path: Column, root: str) -> Column:
    """The path below `root`, for the order of its parts and its class folder."""
    tail = root.rstrip("/").rpartition("://")[2].lstrip("/")
    return F.substring(path, F.instr(path, tail) + len(tail) + 1, F.length(path))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a text file: stripped, without blanks."""
    return distinct_names(spark.read.text(path), F.col("value"))


def distinct_names(lines: DataFrame, line: Column) -> DataFrame:
    """Lines as a list of names: stripped, without blanks, distinct."""
    return lines.select(stripped(line).alias("name")).filter("name != ''").distinct()


