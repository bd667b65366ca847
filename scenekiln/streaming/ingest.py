"""Shards as a stream: an extension for folders that go on growing while a set is built.

A new shard is read once, when it is listed; the class index is appended to and class counts are kept as state. A shard
file is complete when it appears, as writers move it into place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenekiln.functions.text import stripped
from scenekiln.sources.shards import members_of

_FILES = "path string, modificationTime timestamp, length long, content binary"  # contents are not asked for, and so not read


def stream_members(spark: SparkSession, folder: str, exts: list[str] | None = None, payload: bool = True, files_at_once: int = 64) -> DataFrame:
    """Members of shards as they arrive in `folder`."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.tar").option("maxFilesPerTrigger", files_at_once).load(folder)
    return members_of(files, exts, payload)


def stream_class_counts(members: DataFrame) -> DataFrame:
    """Samples by class so far. State is one row a class."""
    cls = members.filter("ext = 'cls'")
    return cls.groupBy(stripped(F.col("payload").cast("string")).alias("name")).agg(F.count("*").alias("n"))


def append_index(members: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append (name, shard, key) of new shards as Parquet, each exactly once, and stop when all there is has been read."""
    cls = members.filter("ext = 'cls'").select(stripped(F.col("payload").cast("string")).alias("name"), "shard", "key")
    return cls.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
