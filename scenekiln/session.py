"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Unions of joined branches under a window gave wrong rows with output partitioning carried through UNION ALL.
UNION = ("spark.sql.unionOutputPartitioning", "false")
#: Settings that every plan of this package counts on; none of them depends on the size of the data.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    UNION[0]: UNION[1],
}


#: Temporary folders of local applications whose setting is unset: it cannot be changed while a session runs.
_FOLDERS: dict[str, str] = {}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName("scenekiln")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process of this machine."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def united(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, by position, right in any session: see UNION."""
    frames[0].sparkSession.conf.set(*UNION)
    return reduce(DataFrame.union, frames)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where that is unset (tests, a laptop) a temporary folder of this machine is made; on a cluster, where each
    executor would write to its own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="scenekiln-")
        return _FOLDERS[app]
    return folder


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark would take for it, as readers and writers outside the JVM need one."""
    if "://" in folder:
        return folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and "://" not in whole else whole


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, with its scheme."""
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and later readers prune its columns. The files are
    left to the cluster's cleaning of the checkpoint folder, as later jobs may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
