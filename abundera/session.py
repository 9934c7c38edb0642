"""Session helpers: builder defaults and the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def build_session(app: str = "abundera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is absent, the checkpoint folder the context was given
    stands in; where there is none either, a temporary folder of this machine,
    once per application, but only in local mode, where all tasks run here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = "file://" + tempfile.mkdtemp(prefix="abundera-")
    return _LOCAL_SHARED[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    path = f"{shared_dir(spark)}/abundera-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables this application has written; results read from them must have been used by then."""
    jvm, n = spark.sparkContext._jvm, 0
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
    return n


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable ``checkpoint``: later stages survive the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back as a columnar table."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """All rows on the driver, or an error if there are more than ``limit``; never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def pandas_bounded(df: DataFrame, limit: int, what: str):
    """The same as a pandas frame."""
    pdf = df.limit(limit + 1).toPandas()
    if len(pdf) > limit:
        raise ValueError(f"more than {limit} {what}")
    return pdf
