"""Session construction and the two storage helpers every plan shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; `conf` overrides any key (dots as `__`)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from `spark.checkpoint.dir`. Only where that is unset and the
    master is local (tests, notebooks) a temporary folder is made and used.
    """
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[str] = []  # paths only: modules are sent to Python workers by value


def release() -> None:
    """Deletes all tables that `materialize` has written so far; for drivers that live long, once their results are stored."""
    sc = SparkContext._active_spark_context
    while _written and sc is not None:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be ending
            pass


atexit.register(release)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage.

    The copy is a compressed columnar table, so later reads prune columns, and
    it survives the loss of any executor. Written tables are deleted by `release`
    or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder) of a data folder."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))
