"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN_DIR = "alertmill.scratch.dir"


def build_session(app: str = "alertmill", master: str = "local[*]", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted configuration is used instead."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.appName(app).master(master)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master without that setting gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="alertmill-")
    spark.conf.set(_OWN_DIR, own)
    return own


_TABLES: list[str] = []


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write df as parquet into the shared folder and read it back.

    A written table survives lost executors, is column-pruned by later readers and gives AQE real sizes. All tables of an
    application lie in one folder named by its id, so those of a killed driver can be told and deleted. They are removed
    by drop_tables or when the driver ends.
    """
    spark = df.sparkSession
    if not _TABLES:
        atexit.register(drop_tables, spark)
    path = f"{scratch_dir(spark)}/alertmill-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_as(written: DataFrame, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table that materialize wrote, read with another schema of the same layout."""
    return spark.read.schema(schema).parquet(*written.inputFiles()) if written.inputFiles() else spark.createDataFrame([], schema)


def drop_tables(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables written so far (from the since-th on): to be called once a query's result has been used."""
    while len(_TABLES) > since:
        _remove(spark, _TABLES.pop())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, so a session that runs many queries keeps no more than one's."""
    at = len(_TABLES)
    try:
        yield
    finally:
        drop_tables(spark, at)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its input has fewer partitions than there are cores; otherwise as it is.

    For costly work per row behind a small or unsplittable file. Large inputs have partitions enough and are not moved.
    Meant for scans and projections of them, whose partitions are known from the plan alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bind(f, *args):  # noqa: ANN001, ANN002, ANN201
    """f with its first arguments fixed, as a plain function: applyInPandas looks at signatures, which a partial lacks."""

    def run(pdf):  # noqa: ANN001, ANN202
        return f(*args, pdf)

    return run


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
        pass
