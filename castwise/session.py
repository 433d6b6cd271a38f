"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def local_session(name: str, cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; on a cluster use the one given by spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_fallback: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the package to the Python workers once per application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="castwise-")  # on the driver alone; Spark hands the file out
    path = os.path.join(folder, f"{package.name}-{app}.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the session names one.

    Only where it is unset and the master is local, a fresh local folder is made and remembered;
    on several machines each would write to its own disk, so there the setting is required.
    """
    ship_package(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback[app]


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table survives the loss of executors, and its rows (with any
    partition ids stored in them) never change on recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 10_000


def lookup_table(df: DataFrame, name: str = "lookup") -> DataFrame:
    """``df`` written once and, if it has at most ``SMALL_ROWS`` rows, marked for broadcast.

    Fact rows then meet it where they are, without a shuffle on a key of few values. A larger
    table is left to Spark's choice by size, with skewed partitions split at run time.
    """
    kept = written(df, name)
    return F.broadcast(kept) if kept.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else kept
