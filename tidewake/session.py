"""A session with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings override any of it (dots as double underscores)."""
    builder = SparkSession.builder.appName("tidewake")
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of applications without a shared one, as in tests.
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's folder for tables between two steps: in the shared folder of the cluster; without one a temporary folder in local mode, otherwise the warehouse."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = _own[app] = f"file://{tempfile.mkdtemp(prefix='tidewake-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/tidewake-steps-{app}"


def staged(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """df, computed once: written to the shared folder and read again, so that a lost executor repeats nothing before it."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, as a file that Spark itself hands to them; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidewake-")) / "tidewake.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
