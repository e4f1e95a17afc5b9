"""Work tables in the folder that the driver and all executors share: they cut lineage, and a lost executor costs a reread."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _OWN.get(sc.applicationId) or _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="saltmarsh-"))
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/saltmarsh/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go once the query that wrote them has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts the lineage: df written as Parquet to the shared folder and read again with the same schema; its shuffle files are deleted."""
    path = scratch(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once all that reads them has itself been written."""
    for t in tables:
        drop_scratch(t.sparkSession, t.scratch_path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system, whatever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
