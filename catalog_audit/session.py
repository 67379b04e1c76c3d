"""Session settings and durable stage tables.

Nothing here assumes a driver-local disk: a stage that several later stages read is
written once as Parquet under ``spark.checkpoint.dir`` and read back, so a lost
executor costs a re-read and the optimizer knows the stage's true size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # many-to-one lookups on a hot key: let AQE split the hot partition even when
    # that costs one more exchange afterwards
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (all are session-scoped)."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables and stream checkpoints.

    ``spark.checkpoint.dir`` names it. A local session without the setting gets a
    temporary folder; a cluster session without it is an error, because a folder on
    one machine is invisible to the others.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        known = sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        known = tempfile.mkdtemp(prefix="catalog-audit-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


_written: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark)}/catalog_audit/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def release_stages(spark: SparkSession) -> int:
    """Delete the stage tables this process wrote; frames read from them become invalid."""
    conf, done = spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` that also reports aggregates observed while writing (no second pass)."""
    seen = Observation()
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counts.items()]), name)
    return stored, {k: v or 0 for k, v in seen.get.items()}
