"""Session settings the library expects, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
MERGED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INPUT_PER_PARTITION = 2 * 2**20


def local_session(cores: str = "*", app: str = "snapops", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All clock values are epoch milliseconds or UTC text, so the session must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_fitted: dict[str, dict[str, str]] = {}


def fit_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """As many shuffle partitions as the input needs, so that the rows of a task stay in memory at any size.

    Of the given tables a partition gets ``INPUT_PER_PARTITION`` bytes: their lines grow to
    about a hundred times that as manifest entries in memory. Spark still merges partitions
    that turn out small, up to 8 MB, since such rows shrink to a tenth when they are shuffled.
    A setting of the session's own is left alone; for small inputs nothing is set.
    """
    ours = _fitted.setdefault(spark.sparkContext.applicationId, {})
    for name in [name for name, value in ours.items() if spark.conf.get(name, None) != value]:
        del ours[name]
    needed = -(-input_bytes // INPUT_PER_PARTITION)
    large = needed > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in ((FIRST_PARTITIONS, str(needed)), (MERGED_BYTES, "8m")):
        if name not in ours and spark.conf.get(name, None) is not None:
            continue
        if large:
            spark.conf.set(name, value)
            ours[name] = value
        elif ours.pop(name, None):
            spark.conf.unset(name)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. A local session, whose
    executors are this process, may go without; any other session must set it.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read back, so that plans on them know their size."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="snapops-")
