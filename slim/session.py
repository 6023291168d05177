"""Session settings the package relies on.

Memory and checkpoint folders belong to the cluster and are left as the session
has them. Shuffle partitions follow the data: they are cut fine and put together
up to PARTITION, so a task's rows do not grow with the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps are compared as UTC wall-clock values.
    "spark.sql.session.timeZone": "UTC",
    # A repeated object key keeps its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows that were spread by document id stay where they are for joins and
    # windows keyed by (document id, anything else): one exchange per document.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A document's leaves take some 70 times the memory of its compressed text, so a
# task that gets this much of it sorts its leaves without spilling. Partitions
# are cut as finely as Spark still keeps their exact sizes.
PARTITION = "4m"
FINEST = 2000

# To be set when the session is built: long expressions are made of many small
# columns, and recording the call site of each takes longer than planning.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the same session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # A session that cuts finer keeps its own; coarser parts would spill.
    built = spark.sparkContext.getConf().get
    finest, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(finest, str(max(FINEST, int(spark.conf.get("spark.sql.shuffle.partitions")), int(built(finest, "0")))))
    spark.conf.set(size, min(built(size, PARTITION), PARTITION, key=size_in_bytes))
    return spark


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings give it: 4m, 64MB, or bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", text.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the one that spark.checkpoint.dir names, which
    driver and executors share. Without one, a cluster is refused; only a local
    session falls back to a temporary folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="slim-")
    return f"{base.rstrip('/')}/slim/{name}-{uuid.uuid4().hex}"
