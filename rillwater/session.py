"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "rillwater", cpus: int | str = "*", partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """Session for one machine (tests, bench); on a cluster use the cluster's own."""
    partitions = partitions or (os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _plain(path: str) -> str:
    return re.sub("/+", "/", path.removeprefix("file:") + "/")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    A folder given to this context by ``setCheckpointDir`` counts before the one in
    the settings, from which Spark starts. Only where nothing is configured (tests, a
    laptop) a fresh local folder is made and kept for the rest of the session.
    """
    named, given = spark.conf.get(CHECKPOINT_KEY, None), spark.sparkContext.getCheckpointDir()
    if given and not (named and _plain(given).startswith(_plain(named))):
        return given
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rillwater-")
    spark.sparkContext.setCheckpointDir(made)
    return made
