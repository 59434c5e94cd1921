"""Session helpers: settings the operators rely on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docketry")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    ship_code(session)
    return session


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where the package is installed on every node, or was given to
    ``spark-submit`` with ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docketry-code-")) / "docketry.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


# Bytes that a Python worker gets at once; texts may be long.
ARROW_BYTES = 16 << 20


def bound_arrow_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Keep Arrow batches of this session below ``most`` bytes; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(most)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only in local mode without one.

    On a cluster a folder of the driver's machine would be lost to the executors,
    so there a session without ``spark.checkpoint.dir`` is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docketry-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` in the checkpoint folder so that lost executors do not redo it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
