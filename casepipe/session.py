"""Session helpers.

Library functions never create a session; they take DataFrames (or a session
when they have to read).  These helpers exist for tests, the bench and the
driver entry point.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "casepipe") -> SparkSession:
    """A local session tuned for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is; a
    folder that the application has given to ``setCheckpointDir`` is kept.
    Only a local master without either gets a fresh scratch folder (tests);
    elsewhere a missing setting is an error, since executors would write to
    their own disks.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if getattr(sc, "_casepipe_checkpoints", None) != conf_dir:
            sc.setCheckpointDir(conf_dir)
            sc._casepipe_checkpoints = conf_dir
        return conf_dir
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    conf_dir = tempfile.mkdtemp(prefix="casepipe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    sc._casepipe_checkpoints = conf_dir
    return conf_dir


def ship(spark: SparkSession) -> None:
    """Make ``casepipe`` importable in the Python workers (as ``--py-files``
    would): zip the package once per SparkContext and ``addPyFile`` it."""
    sc = spark.sparkContext
    if getattr(sc, "_casepipe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = tempfile.mkdtemp(prefix="casepipe-pkg-")
    sc.addPyFile(shutil.make_archive(os.path.join(base, "casepipe"), "zip", root_dir=root, base_dir="casepipe"))
    sc._casepipe_shipped = True


def checkpoint(df):
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (resolved
    from the session first, so it works in any session)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Session setting of Spark 4.1: an execution's shuffle files go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for results that are stored,
    so that no later step reads the shuffles again."""
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if was is None else spark.conf.set(DROP_SHUFFLES, was)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
