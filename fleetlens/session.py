"""Session settings of tests and benchmark, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "fleetlens") -> SparkSession:
    """One machine for everything, so its own folders will do; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        # HotSpot does not compile methods over 8000 bytes; plan such stages without fusion
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", _own_folder("warehouse"))
        .config("spark.checkpoint.dir", _own_folder("shared"))
        .getOrCreate()
    )


def _own_folder(name: str) -> str:
    """A temporary folder that goes with this process."""
    folder = tempfile.mkdtemp(prefix=f"fleetlens-{name}-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a temporary one, for its only machine.  On
    a cluster there is no folder to fall back to, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        given = _own_folder("shared")
        spark.conf.set("spark.checkpoint.dir", given)
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`remove_scratch` deletes what was put there."""
    path = f"{shared_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch paths handed out; frames that read them are void afterwards."""
    jvm = spark.sparkContext._jvm
    for path in _scratch:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch.clear()


_scratch: list[str] = []
