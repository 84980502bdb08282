"""Where a job keeps the files it writes for itself."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the cluster's shared folder.

    The folder is the one in ``spark.checkpoint.dir``. Without that setting a session on one
    machine gets a temporary folder, and a cluster session is refused, since its executors
    could not see a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="annalist-"))
        base = _local_base[0]
    return f"{base.rstrip('/')}/annalist/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path; nothing below it is listed."""
    system, place = _place(spark, path)
    return system.exists(place)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    system, place = _place(spark, path)
    return system.getContentSummary(place).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has made for itself."""
    system, place = _place(spark, path)
    system.delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
